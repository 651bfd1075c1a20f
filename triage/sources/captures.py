"""HAR captures and raw HTTP text as exchange rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.functions.tags import let
from triage.functions.text import strip
from triage.schemas import JSON_LIMITS, PAIRS
from triage.sources import har_blocks

_COOKIES = "array<struct<name:string,value:string,path:string,secure:boolean,httpOnly:boolean,sameSite:string>>"


def read_har(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """One row per ``log.entries`` item of every capture below ``path``; a capture of any size is read by as many tasks as it has splits.

    Unless lenient, one bad entry rejects its file.  The files are read once for the rows and once to judge them: land the rows as
    Parquet before heavy use.
    """
    items, frames = har_blocks.read_items(spark, path)
    entries = items.select("source_file", "entry_idx", _entry(F.col("item")).alias("x"))
    if lenient:
        return _exchanges(entries.filter("x.is_object"))
    bad = _rejects(entries, frames).select("source_file")
    return _exchanges(entries).join(bad, "source_file", "left_anti")


def read_har_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, reason) of the captures a strict read leaves out.  Spark passes over files without a byte."""
    items, frames = har_blocks.read_items(spark, path)
    return _rejects(items.select("source_file", "entry_idx", _entry(F.col("item")).alias("x")), frames)


def _rejects(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """The first that holds: no text, broken JSON anywhere, a wrong frame, the first entry that is wrong."""
    broken = F.col("x.fault") == INVALID
    faults = entries.where("x.fault is not null").groupBy("source_file").agg(
        F.max(broken).alias("broken"), F.min(F.struct("entry_idx", "x.fault")).alias("first"))
    reason = (F.when(F.col("reason").isin("HAR file is empty", INVALID), F.col("reason")).when(F.col("broken"), F.lit(INVALID))
              .otherwise(F.coalesce("reason", "first.fault")))
    return frames.join(faults, "source_file", "left").select("source_file", reason.alias("reason")).where("reason is not null")


_ENTRY = (
    f"request struct<method:string,url:string,headers:{PAIRS},queryString:{PAIRS},cookies:{PAIRS},"
    f"postData:struct<text:string,params:{PAIRS}>>, "
    f"response struct<status:string,headers:{PAIRS},cookies:{_COOKIES},content:struct<mimeType:string,text:string>>"
)


INVALID = "Invalid JSON in HAR file"


def _is_broken(text: Column) -> Column:
    """Whether a text is no JSON, of whatever length its strings are."""
    held = F.concat(F.lit('{"v":'), text, F.lit("}"))
    return F.from_json(held, "v string, _broken string", {**JSON_LIMITS, "columnNameOfCorruptRecord": "_broken"})["_broken"].isNotNull()


def _entry(e: Column) -> Column:
    """A parsed entry with its fault, if any."""
    return let(F.from_json(e, _ENTRY, JSON_LIMITS), lambda x: F.struct(
        x.alias("e"), e.startswith("{").alias("is_object"),
        F.when(x["request"].isNull() & x["response"].isNull() & _is_broken(e), F.lit(INVALID))
        .when(~e.startswith("{"), F.lit("Every HAR log.entries item must be an object"))
        .when(x["request"].isNull() | x["response"].isNull(),
              F.lit("Every HAR entry must contain request and response objects"))
        .when(x["response"]["status"].isNotNull() & x["response"]["status"].try_cast("double").isNull(),
              F.lit("HAR response status must be an integer")).alias("fault")))


def _parsed(captures: DataFrame) -> DataFrame:
    """Parsed entries of each capture and the reason to reject it, from one look at the text.

    Everything is bound inside one expression: a capture text may be long, or itself
    be computed, and must not be evaluated once per test.
    """
    def judge(text, raw, entries):
        fault = F.array_compact(F.transform(entries, lambda x: x["fault"]))
        reason = (F.when(strip(text) == "", F.lit("HAR file is empty"))
                  # only what gave no entries is parsed again, to tell broken text from a missing list
                  .when(raw.isNull() & _is_broken(text), F.lit(INVALID))
                  .when(~text.rlike(r"^\s*+\{"), F.lit("HAR root must be a JSON object"))
                  .when(raw.isNull(), F.lit("HAR must contain a log.entries list"))
                  .otherwise(F.try_element_at(fault, F.lit(1))))
        return F.struct(entries.alias("entries"), reason.alias("reason"))

    def parse(text):
        log = F.from_json(text, "log struct<entries array<string>>", JSON_LIMITS)
        return let(log.getField("log").getField("entries"), lambda raw: let(
            F.transform(raw, _entry), lambda entries: judge(text, raw, entries)))

    return captures.select("source_file", let(F.col("text"), parse).alias("c"))


def har_rejects(captures: DataFrame) -> DataFrame:
    """(source_file, reason) of the captures a strict read leaves out."""
    return _parsed(captures).select("source_file", F.explode(F.array_compact(F.array("c.reason"))).alias("reason"))


def exchanges_from_har(captures: DataFrame, lenient: bool = False) -> DataFrame:
    """Exchange rows from capture texts; one bad entry rejects its file unless lenient."""
    kept = F.col("c.entries") if lenient else F.when(F.col("c.reason").isNull(), F.col("c.entries"))
    rows = _parsed(captures).select("source_file", F.posexplode(kept).alias("entry_idx", "x"))
    return _exchanges(rows.filter("x.is_object") if lenient else rows)


def _exchanges(entries: DataFrame) -> DataFrame:
    """Parsed entries (source_file, entry_idx, x) as exchange rows."""
    rows = entries.select("source_file", "entry_idx", F.col("x.e.request").alias("q"), F.col("x.e.response").alias("p"))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def items(name: str, kind: str = PAIRS) -> Column:
        return F.coalesce(F.col(name), F.array().cast(kind))

    return rows.select(
        "source_file", F.col("entry_idx").cast("bigint"), F.upper(text("q.method")).alias("method"),
        text("q.url").alias("url"), F.coalesce(F.col("p.status").try_cast("double").try_cast("int"), F.lit(0)).alias("status"),
        items("q.headers").alias("request_headers"), items("p.headers").alias("response_headers"),
        items("q.queryString").alias("query_string"), items("q.cookies").alias("request_cookies"),
        items("p.cookies", _COOKIES).alias("response_cookies"), text("q.postData.text").alias("request_body"),
        items("q.postData.params").alias("form_params"), text("p.content.mimeType").alias("mime_type"),
        text("p.content.text").alias("response_body"))


def har_text(exchanges: DataFrame) -> DataFrame:
    """The reverse: one capture text per exchange, for landing and round-trip checks."""
    c = F.col
    entry = F.struct(
        F.struct(c("method"), c("url"), c("request_headers").alias("headers"),
                 c("query_string").alias("queryString"), c("request_cookies").alias("cookies"),
                 F.struct(c("request_body").alias("text"), c("form_params").alias("params")).alias("postData"),
                 ).alias("request"),
        F.struct(c("status"), c("response_headers").alias("headers"), c("response_cookies").alias("cookies"),
                 F.struct(c("mime_type").alias("mimeType"), c("response_body").alias("text")).alias("content"),
                 ).alias("response"))
    log = F.struct(F.struct(F.lit("1.2").alias("version"), F.array(entry).alias("entries")).alias("log"))
    return exchanges.select(F.concat_ws("#", "source_file", "entry_idx").alias("source_file"),
                            F.to_json(log).alias("text"))


def raw_http_exchanges(artifacts: DataFrame) -> DataFrame:
    """Raw HTTP text as exchange rows: the first line decides the side, ``k: v`` lines are headers."""
    split = artifacts.select("source_file", F.split("text", "\r\n|[\n\r]").alias("ls"))
    named = F.filter(F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))), lambda x: x.contains(":"))
    headers = F.transform(named, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("name"),
        F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("value")))
    none = F.array().cast(PAIRS)
    rows = split.select("source_file", F.col("ls")[0].startswith("HTTP/").alias("is_response"),
                        headers.alias("h")).filter(F.size("h") > 0)
    return rows.select(
        "source_file", F.lit(0).cast("bigint").alias("entry_idx"), F.lit("UNKNOWN").alias("method"),
        F.lit("").alias("url"), F.lit(None).cast("int").alias("status"),
        F.when(F.col("is_response"), none).otherwise(F.col("h")).alias("request_headers"),
        F.when(F.col("is_response"), F.col("h")).otherwise(none).alias("response_headers"),
        none.alias("query_string"), none.alias("request_cookies"),
        F.array().cast(_COOKIES).alias("response_cookies"), F.lit("").alias("request_body"),
        none.alias("form_params"), F.lit("").alias("mime_type"), F.lit("").alias("response_body"))


__all__ = ["read_har", "read_har_rejects", "har_rejects", "exchanges_from_har", "har_text", "raw_http_exchanges"]
