"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of every two neighbouring lines that aren't blank chooses where chunks begin: of any two windows that follow
each other the smaller one is a boundary.  That depends on the lines nearby alone, so a shared passage has the same boundaries inside
whatever stands around it.  The two lines at a boundary are a chunk; so are two lines of over ``words`` words that no boundary begins, and
a line of over ``words`` words.  Chunk hashes are counted over the whole table with partial aggregation.  What repeats is extended by the
line beside it that no chunk covers: the window there becomes a chunk too, and all are counted again.  Only for hashes that repeat are the
bytes compared with those of the first occurrence.  So every repeated passage of over ``words`` words, and every one of three lines, goes as
a whole; of shorter ones of two lines those go whose window is a boundary in both places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.common import discard, land

WORDS = 50
#: Two lines of fewer bytes are no chunk: brackets, rules and single words are structure.
LEAST = 24
#: Hashes that more than this share of the chunks have are joined by broadcast: fewer than its inverse.
HOT = 1 / 1024
#: Later occurrences of one chunk that are compared with a copy of the first one.
PER_COPY = 1000

_BLANK = " \t\r\x0b\x0c"


def chunks(lines: Column, words: int, least: int) -> Column:
    """start, stop (exclusive), h and n (hash and bytes) of the chunks of a line array, and the same of the windows before and behind
    (before, behind) where those are no chunks, else null."""
    filled = F.filter(F.transform(lines, lambda x, i: F.struct(
        i.alias("i"), F.xxhash64(x).alias("h"), F.octet_length(x).alias("n"),
        (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w"), (F.btrim(x, F.lit(_BLANK)) == "").alias("blank"))),
        lambda x: ~x["blank"])

    def window(x: Column, i: Column, all_: Column) -> Column:
        y = F.get(all_, i + 1)
        n = x["n"] + y["n"]
        # of lines too short for a chunk no hash counts; the gap tells pairs with blank lines between them apart
        return F.when(y.isNotNull() & (n >= least), F.struct(
            x["i"].alias("start"), (y["i"] + 1).alias("stop"), F.xxhash64(x["h"], y["h"], y["i"] - x["i"]).alias("h"), n.alias("n"),
            (x["w"] + y["w"] > words).alias("long")))

    def chosen(x: Column, i: Column, all_: Column) -> Column:
        before, behind = F.when(i > 0, F.get(all_, F.greatest(i - 1, F.lit(0)))), F.get(all_, i + 1)
        smaller = lambda y: y.isNotNull() & (x["h"] <= y["h"])
        alone = before.isNull() & behind.isNull()
        return F.when(x.isNotNull(), F.struct(
            *_window(x), (x["long"] | alone | smaller(before) | smaller(behind)).alias("is")))

    def reach(x: Column, i: Column, all_: Column) -> Column:
        before, behind = F.when(i > 0, F.get(all_, F.greatest(i - 1, F.lit(0)))), F.get(all_, i + 1)
        return F.struct(*_window(x), x["is"].alias("is"), F.when(~before["is"], F.struct(*_window(before))).alias("before"),
                        F.when(~behind["is"], F.struct(*_window(behind))).alias("behind"))

    one = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  use(value), the value computed once
    pairs = one(filled, lambda a: one(F.transform(a, lambda x, i: window(x, i, a)), lambda b: one(
        F.transform(b, lambda x, i: chosen(x, i, b)), lambda c: F.transform(c, lambda x, i: reach(x, i, c)))))
    pairs = F.transform(F.filter(pairs, lambda x: x["is"]), lambda x: F.struct(*_window(x), x["before"].alias("before"), x["behind"].alias("behind")))
    none = F.lit(None).cast("struct<start:int,stop:int,h:bigint,n:int>")
    single = F.transform(F.filter(filled, lambda x: x["w"] > words), lambda x: F.struct(
        x["i"].alias("start"), (x["i"] + 1).alias("stop"), F.xxhash64(x["h"]).alias("h"), x["n"].alias("n"), none.alias("before"), none.alias("behind")))
    return F.concat(pairs, single)


def _window(x: Column) -> list[Column]:
    return [x[c].alias(c) for c in ("start", "stop", "h", "n")]


def _body(lines: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, stop - start), "\n")


def _met(places: DataFrame, repeated: DataFrame, limit: float) -> DataFrame:
    """The places whose h and n are among the repeated ones, with the columns of those; hot ones, boundedly many, are joined by broadcast."""
    hot, rare = repeated.where(F.col("times") > limit), repeated.where(F.col("times") <= limit)
    others = places.join(F.broadcast(hot.select("h", "n")), ["h", "n"], "left_anti")
    return places.join(F.broadcast(hot), ["h", "n"]).unionByName(others.join(rare, ["h", "n"]))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """Every row of ``docs`` with its columns, the text without the lines removed, and n_lines, n_removed_lines (long).

    A line goes, with its line feed, if it lies in a chunk that an earlier place, by id and line, has byte by byte;
    within a document too, where a repeat begins after the end of the first occurrence.  Words are counted by blanks.  Blank lines go only
    between the lines of a chunk.  Null texts stay null and empty ones empty, both with n_removed_lines 0 (n_lines 0 for null, 1 for empty).
    Rows that share id and text are one document and are cut alike; those that share an id but have different texts are documents of their
    own.  Rows whose id is null are never cut and never count.  An empty table gives an empty one.  Columns already named n_lines or
    n_removed_lines are replaced.  Texts of any length are handled in time linear in their lines.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    key, digest = ["__id", "__digest"], F.xxhash64(F.col(text)).alias("__digest")
    lined = docs.select(F.col(doc_id).alias("__id"), digest, F.split(F.col(text), "\n", -1).alias("__lines")).where("__id is not null and __lines is not null")
    # one row per chunk, without its text
    places = land(lined.select(*key, F.inline(chunks(F.col("__lines"), words, least))), "line-chunks")
    limit = HOT * places.count()
    counted = land(places.groupBy("h", "n").agg(F.count("*").alias("times")).where("times > 1"), "line-repeats")
    open_ = places.where("before is not null or behind is not null").select(*key, "h", "n", F.array_compact(F.array("before", "behind")).alias("near"))
    beside = land(_met(open_, counted, limit).select(*key, F.explode("near").alias("w")).select(*key, "w.*").distinct(), "line-extensions")
    found, places = places, places.drop("before", "behind").unionByName(beside)
    first = F.min(F.struct(*key, "start", "stop")).alias("first")
    repeated = land(places.groupBy("h", "n").agg(F.count("*").alias("times"), first).where("times > 1"), "line-repeats")
    met = _met(places, repeated, limit)
    is_first = F.struct(*key, "start") == F.struct("first.__id", "first.__digest", "first.start")
    apart = (F.struct(*key) != F.struct("first.__id", "first.__digest")) | (F.col("start") >= F.col("first.stop"))
    marked = met.where(is_first | apart).select(*key, F.struct(
        "start", "stop", "h", is_first.alias("is_first"), F.floor(F.col("times") / PER_COPY + 1).cast("int").alias("copies")).alias("mark"))
    marked = land(marked.distinct().groupBy(*key).agg(F.collect_list("mark").alias("marks")), "line-marks")
    discard(found, counted, beside, repeated)

    # bytes of the marked chunks only
    body = docs.select(F.col(doc_id).alias("__id"), digest, F.col(text).alias("__text")).join(marked.hint("merge"), key).select(
        *key, F.split("__text", "\n", -1).alias("__lines"), "marks")
    body = body.select(*key, F.inline(F.transform("marks", lambda m: F.struct(
        *[m[c].alias(c) for c in ("start", "stop", "h", "is_first", "copies")], _body(F.col("__lines"), m["start"], m["stop"]).alias("body")))))
    # the first occurrence of a chunk of many is copied, and each later one meets one of the copies
    first = body.where("is_first").select("h", "body", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    later = body.where("not is_first").withColumn("salt", F.pmod(F.xxhash64(*key, "start"), "copies").cast("int"))
    later = later.join(first, ["h", "salt", "body"], "left_semi")
    # landed, so that the texts and bodies shuffled for it are gone from the disk when the texts are shuffled for the result
    gone = land(later.groupBy(*key).agg(F.collect_set(F.struct("start", "stop")).alias("__gone")), "line-gone")
    discard(marked)

    # what is marked and what goes grows with the corpus, so neither is broadcast
    out = docs.withColumns({"__id": F.col(doc_id), "__digest": digest}).join(gone.hint("merge"), key, "left").drop(*key)
    lines = F.split(F.col(text), "\n", -1)
    cut = F.flatten(F.transform("__gone", lambda g: F.sequence(g["start"], g["stop"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)  # by a hash set, in order
    kept = F.transform(stay, lambda i: F.get(lines, i))
    return (out.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
            .withColumn("n_removed_lines", F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(stay)).cast("long"))
            .withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__gone"))
