"""Projections and counts over exchange rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions.tags import let
from triage.functions.text import CATEGORIES, category_mask, redact
from triage.functions.jsonwalk import body_leaves
from triage.functions.urls import query, query_pairs


def header(headers: Column, name: str) -> Column:
    """Value of a header by name, any case; the last duplicate wins; NULL if absent."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(F.trim(h["name"])) == name), F.lit(-1))["value"]


def header_or_empty(headers: Column, name: str) -> Column:
    return F.coalesce(header(headers, name), F.lit(""))


def unique_headers(headers: Column) -> Column:
    """``array<struct<name,value>>``: lower-case names, of duplicates the last."""
    named = F.filter(F.transform(headers, lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"),
                                                             h["value"].alias("value"))), lambda h: h["name"] != "")
    return let(named, lambda hs: F.filter(hs, lambda h, i: ~F.exists(
        F.slice(hs, i + 2, F.size(hs)), lambda later: later["name"] == h["name"])))


def header_map(headers: Column) -> Column:
    """Lower-case name to value, without relying on the session's map-key policy."""
    return F.map_from_entries(unique_headers(headers))


def flatten_exchange(exchanges: DataFrame) -> DataFrame:
    """Method, URL, status, MIME type and header maps of each exchange."""
    return exchanges.select(
        "source_file", "entry_idx", F.upper("method").alias("method"), "url", "status",
        header_map(F.col("request_headers")).alias("request_headers"),
        header_map(F.col("response_headers")).alias("response_headers"), "mime_type")


def summarize(exchanges: DataFrame) -> DataFrame:
    """Exchanges per method, status and MIME type in one pass: (dimension, value, entries)."""
    dims = F.array(
        F.struct(F.lit("method").alias("dimension"), F.col("method").alias("value")),
        F.struct(F.lit("status").alias("dimension"), F.col("status").cast("string").alias("value")),
        F.struct(F.lit("mime_type").alias("dimension"),
                 F.when(F.col("mime_type") == "", "unknown").otherwise(F.col("mime_type")).alias("value")))
    return exchanges.select(F.inline(dims)).groupBy("dimension", "value").agg(F.count("*").alias("entries"))


def named_values(exchanges: DataFrame) -> DataFrame:
    """Every named value of an exchange with its location: (location, source_url, name, value)."""
    c = F.col

    def at(location: str, pairs: Column) -> Column:
        return F.transform(pairs, lambda p: F.struct(
            F.lit(location).alias("location"), F.coalesce(p["name"], F.lit("")).alias("name"),
            F.coalesce(p["value"], F.lit("")).alias("value")))

    def one(location: str, name: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(location).alias("location"), F.lit(name).alias("name"),
                                F.coalesce(value, F.lit("")).alias("value")))

    values = F.concat(
        one("request URL", "request_url", c("url")),
        at("query parameter", query_pairs(query(c("url")))), at("query parameter", c("query_string")),
        at("request header", c("request_headers")), at("cookie", c("request_cookies")),
        at("response header", c("response_headers")),
        at("cookie", F.transform("response_cookies", lambda k: F.struct(k["name"], k["value"]))),
        one("request body", "request_body", c("request_body")), at("request body", c("req_leaves")),
        at("request body", c("form_params")),
        one("response body", "response_body", c("response_body")), at("response body", c("resp_leaves")))
    # the URL is redacted once per exchange, before its values are spread out
    leaves = exchanges.withColumns({
        "req_leaves": body_leaves(c("request_body")), "resp_leaves": body_leaves(c("response_body")),
        "source_url": redact(c("url"))})
    return leaves.select("source_file", "entry_idx", "source_url", F.explode(values).alias("v")).select(
        "source_file", "entry_idx", "source_url", "v.location", "v.name", "v.value")


def sensitive_material(exchanges: DataFrame) -> DataFrame:
    """Where sensitive values were seen, never the values.

    Masks of one (file, location, URL, name) are or-ed before the shuffle; the
    categories are spread out afterwards.
    """
    # values without a category leave here; exploded, because a filter on the mask would compute it twice
    some = F.filter(F.array(category_mask(*map(F.col, ("name", "value", "low", "low_value")))), lambda m: m != 0)
    masked = (named_values(exchanges)
              .withColumns({"low": F.lower("name"), "low_value": F.lower("value")})
              .select("source_file", "location", "source_url", "name", F.explode(some).alias("mask")))
    merged = masked.groupBy("source_file", "location", "source_url", "name").agg(F.bit_or("mask").alias("mask"))
    return (merged.select("source_file", "location", "source_url", "name",
                          F.explode(CATEGORIES.array(F.col("mask"))).alias("category"))
            .withColumn("redacted_value", F.concat(F.lit("<redacted-"), F.replace("category", F.lit("_"), F.lit("-")),
                                                   F.lit(">"))))
