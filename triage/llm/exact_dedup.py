"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Each text is reduced to the digest of its normalised form.  One Misra-Gries pass (``freqItems``) finds every digest that more than
``SUPPORT`` of the rows have, with false positives; an exact count of these candidates, combined before the shuffle, verifies them.  The
verified ones, fewer than 1 / ``SUPPORT``, are broadcast with the row of theirs that stays, so their rows are decided where they lie.  All
other digests take an ordinary shuffle, in which no key has more than ``SUPPORT`` of the rows.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest id (null last).  Null texts count
as empty, and empty ones are equal to those of white space.  Rows that share id, length and normalised text are one document, flagged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.common import land

#: Share of the rows from which a digest is heavy; at most 1 / SUPPORT digests are broadcast.
SUPPORT = 1 / 1024
#: The characters without which texts are compared.
SPACE = r"[\x20\x09-\x0D]+"

_HALF, _LONG = 1 << 63, 1 << 64
_LONGEST = (1 << 31) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _rank(n: Column, doc_id: Column) -> Column:
    """One number of fixed width that is smallest for the row that stays, so that a hash aggregate finds it."""
    number = F.when(doc_id.isNull(), _whole(_LONG)).otherwise(doc_id.cast("decimal(20,0)") + _whole(_HALF))
    return ((_whole(_LONGEST) - n) * _whole(2 * _LONG) + number).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    number = rank % _whole(2 * _LONG)
    return F.when(number < _whole(_LONG), (number - _whole(_HALF)).cast("long"))


def heavy(rows: DataFrame, *, support: float = SUPPORT) -> DataFrame:
    """digest, best, group_size of every digest that more than ``support`` of the rows have: fewer than 1 / ``support`` rows."""
    total = rows.count()
    found = rows.stat.freqItems(["digest"], support)
    candidates = found.select(F.explode("digest_freqItems").alias("digest"))
    counted = _groups(rows.join(F.broadcast(candidates), "digest", "left_semi"))
    return counted.where(F.col("group_size") > support * total)


def _digests(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """digest of the normalised text, and the rank of the row in its group."""
    body = F.col(text)
    return [F.unhex(F.sha2(normalised(body).cast("binary"), 256)).alias("digest"),
            _rank(F.length(F.coalesce(body, F.lit(""))), F.col(doc_id).cast("long")).alias("rank")]


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size (long), kept (boolean) and text_sha256 of every row; ids are whole numbers.  Texts are read once."""
    rows = land(docs.select(F.col(doc_id).cast("long").alias("doc_id"), *_digests(docs, doc_id, text)), "digests")
    hot = land(heavy(rows, support=support), "heavy-digests")
    light = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    decided = rows.join(F.broadcast(hot), "digest").unionByName(light.join(_groups(light), "digest"))
    return decided.select("doc_id", _id_of(F.col("best")).alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"),
                          F.lower(F.hex("digest")).alias("text_sha256"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("rank").alias("best"), F.count("*").alias("group_size"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Rows with a heavy digest are removed where they lie; of the others only
    those go through a shuffle with their texts.  Rows that share id, length and normalised text stay together: nothing tells them apart.
    """
    digest, rank = _digests(docs, doc_id, text)
    rows = land(docs.select(digest, rank), "digests")
    hot = land(heavy(rows, support=support), "heavy-digests")
    light = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    gone = light.join(_groups(light).where("group_size > 1"), "digest").where("rank <> best").select(
        F.col("digest").alias("__digest"), F.col("rank").alias("__rank")).distinct()
    out = docs.withColumns({"__digest": digest, "__rank": rank}).join(
        F.broadcast(hot.select(F.col("digest").alias("__digest"), F.col("best").alias("__best"))), "__digest", "left")
    out = out.where("__best is null or __rank = __best").join(gone, ["__digest", "__rank"], "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
