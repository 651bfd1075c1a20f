"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations are grouped into one weighted sequence with the list of those that end there.  Sequences that are a proper prefix of
another (found by an anti-join) are no leaves.  Each sequence is spread into its prefixes once, and the weights are summed per prefix.

Turns are compared by the SHA-256 of role and text, prefixes by a 127-bit polynomial of those digests, so texts are never shuffled.  A
conversation may hold any share of the turns: places and prefixes are found by range-dealt scans (``scans``), and joins on a sequence are
split by depth.  Sums over subtrees come from suffix sums: each node is owned by the leaf below it with the smallest conversation, so the
nodes of one owner are the lower end of one path, and all above that end get its whole sum.  Nothing is spread to all its ancestors.

Null roles and texts are empty; turns without a conversation are left out; turns with the same number are ordered by digest, so repeated
rows are turns of their own.  Null turn numbers come first.  No turns give no nodes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.common import land
from triage.llm.scans import EMPTY, scan

#: Turns of a path that share one join key.
SPLIT = 1024
#: Conversations whose ids stand in one piece of an end list.
BLOCK_BITS = 10
#: Parents with more than this share of all nodes as children are joined by broadcast: fewer than its inverse.
HOT_PARENT = 1 / 1024


@dataclass
class Trie:
    #: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (long), node (its key)
    nodes: DataFrame
    #: node, conv_id: the conversations that end at a node, in long form
    ends: DataFrame


def turns_of(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n (place in the conversation, from 1), token (16 bytes) and words of every turn."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    digest = F.sha2(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said).cast("binary"), 256)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("token"),
        F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return scan(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("token")]).select("conv", "n", "token", "words")


def rebuilt(turns: DataFrame, *, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns replaced by those of the first of its family: (conv, part, n, token, words), and all convs.

    The first h turns of conversation conv - conv % family come in place of its own first h; h = crc32(conv as text) % most.
    """
    turns = land(turns, "turns")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    convs = turns.select("conv").distinct()
    heads = turns.where((F.col("n") < most) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    members = convs.select("conv", h, (F.col("conv") - F.col("conv") % family).alias("base"))
    begin = members.join(heads, "base").where("n <= h").select("conv", F.lit(0).alias("part"), "n", "token", "words")
    own = turns.where(F.col("n") > h).select("conv", F.lit(1).alias("part"), "n", "token", "words")
    return begin.unionAll(own), convs


def _split(depth: Column) -> Column:
    return F.floor(depth / SPLIT).cast("int").alias("split")


def _spread(sequences: DataFrame) -> DataFrame:
    """One row of a sequence for every SPLIT turns it has."""
    return sequences.withColumn("split", F.explode(F.sequence(F.lit(0), _split(F.col("len")))))


def build(rows: DataFrame, convs: DataFrame) -> Trie:
    """The trie of conversations given as (conv, part, n, token, words), ordered by part and n; ``convs`` has all of them, turnless too."""
    root = F.lit(EMPTY)
    path = land(scan(rows, "conv", [F.col("part"), F.col("n")], token="token", value="words").select(
        "conv", F.col("n").alias("depth"), F.col("before").alias("parent"), F.col("h").alias("node"), "words"), "paths")

    # identical conversations are one weighted sequence, named by its smallest conversation
    lengths = path.groupBy("conv").agg(F.max("depth").alias("depth"))
    ends = convs.join(lengths.join(path.select("conv", "depth", "node"), ["conv", "depth"]), "conv", "left").select(
        "conv", F.coalesce("depth", F.lit(0).cast("long")).alias("len"), F.coalesce("node", root).alias("node"))
    ends = land(ends, "ends")
    sequences = land(ends.groupBy("node").agg(F.min("conv").alias("seq"), F.count("*").alias("weight"), F.max("len").alias("len")), "sequences")

    # prefixes of every sequence; a sequence that is a proper prefix is no leaf
    own = path.withColumn("split", _split(F.col("depth"))).join(
        _spread(sequences.select(F.col("seq").alias("conv"), "weight", "len")), ["conv", "split"]).withColumnRenamed("conv", "seq")
    columns = ["seq", "len", "weight", "depth", "node", "parent", "words"]
    prefixes = own.select(*columns).unionAll(sequences.select(
        "seq", "len", "weight", F.lit(0).cast("long"), root, F.lit(None).cast("binary"), F.lit(0).cast("long")))
    prefixes = land(prefixes, "prefixes")
    proper = prefixes.where("depth < len").select("node").distinct()
    leaves = land(sequences.join(proper, "node", "left_anti").select("seq", "len"), "leaves")
    below = prefixes.withColumn("split", _split(F.col("depth"))).join(
        _spread(leaves).select(F.col("seq"), "split", F.lit(True).alias("leaf")), ["seq", "split"], "left")
    below = land(below.drop("split"), "prefixes-of-leaves")
    nodes = below.groupBy("node", "parent").agg(
        F.max("depth").alias("depth"), F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.count("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("seq"))).alias("owner"), F.max("words").alias("words"))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))

    # the nodes that a leaf owns are the lower end of its path; what is above that end gets the whole sum
    nodes = land(scan(nodes, "owner", [F.col("depth").desc()], value="saved"), "nodes")
    owned = nodes.groupBy("owner").agg(F.max("total").alias("sum"), F.min("depth").alias("top"), F.max("depth").alias("len"))
    owned = owned.where("top > 0 and sum > 0").withColumn("split", F.explode(F.sequence(F.lit(0), _split(F.col("top") - 1)))).withColumnRenamed("owner", "seq")
    above = below.where("leaf").withColumn("split", _split(F.col("depth"))).join(owned.drop("len"), ["seq", "split"]).where("depth < top")
    above = above.groupBy("node").agg(F.sum("sum").alias("above"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    found = nodes.join(above, "node", "left").join(children, "node", "left").select(
        "node", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("total") + F.coalesce("above", F.lit(0))).cast("long").alias("saved_tokens"))
    return Trie(_with_parents(land(found, "nodes")), ends.select("node", F.col("conv").alias("conv_id")))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """parent_conv_id of every node; parents of very many children, boundedly many, are not joined by shuffling their children."""
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    limit = HOT_PARENT * nodes.count()
    hot = parents.where(F.col("n_children") > limit).drop("n_children")
    rest = parents.where(F.col("n_children") <= limit).drop("n_children")
    near = nodes.join(F.broadcast(hot), "parent")
    far = nodes.join(F.broadcast(hot.select("parent")), "parent", "left_anti").join(rest, "parent", "left")
    return near.unionByName(far).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "node")


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the decimal ids that end at a node, ascending, comma-joined.

    Ids are first joined in pieces of at most 1,024 neighbouring ones, so the one task that a digest takes reads few rows, one at a time.
    """
    pieces = ends.groupBy("node", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    pieces = pieces.select("node", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, found = [], []
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if key != node:
                    if state is not None:
                        nodes.append(node)
                        found.append(state.hexdigest())
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "block").mapInArrow(digest, "node binary, ends_sha256 string")
