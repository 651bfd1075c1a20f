"""Secret scan in DataFrame functions: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over a small alphabet, one of random strings and one of ordinary identifiers, are trained from labelled samples.
Counting pairs of characters is an aggregate whose result is bounded by the square of the alphabet.  The ratio of every pair becomes one
constant array; a run of characters is a secret if its mean ratio per pair and its total ratio are high enough.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.folds import before, once

#: Patterns of the base kinds (fixed values): name, pattern, group that must have the length, least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))
#: Same matches as the patterns above that are long enough; a run is matched whole, so the length can stand in the pattern.
QUICK = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"(?<![A-Za-z0-9_])(?:[A-Za-z_]{8,}[0-9]{0,3}|[0-9]{6,})(?![A-Za-z0-9_])"
MEAN_RATIO = 0.8
TOTAL_RATIO = 16.0
#: Labelled samples are bounded: so many distinct strings of each label, so many texts for ordinary identifiers.
MAX_SAMPLES = 20_000
MAX_TEXTS = 2_000


def codes(value: Column) -> Column:
    """Places of the characters in the alphabet."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def train(samples: DataFrame, *, value: str = "value", label: str = "label", smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every pair of characters, random (label 1) against ordinary (label 0).

    The random model is half what it learned and half equal chances, since secrets come in alphabets no sample has; the ordinary model backs
    off to how common each character is.  Without samples of a label its model is the smoothing alone.  Null values and labels, values with one character, and pairs outside of the alphabet are left out;
    repeated samples count each time.  At most 2·len(ALPHABET)² counts reach the driver.
    """
    coded = samples.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("label"), codes(F.col(value)).alias("c")).where(F.size("c") >= 2)
    pairs = coded.select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b")))).alias("p"))
    counts = pairs.where("p.a >= 0 and p.b >= 0").groupBy("label", "p.a", "p.b").agg(F.count("*").alias("n")).collect()
    n = len(ALPHABET)
    seen = [[[0] * n for _ in range(n)] for _ in range(2)]
    for r in counts:
        seen[1 if r.label > 0 else 0][r.a][r.b] += r.n
    ordinary, random = seen
    every = sum(map(sum, ordinary)) + smooth * n
    single = [(sum(row[b] for row in ordinary) + smooth) / every for b in range(n)]
    out = []
    for a in range(n):
        total = [sum(own[a]) for own in seen]
        for b in range(n):
            learned = random[a][b] / total[1] if total[1] else 1 / n
            common = (ordinary[a][b] + 2 * single[b]) / (total[0] + 2)
            out.append(math.log((learned + 1 / n) / 2) - math.log(common))
    return out


def ratio(value: Column, model: list[float]) -> Column:
    """Sum of the ratios over the pairs of a string of alphabet characters."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")
    c = codes(value)
    pairs = F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * len(ALPHABET) + b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(F.get(table, p), F.lit(0.0)))


def _located(found: Column, parts: Column, ok, kind: Column) -> Column:
    """Array of (start, kind, stop) of matches, from the matches and the text between them."""
    def all_(starts: Column) -> Column:
        rows = F.transform(starts, lambda gap, i: F.struct(
            (gap + F.length(F.get(parts, i))).alias("start"), kind.alias("kind"), (gap + F.length(F.get(parts, i)) + F.length(F.get(found, i))).alias("stop"), ok(i).alias("ok")))
        return F.transform(F.filter(rows, lambda r: r["ok"]), lambda r: F.struct(*[r[c].alias(c) for c in ("start", "kind", "stop")]))

    sizes = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
    return F.when(F.size(found) > 0, once(before(sizes, lambda a, b: a + b, F.lit(0)), all_)).otherwise(
        F.array().cast("array<struct<start:int,kind:int,stop:int>>"))


def _free(spans: Column) -> Column:
    """Sorted spans without those of kind random that overlap one of a base kind."""
    end = (1 << 31) - 1
    reached = before(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["stop"]).otherwise(F.lit(-1))), F.greatest, F.lit(-1))
    follows = before(F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(F.lit(end))), F.least, F.lit(end))
    return once(reached, lambda r: once(F.reverse(follows), lambda f: F.filter(
        spans, lambda s, i: (s["kind"] < 3) | ((F.get(r, i) <= s["start"]) & (F.get(f, i) >= s["stop"])))))


def base_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """The matched values of the base kinds (column value), as samples of random strings."""
    body = F.coalesce(F.col(text), F.lit(""))
    values = [F.filter(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)]
    values += [F.regexp_extract_all(body, F.lit(QUICK[k]), F.lit(0)) for k in ("access", "hex")]
    return docs.select(F.explode(F.concat(*values)).alias("value"))


def samples_from(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_samples: int = MAX_SAMPLES,
                 max_texts: int = MAX_TEXTS) -> DataFrame:
    """Labelled samples (value, label): values of the base patterns are random, words of the texts with the smallest hashes ordinary.
    Distinct values with the smallest hashes, at most ``max_samples`` of each label; each word also in the usual styles of identifiers."""
    random = base_values(docs, text).where(F.col("value").rlike("[0-9]")).distinct().orderBy(F.xxhash64("value"), "value").limit(max_samples)
    ids = docs.select(F.col(doc_id).alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(max_texts)  # few enough to broadcast
    few = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(ids), "i")
    clean = F.regexp_replace(F.regexp_replace(F.col("t"), ASSIGN, " "), "[0-9a-f]{32,}|AKIA[A-Z0-9]+", " ")
    ordinary = few.select(F.explode(F.regexp_extract_all(clean, F.lit(WORD), F.lit(0))).alias("value"))
    ordinary = ordinary.distinct().orderBy(F.xxhash64("value"), "value").limit(max_samples)
    v, up, cap = F.col("value"), F.upper("value"), F.initcap("value")
    ordinary = ordinary.select(F.explode(F.array(v, up, F.concat(v, cap), F.concat_ws("_", v, v), F.concat_ws("_", up, up))).alias("value"))
    return random.select("value", F.lit(1).alias("label")).unionAll(ordinary.select("value", F.lit(0).alias("label")))


def scan(docs: DataFrame, model: list[float], *, text: str = "text", into: str = "secrets", mean_ratio: float = MEAN_RATIO,
         total_ratio: float = TOTAL_RATIO) -> DataFrame:
    """Every row with its columns and ``into``: array of (start, kind, stop), sorted; kind is a place in KINDS, offsets count code points.

    Base kinds are leftmost non-overlapping matches of their patterns, those too short dropped.  A run of 16 characters or more that
    overlaps none of them is of kind random if the models say so; a part of a run beside a base span is no span.  Null and empty texts and an
    empty table have no spans; repeated rows have the same.  A column already named
    ``into`` is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.drop(into).withColumns({
        "__text": body, "__assign": F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(0)),
        "__access": F.regexp_extract_all(body, F.lit(QUICK["access"]), F.lit(0)),
        "__hex": F.regexp_extract_all(body, F.lit(QUICK["hex"]), F.lit(0)), "__run": F.regexp_extract_all(body, F.lit(RUN), F.lit(0))})
    none = F.array().cast("array<string>")
    between = lambda name, pattern: F.when(F.size(name) > 0, F.split("__text", pattern, -1)).otherwise(none)
    two = one.withColumns({
        "__assign_in": F.when(F.size("__assign") > 0, F.regexp_extract_all("__text", F.lit(ASSIGN), F.lit(2))).otherwise(none),
        "__assign_by": between("__assign", ASSIGN), "__access_by": between("__access", QUICK["access"]),
        "__hex_by": between("__hex", QUICK["hex"]), "__run_by": between("__run", RUN)})
    true = lambda i: F.lit(True)
    three = two.withColumns({
        "__base": F.concat(
            _located(F.col("__assign"), F.col("__assign_by"), lambda i: F.length(F.get("__assign_in", i)) >= 8, F.lit(0)),
            _located(F.col("__access"), F.col("__access_by"), true, F.lit(1)), _located(F.col("__hex"), F.col("__hex_by"), true, F.lit(2))),
        "__runs": F.transform("__run", lambda r: ratio(r, model) >= F.greatest(F.lit(total_ratio), mean_ratio * (F.length(r) - 1)))})
    # located only where the models found something
    four = three.withColumn("__more", F.when(
        F.exists("__runs", lambda r: r), _located(F.col("__run"), F.col("__run_by"), lambda i: F.get("__runs", i), F.lit(3))).otherwise(
        F.array().cast("array<struct<start:int,kind:int,stop:int>>")))
    spans = F.array_sort(F.concat("__base", "__more"))
    free = F.when(F.size("__more") > 0, once(spans, _free)).otherwise(spans)
    return four.withColumn(into, free).select(*docs.drop(into).columns, into)


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["stop"].cast("string"))), ",")
