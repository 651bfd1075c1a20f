"""Toxicity: a counterfactually regularised linear classifier over hashed words and word beginnings.

Learning uses at most ``max_rows`` labelled rows, the ones with the smallest hash of their id.  Executors turn them into sets of hashed
features, feature counts choose those that go with toxic rows beyond chance, and the short feature lists of the sample are fitted on
the driver.  For every row that names a group (``identity`` lists) a copy with the term swapped for the next of its list is made, and
the squared difference of the two scores is added to the loss; so a neutral mention of a group cannot carry weight by itself.
Scoring reads each text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.llm.common import ALNUM_WORDS, hash_ranges, mix, small_batches, text_bytes, words

#: Lengths in bytes of the word beginnings that count as features, beside the whole word.
BEGINNINGS = (4, 5, 6)
MAX_ROWS = 20_000
MAX_FEATURES = 4_096
#: A feature is taken if its log-likelihood ratio statistic is above this; chance reaches it once in millions of features.
MIN_G = 25.0
THRESHOLD = 0.3
#: Terms of one list may stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "citizens", "natives"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"), ("muslime", "christen", "juden"),
)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def text_features(data: np.ndarray, offsets: np.ndarray, swap: tuple[np.ndarray, np.ndarray] | None = None):
    """(row, feature hash) pairs of all words; with ``swap`` (sorted word hashes, their substitutes' features) also the rows that
    name a term, and the pairs with these words replaced."""
    starts, ends = words(data, offsets, ALNUM_WORDS)
    rows = np.searchsorted(offsets, starts, "right") - 1
    whole = hash_ranges(data, starts, ends)
    columns = [whole]
    for n in BEGINNINGS:
        stop = np.minimum(ends, starts + n)
        part = mix(hash_ranges(data, starts, stop) + np.uint64(n))
        columns.append(np.where(ends - starts > n, part, whole))
    found = np.stack(columns, axis=1) if len(starts) else np.empty((0, 1 + len(BEGINNINGS)), np.uint64)
    if swap is None or not len(swap[0]):
        return rows, found, None, None
    at = np.searchsorted(swap[0], whole)
    at[at == len(swap[0])] = 0
    named = swap[0][at] == whole
    changed = found.copy()
    changed[named] = swap[1][at[named]]
    return rows, found, np.unique(rows[named]), changed


def _term_features(terms: Sequence[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(terms, pa.string()))
    return text_features(data, offsets)[1]


def swaps(identity: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all one-word terms, and the features of the next term of each one's list."""
    terms = [t for own in identity for t in own]
    others = [own[(k + 1) % len(own)] for own in identity for k in range(len(own))]
    if not terms:
        return np.empty(0, np.uint64), np.empty((0, 1 + len(BEGINNINGS)), np.uint64)
    own, other = _term_features(terms)[:, 0], _term_features(others)
    order = np.unique(own, return_index=True)[1]
    return own[order], other[order]


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(y, text) of at most ``max_rows`` labelled rows; the ids are few enough to broadcast, so texts are not shuffled."""
    chosen = (labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).where("__id is not null and y is not null")
              .orderBy(F.xxhash64("__id"), "__id", "y").limit(max_rows))
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("t")).join(F.broadcast(chosen), "__id").select("y", "t")


def choose_features(sample: DataFrame, max_features: int, min_g: float) -> tuple[np.ndarray, int, int]:
    """Features that go with toxic rows, by the likelihood ratio of their document counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("t"))
            rows, found, _, _ = text_features(data, offsets)
            y = batch.column("y").to_numpy(zero_copy_only=False) > 0
            pair = np.unique(np.stack([np.repeat(rows, found.shape[1]).astype(np.uint64), found.ravel()]), axis=1)
            toxic = y[pair[0].astype(np.int64)] if pair.size else np.empty(0, bool)
            names, which = np.unique(pair[1], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.array(np.bincount(which, toxic, len(names)).astype(np.int64)),
                 pa.array(np.bincount(which, ~toxic, len(names)).astype(np.int64))], names=["f", "pos", "neg"])

    sizes = sample.agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") <= 0).alias("n")).first()
    p, n = int(sizes.p or 0), int(sizes.n or 0)
    if not p or not n:
        return np.empty(0, np.uint64), p, n
    counts = sample.mapInArrow(count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / F.lit(float(p + n))
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / (share * of))).otherwise(0.0) + F.when(
        seen < of, (of - seen) * F.log((of - seen) / ((1 - share) * of))).otherwise(0.0)
    g = 2 * (part(F.col("pos"), F.lit(float(p))) + part(F.col("neg"), F.lit(float(n))))
    best = (counts.where(F.col("pos") * n > F.col("neg") * p).where("pos + neg < {}".format(p + n)).withColumn("g", g)
            .where(F.col("g") > min_g).orderBy(F.desc("g"), "f").limit(max_features))
    return np.sort(np.array([r.f for r in best.collect()], np.int64).view(np.uint64)), p, n


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        identity: Sequence[Sequence[str]] = IDENTITY, fairness: float = 5.0, ridge: float = 1e-2, max_rows: int = MAX_ROWS,
        max_features: int = MAX_FEATURES, min_g: float = MIN_G) -> Model:
    """Fits on the labelled rows given (rows with null id or label are left out; of texts repeated or labelled twice each row counts).
    Without both classes the score is the smoothed share of toxic rows, for every text."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, doc_id, text, label, max_rows)
    chosen, p, n = choose_features(sample, max_features, min_g)
    prior = float(np.log((p + 0.5) / (n + 0.5)))
    if not len(chosen):
        return Model(chosen, np.empty(0), prior)
    swap = swaps(identity)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("t"))
            rows, found, named, changed = text_features(data, offsets, swap)
            own = _row_lists(rows, found, chosen, batch.num_rows)
            other = own if changed is None else _row_lists(rows, changed, chosen, batch.num_rows)
            marks = np.zeros(batch.num_rows, bool)
            if named is not None:
                marks[named] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(own, pa.list_(pa.int32())),
                 pa.array([o if m else None for o, m in zip(other, marks)], pa.list_(pa.int32()))], names=["y", "own", "other"])

    got = sample.mapInArrow(lists, "y int, own array<int>, other array<int>").collect()  # at most max_rows short lists
    weights, bias = _descend(got, len(chosen), prior, fairness, ridge)
    return Model(chosen, weights, bias)


def _row_lists(rows: np.ndarray, found: np.ndarray, chosen: np.ndarray, n: int) -> list[np.ndarray]:
    at = np.searchsorted(chosen, found)
    at[at == len(chosen)] = 0
    r, c = np.nonzero(chosen[at] == found) if found.size else (np.empty(0, np.int64), np.empty(0, np.int64))
    pair = np.unique(np.stack([rows[r], at[r, c]]), axis=1) if len(r) else np.empty((2, 0), np.int64)
    cuts = np.searchsorted(pair[0], np.arange(n + 1))
    return [pair[1][cuts[k] : cuts[k + 1]].astype(np.int32) for k in range(n)]


def _descend(got, size: int, prior: float, fairness: float, ridge: float, rounds: int = 400, rate: float = 0.05):
    """Adam on the log loss, the ridge, and the squared change of the score under swaps."""
    got = sorted(got, key=lambda r: (r.y, tuple(r.own)))
    y = np.array([float(r.y > 0) for r in got])
    row = np.repeat(np.arange(len(got)), [len(r.own) for r in got])
    col = np.array([c for r in got for c in r.own], np.int64)
    named = [r for r in got if r.other is not None]
    diff_row = np.array([k for k, r in enumerate(named) for _ in [*r.own, *r.other]], np.int64)
    diff_col = np.array([c for r in named for c in [*r.own, *r.other]], np.int64)
    sign = np.array([s for r in named for s in [*[1.0] * len(r.own), *[-1.0] * len(r.other)]])
    w, b = np.zeros(size), prior
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], len(got))
        err = (1 / (1 + np.exp(-z)) - y) / len(got)
        gw = np.bincount(col, err[row], size) + ridge * w / len(got)
        if len(named):
            change = np.bincount(diff_row, sign * w[diff_col], len(named))
            gw += 2 * fairness / len(named) * np.bincount(diff_col, sign * change[diff_row], size)
        g = np.append(gw, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """Every row with its columns and a score between 0 and 1; null and empty texts get the score of a text without features.
    Repeated rows get the same score, texts of any length are read whole, and an empty table gives an empty one.  A column already named
    ``into`` is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = np.zeros(1 << 16, bool)
        table[(model.features & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            z = np.full(batch.num_rows, model.bias)
            if len(model.features):
                rows, found, _, _ = text_features(data, offsets)
                r, c = np.nonzero(table[(found & np.uint64(0xFFFF)).astype(np.int64)])
                rows, found = rows[r], found[r, c]
                at = np.searchsorted(model.features, found)
                at[at == len(model.features)] = 0
                hit = model.features[at] == found
                pair = np.unique(np.stack([rows[hit], at[hit]]), axis=1)
                z += np.bincount(pair[0], model.weights[pair[1]], batch.num_rows)
            value = pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
