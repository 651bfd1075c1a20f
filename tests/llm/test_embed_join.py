"""The embedding join on many blocks, on both number types and on vectors of several widths."""

import brute
import numpy as np

from triage.llm import embed_join


def want_of(rows):
    """vec_id -> (n_links, component_id) by comparing all pairs."""
    links = []
    for a, (i, x, p) in enumerate(rows):
        for j, y, q in rows[a + 1 :]:
            if p == q and len(x) == len(y):
                u, v = (np.asarray(z, float) / np.linalg.norm(np.asarray(z, float)) for z in (x, y))
                links += [(i, j)] * bool(u @ v >= 0.93)
    comp = brute.components([r[0] for r in rows], links)
    return {i: (sum(i in e for e in links), comp[i]) for i, _, _ in rows}


def test_pairs_of_blocks_are_read_without_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 8))
    rows = [(k, [float(v) for v in base[k % 9] + rng.normal(size=8) * 0.2], k % 2) for k in range(200)]
    plans, land = {}, embed_join.land
    monkeypatch.setattr(embed_join, "land", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), land(df, name))[1])
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embed_join.link(given, block=16).collect()}
    assert found == want_of(rows) and any(n for n, _ in found.values())
    assert "Exchange" not in plans["grid-links"]  # else the vectors are written once for every pair of blocks


def test_repeats_widths_and_negative_zeros(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, -0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 0), (5, [1.0, 0.01, 0.0], 0), (6, [0.0, 1.0], 0), (7, [2.0, 0.0], 0)]
    rows += [(10 + k, [3.0, 3.0], 2) for k in range(5)]
    for kind in ("float", "double"):
        given = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        assert {r.vec_id: (r.n_links, r.component_id) for r in embed_join.link(given).collect()} == want_of(rows)
