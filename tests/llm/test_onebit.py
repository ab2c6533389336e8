from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import onebit as B
from tracewell.llm.text import importable


def brute(rows, k=5):
    """query_id -> all (rank, vec_id, score) lists, by comparing every query with every row."""
    sound = [(i, i_, np.array(v, float)) for i, (i_, v) in enumerate(rows) if i_ is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q, x in sound:
        if q % 50 == 0:
            near = []
            for j, c, y in sound:
                if j != i and len(x) == len(y):
                    near.append((-float(np.dot(x / max(abs(x)), y / max(abs(y)))) / (np.linalg.norm(x / max(abs(x))) * np.linalg.norm(y / max(abs(y)))), c))
            near.sort(key=lambda t: (round(t[0], 12), t[1]))
            out += [(q, r + 1, c, round(-s, 9)) for r, (s, c) in enumerate(near[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_all_cases_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    hot = [rng.gauss(0, 1) for _ in range(16)]
    rows += [(1000 + i, hot) for i in range(200)] + [(1300 + i, [x + rng.gauss(0, 1e-3) for x in hot]) for i in range(200)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (2000, [1e200] * 16), (2050, [2e200] * 15 + [1e200]), (2100, [1e200 * 2.0**-1200] * 16)]
    rows += [(None, hot), (3000, None), (3050, []), (3100, [0.0] * 16), (3150, [float("nan")] * 16), (3200, [float("inf")] + [1.0] * 15), (3250, [None] + [1.0] * 15)]
    rows += [(4000, [1.0, 2.0]), (4001, [2.0, 1.0]), (4050, [5.0]), (4002, [-2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, code string, d int").repartition(5)
    importable(spark)
    monkeypatch.setattr(B, "EPSILON", 1e9)  # every pair is verified: all paths but the estimate, exactly
    index = B.build(df)
    for limit in (B.ROUND_BYTES, 700):
        assert found(B.search(index, F.col("id") % 50 == 0, 5, limit)) == brute(rows)


def test_few_rows_and_none(spark):
    df = importable(spark).createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert found(B.search(B.build(df), F.col("id") % 50 == 0)) == [(0, 1, 1, round(math.sqrt(0.5), 9)), (0, 2, 2, 0.0)]
    assert B.search(B.build(df.limit(0)), F.col("id") % 50 == 0).count() == 0
    assert B.search(B.build(df), F.col("id") == 77).count() == 0


def test_estimates_stay_within_the_bound():
    """Over random pairs the estimate is unbiased, and leaves the bound about as rarely as a normal error does."""
    rng = np.random.default_rng(1)
    d = 64
    x, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.standard_normal((2000, d)), rng.standard_normal((200, d))))
    code, scalar = B.codes_of(x, B.rotation(d))
    assert code.shape == (2000, 8)
    estimate = (q @ B.rotation(d)) @ (B.unpacked(code, d) / scalar[:, None]).T
    error = estimate - q @ x.T
    assert abs(error.mean()) < 1e-3
    assert (np.abs(error) > B.bound(scalar, d)).mean() < 0.02
    assert np.allclose(B.rotation(d) @ B.rotation(d).T, np.eye(d))


@pytest.mark.parametrize("table", ["sf", "larger"])
def test_recall(spark, sf, table):
    sf = sf if table == "sf" else "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = found(B.op11_nearest(importable(spark), sf))
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -2
        best = np.lexsort((ids, -score))[:5]
        want += [(int(ids[q]), r + 1, int(ids[c]), round(float(score[c]), 9)) for r, c in enumerate(best)]
    assert len(got) == len(want)
    assert len({(q, c) for q, _, c, _ in got} & {(q, c) for q, _, c, _ in want}) >= 0.99 * len(want)
