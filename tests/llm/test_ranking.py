from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.oracle import compare, connect
from tracewell.llm import ranking as R
from tracewell.llm.text import importable

FOLD = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return [t.translate(FOLD) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=20):
    """Every document scored for every item."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        scored.sort()
        out += [(item or 0, r + 1, i, -s) for r, (s, _, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"] or 0, r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def made(n=900, seed=1):
    rng = random.Random(seed)
    words = [a + b for a in "ba do ki LU me pö ra su 7".split() for b in "na lo mi ke tu so é".split()]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 60, 200])))) for i in range(n)]
    docs += [(n + i, docs[5][1] + " bana") for i in range(150)] + [(n + 200, None), (n + 201, "..., !"), (None, "bana dolo"), (7, "bana dolo"), (7, "bana dolo"), (n + 202, "bana " * 5000)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 2, 8, 30])))) for i in range(25)]
    items += [(30, None), (31, "!"), (32, "absent"), (33, "bana bana BANA dolo absent"), (None, "kina lulo"), (34, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("limits", ["one shard", "many shards and blocks"])
def test_equals_brute_force(spark, monkeypatch, limits):
    docs, items = made()
    importable(spark)
    if limits != "one shard":
        monkeypatch.setattr(R, "SHARD_BYTES", 20_000)
        monkeypatch.setattr(R, "BLOCK", 8)
    d = spark.createDataFrame([(i, t, "x", b"y") for i, t in docs], "doc_id bigint, text string, shard string, term binary").coalesce(2)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    index = R.build(d)
    want = brute(docs, items)
    assert found(R.search(index, b)) == want
    if limits != "one shard":
        assert found(R.search(index, b, 20, 100)) == want  # items block by block
        assert found(R.search(index, b, 3)) == brute(docs, items, 3)


def test_pruning_opens_few_blocks_and_changes_nothing():
    """Block maxima keep most blocks of a frequent term packed; without bounds every block is opened."""
    rng = np.random.default_rng(1)
    n = 40_000
    m = 75 + rng.integers(1, 60, n)
    lists = {}

    def add(term, rows, tf):
        starts = np.arange(0, len(rows), R.BLOCK)
        ends = np.append(starts[1:], len(rows))
        ascending = np.concatenate([np.cumsum(tf[a:b]) for a, b in zip(starts, ends)])
        cuts = np.append(starts, len(rows))
        lists[term] = R.List(ends - starts, rows[ends - 1], np.maximum.reduceat(R.impacts(tf, m[rows]), starts), R.pack(rows, cuts).to_pylist(), R.pack(ascending, cuts).to_pylist())

    frequent = np.flatnonzero(rng.random(n) < 0.6)
    tf = {b"often": np.ones(len(frequent), np.int64)}
    tf[b"often"][:50] = 40
    add(b"often", frequent, tf[b"often"])
    rare = np.flatnonzero(rng.random(n) < 0.05)
    tf[b"rare"] = rng.integers(1, 9, len(rare))
    add(b"rare", rare, tf[b"rare"])
    item = {b"often": 40, b"rare": 6000}
    score = np.zeros(n, np.int64)
    for t, rows in ((b"often", frequent), (b"rare", rare)):
        score[rows] += item[t] * R.impacts(tf[t], m[rows])
    want = np.lexsort((np.arange(n), -score))[:20]
    rows, scores = R.Shard(lists, m, np.arange(n)).best(item, 20)
    assert rows.tolist() == want.tolist() and scores.tolist() == score[want].tolist()
    opened = sum(x is not None for x in lists[b"often"].found)
    assert opened < 0.6 * len(lists[b"often"].found)


def test_edges(spark):
    docs = importable(spark).createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a"), (2, "")], "item_id bigint, text string")
    assert found(R.search(R.build(docs), items)) == brute([(1, "a b"), (2, None)], [(1, "a")])
    assert R.search(R.build(docs.limit(0)), items).count() == 0 and R.search(R.build(docs), items.limit(0)).count() == 0


def test_query(spark, sf):
    got, want = compare(R.op12_ranked_search(importable(spark), sf), R.SQL, connect(sf))
    assert got == want and len(got) > 100
