from __future__ import annotations

import random

import numpy as np

from tests.oracle import compare, connect
from tracewell.llm import decontamination as C


def test_lists_come_back():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.integers(0, 1 << k, size=n)) for k, n in ((3, 0), (3, 5), (20, 1000), (33, 50), (1, 0))]
    packed = C.pack(np.concatenate(lists), np.cumsum([0, *map(len, lists)])).to_pylist()
    assert all((C.unpack(p) == x).all() for p, x in zip(packed, lists))


def brute(doc, items, width=13):
    words, hit, found = C.words_of(doc), set(), set()
    for item, text in items:
        own = C.words_of(text)
        if own:
            n = min(width, len(own))
            windows = {own[i : i + n] for i in range(len(own) - n + 1)}
            for p in range(len(words) - n + 1):
                if words[p : p + n] in windows:
                    hit.update(range(p, p + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def cases():
    rng = random.Random(3)
    vocabulary = "a b c d e é A, B. the".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(12)] + [(12, None), (13, "..."), (14, "a b"), (15, "a b")]
    docs = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(120)] + ["", None, "...", items[5][1] + " " + items[5][1]]
    docs += [" ".join(rng.choices(vocabulary, k=20)) + " " + t for _, t in items[:12]]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(docs)], "doc_id bigint, text string, segment string, n int")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id bigint, text string, term string")
    want = {i: brute(t, [(str(k), x) for k, x in items]) for i, t in enumerate(docs)}
    for limit in (C.BLOCK_WORDS, 20):  # all items at once, and block by block
        monkeypatch.setattr(C, "item_blocks", lambda x, limit=limit, f=_blocks: f(x, limit))
        got = {r["doc_id"]: r for r in C.contamination(d, b).collect()}
        assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in got.items()} == want
        assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got.values())
    kept = C.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if not r["contaminated"])


_blocks = C.item_blocks


def test_query(spark, sf):
    got, want = compare(C.op5_decontamination(spark, sf), C.SQL, connect(sf))
    assert got == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x blue y green red z"), (2, "red " + "pad " * 30 + "green blue"), (3, "red green"), (4, None)], "doc_id bigint, text string")
    phrases = spark.createDataFrame([(7, "red green blue")], "item_id bigint, text string")
    index = C.build(docs)
    rows = C.near(index, phrases, slop=2)
    out = C.located(index, rows).where("item_id IS NOT NULL").collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in out] == [(1, 1, 5)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "word " * 100_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "b c"), (None, "a b c")], "item_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in C.contamination(docs, items).collect()) == [(0, 3), (1, 3), (1, 3), (2, 0)]
    assert C.contamination(docs.limit(0), items).count() == 0
    assert C.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_items_without_id_hit_words(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, "before " + passage), (2, "other words")], "doc_id bigint, text string")
    b = spark.createDataFrame([(None, passage), (7, "no such passage")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in C.contamination(d, b).collect()}
    assert got == {1: (20, 0, [], True), 2: (0, 0, [], False)}
