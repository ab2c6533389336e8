from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tracewell.llm import sharding


def brute(texts, shards):
    """Smallest capacity over the same order of groups, tried one by one; (shard per text, capacity)."""
    copies = Counter(t or "" for t in texts)
    groups = sorted(((len(t.encode()) + 1) * n, hashlib.md5(t.encode()).digest(), t) for t, n in copies.items())
    groups.sort(key=lambda g: (-g[0], g[1]))
    total, where, k = sum(g[0] for g in groups), {}, 0
    while groups and shards - k > 1 and groups[0][0] * (shards - k) > total:
        total -= groups[0][0]
        where[groups.pop(0)[2]] = k
        k += 1
    if not groups:
        return where, 0
    for capacity in range(max(groups[0][0], -(-total // (shards - k))), total + 1):
        got, at, used = {}, k, 0
        for size, _, t in groups:
            if used + size > capacity:
                at, used = at + 1, 0
            used += size
            got[t] = at
        if at < shards:
            return where | got, capacity


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, shard string, _bucket string")


CASES = {
    "one": ["a"],
    "null and empty": [None, "", None, "abc"],
    "equal sizes": [f"{i:04d}" for i in range(300)],
    "hot copies": ["hot text"] * 200 + [f"t{i}" for i in range(90)],
    "two hot": ["x" * 50] * 30 + ["y" * 70] * 40 + [("z" * (i % 37)) + str(i) for i in range(150)],
    "mixed": [("w" * random.Random(i).randrange(200)) + str(i % 120) for i in range(400)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, name):
    texts = CASES[name]
    rows = sharding.minimax_shards(table(spark, texts), 8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    where, _ = brute(texts, 8)
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["shard"] == where[texts[r["doc_id"]] or ""]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edges(spark):
    docs = table(spark, ["a", "b"])
    assert sharding.minimax_shards(docs.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id bigint, text string")
    rows = sharding.minimax_shards(repeated, 2).collect()
    assert len(rows) == 4 and {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in {r["shard"] for r in rows}}


def test_query(spark, sf):
    rows = sharding.op2_minimax_shards(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    where, _ = brute(list(texts.values()), 8)
    assert {r["doc_id"]: r["shard"] for r in rows} == {i: where[t or ""] for i, t in texts.items()}
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    largest = max(Counter(len((t or '').encode()) + 1 for t in texts.values()))
    assert len(sizes) == 8 and max(sizes.values()) <= sum(sizes.values()) / 8 + largest


def test_no_python(spark, sf):
    plan = sharding.op2_minimax_shards(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
