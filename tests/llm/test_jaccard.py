from __future__ import annotations

import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import jaccard as J
from tracewell.llm.components import SALTS, _least, components

FOLD = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """Links between different texts, and groups, by comparing all pairs that share a shingle."""
    kinds = sorted({t or "" for t in texts})
    sets = {t: shingle_set(t) for t in kinds}
    holders = defaultdict(set)
    for t in kinds:
        for s in sets[t]:
            holders[s].add(t)
    links, root = defaultdict(set), {t: t for t in kinds}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for t in kinds:
        for u in {u for s in sets[t] for u in holders[s] if u != t}:
            common = len(sets[t] & sets[u])
            if 9 * common >= 4 * (len(sets[t]) + len(sets[u])):
                links[t].add(u)
                root[find(t)] = find(u)
    return links, find


def check(rows, texts):
    links, find = brute(texts.values())
    copies, groups = defaultdict(list), defaultdict(list)
    for i, t in texts.items():
        copies[t or ""].append(i)
        groups[find(t or "")].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["class_id"], r["n_copies"]) == (min(copies[t]), len(copies[t]))
        assert r["n_links"] == len(links[t])
        assert r["group_id"] == min(groups[find(t)])


def made(n=160, seed=1):
    rng = random.Random(seed)
    words = [a + b for a in "ba do ki lu me po ra su".split() for b in "na lo mi ke tu so".split()]
    base = [rng.choices(words, k=rng.randrange(1, 120)) for _ in range(n // 4)]
    texts = ["", None, "one", "One!", "two words", "two  words", "a b c d", "..."]
    while len(texts) < n:
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    hot = rng.choices(words, k=80)
    for i in range(60):
        own = list(hot)
        own[i] = "changed"
        texts.append(" ".join(own))
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [512, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_TEXTS", block)
    texts = made()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id bigint, text string, key string, bucket int")
    check(J.near_duplicates(docs).collect(), texts)
    kept = J.drop_near_duplicates(docs)
    links, find = brute(texts.values())
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[find(t or "")].append(i)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_blocks_without_members(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BYTES", 64)  # two texts in some ten blocks: most are empty
    own = [f"w{i}" for i in range(80)]
    texts = {1: " ".join(own), 2: " ".join(own[:-1])}
    check(J.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect(), texts)
    # a pair in one of many blocks counts once, also where the blocks beside it are empty
    rows = [(bytes([k]), 5, 0, 12, block, guide, texts[k]) for k, block, guide in ((1, 4, False), (2, 4, False), *((2, b, True) for b in range(12)))]
    members = spark.createDataFrame(rows, "key binary, bucket bigint, band int, blocks int, block int, guide boolean, text string")
    deltas = J.met(members, *J.bands_for())
    assert {(r["key"][0], r["size"], len(r["delta"])) for r in deltas.collect()} == {(1, 76, 1), (2, 75, 0)}
    assert [r["n_links"] for r in J.verified(deltas).collect()] == [1, 1]


def test_blocks_by_differences_equal_full_sets():
    rng = np.random.default_rng(5)
    guide = np.unique(rng.integers(0, 1 << 62, 60))
    sets = [np.unique(np.concatenate([rng.choice(guide, rng.integers(40, len(guide) + 1), replace=False), rng.integers(0, 99, rng.integers(0, 6))])) for _ in range(70)]
    sets += [np.unique(rng.integers(0, 1 << 62, 30)), guide]  # a chance member of the bucket, and the guide itself
    earlier = rng.integers(0, 9, (len(sets), 2))

    def block(rows):
        deltas = [np.setxor1d(guide, sets[r]) for r in rows]
        return J.Block(None, np.array([len(sets[r]) for r in rows]), np.concatenate(deltas), np.cumsum([0, *map(len, deltas)]), earlier[rows])

    left, right = np.arange(30), np.arange(30, len(sets))
    found = J.linked_blocks(block(left), block(right), Fraction(4, 5))
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            common = len(np.intersect1d(sets[a], sets[b]))
            assert found[i, j] == (9 * common >= 4 * (len(sets[a]) + len(sets[b])) and (earlier[a] != earlier[b]).all())
    assert 0 < found.sum() < found.size


def test_a_family_sends_each_text_once_per_bucket(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TEXTS", 8)
    own = [f"w{i}" for i in range(120)]
    texts = {i: " ".join([*own[:i], "x", *own[i + 1 :]]) for i in range(100)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check(J.near_duplicates(docs).collect(), texts)
    bands, rows = J.bands_for()
    classes = J.signed(docs.withColumn("key", F.unhex(F.md5("text"))), bands, rows)
    members = J.placed(J.buckets(classes))
    big = members.where("blocks > 1")
    assert big.where("NOT guide").groupBy("key", "bucket").count().where("count > 1").isEmpty()
    assert big.where("guide").groupBy("bucket").agg(F.countDistinct("key").alias("k"), F.count("*").alias("n"), F.first("blocks").alias("b")).where("k <> 1 OR n <> b").isEmpty()
    deltas = J.met(members.join(classes.select("key").join(docs.withColumn("key", F.unhex(F.md5("text"))), "key"), "key"), bands, rows).where("delta IS NOT NULL")
    assert deltas.agg(F.max(F.size("delta"))).first()[0] <= 20  # each text differs from the guide by two words at most


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(J.op8_near_duplicates(spark, sf).collect(), texts)


def test_repeated_rows_that_differ_elsewhere(spark):
    rows = [(1, "same text", 0.5 * i, [i], {"a": i}) for i in range(6)]
    kept = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, x double, y array<int>, z map<string,int>")
        kept.add(tuple(r["x"] for r in J.drop_near_duplicates(docs.repartition(3)).collect()))
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_edges(spark):
    rows = [(1, "same text here", "x"), (1, "same text here", "y"), (None, "same text here", None), (None, None, "z"), (7, "word " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, jaccard_key string")
    assert J.near_duplicates(docs).count() == 5
    kept = sorted((r["doc_id"] or 0) for r in J.drop_near_duplicates(docs).collect())
    assert kept == [0, 1, 7]
    assert J.near_duplicates(docs.limit(0)).count() == 0 and J.drop_near_duplicates(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.95):
        bands, rows = J.bands_for(t, 0.999, 400)
        assert 1 - (1 - t**rows) ** bands >= 0.999 and bands * rows <= 400


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (3, 2), (9, 9)] + [(50, 50 - i) for i in range(1, 9)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {out[i] for i in range(100, 141)} == {100} and {out[i] for i in (1, 2, 3)} == {1} and {out[i] for i in range(42, 51)} == {42} and 9 not in out


def test_components_spread_a_centre(spark):
    star = spark.range(1, 4001).selectExpr("0L AS v", "id AS u")
    least = _least(star.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS))).select(F.col("v").alias("u"), F.col("u").alias("v"), "salt"))
    assert least.agg(F.count("*"), F.min("m"), F.max("m")).first() == (SALTS, 1, 1)
    out = components(star)
    assert out.count() == 4001 and out.where("root <> 0").isEmpty()
    assert components(star.limit(0)).isEmpty()
