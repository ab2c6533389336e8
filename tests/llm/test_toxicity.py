from __future__ import annotations

import random
import zlib

import pyarrow as pa
import pytest

from tracewell.llm import toxicity as X

CLEAN = [a + b for a in "ba do ki lu me po ra su ti vo".split() for b in "na lo mi ke tu".split()]
RUDE = ["grubnak", "zoltfig", "mirpeth", "quonsel"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = rng.choices(CLEAN, k=rng.randrange(20, 80))
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        docs.append((i, " ".join(words), "x"))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels, [any(w in RUDE for w in t.split()) for _, t, _ in docs]


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(2500)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    rows = X.score(d, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(rows) == len(docs)
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum((r["score"] >= 0.3) == truth[r["doc_id"]] for r in out) / len(out)
    assert right > 0.98 and all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(400, 2)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = ({r["doc_id"]: r["score"] for r in X.score(d, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_scores_equal_a_plain_sum():
    texts = pa.array(["bana dolo grubnak bana", None, "", "other words", "GRUBNAK, dolo!"])
    words = {w: X.buckets(pa.array([w]))[0][0] for w in ("grubnak", "dolo")}
    order = sorted(words.items(), key=lambda x: x[1])
    weight = {"grubnak": 2.5, "dolo": -0.5}
    c = X.Classifier(*(X.np.array(x) for x in ([b for _, b in order], [weight[w] for w, _ in order])), -1.0)
    want = [1.0, -1.0, -1.0, -1.0, 1.0]
    assert c.scores(texts) == pytest.approx([1 / (1 + X.np.exp(-m)) for m in want])


@pytest.mark.parametrize("shift, climbs", [(0.0, False), (6.0, True)])
def test_direction_equals_differences(shift, climbs):
    rng = X.np.random.default_rng(4)
    margin, n_pos, prior, h = rng.normal(0, 2, 40), 12, 0.3, 1e-5
    margin[:n_pos] += 2 * shift  # positives that look toxic and unlabelled rows that look clean drive the negative part below zero
    margin[n_pos:] -= shift
    assert (X.risk(margin, n_pos, prior)[1] < 0) == climbs

    def goal(m):
        own, negative = X.risk(m, n_pos, prior)
        return -negative if climbs else own + negative

    steps = X.np.eye(len(margin)) * h
    want = [(goal(margin + s) - goal(margin - s)) / (2 * h) for s in steps]
    assert X.step_direction(margin, n_pos, prior) == pytest.approx(want, abs=1e-8)
    losses = [[X.np.log(1 + X.np.exp(sign * m)) for m in part] for part, sign in ((margin[:n_pos], -1), (margin[n_pos:], 1), (margin[:n_pos], 1))]
    a, b, c = (sum(x) / len(x) for x in losses)
    assert X.risk(margin, n_pos, prior) == pytest.approx((prior * a, b - prior * c))


def test_features_of_the_sample_equal_plain_counts(spark):
    docs, labels, _ = corpus(900, 7)
    rows, _ = X.sample_rows(spark.createDataFrame(docs, "doc_id bigint, text string, x string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    sample, plain = X.featured(rows), sorted((r["doc_id"], r["positive"], set(r["words"])) for r in rows.collect())
    n_pos = sum(p for _, p, _ in plain)
    words = sorted(set().union(*(w for _, _, w in plain)))
    have = {w: (sum(p and w in ws for _, p, ws in plain), sum(not p and w in ws for _, p, ws in plain)) for w in words}
    often = [w for w in words if sum(have[w]) >= X.MIN_SUPPORT]
    chosen = X.features(X.np.array(often), *(X.np.array([have[w][k] for w in often]) for k in (0, 1)), n_pos, len(plain) - n_pos)
    assert sample.chosen.tolist() == chosen.tolist() and {X.buckets(pa.array([w]))[0][0] for w in RUDE} <= set(chosen)
    assert sample.positive.tolist() == [p for _, p, _ in plain]
    for k, (_, _, ws) in enumerate(plain):
        assert sample.chosen[sample.columns[sample.bounds[k] : sample.bounds[k + 1]]].tolist() == sorted(ws & set(chosen.tolist()))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "word " * 100_000, 3), (3, "word " * 100_000, 3)], "doc_id bigint, text string, held_out int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (9, None)], "doc_id bigint, toxic int")
    assert X.score(docs, labels).count() == 4
    assert X.score(docs, labels.limit(0)).select("predicted").distinct().collect()[0][0] == 0
    assert X.score(docs.limit(0), labels).count() == 0


def test_query(spark, sf):
    assert X.op7_toxicity(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
