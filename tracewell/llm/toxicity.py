"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic rows are the positives; everything else, rows labelled clean included, is unlabelled text. A
linear classifier in numpy over the words of a text (present or not, hashed) minimises the risk estimator
pi R+(positive) + max(0, R-(unlabelled) - pi R-(positive)): the class prior pi takes out of
the unlabelled risk what positives in it contribute, and what would be negative is not followed but undone. pi is the share of toxic
rows among labelled ones, given or estimated from the training rows. With logistic loss the score is a probability.

Training rows are a bounded sample by hash (POSITIVES, UNLABELLED). Spark counts their words; the driver gets one row per hashed word of enough
support (2^BITS at most), chooses FEATURES of them, and then gets only the features of each training row, so its memory doesn't depend on
how long texts are. Scores cover every row and its whole text. Labels of
rows whose crc32(doc_id) mod 4 is 2 are held out. Only the text is an input of the score.
Null and empty texts get the score of a text without known words. Repeated rows are scored each, repeated labels count
once; a null doc_id has no label and is not held out. An empty table gives an empty result; without any positive every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.text import least_hashes, slices, split_words, word_hashes, written

BITS = 21
POSITIVES = 8_000  # rows
UNLABELLED = 16_000  # rows
FEATURES = 20_000  # of the words that are relatively more frequent among positives or simply frequent
MIN_SUPPORT = 3
SURE = 5.5  # standard deviations; of a million chance words fewer than ten come so far
EPOCHS = 30
BATCH = 1024
CUT = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different hashed words of each text, on end, and where each text's begin and end."""
    data, offsets, bounds = split_words(texts)
    words = (word_hashes(data, offsets) >> np.uint64(64 - BITS)).astype(np.int64)
    keyed = np.unique((np.repeat(np.arange(len(texts)), np.diff(bounds)) << BITS) | words)
    return keyed & ((1 << BITS) - 1), np.searchsorted(keyed, np.arange(len(texts) + 1) << BITS)


@dataclass
class Classifier:
    words: np.ndarray  # buckets with a weight, ascending
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        own, bounds = buckets(texts)
        if not len(self.words):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        weight = np.where(self.words[at] == own, self.weights[at], 0.0)
        run = np.concatenate([[0.0], np.cumsum(weight)])
        margin = run[bounds[1:]] - run[bounds[:-1]] + self.bias
        # sums over an empty or unknown text are exact zeros
        return 1 / (1 + np.exp(-np.clip(np.round(margin, 9), -50, 50)))


@dataclass
class Sample:
    chosen: np.ndarray  # hashed words that are features, ascending
    columns: np.ndarray  # indexes into `chosen`, row by row
    bounds: np.ndarray
    positive: np.ndarray


def _gain(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))


def features(words: np.ndarray, in_pos: np.ndarray, in_unl: np.ndarray, n_pos: int, n_unl: int) -> np.ndarray:
    """Of hashed words in ascending order, with the numbers of positive and of unlabelled rows that have them, those to weigh."""
    # how surely a word's share differs between both (root of the likelihood ratio statistic), so that chance words stay out
    both = ((own, (in_pos + in_unl) * n / (n_pos + n_unl), n) for own, n in ((in_pos, n_pos), (in_unl, n_unl)))
    z = np.sqrt(np.maximum(2 * sum(_gain(own, mean) + _gain(n - own, n - mean) for own, mean, n in both), 0))
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    return words[best[z[best] >= SURE]]


def risk(margin: np.ndarray, n_pos: int, prior: float) -> tuple[float, float]:
    """The positives' part and the negative part of the risk; the first `n_pos` rows are positive, the others unlabelled."""
    loss_neg = np.logaddexp(0, margin)  # of calling a row clean; logaddexp(0, -margin) of calling it toxic
    return prior * np.logaddexp(0, -margin[:n_pos]).mean(), loss_neg[n_pos:].mean() - prior * loss_neg[:n_pos].mean()


def step_direction(margin: np.ndarray, n_pos: int, prior: float) -> np.ndarray:
    """By margin, the gradient of the risk, or where its negative part is below zero that of going back up."""
    f = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
    g = np.empty(len(margin))
    if risk(margin, n_pos, prior)[1] >= 0:
        g[:n_pos] = prior / n_pos * ((f[:n_pos] - 1) - f[:n_pos])
        g[n_pos:] = f[n_pos:] / (len(margin) - n_pos)
    else:  # overfitted: climb back
        g[:n_pos] = prior / n_pos * f[:n_pos]
        g[n_pos:] = -f[n_pos:] / (len(margin) - n_pos)
    return g


def train(sample: Sample, prior: float, seed: int = 11) -> Classifier:
    """nnPU by Adam on batches that hold positives and unlabelled rows in proportion."""
    if not sample.positive.any():
        return Classifier(np.empty(0, np.int64), np.empty(0), -50.0)
    if not len(sample.chosen):
        return Classifier(sample.chosen, np.empty(0), float(np.log(prior / (1 - prior))))
    bounds, column = sample.bounds, sample.columns
    rng = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(sample.positive), np.flatnonzero(~sample.positive)
    w, b = np.zeros(len(sample.chosen)), np.array([np.log(prior / (1 - prior))])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros(1), np.zeros(1)]
    step, batches = 0, max(1, -(-len(sample.positive) // BATCH))
    for epoch in range(EPOCHS):
        rate = 0.05 * (1 - epoch / EPOCHS) + 0.002
        for ps, us in zip(np.array_split(rng.permutation(pos), batches), np.array_split(rng.permutation(unl), batches)):
            rows = np.concatenate([ps, us])
            if not len(ps) or not len(us):
                continue
            counts = bounds[rows + 1] - bounds[rows]
            local = np.repeat(np.arange(len(rows)), counts)
            cols = column[np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())]
            g = step_direction(np.bincount(local, w[cols], len(rows)) + b, len(ps), prior)
            step += 1
            for param, grad, m, v in ((w, np.bincount(cols, g[local], len(w)) + 1e-5 * w, *moments[:2]), (b, np.array([g.sum()]), *moments[2:])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Classifier(sample.chosen, w, float(b[0]))


def sample_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Bounded training rows (doc_id, positive, words: different hashed words) and the class prior."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(max(known or 0.0, 1e-3), 0.5)
    order = F.xxhash64("doc_id", F.lit(3))
    pos_ids = least_hashes(usable.where("toxic = 1").select("doc_id", order.alias("at")), "at", POSITIVES).select("doc_id")
    # labels of held-out rows are not looked at, so these rows are no part of the training text either
    free = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").join(usable.where("toxic = 1"), "doc_id", "left_anti")
    unl_ids = least_hashes(free.distinct().select("doc_id", order.alias("at")), "at", UNLABELLED).select("doc_id")
    ids = pos_ids.withColumn("positive", F.lit(True)).unionByName(unl_ids.withColumn("positive", F.lit(False)))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # about POSITIVES + UNLABELLED ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, bounds = buckets(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), lists], names=["doc_id", "positive", "words"])

    kind = dict(docs.dtypes)["doc_id"]
    return written(rows.mapInArrow(run, f"doc_id {kind}, positive boolean, words array<int>"), "toxicity-sample"), prior


def _values(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


def featured(rows: DataFrame) -> Sample:
    """The features of all training rows, each row with those it has, in order of doc_id."""
    n_rows, n_pos = rows.agg(F.count("*"), F.count_if("positive")).first()
    counts = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("unl"))
    table = counts.where(F.col("pos") + F.col("unl") >= MIN_SUPPORT).orderBy("word").toArrow()
    words = _values(table, "word")
    chosen = features(words, _values(table, "pos"), _values(table, "unl"), n_pos, max(n_rows - n_pos, 1)) if n_pos else words[:0]
    shared = rows.sparkSession.sparkContext.broadcast(chosen)  # FEATURES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            own = lists.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            column = np.searchsorted(shared.value, own)
            used = np.isin(own, shared.value)
            ends = np.searchsorted(owner[used], np.arange(len(lists) + 1)).astype(np.int32)
            columns = pa.ListArray.from_arrays(pa.array(ends), pa.array(column[used].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), columns], names=["doc_id", "positive", "columns"])

    kind = dict(rows.dtypes)["doc_id"]
    table = rows.mapInArrow(run, f"doc_id {kind}, positive boolean, columns array<int>").orderBy("doc_id", "columns").toArrow()
    sizes = np.array(pc.list_value_length(table["columns"]).to_numpy(), np.int64)
    columns = pc.list_flatten(table["columns"]).to_numpy().astype(np.int64)
    return Sample(chosen, columns, np.concatenate([[0], np.cumsum(sizes)]), table["positive"].to_numpy().astype(bool))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows, prior = sample_rows(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(train(featured(rows), prior))  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels)
