"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Every document gets counts over its whole text and a vector of transformed
statistics. Per level - all rows, each lang, each (lang, source) - location and scatter of the vectors are
minimum-covariance-determinant (MCD) estimates: starting from the median and
the spread around it, the share H of rows nearest by Mahalanobis distance gives
the next mean and covariance, as long as the level's own determinant falls by more than a fixed tolerance, however
many steps that takes and whatever other levels do; rows inside
the 97.5 % ellipsoid then give the final ones. Each step is one aggregation over the rows of unsettled levels: sums per
(level, distance bin), so that no level meets in one task, however large.

A (lang, source) is judged by its own estimates mixed with those of its lang, as if these stood for PRIOR_ROWS further
rows; a lang's are mixed with those of all rows, and those with a wide prior. So a group's size
only weighs, and no number of rows changes the method.

Null text counts as empty and fails the base rule. Null lang or source is a value of its own.
Repeated rows count and are judged each. An empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracewell.llm.text import encoded, fresh, slices, written

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:=_~^\\/@[]{}()\"'`+" + SYMBOLS
SPACES = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Each transformed statistic with the least standard deviation it is given: smaller differences say nothing.
STATISTICS = {
    "word_length": 0.05,  # log of characters per word
    "symbols": 0.05,  # log of 1 + symbols per ten words
    "marks": 0.10,  # log of 1 + other marks per ten words
    "capitals": 0.10,  # square root of the share of A-Z among characters in words
    "repeats": 0.15,  # square root of the share of words in repeated windows
    "dup_lines": 0.10,  # square root of the share of repeated lines
}
D = len(STATISTICS)
PRIOR_SPREAD = 4.0  # deviations of the prior for all rows, in floors


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    h: float = 0.75  # share of rows that the estimates are fitted on
    prior_rows: int = 300  # what the level above weighs: one row far from all others is an outlier, some alike are a group
    tolerance: float = 0.01  # of the log determinant; a level that falls by less has settled
    reweight: float = 0.975
    quantile: float = 1 - 1e-12  # of the chi-squared distribution; rows beyond are rejected, clean ones practically never


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    for i, gram in enumerate(grams):
        j = first.setdefault(gram, i)
        if j != i:
            hit[i : i + 3] = hit[j : j + 3] = b"\1\1\1"
    return hit.count(1)


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and STATISTICS of one whole text in UTF-8."""
    words = text.split()
    n = len(words)
    letters = text.translate(None, SPACES)
    chars = len(letters.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    marks = len(text) - len(text.translate(None, MARKS)) - symbols
    capitals = len(text) - len(text.translate(None, UPPER))
    some, ten = max(n, 1), 10 / max(n, 1)
    vector = [
        math.log(max(chars, 1) / some),
        math.log1p(symbols * ten),
        math.log1p(marks * ten),
        math.sqrt(capitals / max(chars, 1)),
        math.sqrt(repeats / some),
        math.sqrt(dup_lines / max(len(lines), 1)),
    ]
    return [n, chars, symbols, dup_lines, repeats], vector


def with_statistics(docs: DataFrame, names: list[str]) -> DataFrame:
    """`docs` with COUNTS and the vector appended under `names`, in one pass over the text."""
    kinds = [T.LongType()] * len(COUNTS) + [T.ArrayType(T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [measure(x) for x in encoded(batch.column("text"))]
            new = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            new.append(pa.array([r[1] for r in rows], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def chi_squared_cdf(x: float, d: float) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_squared_quantile(p: float, d: float) -> float:
    low, high = 0.0, 1.0
    while chi_squared_cdf(high, d) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared_cdf(middle, d) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest `share` of normal rows is to be multiplied by."""
    return share / chi_squared_cdf(chi_squared_quantile(share, D), D + 2)


FIT = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("covariance", T.ArrayType(T.DoubleType())),
        T.StructField("whiten", T.ArrayType(T.DoubleType())),  # rows of a lower triangle W: distance² = |W (x - mean)|²
        T.StructField("log_det", T.DoubleType()),
    ]
)
_FIT_TYPES = (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
EVERYTHING = "[]"  # the level of all rows
SALTS = 64  # parts that a level's rows are dealt to where they meet its estimates
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def solve(mean: np.ndarray, covariance: np.ndarray) -> tuple[list[float], list[float], list[float], float]:
    """Mean and covariance as they are; with floors on the deviations, the whitening triangle and the log determinant."""
    root = np.linalg.cholesky(covariance + np.diag(np.square(list(STATISTICS.values()))))
    return mean.tolist(), covariance.ravel().tolist(), np.linalg.inv(root).ravel().tolist(), float(2 * np.log(np.diag(root)).sum())


def mixed(n: int, mean: np.ndarray, covariance: np.ndarray, m: int, above_mean: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of n rows together with m rows of the level above."""
    share, apart = n / (n + m), mean - above_mean
    return above_mean + share * apart, share * covariance + (1 - share) * above + share * (1 - share) * np.outer(apart, apart)


def _fits(rows: DataFrame, make) -> DataFrame:
    """A row of FIT for each row: small matrices, each apart from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [make(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(_FIT_TYPES)], names=FIT.names)

    return rows.mapInArrow(run, FIT)


def solved(sums: DataFrame, factor: float) -> DataFrame:
    """Estimates from sums (level, n, s, q)."""

    def make(r: dict) -> tuple:
        mean = np.array(r["s"]) / r["n"]
        square = np.zeros((D, D))
        for (i, j), q in zip(PAIRS, r["q"]):
            square[i, j] = square[j, i] = q / r["n"]
        return r["level"], r["n"], *solve(mean, (square - np.outer(mean, mean)) * factor)

    return _fits(sums, make)


def distance(vector: str = "vector", mean: str = "mean", whiten: str = "whiten") -> Column:
    """Squared Mahalanobis distance; the fit's columns stand beside the vector."""
    x = [F.element_at(vector, i + 1) - F.element_at(mean, i + 1) for i in range(D)]
    total = F.lit(0.0)
    for i in range(D):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.element_at(whiten, i * D + j + 1) * x[j]
        total = total + part * part
    return total


def moments() -> list[Column]:
    x = [F.element_at("vector", i + 1) for i in range(D)]
    return [F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in PAIRS)).alias("q")]


def summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy("level").agg(
        F.sum("n").alias("n"),
        F.array(*(F.sum(F.element_at("s", i + 1)) for i in range(D))).alias("s"),
        F.array(*(F.sum(F.element_at("q", i + 1)) for i in range(len(PAIRS)))).alias("q"),
    )


def nearest(binned: DataFrame, h: float) -> DataFrame:
    """Of each level's bins (level, bin, n, s, q), the nearest ones that together hold at least `h` of its rows."""
    near = Window.partitionBy("level").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("level")
    before, total = F.coalesce(F.sum("n").over(near), F.lit(0)), F.sum("n").over(everything)
    return binned.withColumn("inside", before < h * total).where("inside").drop("inside")


def starts(vectors: DataFrame) -> DataFrame:
    """Per level, medians and spreads around them, from histograms with bins of a fiftieth of the floor: exact counts, any size."""
    widths = F.array(*(F.lit(w / 50) for w in STATISTICS.values()))
    bins = (
        vectors.select("level", F.posexplode("vector").alias("k", "v"))
        .groupBy("level", "k", F.floor(F.col("v") / F.get(widths, F.col("k"))).alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("v", (F.col("bin") + 0.5) * F.get(widths, F.col("k")))
    )

    def median(rows: DataFrame, order: str, name: str) -> DataFrame:
        w = Window.partitionBy("level", "k")
        reached = F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("reached", reached).withColumn("total", F.sum("n").over(w))
        return rows.where(F.col("reached") * 2 >= F.col("total")).groupBy("level", "k").agg(F.min(order).alias(name))

    middle = median(bins, "v", "middle")
    away = bins.join(middle, ["level", "k"]).withColumn("away", F.abs(F.col("v") - F.col("middle")))
    spread = median(away, "away", "spread").join(middle, ["level", "k"])
    one = spread.groupBy("level").agg(F.sort_array(F.collect_list(F.struct("k", "middle", "spread"))).alias("x"))

    def make(r: dict) -> tuple:
        mean, deviation = (np.array([x[name] for x in r["x"]]) for name in ("middle", "spread"))
        return r["level"], 0, *solve(mean, np.diag(np.square(1.4826 * deviation)))

    return _fits(one, make)


def level_name(*columns: str) -> Column:
    """A key for a group of columns in which null differs from every value."""
    return F.to_json(F.array(*columns), {"ignoreNullFields": "false"})


def beside(vectors: DataFrame, fits: DataFrame) -> DataFrame:
    """Vectors with the estimates of their level. A level may hold all rows, so its estimates, a row, go to each of its parts."""
    return vectors.join(fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["level", "salt"])


def concentrated(vectors: DataFrame, rules: Rules) -> DataFrame:
    """MCD estimates per level of `vectors` (level, vector, salt), before they are mixed."""

    def binned(fits: DataFrame) -> DataFrame:
        d = beside(vectors, fits).withColumn("bin", F.floor(F.log2(F.greatest(distance(), F.lit(1e-6))) * 32))
        return d.groupBy("level", "bin").agg(*moments())

    open_ = written(starts(vectors), "quality-fit")
    settled, first = [], True
    while True:
        # a settled level takes no further part; every other one has just lost a fixed share of a determinant that floors bound
        # from below, so this ends
        new = written(solved(summed(nearest(binned(open_), rules.h)), consistency(rules.h)), "quality-fit")
        before = open_.select("level", F.lit(None).cast("double").alias("was") if first else F.col("log_det").alias("was"))
        pairs, first = new.join(before, "level"), False
        falls = F.col("was").isNull() | (F.col("was") - F.col("log_det") > rules.tolerance)
        settled.append(pairs.where(~falls).drop("was"))
        open_ = pairs.where(falls).drop("was")
        if open_.isEmpty():
            break
    fits = written(reduce(DataFrame.unionByName, settled), "quality-fit")
    inside = beside(vectors, fits).where(distance() <= chi_squared_quantile(rules.reweight, D))
    return written(solved(inside.groupBy("level").agg(*moments()), consistency(rules.reweight)), "quality-fit")


def fit(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per (lang, source) with rows that pass the base rules: lang, source, mean, whiten of the estimates that judge it.

    `measured` has lang, source, vector and base_failed. The result is a small table with a row per group.
    """
    good = measured.where(~F.col("base_failed"))
    pair, lang = level_name("lang", "source"), level_name("lang")
    levels = good.select(F.explode(F.array(F.lit(EVERYTHING), lang, pair)).alias("level"), "vector")
    vectors = written(levels.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "quality-vectors")
    fits = concentrated(vectors, rules)
    wide = np.diag(np.square(PRIOR_SPREAD * np.array(list(STATISTICS.values()))))

    def with_prior(r: dict) -> tuple:
        mean = np.array(r["mean"])
        return r["level"], r["n"], *solve(*mixed(r["n"], mean, np.array(r["covariance"]).reshape(D, D), rules.prior_rows, mean, wide))

    def with_above(r: dict) -> tuple:
        own, above = ((np.array(r[p + "mean"]), np.array(r[p + "covariance"]).reshape(D, D)) for p in ("", "above_"))
        return r["level"], r["n"], *solve(*mixed(r["n"], *own, rules.prior_rows, *above))

    def below(levels: DataFrame, above: DataFrame) -> DataFrame:
        """Estimates of `levels` (level, above: the level over it), mixed with those above."""
        over = above.select(F.col("level").alias("above"), F.col("mean").alias("above_mean"), F.col("covariance").alias("above_covariance"))
        return _fits(fits.join(levels, "level").join(over, "above"), with_above)

    groups = written(good.select("lang", "source").distinct(), "quality-groups")
    top = written(_fits(fits.where(F.col("level") == EVERYTHING), with_prior), "quality-fit")
    langs = written(below(groups.select(lang.alias("level"), F.lit(EVERYTHING).alias("above")).distinct(), top), "quality-fit")
    pairs = below(groups.select(pair.alias("level"), lang.alias("above")), langs)
    return written(pairs.join(groups.select("lang", "source", pair.alias("level")), "level").select("lang", "source", "mean", "whiten"), "quality-fit")


def judged(measured: DataFrame, fits: DataFrame, names: dict[str, str], rules: Rules = Rules()) -> DataFrame:
    """`measured` (with lang and source) plus `names`: squared distance (null where no row of the group passes the base rules) and verdict."""
    own = fresh(measured, "level_lang", "level_source", "mean", "whiten")
    model = fits.select(*(F.col(c).alias(name) for c, name in zip(("lang", "source", "mean", "whiten"), own)))
    limit = chi_squared_quantile(rules.quantile, D)
    joined = measured.join(model, measured["lang"].eqNullSafe(model[own[0]]) & measured["source"].eqNullSafe(model[own[1]]), "left")
    return (
        joined.withColumn(names["distance"], distance(names["vector"], own[2], own[3]))
        .withColumn(names["kept"], ~F.col(names["base_failed"]) & F.coalesce(F.col(names["distance"]) <= limit, F.lit(True)))
        .drop(*own)
    )


def base_failed(n_words: str, n_repeat_words: str, rules: Rules = Rules()) -> Column:
    return (F.col(n_words) < rules.min_words) | (100 * F.col(n_repeat_words) > rules.max_repeat_percent * F.col(n_words))


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per document: doc_id, lang, source, COUNTS, base_failed, distance, kept."""
    counts = with_statistics(docs.select("doc_id", "lang", "source", "text"), [*COUNTS, "vector"]).drop("text")
    measured = written(counts.withColumn("base_failed", base_failed("n_words", "n_repeat_words", rules)), "quality-measured")
    return judged(measured, fit(measured, rules), {x: x for x in ("vector", "distance", "kept", "base_failed")}, rules).drop("vector")


def keep_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` that pass, with their columns. The text is measured again instead of shuffled."""
    narrow = with_statistics(docs.select("lang", "source", "text"), [*COUNTS, "vector"]).drop("text")
    fits = fit(written(narrow.withColumn("base_failed", base_failed("n_words", "n_repeat_words", rules)), "quality-measured"), rules)
    names = dict(zip([*COUNTS, "vector", "distance", "kept", "base_failed"], fresh(docs, *(f"quality_{x}" for x in (*COUNTS, "vector", "distance", "kept", "base_failed")))))
    measured = with_statistics(docs, [names[x] for x in (*COUNTS, "vector")])
    measured = measured.withColumn(names["base_failed"], base_failed(names["n_words"], names["n_repeat_words"], rules))
    return judged(measured, fits, names, rules).where(F.col(names["kept"])).select(*docs.columns)


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
