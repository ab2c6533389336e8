"""Rounding, buckets, display formats and text matching."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import scalars as S


def column(spark, values, kind, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_cents_are_exact(spark):
    # nano-dollars on both sides of half a cent
    nano = [0, 4_999_999, 5_000_000, 15_000_000, 1_005_000_000, 1_004_999_999, 2_675_000_000, None]
    assert column(spark, nano, "bigint", S.usd) == [0.0, 0.0, 0.01, 0.02, 1.01, 1.0, 2.68, None]


def test_ratio_rounding(spark):
    rows = spark.createDataFrame(
        [(1, 3), (1, 8), (5, 2), (-5, 2), (5, 0), (None, 1), (1, None), (0, 7), (-1, 3), (10**15, 3)], "n bigint, d bigint"
    )
    got = [
        tuple(r)
        for r in rows.select(
            S.ratio_round(F.col("n"), F.col("d"), 2).alias("a"), S.ratio_round(F.col("n"), F.col("d"), 0).alias("b"),
            S.ratio_round(F.col("n"), F.col("d"), 1, percent=True).alias("c"),
        ).collect()
    ]
    assert got == [
        (0.33, 0.0, 33.3), (0.13, 0.0, 12.5), (2.5, 3.0, 250.0), (-2.5, -3.0, -250.0), (None, None, None), (None, None, None),
        (None, None, None), (0.0, 0.0, 0.0), (-0.33, 0.0, -33.3), (333333333333333.33, 333333333333333.0, 33333333333333333.3),
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(1, 10**12)), min_size=50, max_size=50))
def test_ratio_matches_exact_arithmetic(spark, pairs):
    rows = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(pairs)], "i int, n bigint, d bigint")
    got = rows.select("i", S.ratio_round(F.col("n"), F.col("d"), 1, percent=True).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [((2000 * n + d) // (2 * d)) / 10 for n, d in pairs]


def test_rates():
    assert S.nano_rate(0.25) == 250 and S.nano_rate(15.0) == 15000 and S.nano_rate(2.7) == 2700
    with pytest.raises(ValueError):
        S.nano_rate(0.0001)


def test_human_counts(spark):
    n = [None, 0, 999, 1000, 1499, 1500, 2500, 999_499, 999_500, 1_250_000, 1_340_000, 12_345_678]
    assert column(spark, n, "bigint", S.human_count) == [
        "0", "0", "999", "1K", "1K", "2K", "2K", "999K", "1000K", "1.2M", "1.3M", "12.3M",
    ]
    up = lambda c: S.human_count(c, ties="up")
    assert column(spark, n, "bigint", up)[3:] == ["1K", "1K", "2K", "3K", "999K", "1000K", "1.3M", "1.3M", "12.3M"]
    assert column(spark, [12.4, 12.5, 999.4], "double", up) == ["12", "13", "999"]


def test_money_and_labels(spark):
    assert column(spark, [None, 0.0, 1234.5], "double", S.money) == ["$0", "$0.00", "$1234.50"]
    names = ["-home-user-project-with-long-name", ".dot", "plain", "--two", None]
    assert column(spark, names, "string", S.clean_label) == ["home-user-project-wi", "dot", "plain", "-two", ""]


def test_buckets(spark):
    assert column(spark, [0, 3, 4, 10, 11, 30, 31, None], "int", S.message_bucket) == [
        "abandoned", "abandoned", "short", "short", "medium", "medium", "long", "long",
    ]
    assert column(spark, ["x" * 49, "x" * 50, "é" * 199, "x" * 200], "string", S.prompt_bucket) == [
        "short", "medium", "medium", "detailed",
    ]


def test_model_family(spark):
    names = ["x-Opus-4", "sonnet", "haiku-3", "other", None]
    assert column(spark, names, "string", S.model_family) == ["opus", "sonnet", "haiku", None, None]


TEXTS = ["x", "50% off", "a_b", "A\\B", "Éon", None]


@pytest.mark.parametrize(
    "query, wild, literal",
    [
        ("%", [0, 1, 2, 3, 4], [1]),
        ("_b", [2, 3], [2]),
        ("a\\b", [3], [3]),
        ("\\", [3], [3]),
        ("éO", [4], [4]),
        ("0% O", [1], [1]),
        ("a%b", [2, 3], []),
        ("~", [], []),
    ],
)
def test_matching(spark, query, wild, literal):
    hit = lambda fn: [i for i, v in enumerate(column(spark, TEXTS, "string", fn)) if v]
    assert hit(lambda c: S.matches(c, query)) == wild
    assert hit(lambda c: S.matches(c, query, literal=True)) == literal


def test_wrong_arguments(spark):
    with pytest.raises(ValueError):
        S.matches(F.col("v"), "")
    with pytest.raises(ValueError):
        S.day_before(dt.date(2024, 1, 1), 0)
    with pytest.raises(ValueError):
        S.human_count(F.col("v"), ties="down")
