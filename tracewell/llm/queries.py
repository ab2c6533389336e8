"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tracewell.llm import alignment, decontamination, jaccard, licenses, onebit, pieces, pii, quality, ranking, secret_scan, sharding, toxicity, warc
from tracewell.llm.text import importable

Query = Callable[[SparkSession, str], DataFrame]


def _ready(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(importable(spark), sf_dir)

    return run


QUERIES: dict[str, Query] = {
    "op1_warc_packages": _ready(warc.op1_warc_packages),
    "op2_minimax_shards": _ready(sharding.op2_minimax_shards),
    "op3_license_scan": _ready(licenses.op3_license_scan),
    "op4_pii": _ready(pii.op4_pii),
    "op5_decontamination": _ready(decontamination.op5_decontamination),
    "op6_secrets": _ready(secret_scan.op6_secrets),
    "op7_toxicity": _ready(toxicity.op7_toxicity),
    "op8_near_duplicates": _ready(jaccard.op8_near_duplicates),
    "op9_sentencepiece": _ready(pieces.op9_sentencepiece),
    "op10_quality_outliers": _ready(quality.op10_quality_outliers),
    "op11_nearest": _ready(onebit.op11_nearest),
    "op12_ranked_search": _ready(ranking.op12_ranked_search),
    "op13_alignment": _ready(alignment.op13_alignment),
    "pipeline": _ready(corpus_pipeline.run),
}

ORACLE: dict[str, str] = {"op1_warc_packages": warc.SQL, "op5_decontamination": decontamination.SQL, "op12_ranked_search": ranking.SQL}
