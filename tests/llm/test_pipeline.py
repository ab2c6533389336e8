from __future__ import annotations

import corpus_pipeline as C
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_jaccard import brute as near
from tracewell.llm import pieces, pii, quality
from tracewell.llm.queries import ORACLE, QUERIES


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLE) <= set(QUERIES)


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in quality.quality(docs).where("kept").join(docs.select("doc_id", "text"), "doc_id").collect()}
    _, find = near(left.values())
    groups: dict[str, list[int]] = {}
    for i, t in left.items():
        groups.setdefault(find(t), []).append(i)
    left = {min(g): left[min(g)] for g in groups.values()}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, t in list(left.items()):
        n_words, n_hit, _ = contaminated(t, items)
        if n_hit and 20 * n_hit >= n_words:
            del left[i]
    model = pieces.load()
    rows = C.run(spark, sf).collect()
    assert {r["doc_id"]: pieces.decode_ids(model, r["ids"]) for r in rows} == {i: pii.masked(t) for i, t in left.items()}


def test_edges_run_through_all_stages(spark, tmp_path):
    """No documents, null and empty texts, repeated rows, extra columns with the names that stages use."""
    good = [" ".join(f"w{i}x{k}" for k in range(70)) for i in range(3)]
    rows = [(1, good[0]), (1, good[0]), (2, None), (3, ""), (None, good[1]), (4, good[2] + " mail a@b.example"), (5, "short")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "k", "q") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, mean string")
    spark.createDataFrame([(1, "no such passage"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    out = {r["doc_id"]: r["n_ids"] for r in C.run(spark, f"{tmp_path}/sf").collect()}
    assert set(out) == {None, 1, 4} and all(out.values())
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/sf/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(20), sf).columns == docs.columns
