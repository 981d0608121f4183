"""The pipeline: each stage on what the one before kept, against plain versions where they are exact."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from tests.conftest import DATA
from tests.llm.test_llm import plain_components, plain_lines


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, before = {}, docs
    for name, stage in pipeline.STAGES:
        kept[name] = stage(spark, before, DATA).cache()
        if name != pipeline.STAGES[-1][0]:
            assert kept[name].columns == list(pipeline.COLUMNS)
            assert kept[name].where(F.length("text") != F.col("n_chars")).count() == 0
        before = kept[name]
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    first = rows(kept["language ID"])
    second = sorted((i, t) for i, _, _, t in plain_lines(first))
    assert rows(kept["line dedup"]) == second
    alone = {i for i, _, c in plain_components(second) if i == c}
    assert [i for i, _ in rows(kept["n-gram Jaccard join"])] == sorted(alone)
    fourth = rows(kept["benchmark decontamination"])
    assert {i for i, _ in fourth} <= alone and len(fourth) > 0.9 * len(alone)
    again = pipeline.STAGES[3][1](spark, kept["benchmark decontamination"], DATA)
    assert rows(again) == fourth
    last = kept["mixing sources"]
    assert last.count() == len(fourth) and last.where("taken > 3 * size").count() == 0


def test_short_items_are_cut(spark, tmp_path):
    spark.createDataFrame([(1, "Paris is nice"), (2, " ".join(f"w{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = " ".join(f"o{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"{own} paris, is nice {own}", "en", "s", 0), (2, f"{own} paris is not nice", "en", "s", 0), (3, f"{own} w1 w2 w3 {own}", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text.split() for r in pipeline.benchmark(spark, docs, str(tmp_path)).collect()}
    assert got[1] == [*own.split(), *own.split()]
    assert got[2] == [*own.split(), "paris", "is", "not", "nice"] and got[3] == [*own.split(), "w1", "w2", "w3", *own.split()]
