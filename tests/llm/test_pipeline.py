"""The pipeline, stage by stage, on the smallest test tables; and its registration."""

import os

import pytest

import corpus_pipeline
from quillon.llm import mixing, neardup, pieces, queries, substring
from quillon.runtime import table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns and docs.schema == spark.createDataFrame([], before.schema).schema
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2] and seen[5] >= seen[4]
    kept = spark.read.parquet(f"{tmp_path}/1")
    assert neardup.near_duplicates(kept).filter("not kept").count() == 0
    assert substring.deduplicate(spark.read.parquet(f"{tmp_path}/2"), inner=False).filter("n_removed > 0").count() == 0
    mixed, source = spark.read.parquet(f"{tmp_path}/3"), spark.read.parquet(f"{tmp_path}/2")
    assert mixed.exceptAll(mixing.mix(source).select(*columns)).count() == 0
    out = spark.read.parquet(f"{tmp_path}/4")
    assert out.filter("not round_trip").count() == 0
    assert pieces.decode(out, ["doc_id"]).join(mixed.select("doc_id", mixed["text"].alias("t")), "doc_id").filter("text <> t").count() == 0


def test_names_are_registered_once():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["quality classifier", "MinHash near-dedup"]
