import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.helpers import words


def test_stages_over_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "mixture", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut_lineage(stage(spark, before, folder), name)
        if name != "packing":
            assert after.columns == columns
        if name == "quality":
            kept = {r.doc_id for r in after.select("doc_id").collect()}
            assert all(i in kept for i, q in labels.items() if q == 1)
        if name == "line_dedup":
            lines = [x for r in after.collect() for x in r.text.split("\n") if x.strip()]
            assert len(lines) == len(set(lines)) and after.count() == before.count()
        if name == "mixture":
            assert sum(len(words(r.text)) for r in after.collect()) <= 3 * sum(len(words(r.text)) for r in before.collect())
        before = after
    assert before.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
