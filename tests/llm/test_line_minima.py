from pyspark.sql import functions as F

from provisor.llm.lines import BINS, LINE_BYTES, _halves, grams, split_lines
from provisor.session import scratch
from tests.llm.helpers import corpus, frame


def test_minima_are_gathered_without_objects_and_places_found_at_once(spark):
    lines = split_lines(frame(spark, corpus(n=12)).select("doc_id", "text").where("text is not null")).select("lid", "line")
    halves = _halves(lines)
    plan = halves._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_list" not in plan
    assert all(len(r.halves) == BINS and None not in r.halves for r in halves.collect())


def test_long_lines_and_bad_bytes_have_a_shingle_at_each_place(spark):
    odd = spark.sql("select repeat('abé\U0001f600', 100000) as line union all select cast(X'80FF4142' as string)")
    assert sorted(r.n for r in odd.select(F.size(grams(F.col("line"))).alias("n")).collect()) == [1, 399_996]


def test_tasks_of_a_block_are_bounded_and_the_session_keeps_its_own(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    with scratch(spark, LINE_BYTES):
        assert int(spark.conf.get(name)) == LINE_BYTES
    assert spark.conf.get(name) == before
