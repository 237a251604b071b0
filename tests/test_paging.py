from pyspark.sql import functions as F

from conftest import frame
from provisor.operators import paging
from provisor.operators.paging import OrderedPages

SCHEMA = "name string, id long, row string, range_no int"


def test_pages_cover_the_order(spark):
    """Equal leading values, nulls and columns named like the stored ones; every row on one page."""
    rows = frame(spark, SCHEMA, *[("same" if i % 3 else None, i, f"r{i}", i) for i in range(200)])
    order = [F.col("name"), F.desc("id")]
    pages = OrderedPages(rows, order, range_rows=16)
    want = [r.id for r in rows.orderBy(*order).collect()]
    got = [r.id for start in range(0, 220, 37) for r in pages.page(37, start).collect()]
    assert got == want and pages.page(5, 10).columns == rows.columns
    assert pages.page(5, 10_000).isEmpty()


def test_a_page_reads_its_ranges(spark):
    rows = spark.range(10_000).withColumn("name", F.sha1(F.col("id").cast("string")))
    pages = OrderedPages(rows, ["name", "id"], range_rows=500)
    page = pages.page(20, 7_000)
    assert {f.split("range_no=")[1].split("/")[0] for f in page.inputFiles()} >= {str(r.range_no) for r in pages.starts.where("start <= 7000 and start + n > 7000").collect()}
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range_no" in plan or "PartitionFilters: [range_no" in plan
    scanned = pages.starts.where("start < 7020 and start + n > 7000").agg(F.sum("n")).first()[0]
    assert scanned < 2_000 and page.count() == 20


def test_empty_table(spark):
    assert OrderedPages(spark.createDataFrame([], SCHEMA), ["id"]).page(10).isEmpty()


def test_short_ranges_stay_few(spark, monkeypatch):
    """Ranges of a fixed few rows made a task and a folder for every few rows of a large set."""
    monkeypatch.setattr(paging, "MOST_RANGES", 8)
    pages = paging.OrderedPages(spark.range(2000).withColumn("k", F.col("id") % 3), [F.desc("k"), "id"], "few-ranges", 2)
    assert pages.starts.count() <= 8
    want = sorted(((i % 3, i) for i in range(2000)), key=lambda r: (-r[0], r[1]))
    assert [(r.k, r.id) for r in pages.page(50, 660).collect()] == want[660:710]
    assert [(r.k, r.id) for r in pages.page(50, 1990).collect()] == want[1990:]
