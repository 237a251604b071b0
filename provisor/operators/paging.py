"""Pages far into an ordered set, read from the ranges that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provisor.session import shared_dir

#: Rows of a range, and ranges up to which smaller ones are written; each range costs a task and a folder.
RANGE_ROWS, MOST_RANGES = 1_000_000, 256


class OrderedPages:
    """Rows in a total order, written once in ranges with the number of rows before each.

    ``order`` holds names or sort expressions over the columns of ``rows``; it must end in a unique
    column, so equal leading values spread over several ranges. A page reads the ranges that it
    meets and sorts nothing else, however deep it lies. One range is one task's sort. ``range_rows`` below
    ``RANGE_ROWS`` holds up to ``MOST_RANGES`` ranges; more rows make these longer.
    """

    def __init__(self, rows: DataFrame, order: list[str | Column], name: str = "pages", range_rows: int = RANGE_ROWS):
        self.spark, self.order, self.columns = rows.sparkSession, order, rows.columns
        self.folder = shared_dir(self.spark, name)
        n = rows.count()
        parts = max(1, min(-(-n // range_rows), max(MOST_RANGES, -(-n // RANGE_ROWS))))
        placed = rows.repartitionByRange(parts, *order).select(
            F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.spark_partition_id().alias("range_no"))
        placed.write.partitionBy("range_no").parquet(f"{self.folder}/rows")
        self.schema = placed.schema
        before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
        self._stored().groupBy("range_no").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "start", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{self.folder}/starts")
        self.starts = self.spark.read.parquet(f"{self.folder}/starts")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order; fewer or none beyond its end."""
        met = self.starts.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).select("range_no", "start").collect()
        rows = self._stored().where(F.col("range_no").isin([r.range_no for r in met])).select("row.*")
        inside = offset - min((r.start for r in met), default=offset)
        return rows.orderBy(*self.order).offset(inside).limit(limit)
