"""Building blocks that keep one hot key from landing in one task.

Aggregates use numeric buffers, so they combine on the map side. Ordered work inside a key
(numbering, previous row, exact percentiles) is cut into ordered buckets first: only one short
summary row per bucket is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provisor.session import ship


def numbered(
    df: DataFrame, keys: list[str], bucket: Column, order: list, out: str, start: int = 1
) -> DataFrame:
    """``row_number`` per key without one task per key.

    ``bucket`` must not decrease along ``order``. Rows are ordered inside (key, bucket); the
    offset of a bucket is the running count of the buckets before it.
    """
    marked = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = marked.withColumn("_rank", F.row_number().over(inside))
    return (
        local.join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_rank") + F.col("_offset") + (start - 1)).cast("long"))
        .drop("_bucket", "_rank", "_offset")
    )


def running_total(
    df: DataFrame, keys: list[str], bucket: Column, order: str, value: Column, out: str
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``, current row included, cut into buckets."""
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_s"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_run", F.sum("_value").over(inside))
    return local.join(offsets, [*keys, "_bucket"]).withColumn(out, F.col("_run") + F.col("_offset")).drop(
        "_bucket", "_value", "_run", "_offset")


def previous_value(
    df: DataFrame, keys: list[str], bucket: Column, order: str, value: str, out: str
) -> DataFrame:
    """``lag(value)`` per key, cut into buckets.

    Inside a bucket the window function is used; the first row of a bucket takes the last value
    of the nearest earlier bucket of its key.
    """
    marked = df.withColumn("_bucket", bucket)
    tails = marked.groupBy(*keys, "_bucket").agg(F.max_by(value, order).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket")
    tails = tails.select(*keys, "_bucket", F.lag("_tail").over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    local = marked.withColumn("_lag", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    return (
        local.join(tails, [*keys, "_bucket"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
        .drop("_bucket", "_before", "_lag", "_first")
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], width: float
) -> DataFrame:
    """Nearest-rank percentiles per key, exact, with bounded work per task.

    First pass: counts per (key, value range of ``width``) give the range that holds each rank.
    Second pass: only the rows of those ranges are counted per value. Null values do not count.
    Keys without any value are absent.
    """
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_range")
    )
    along = Window.partitionBy(*keys).orderBy("_range")
    whole = Window.partitionBy(*keys)
    ranges = (
        rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(whole))
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(p))).alias("rank"))
        for name, p in fractions.items()
    ]))
    targets = (
        ranges.select("*", wanted.alias("_t"))
        .where((F.col("_t.rank") <= F.col("_upto")) & (F.col("_t.rank") > F.col("_upto") - F.col("_n")))
        .select(*keys, "_range", F.col("_t.name").alias("_name"),
                (F.col("_t.rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    values = (
        rows.join(targets.select(*keys, "_range").distinct(), [*keys, "_range"], "left_semi")
        .groupBy(*keys, "_range", "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(
            Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    )
    picked = values.join(targets, [*keys, "_range"]).where(F.col("_upto") >= F.col("_rank"))
    return picked.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in fractions
    ])


def complete_sum(value: Column, counted: Column | None = None) -> Column:
    """Sum that is null unless every counted row has a value and there is at least one."""
    counted = F.lit(True) if counted is None else counted
    return F.when(
        (F.count_if(counted & value.isNull()) == 0) & (F.count_if(counted) > 0),
        F.sum(F.when(counted, value)),
    )


def round_half_even(value: Column, digits: int) -> Column:
    """Round a double like Python's ``round``: in binary arithmetic, ties to even."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def scan_in_order(df: DataFrame, keys: list[str], order: list[str], scan, schema: str) -> DataFrame:
    """Sequential pass per key over sorted partitions in bounded memory.

    ``scan`` gets the Arrow batches of one partition in (key, order) sequence and carries its own
    small state; the sort spills to disk, so no key is ever collected.
    """
    ship(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)
