"""A store of keyed rows for streams: sorted runs of files, read by key range and merged as they add up.

Every micro-batch adds one run, whose files hold disjoint ranges of the keys' hashes. Where
``FAN`` runs of one level have come together they are merged into one of the next level, so a
store of n batches has about FAN * log n runs, and each row is written log n times. A manifest per
batch lists the live files with their ranges. A batch reads the manifest of the batch before it
and replaces its own run and manifest, so it can be repeated after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from provisor.session import cut_lineage, exists

MANIFEST = "file string, low long, high long, rows long, level int, run string"
#: Runs of a level that are merged, rows of a file, and slots of the hash range by which files are found.
FAN, FILE_ROWS, SLOTS = 8, 250_000, 4_096


class KeyedLog:
    """Rows of ``schema`` under ``root``, looked up by ``key``; a key may have several rows."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: StructType):
        self.spark, self.root, self.key, self.schema = spark, root, key, schema

    def _manifest(self, before: int) -> DataFrame:
        """Live files as batches before ``before`` left them."""
        path = f"{self.root}/manifest"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], MANIFEST)
        if exists(self.spark, f"{path}/batch={before - 1}"):
            return self.spark.read.schema(MANIFEST).parquet(f"{path}/batch={before - 1}")
        told = self.spark.read.schema(MANIFEST + ", batch long").parquet(path).where(F.col("batch") < before)
        return told.where(F.col("batch") == (told.agg(F.max("batch")).first()[0] or 0)).drop("batch")

    def files_for(self, keys: DataFrame, before: int) -> list[str]:
        """Files that can hold one of ``keys``; the list is bounded by the number of live files."""
        hashes = keys.select(F.xxhash64(self.key).alias("h")).distinct().withColumn("slot", F.floor(F.col("h") / (1 << 52)))
        slots = F.explode(F.sequence(F.floor(F.col("low") / (1 << 52)), F.floor(F.col("high") / (1 << 52))))
        files = self._manifest(before).select("file", "low", "high", slots.alias("slot"))
        hit = files.join(hashes, "slot").where("h between low and high").select("file").distinct()
        return sorted(r.file for r in hit.collect())

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """Rows whose key is among ``keys``, as batches before ``before`` stored them."""
        files = self.files_for(keys, before)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _write(self, rows: DataFrame, name: str, level: int) -> DataFrame:
        n = rows.count()
        if not n:
            return self.spark.createDataFrame([], MANIFEST)
        place = F.xxhash64(self.key)
        path = f"{self.root}/runs/{name}"
        rows.select(*self.schema.names).repartitionByRange(-(-n // FILE_ROWS), place).sortWithinPartitions(place).write.mode("overwrite").parquet(path)
        held = self.spark.read.schema(self.schema).parquet(path).select("_metadata.file_path", place.alias("h"))
        return held.groupBy(F.col("file_path").alias("file")).agg(
            F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("rows")).select(
            "*", F.lit(level).alias("level"), F.lit(name).alias("run"))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store ``rows`` as the run of ``batch_id``, merge full levels, publish the batch's manifest."""
        live = cut_lineage(self._manifest(batch_id).unionByName(self._write(rows, f"b{batch_id}-0", 0)), "manifest")
        level = 0
        while live.where(F.col("level") == level).select("run").distinct().count() >= FAN:
            old = [r.file for r in live.where(F.col("level") == level).select("file").collect()]
            merged = self._write(self.spark.read.schema(self.schema).parquet(*old), f"b{batch_id}-{level + 1}", level + 1)
            live = cut_lineage(live.where(F.col("level") != level).unionByName(merged), "manifest")
            level += 1
        live.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch_id}")

    def read(self, before: int) -> DataFrame:
        """All rows that batches before ``before`` stored."""
        files = [r.file for r in self._manifest(before).select("file").collect()]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
