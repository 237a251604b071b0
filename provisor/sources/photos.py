"""Photo files: size, hash and type by signature; conflicting uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_BYTES = 12 * 1024 * 1024
SUFFIXES = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (photo_id, content); the identifier is the file name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("photo_id"), "content")


def from_base64(rows: DataFrame, value: str = "image_base64") -> DataFrame:
    """Decode base64 values, with or without a data-URL head; broken ones become null."""
    return rows.withColumn("content", F.try_to_binary(F.substring_index(value, ",", -1), F.lit("base64"))).drop(value)


def media_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp"))


def manifest(photos: DataFrame) -> DataFrame:
    """Size, hash, type and outcome of every photo."""
    size = F.octet_length("content")
    rows = photos.withColumns({"size_bytes": size, "sha256": F.sha2("content", 256), "mime_type": media_type(F.col("content"))})
    return rows.withColumn(
        "outcome", F.when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty").when(F.col("size_bytes") > MAX_BYTES, "too_large")
        .when(F.col("mime_type").isNull(), "unknown_type").otherwise("accepted")).drop("content")


def conflicts(listed: DataFrame) -> DataFrame:
    """Identifiers used for more than one content."""
    return listed.groupBy("photo_id").agg(F.min("sha256").alias("_a"), F.max("sha256").alias("_b")).where("_a <> _b").select("photo_id")


def export_manifest(photos: DataFrame, files: DataFrame, include: bool) -> DataFrame:
    """Manifest beside an export: expected file name, available, included."""
    suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    have = files.select("photo_id").distinct().withColumn("_have", F.lit(True))
    rows = photos.join(have, "photo_id", "left").withColumn("available", F.coalesce("_have", F.lit(False)))
    name = F.concat(F.lit("photos/"), F.col("run_id").cast("string"), F.lit("/"), F.col("photo_id").cast("string"), suffix[F.col("mime_type")])
    return rows.select("photo_id", "run_id", "sha256", name.alias("file"), "available", (F.col("available") & F.lit(include)).alias("included"))
