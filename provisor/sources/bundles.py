"""Multi-table JSON bundles with fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from provisor.operators.quality import column_contract, union_all
from provisor.schemas import BUNDLE_COLUMNS, BUNDLE_VERSION, bundle_schema


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One frame per table of the bundle documents under ``path``; malformed input fails."""
    docs = spark.read.schema(bundle_schema()).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return {t: docs.select(F.inline(t)) for t in BUNDLE_COLUMNS} | {"metadata": docs.select("metadata.*")}


def bundle_contract(spark: SparkSession, path: str) -> DataFrame:
    """Violations of the exact column lists: reads the keys the documents really have."""
    docs = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    parts = [column_contract("bundle", docs.drop("metadata"), list(BUNDLE_COLUMNS), flat=False)]
    for table, columns in BUNDLE_COLUMNS.items():
        if table in docs.columns and docs.schema[table].dataType.simpleString().startswith("array<struct"):
            parts.append(column_contract(table, docs.select(F.inline(table)), columns.split()))
    return union_all(parts)


def require_version(bundle: dict[str, DataFrame]) -> None:
    """Guard with an action: only the supported bundle version is accepted."""
    versions = {r.schema_version for r in bundle["metadata"].distinct().limit(2).collect()}
    if versions != {BUNDLE_VERSION}:
        raise ValueError(f"unsupported bundle version: {versions}")
