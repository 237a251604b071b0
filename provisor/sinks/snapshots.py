"""Versioned catalog snapshots.

A writer claims the next version, writes its tables into a folder of its own, and publishes the
version by moving one small file into the log. Readers follow the log, so they see the version
before until then, whole. A claim without a published version belongs to a writer that is at work
or has died: after ``lease`` seconds another writer may take the version over with a claim of the
next number, and the former one can then no longer publish. What a dead writer left behind is in
its own folder and in nobody's way.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from provisor.operators.catalog import table_counts
from provisor.operators.changes import changed_rows, snapshot_diff
from provisor.session import exists

LOG_SCHEMA = "version long, written_at timestamp, input_filename string, input_sha256 string, ingredient_count long, rule_count long, folder string"


class SnapshotBusy(RuntimeError):
    """Another writer holds the version."""


def versions(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/log"):  # nothing published yet
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).json(f"{root}/log")


def current_version(spark: SparkSession, root: str) -> int:
    return versions(spark, root).agg(F.max("version")).first()[0] or 0


def read_current(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    newest = versions(spark, root).agg(F.max_by("folder", "version")).first()[0]
    if not newest:
        raise ValueError(f"no snapshot under {root}")
    return {n: spark.read.parquet(f"{root}/{newest}/{n}") for n in names}


class _Files:
    """The few file operations of the protocol, in any file system that Spark can use."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str = "") -> None:
        """A new file; fails if there is one."""
        out = self.fs.create(self.path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def names(self, folder: str) -> dict[str, int]:
        """File names of a folder with their times, in milliseconds."""
        if not self.fs.exists(self.path(folder)):
            return {}
        return {f.getPath().getName(): f.getModificationTime() for f in self.fs.listStatus(self.path(folder))}

    def move(self, name: str, to: str) -> bool:
        target = self.path(to)
        self.fs.mkdirs(target.getParent())
        return not self.fs.exists(target) and self.fs.rename(self.path(name), target)


def _claims(files: _Files, version: int) -> dict[int, int]:
    """Numbers and times of the claims to a version."""
    return {int(name.split(".")[1]): at for name, at in files.names("claims").items() if name.startswith(f"v{version:08d}.")}


def _claim(files: _Files, version: int, lease: float) -> int:
    """Claim a version; a claim younger than ``lease`` seconds is respected."""
    held = _claims(files, version)
    if held and time.time() - max(held.values()) / 1000 < lease:
        raise SnapshotBusy(f"version {version} is being written")
    number = max(held, default=-1) + 1
    try:
        files.create(f"claims/v{version:08d}.{number}")
    except Exception as taken:
        if number not in _claims(files, version):
            raise
        raise SnapshotBusy(f"version {version} was claimed at the same time") from taken
    return number


def write_snapshot(tables: dict[str, DataFrame], root: str, filename: str = "", file_sha256: str = "", lease: float = 6 * 3600) -> dict[str, int]:
    """Write all tables as a new version, check their counts, then publish it.

    Each table is computed once: its rows are counted while they are written. A write that fails
    gives its claim up; one that dies keeps it for ``lease`` seconds (see the module). Raises
    ``SnapshotBusy`` while another writer holds the version, or where one took it over.
    """
    spark = next(iter(tables.values())).sparkSession
    version, files = current_version(spark, root) + 1, _Files(spark, root)
    number = _claim(files, version, lease)
    folder = f"v{version:08d}-{number}"
    try:
        expected = {}
        for name, df in tables.items():
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(f"{root}/{folder}/{name}")
            expected[name] = seen.get["rows"]
        written = {n: spark.read.schema(df.schema).parquet(f"{root}/{folder}/{n}") for n, df in tables.items()}
        actual = {r.table_name: r.rows for r in table_counts(written).collect()}
        if actual != expected:
            raise ValueError(f"row counts changed while writing: {expected} != {actual}")
        row = {"version": version, "written_at": dt.datetime.now(dt.timezone.utc).isoformat(), "input_filename": filename, "input_sha256": file_sha256,
               "ingredient_count": expected.get("ingredients", 0), "rule_count": expected.get("ingredient_rules", 0), "folder": folder}
        ready = f"claims/ready-{uuid.uuid4().hex}"
        files.create(ready, json.dumps(row))
        if max(_claims(files, version)) != number or not files.move(ready, f"log/v{version:08d}.json"):
            raise SnapshotBusy(f"version {version} was taken over")
    except Exception:
        _give_up(files, version, number)
        raise
    return expected


def _give_up(files: _Files, version: int, number: int) -> None:
    """Date a claim back, so that the next writer need not wait."""
    files.fs.setTimes(files.path(f"claims/v{version:08d}.{number}"), 0, -1)


def load_if_empty(tables: dict[str, DataFrame], root: str) -> str:
    """Load a first snapshot; keep a usable one; refuse a filled one without active ingredients."""
    spark = next(iter(tables.values())).sparkSession
    if not current_version(spark, root):
        write_snapshot(tables, root, "bootstrap")
        return "loaded"
    stored = read_current(spark, root, list(tables))
    if sum(r.rows for r in table_counts(stored).collect()) == 0:
        write_snapshot(tables, root, "bootstrap")
        return "loaded"
    if stored["ingredients"].where("is_active").limit(1).count() == 0:
        raise ValueError("catalog is partly filled or has no active ingredient; review it by hand")
    return "preserved"


def apply_additions(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, str], root: str) -> dict[str, int]:
    """Write a snapshot with additions and changes only; a missing row is an error.

    Returns the changed rows per table. The written version is read again and must equal the
    wanted one.
    """
    counts = {}
    for name, key in keys.items():
        if snapshot_diff(before[name], after[name], key).where("change = 'deleted'").limit(1).count():
            raise ValueError(f"additions must not delete rows: {name}")
        counts[name] = changed_rows(before[name], after[name], key).count()
    if any(counts.values()):
        write_snapshot(after, root, "additions")
        spark = next(iter(after.values())).sparkSession
        stored = read_current(spark, root, list(after))
        for name in keys:
            if stored[name].exceptAll(after[name]).limit(1).count() or after[name].exceptAll(stored[name]).limit(1).count():
                raise ValueError(f"written rows differ: {name}")
    return counts


def backup(df: DataFrame, path: str) -> None:
    """Copy of rows before a change; an existing copy is never overwritten."""
    df.write.mode("error").parquet(path)
