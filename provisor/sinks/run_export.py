"""Whole runs as nested JSON: run, case, events, tasks, exclusion log, summary, and the aggregates of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provisor.operators.experiments import MAX_EVENTS
from provisor.session import cut_lineage

# Limits of one export.
MAX_RUNS = 200
MAX_BYTES = 32 * 1024 * 1024

SECTIONS = ("run", "case", "events", "tasks", "exclusion_audit", "measured_summary", "aggregates")


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def _single(df: DataFrame, section: str, run: Column) -> DataFrame:
    return df.select(run.alias("run_id"), F.lit(section).alias("section"), F.lit(1).cast("long").alias("no"), _json(df).alias("item"))


def _listed(df: DataFrame, section: str, bucket: Column, order: list[Column]) -> DataFrame:
    """Rows numbered per run along ``order``; only bucket sizes meet per run, so a long log is no single task's work.

    Rows move to their bucket as they are; their JSON, which is longer, is made there.
    """
    taken, free = {c.lower() for c in df.columns}, "_"
    while any(c.startswith(free) for c in taken):
        free += "_"
    at, keys = f"{free}bucket", [f"{free}order{i}" for i in range(len(order))]
    rows = df.where("run_id is not null").withColumn(at, bucket)
    before = Window.partitionBy("run_id").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("run_id", at).agg(F.count(F.lit(1)).alias(f"{free}n"))
    sizes = sizes.select("run_id", at, F.coalesce(F.sum(f"{free}n").over(before), F.lit(0)).alias("offset"))
    items = rows.repartition("run_id", at).select("run_id", at, *[c.alias(k) for c, k in zip(order, keys)], _json(df).alias("item"))
    inside = Window.partitionBy("run_id", at).orderBy(*keys, "item")
    ranked = items.select("run_id", at, "item", F.row_number().over(inside).alias("rank")).join(sizes, ["run_id", at])
    return ranked.select(F.col("run_id").cast("string").alias("run_id"), F.lit(section).alias("section"),
                         (F.col("rank") + F.col("offset")).cast("long").alias("no"), "item")


def export_parts(
    runs: DataFrame, cases: DataFrame, events: DataFrame, tasks: DataFrame, exclusion_audit: DataFrame, summaries: DataFrame,
    aggregates: DataFrame | None = None, include_excluded: bool = False, part_rows: int = MAX_EVENTS,
) -> DataFrame:
    """(run_id, section, part_no, rows, bytes, items): every row of every chosen run, as JSON in order.

    Children come with ``run_id``; events are in order of source and seq, tasks of ``requested_at`` and
    ``task_no``, the exclusion log of ``id``, equal ones by their text. A list of more than ``part_rows``
    rows goes on in further parts, so no row of the result grows with its run. Runs excluded from the
    analysis are left out unless ``include_excluded``; rows without a run belong to none. ``run_id`` is
    text here, and null for the ``aggregates`` of the whole export.
    """
    chosen = runs.where("run_id is not null")
    if not include_excluded:
        chosen = chosen.where(~F.coalesce("excluded_from_analysis", F.lit(False)))
    ids = chosen.select("run_id")
    mine = lambda df: df.join(ids, "run_id", "left_semi").select(*df.columns)
    of_run = F.col("run_id").cast("string")
    # The case is packed before the join, so clashing names of both sides stay apart.
    packed = cases.select(F.col("case_id"), _json(cases).alias("item"))
    case_rows = chosen.select("run_id", "case_id").join(packed, "case_id").select(
        of_run.alias("run_id"), F.lit("case").alias("section"), F.lit(1).cast("long").alias("no"), "item")
    source, seq = F.coalesce("source", F.lit("")), F.coalesce(F.col("seq").cast("long"), F.lit(-1))
    at = F.coalesce(F.unix_micros(F.col("requested_at").cast("timestamp")), F.lit(-(2**63)).cast("long"))
    parts = [
        _single(chosen, "run", of_run), case_rows,
        _listed(mine(events), "events", F.struct(source, F.floor(seq / 4096)), [source, seq]),
        _listed(mine(tasks), "tasks", F.floor(at / 86_400_000_000), [at, F.col("task_no")]),
        _listed(mine(exclusion_audit), "exclusion_audit", F.floor(F.coalesce("id", F.lit(-1)) / 4096), [F.coalesce("id", F.lit(-1))]),
        _single(mine(summaries), "measured_summary", of_run),
    ]
    if aggregates is not None:
        parts.append(_single(aggregates, "aggregates", F.lit(None).cast("string")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    grouped = rows.groupBy("run_id", "section", F.floor((F.col("no") - 1) / part_rows).alias("part_no")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("item").cast("long")).alias("bytes"), F.array_sort(F.collect_list(F.struct("no", "item"))).alias("sorted"))
    return grouped.select("run_id", "section", "part_no", "rows", "bytes", F.transform("sorted", lambda x: x["item"]).alias("items"))


def manifest(parts: DataFrame) -> DataFrame:
    """Parts, rows and bytes of every section of a run; what a reader needs to see that an export is whole."""
    return parts.groupBy("run_id", "section").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def write_export(parts: DataFrame, path: str, max_runs: int | None = MAX_RUNS, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Write parts by section and the manifest; returns the manifest.

    An export beyond a limit raises ``ValueError`` and writes nothing: it is never cut.
    """
    ready = cut_lineage(parts, "run-export")
    listed = cut_lineage(manifest(ready), "run-export-manifest")
    size = listed.agg(F.count_distinct("run_id").alias("runs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if max_runs is not None and size.runs > max_runs:
        raise ValueError(f"{size.runs} runs, at most {max_runs} in one export")
    if max_bytes is not None and size.bytes > max_bytes:
        raise ValueError(f"{size.bytes} bytes, at most {max_bytes} in one export")
    ready.write.mode("error").partitionBy("section").json(f"{path}/parts")
    listed.write.mode("error").json(f"{path}/manifest")
    return listed
