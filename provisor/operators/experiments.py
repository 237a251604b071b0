"""Timed scan runs: per-run metrics, condition groups, run changes and exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from provisor.operators.spread import complete_sum, exact_percentiles, numbered, previous_value, round_half_even

# Limits of the experiment tables.
MAX_EVENTS = 5000            # sequence numbers of a run and source are below this
MAX_RELATIVE_MS = 3_600_000  # event times lie within one hour
GRACE_MS = 15_000
HEARTBEAT_SECONDS = 180
RECALL_SUCCESS = 0.8

SUMMED = (
    "ocr_worker_ms", "ocr_cpu_time_ms", "ocr_python_thread_cpu_ms", "tesseract_child_cpu_time_ms",
    "shared_process_cpu_delta_ms",
)
PEAKS = ("tesseract_child_rss_peak_bytes", "ocr_process_tree_rss_peak_bytes", "shared_process_rss_peak_bytes")
GAPS = {
    "barcode_decode_ms": ("barcode_started", "barcode_detected"),
    "photo_wait_ms": ("photo_hint_shown", "photo_ready"),
    "frame_wait_ms": ("camera_ready", "frame_selected"),
}
FIRSTS = sorted({n for pair in GAPS.values() for n in pair} | {"camera_ready", "result_displayed"})


def first_time(name: str) -> Column:
    """Time of the first browser event of a name, by sequence number (numeric buffers)."""
    hit = (F.col("source") == "browser") & (F.col("event_name") == name)
    return F.min_by(F.when(hit, F.col("relative_ms")), F.when(hit, F.col("seq")))


def gap(start: Column, end: Column) -> Column:
    """Non-negative difference; null when either side is missing."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0.0), end - start))


def first_events(events: DataFrame) -> DataFrame:
    """First browser occurrence of every event name per run."""
    return events.where("source = 'browser'").groupBy("run_id", "event_name").agg(
        F.min("seq").alias("seq"), F.min_by("relative_ms", "seq").alias("relative_ms")
    )


def event_metrics(events: DataFrame) -> DataFrame:
    """Everything the event log says about a run, in one aggregate per run.

    Optional columns (``capture_ms``, ``selection_ms``, ``kind``, ``upload_json_bytes``,
    ``download_json_bytes``, ``submission_acknowledged``) hold parsed details.
    """
    have = set(events.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    browser = F.col("source") == "browser"

    def named(name: str) -> Column:
        return browser & (F.col("event_name") == name)

    up, down = col("upload_json_bytes", "long"), col("download_json_bytes", "long")
    traffic = named("task_traffic")
    usable = traffic & F.coalesce(
        (up >= 0) & (down >= 0) & col("submission_acknowledged", "boolean"), F.lit(False)
    )
    kind = col("kind", "string")
    zero = F.lit(0).cast("long")
    first = {f"first_{n}": first_time(n).alias(f"first_{n}") for n in FIRSTS}
    out = events.groupBy("run_id").agg(
        *first.values(),
        F.count_if(named("frame_considered")).alias("frames_considered"),
        F.count_if(named("frame_selected")).alias("frames_sent"),
        F.count_if(named("frame_rejected")).alias("frames_rejected"),
        F.when(F.count_if(named("frame_evaluated")) > 0, F.coalesce(
            F.sum(F.when(named("frame_evaluated"), col("capture_ms", "double"))), F.lit(0.0)
        )).alias("frame_capture_ms"),
        F.coalesce(F.sum(F.when(named("frame_selection_work"), col("selection_ms", "double"))), F.lit(0.0)).alias(
            "client_frame_selection_ms"),
        F.count_if(traffic).alias("traffic_rows"),
        F.count_if(usable).alias("traffic_usable"),
        *[
            F.coalesce(F.sum(F.when(traffic & (kind == k), c)), zero).alias(f"{k}_{label}_bytes")
            for k in ("ocr", "lookup") for label, c in (("upload", up), ("download", down))
        ],
        F.coalesce(F.sum(F.when(traffic, up + down)), zero).alias("traffic_bytes"),
    )
    return out


def task_metrics(tasks: DataFrame) -> DataFrame:
    """Everything the task table says about a run, in one aggregate per run."""
    have = set(tasks.columns)

    def col(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    ocr, lookup = F.col("kind") == "ocr", F.col("kind") == "lookup"
    return tasks.groupBy("run_id").agg(
        F.count_if(ocr).alias("ocr_calls"),
        F.count(F.lit(1)).alias("api_calls"),
        F.min_by(F.when(lookup, col("lookup_ms")), F.when(lookup, F.col("task_no"))).alias("lookup_ms"),
        *[complete_sum(col(c), ocr).alias(c) for c in SUMMED],
        *[F.max(F.when(ocr, col(c, "long"))).alias(c) for c in PEAKS],
        complete_sum(col("input_bytes", "long"), ocr).alias("ocr_image_bytes"),
        F.coalesce(F.bool_or(col("cancel_requested", "boolean")), F.lit(False)).alias("cancel_requested"),
        (F.count_if(ocr & (F.col("status") == "running")) > 0).alias("pending_worker"),
        F.max(F.when(ocr, col("worker_finished_at", "timestamp"))).alias("_last_worker_end"),
        F.max(F.when(ocr, F.col("task_no"))).alias("_last_ocr"),
    )


def representative_tasks(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The recognition task that stands for a run: the winner, else the last one unless a
    barcode won. ``runs`` carries ``winner_no`` and ``outcome``."""
    ocr = tasks.where("kind = 'ocr'")
    last = ocr.groupBy("run_id").agg(F.max("task_no").alias("_last"))
    won = ocr.select("run_id", F.col("task_no").alias("_won"))
    chosen = (
        runs.select("run_id", "outcome", F.col("winner_no").alias("_won")).join(won.withColumn("_is", F.lit(True)), ["run_id", "_won"], "left")
        .join(last, "run_id", "left")
    )
    task = F.when(F.col("_is"), F.col("_won")).when(~F.col("outcome").eqNullSafe("valid_barcode"), F.col("_last"))
    return chosen.select("run_id", task.alias("task_no")).where("task_no is not null")


def run_summaries(runs: DataFrame, tasks: DataFrame, events: DataFrame) -> DataFrame:
    """One row of metrics per run; events and tasks are aggregated once each, then joined by run."""
    review = [c for c in ("frame_complete", "ingredient_recall", "quality_success") if c in tasks.columns]
    reviewed = representative_tasks(runs, tasks).join(
        tasks.select("run_id", "task_no", *review, *([F.col("quality_reviewed")] if "quality_reviewed" in tasks.columns else [])),
        ["run_id", "task_no"],
    ).drop("task_no") if review else None
    joined = runs.join(task_metrics(tasks), "run_id", "left").join(event_metrics(events), "run_id", "left")
    joined = joined.withColumns({
        c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        for c in ("ocr_calls", "api_calls", "frames_considered", "frames_sent", "frames_rejected", "traffic_rows",
                  "traffic_usable", "traffic_bytes", "ocr_upload_bytes", "ocr_download_bytes", "lookup_upload_bytes",
                  "lookup_download_bytes")
    })
    if reviewed is not None:
        joined = joined.join(reviewed, "run_id", "left")
    complete = (F.col("traffic_rows") == F.col("api_calls")) & (F.col("traffic_usable") == F.col("traffic_rows"))
    peak = F.col("tesseract_child_rss_peak_bytes").isNotNull()
    out = joined.withColumns({
        "end_to_end_ms": F.when(F.col("valid_result"), F.col("first_result_displayed")),
        "camera_setup_ms": F.col("first_camera_ready"),
        **{name: gap(F.col(f"first_{a}"), F.col(f"first_{b}")) for name, (a, b) in GAPS.items()},
        "client_frame_selection_ms": F.coalesce("client_frame_selection_ms", F.lit(0.0)),
        **{f"{k}_{d}_bytes": F.when(complete, F.col(f"{k}_{d}_bytes")) for k in ("ocr", "lookup") for d in ("upload", "download")},
        "total_transfer_bytes": F.when(complete, F.col("traffic_bytes")),
        "traffic_measurement_quality": F.when(complete, "utf8_json_reserialized_estimate").otherwise("not_measured"),
        "measurement_quality": F.when(peak, "sampled_process_tree")
            .when(F.col("shared_process_rss_peak_bytes").isNotNull(), "shared_process_estimate").otherwise("not_measured"),
        "cancel_requested": F.coalesce("cancel_requested", F.lit(False)),
        "pending_worker": F.coalesce("pending_worker", F.lit(False)),
        "redundant_ocr_started": (F.col("ocr_calls") > 0) & F.col("outcome").eqNullSafe("valid_barcode"),
        "worker_stopped_after_run": F.coalesce(F.col("_last_worker_end") > F.col("finished_at"), F.lit(False))
            if "finished_at" in runs.columns else F.lit(False),
    })
    dropped = [c for c in out.columns if c.startswith(("first_", "_")) or c in ("traffic_rows", "traffic_usable", "traffic_bytes")]
    return out.drop(*dropped)


# Fixed value: the entry of an environment that tells when a run began, not under which condition.
START_ENTRY = "started_at_utc"


def with_condition(runs: DataFrame, environment: str = "environment") -> DataFrame:
    """Runs with the condition they belong to: ``environment_text`` and ``condition_key``.

    ``environment`` is a map of text to text; its start time is left out and its entries are sorted,
    so equal conditions have equal keys. The key is the hash of protocol, mode, config and
    environment; a null environment counts as empty.
    """
    kept = F.map_filter(F.col(environment), lambda name, _: name != START_ENTRY)
    ordered = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(kept, F.create_map().cast("map<string,string>")))))
    whole = F.struct("protocol_version", "mode", "config_no", ordered.alias("environment"))
    return runs.withColumn("environment_text", F.to_json(ordered)).withColumn(
        "condition_key", F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256))


CONDITION = ["condition_key", "protocol_version", "mode", "config_no", "environment_text"]


def group_report(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Report per experimental condition over runs that are not excluded.

    Totals are null as soon as one run misses a measurement, except runs without any recognition
    call. Percentiles are exact nearest ranks.
    """
    have = set(summaries.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    rows = summaries.where(~F.coalesce("excluded_from_analysis", F.lit(False)))
    called = F.col("ocr_calls") != 0

    def total(value: Column, required: Column) -> Column:
        return F.when(F.count_if(required & value.isNull()) == 0, F.sum(F.coalesce(value, F.lit(0).cast("double"))))

    complete, recall = col("frame_complete", "boolean"), col("ingredient_recall", "double")
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("valid_result").alias("success"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count(complete).alias("frame_reviewed"),
        F.count_if(complete).alias("complete_frames"),
        (F.count_if(complete.isNull() & called) == 0).alias("_all_reviewed"),
        F.count_if(F.coalesce(col("quality_reviewed", "boolean"), F.lit(False))).alias("quality_reviewed"),
        F.count_if(col("quality_success", "boolean")).alias("quality_successes"),
        F.avg(recall).alias("mean_ingredient_recall"),
        F.count("end_to_end_ms").alias("timed_successes"),
        F.sum("ocr_calls").alias("ocr_calls"),
        F.sum("api_calls").alias("api_calls"),
        total(col("ocr_cpu_time_ms", "double"), called).alias("ocr_cpu_time_ms"),
        total(col("shared_process_cpu_delta_ms", "double"), called).alias("_shared"),
        total(col("total_transfer_bytes", "long"), F.lit(True)).alias("total_transfer_bytes"),
        total(col("ocr_image_bytes", "long"), called).alias("ocr_image_bytes"),
        *[F.max(col(c, "long")).alias(c) for c in PEAKS],
    )
    times = exact_percentiles(rows, keys, "end_to_end_ms", {"p50": 0.5, "p95": 0.95}, 1000.0)

    def per(value: str, by: Column) -> Column:
        return F.col(value) / F.nullif(by, F.lit(0).cast("long"))

    n, success = F.col("n"), F.col("success")
    full = F.when(F.col("_all_reviewed"), F.col("complete_frames"))
    return agg.join(times, keys, "left").withColumns({
        "success_rate": success / n,
        "frame_completeness_rate": per("complete_frames", F.col("frame_reviewed")),
        "quality_success_rate": per("quality_successes", F.col("quality_reviewed")),
        "ocr_cpu_per_run_ms": per("ocr_cpu_time_ms", n),
        "ocr_cpu_per_complete_scan_ms": per("ocr_cpu_time_ms", full),
        "transfer_per_run_bytes": per("total_transfer_bytes", n),
        "bytes_per_complete_scan": per("total_transfer_bytes", full),
        "shared_process_cpu_per_run_ms": per("_shared", n),
        "shared_process_cpu_per_success_ms": per("_shared", success),
        "measurement_quality": F.when(F.col("ocr_cpu_time_ms").isNotNull(), "sampled_process_tree").otherwise("not_measured"),
    }).drop("_all_reviewed", "_shared")


def selection_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("excluded_from_analysis").alias("n_excluded")
    )


def select_runs(
    runs: DataFrame, *, mode: str | None = None, case_id=None, outcome: str | None = None,
    since: dt.datetime | None = None, until: dt.datetime | None = None, exclusion: str = "active",
) -> DataFrame:
    """Filter runs by the given arguments only."""
    out = runs
    for column, value in (("mode", mode), ("case_id", case_id), ("outcome", outcome)):
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    if since is not None:
        out = out.where(F.col("started_at") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("started_at") <= F.lit(until))
    if exclusion != "all":
        out = out.where(F.col("excluded_from_analysis") == F.lit(exclusion == "excluded"))
    return out


def history(runs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, identifier on ties."""
    return runs.orderBy(F.desc("started_at"), "run_id").offset(offset).limit(limit)


def over_limit(rows: DataFrame, limit: int) -> DataFrame:
    """One row: does the set have more than ``limit`` rows (reads at most one more)."""
    return rows.limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("over_limit"))


def require_at_most(rows: DataFrame, limit: int) -> DataFrame:
    """Guard with an action: an export that is too large is an error, never cut."""
    if over_limit(rows, limit).first().over_limit:
        raise ValueError(f"more than {limit} rows; narrow the filters")
    return rows


def overdue(runs: DataFrame, now: dt.datetime) -> DataFrame:
    """Running runs past their allowed time plus grace."""
    allowed = F.make_dt_interval(secs=(F.col("run_max_ms") + GRACE_MS) / 1000)
    return runs.where((F.col("status") == "running") & (F.lit(now).cast("timestamp_ntz") > F.col("started_at") + allowed))


def expired_heartbeats(events: DataFrame, now: dt.datetime) -> DataFrame:
    """Runs without an event for longer than the heartbeat limit."""
    last = events.groupBy("run_id").agg(F.max("ts").alias("last_ts"))
    limit = F.lit(now - dt.timedelta(seconds=HEARTBEAT_SECONDS)).cast("timestamp_ntz")
    return last.where(F.col("last_ts") < limit)


def server_sequence(new_events: DataFrame, stored: DataFrame, bucket: Column) -> DataFrame:
    """Next sequence numbers of server events per run, continuing the stored maximum."""
    base = stored.where("source = 'server'").groupBy("run_id").agg(F.max("seq").alias("_base"))
    order = numbered(new_events, ["run_id"], bucket, ["ts", "event_no"], "_n", start=0)
    return order.join(base, "run_id", "left").withColumn(
        "seq", F.col("_n") + F.coalesce(F.col("_base") + 1, F.lit(0))
    ).drop("_n", "_base")


def latest_import(imports: DataFrame) -> DataFrame:
    return imports.agg(F.max_by("input_sha256", "id").alias("input_sha256"))


def quality_review(reviews: DataFrame) -> DataFrame:
    """Recall of reviewed results from ``matched_indices`` and ``reference_count``."""
    matched = F.size(F.array_distinct("matched_indices"))
    recall = matched / F.col("reference_count")
    return reviews.withColumns({
        "matched_count": matched, "ingredient_recall": round_half_even(recall, 4), "quality_success": recall >= RECALL_SUCCESS,
    })


def applied_exclusions(log: DataFrame, bucket: Column) -> DataFrame:
    """Exclusion log without entries that repeat the state before them."""
    state = F.struct("excluded", "reason", "comment")
    rows = previous_value(log.withColumn("_state", state), ["run_id"], bucket, "seq", "_state", "_before")
    was = F.coalesce(F.col("_before.excluded"), F.lit(False))
    same_text = F.col("_before.reason").eqNullSafe(F.col("reason")) & F.col("_before.comment").eqNullSafe(F.col("comment"))
    repeat = (was == F.col("excluded")) & (~F.col("excluded") | same_text)
    return rows.where(~repeat).drop("_state", "_before")


def exclusion_state(log: DataFrame) -> DataFrame:
    """Current exclusion of each run; a restore clears reason and comment."""
    last = log.groupBy("run_id").agg(F.max_by(F.struct("excluded", "reason", "comment"), "seq").alias("s"))
    keep = F.when(F.col("s.excluded"), F.col("s.reason"))
    return last.select("run_id", F.col("s.excluded").alias("excluded"), keep.alias("reason"),
                       F.when(F.col("s.excluded"), F.col("s.comment")).alias("comment"))


def deletion_outcome(requested: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Which requested runs may be deleted: finished ones without a running task."""
    pending = tasks.where("status = 'running'").select("run_id").distinct().withColumn("_pending", F.lit(True))
    known = requested.select("run_id").distinct().join(runs.select("run_id", "status"), "run_id", "left").join(
        pending, "run_id", "left")
    return known.select("run_id", F.when(F.col("status").isNull(), "missing").when(
        (F.col("status") == "running") | F.col("_pending"), "refused").otherwise("deleted").alias("outcome"))


def without_runs(outcome: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of deleted runs."""
    gone = outcome.where("outcome = 'deleted'").select("run_id")
    return [t.join(gone, "run_id", "left_anti") for t in tables]


def finished_runs(requests: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Outcome of finish requests (run_id, requested, winner_no).

    Success needs a sufficient winning task of the matching kind; a finished run stays as it is.
    """
    winner = tasks.select("run_id", F.col("task_no").alias("winner_no"), F.col("kind").alias("_kind"), "sufficient")
    rows = requests.join(runs.select("run_id", "status"), "run_id").join(winner, ["run_id", "winner_no"], "left")
    valid = F.col("requested").isin("valid_barcode", "valid_ocr")
    kind = F.when(F.col("requested") == "valid_ocr", "ocr").otherwise("lookup")
    proven = F.coalesce(F.col("sufficient") & (F.col("_kind") == kind), F.lit(False))
    return rows.select(
        "run_id",
        F.when(F.col("status") != "running", "unchanged").when(valid & ~proven, "rejected")
        .when(F.col("requested") == "cancelled", "interrupted").otherwise("finished").alias("result"),
        (valid & proven & (F.col("status") == "running")).alias("valid_result"),
    )


def export_documents(events: DataFrame) -> DataFrame:
    """Events nested per run for a JSON export, in parts of at most MAX_EVENTS sequence numbers.

    A conforming run has exactly one part; a longer log is kept whole in further parts.
    """
    item = F.struct("seq", *[c for c in events.columns if c not in ("run_id", "seq", "source")])
    return events.groupBy("run_id", "source", F.floor(F.col("seq") / MAX_EVENTS).alias("part_no")).agg(
        F.array_sort(F.collect_list(item)).alias("events")
    )
