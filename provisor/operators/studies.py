"""Study runs: stage replay, overviews and participant views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from provisor.functions.text import WHITE_SPACE

NEWEST = 100
ERROR_STATES = ("error", "needs_retake", "interrupted")

# The stage each action needs, and the stage it leads to.
NEEDS = {
    "start_manual": "manual_ready", "save_manual": "manual_active", "finish_manual": "manual_active",
    "start_app": "app_ready", "save_app": "app_active", "finish_app": "app_active", "annotate": "labeling",
}
LEADS_TO = {
    "start_manual": "manual_active", "save_manual": "manual_active", "finish_manual": "app_ready",
    "start_app": "app_active", "save_app": "app_active", "finish_app": "labeling", "annotate": "completed", "abort": "aborted",
}

STATE = (
    "struct<revision:bigint,stage:string,manual_started:timestamp_ntz,app_started:timestamp_ntz,manual_duration_ms:bigint,"
    "app_duration_ms:bigint,labeling_status:string,accepted:bigint,rejected:array<struct<no:bigint,action:string,reason:string>>>"
)


def _map(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def action_payload(actions: DataFrame, exclusions: Column) -> DataFrame:
    """Reduce the payload of each action to ``payload_error`` (null: fine).

    Needs ``action``, ``answers`` (map code to answer), ``external_search_used``, ``skip_label``,
    ``user_label_text``, ``attempt_displayed``; ``exclusions`` is the array of codes of the run.
    """
    a = F.col("action")
    given = F.coalesce(F.map_keys("answers"), F.array().cast("array<string>"))
    answering = a.rlike("^(save|finish)_")
    foreign = F.size(F.array_except(given, exclusions)) > 0
    missing = a.startswith("finish_") & (F.size(F.array_except(exclusions, given)) > 0)
    error = (
        F.when(answering & foreign, "foreign_answers").when(answering & missing, "missing_answers")
        .when((a == "finish_manual") & F.col("external_search_used").isNull(), "search_flag_missing")
        .when((a == "finish_app") & ~F.coalesce("attempt_displayed", F.lit(False)), "no_displayed_attempt")
        .when((a == "annotate") & ~F.coalesce("skip_label", F.lit(False)) & (F.coalesce(F.btrim("user_label_text", F.lit(WHITE_SPACE)), F.lit("")) == ""), "label_missing")
    )
    return actions.withColumn("payload_error", error)


def step(state: Column, action: Column) -> Column:
    """State after one action: accepted by stage, revision and payload, or listed as rejected."""
    name = action["action"]
    abort = name == "abort"
    closed = state["stage"].isin("completed", "aborted")
    allowed = F.when(abort, ~closed).otherwise(F.coalesce(_map(name, NEEDS) == state["stage"], F.lit(False)))
    reason = (
        F.when(state["revision"] != action["revision"], "stale_revision").when(~allowed, "wrong_stage")
        .otherwise(action["payload_error"]))
    ok = reason.isNull()

    def took(start: str) -> Column:
        # Milliseconds between two times, rounded half to even, never negative.
        micros = F.expr("1") * (F.unix_micros(action["at"].cast("timestamp")) - F.unix_micros(state[start].cast("timestamp")))
        return F.greatest(F.lit(0).cast("long"), F.bround(micros / 1000, 0).cast("long"))

    def update(field: str, test: Column, value: Column) -> Column:
        return F.when(ok & test, value).otherwise(state[field]).alias(field)

    rejected = F.when(ok, state["rejected"]).otherwise(
        F.array_append(state["rejected"], F.struct(action["no"].alias("no"), name.alias("action"), reason.alias("reason"))))
    return F.struct(
        (state["revision"] + F.when(ok, 1).otherwise(0)).alias("revision"),
        F.when(ok, _map(name, LEADS_TO)).otherwise(state["stage"]).alias("stage"),
        update("manual_started", name == "start_manual", action["at"]),
        update("app_started", name == "start_app", action["at"]),
        update("manual_duration_ms", name == "finish_manual", took("manual_started")),
        update("app_duration_ms", name == "finish_app", took("app_started")),
        update("labeling_status", name == "annotate", F.when(F.coalesce(action["skip_label"], F.lit(False)), "skipped").otherwise("done")),
        (state["accepted"] + F.when(ok, 1).otherwise(0)).alias("accepted"),
        rejected.alias("rejected"),
    ).cast(STATE)


def replay_stages(actions: DataFrame, first_stage: str = "manual_ready") -> DataFrame:
    """Fold the time-ordered actions of each study run into its current state.

    Needs ``run_id, no, at, revision, action, payload_error, skip_label``. A study run is one
    person's session, so its action list fits a row.
    """
    item = F.struct("at", F.col("no").cast("long").alias("no"), F.col("revision").cast("long").alias("revision"), "action", "payload_error", "skip_label")
    begin = F.struct(
        F.lit(0).cast("long").alias("revision"), F.lit(first_stage).alias("stage"), *[F.lit(None).alias(c) for c in
        ("manual_started", "app_started", "manual_duration_ms", "app_duration_ms", "labeling_status")],
        F.lit(0).alias("accepted"), F.array().alias("rejected")).cast(STATE)
    folded = actions.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("_a")).select(
        "run_id", F.aggregate("_a", begin, step).alias("s"))
    return folded.select("run_id", "s.*")


def run_overview(runs: DataFrame, validations: DataFrame, cases: DataFrame, studies: DataFrame, photos: DataFrame) -> DataFrame:
    """Runs with validation status, case and study titles and the number of photos."""
    counts = photos.groupBy("run_id").agg(F.count(F.lit(1)).alias("photo_count"))
    return (
        runs.join(validations.select("run_id", F.col("status").alias("validation_status")), "run_id")
        .join(cases.select("case_id", "case_title"), "case_id").join(studies.select("study_id", "study_title"), "study_id")
        .join(counts, "run_id", "left").withColumn("photo_count", F.coalesce("photo_count", F.lit(0))))


def filter_overview(
    overview: DataFrame, *, study_id=None, participant_id=None, case_id=None, stage: str | None = None, validation: str | None = None,
    since: dt.datetime | None = None, until: dt.datetime | None = None, with_errors_in: DataFrame | None = None,
) -> DataFrame:
    """Filter by the given arguments only; ``with_errors_in`` is the attempts table."""
    out = overview
    for column, value in (("study_id", study_id), ("participant_id", participant_id), ("case_id", case_id), ("stage", stage), ("validation_status", validation)):
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("created_at") <= F.lit(until))
    if with_errors_in is not None:
        failed = with_errors_in.where(F.col("status").isin(*ERROR_STATES)).select("run_id")
        out = out.join(failed, "run_id", "left_semi")
    return out


def newest_runs(runs: DataFrame, cases: DataFrame, studies: DataFrame, limit: int = NEWEST) -> DataFrame:
    """Newest runs of every participant with titles.

    The row-number limit is applied before the shuffle too, so each task sends at most ``limit``
    rows per participant.
    """
    along = Window.partitionBy("participant_id").orderBy(F.desc("created_at"), "run_id")
    top = runs.withColumn("_n", F.row_number().over(along)).where(F.col("_n") <= limit).drop("_n")
    return top.join(cases.select("case_id", "case_title"), "case_id").join(studies.select("study_id", "study_title"), "study_id")
