"""Snapshot comparison, checked updates, corrections and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.codes import code_lists, first_code
from provisor.functions.text import collapse_spaces

CODE = r"^E\d{3,4}[a-z]?(?:\([ivx]+\))?$"
MIN_DESCRIPTION_WORDS = 20
DISPLAY_TOLERANCE_MS = 1000
# Words by which a description talks about a publication instead of an ingredient.
ABOUT_PUBLICATION = r"(?iU)\b(?:стать[яеию]|статьёй|статьей|карточк\w*|публикаци\w*|пересказ\w*|сайт\w*)\b"


def description_outcome(code: Column, text: Column) -> Column:
    """Acceptance of a reviewed description: valid code, 20 words, trimmed, about the ingredient."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return (
        F.when(~code.rlike(CODE), "invalid_code")
        .when(F.size(words) < MIN_DESCRIPTION_WORDS, "too_short")
        .when(text.rlike(r"(?U)^\s|\s$"), "not_trimmed")
        .when(text.rlike(ABOUT_PUBLICATION), "about_publication").otherwise("accepted")
    )


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) for added, changed and deleted rows of two snapshots with unique keys."""
    columns = sorted(c for c in after.columns if c != key)
    old = before.select(key, F.struct(*columns).alias("_old"), F.lit(True).alias("_has_old"))
    new = after.select(key, F.struct(*columns).alias("_new"), F.lit(True).alias("_has_new"))
    change = (
        F.when(F.col("_has_old").isNull(), "added").when(F.col("_has_new").isNull(), "deleted")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return old.join(new, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def snapshot_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row with the inserted, updated and deleted counts."""
    diff = snapshot_diff(before, after, key)
    return diff.agg(*[
        F.count_if(F.col("change") == c).alias(n)
        for c, n in (("added", "inserted"), ("changed", "updated"), ("deleted", "deleted"))
    ])


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``after`` that are new or differ."""
    return after.join(snapshot_diff(before, after, key).where("change <> 'deleted'").select(key), key, "left_semi")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per differing field: (key, field, before, after), compared null-safely."""
    old = before.select(key, *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields], F.lit(True).alias("_known"))
    joined = after.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).join(old, key, "left")
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"_b_{f}").alias("before"), F.col(f).alias("after")) for f in fields
    ])
    return joined.select(key, F.col("_known").isNotNull().alias("known"), F.explode(pairs).alias("c")).where(
        ~F.col("c.before").eqNullSafe(F.col("c.after"))
    ).select(key, "known", "c.field", "c.before", "c.after")


def rule_changes(raw: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Changes of rules against the raw extract, with the kind of change.

    A rule the extract lacks is a seed rule; it has one row even when all its fields are null.
    """
    changed = field_changes(raw, current, "rule_id", fields)
    fresh = current.join(raw.select("rule_id"), "rule_id", "left_anti").select("rule_id", F.lit(True).alias("_fresh"))
    rows = changed.join(fresh, "rule_id", "full_outer")
    return rows.select(
        "rule_id", F.when(F.col("_fresh"), "local_seed_rule").otherwise("local_enrichment").alias("change_kind"),
        "field", "before", "after",
    )


def fill_from_match(rows: DataFrame, matched: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fill empty fields from the matched record (already cleaned)."""
    other = matched.select(key, *[F.col(f).alias(f"_m_{f}") for f in fields])
    own = {f: F.nullif(F.col(f), F.lit("")) for f in fields}
    out = rows.join(other, key, "left").withColumns({f: F.coalesce(own[f], F.col(f"_m_{f}")) for f in fields})
    return out.drop(*[f"_m_{f}" for f in fields])


def plan_updates(current: DataFrame, texts: DataFrame, expected: DataFrame) -> DataFrame:
    """Decide per code: apply, already current, stale (someone else changed it), duplicate or missing.

    ``current`` and ``expected`` are (code, id, text), ``texts`` is (code, new_text).
    """
    now = current.groupBy("code").agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("id"), F.min(F.struct(F.col("text").isNull(), "text"))["text"].alias("text")
    )
    old = expected.select("code", F.col("id").alias("_eid"), F.col("text").alias("_etext"))
    rows = texts.join(now, "code", "left").join(old, "code", "left")
    same = F.col("_eid").eqNullSafe(F.col("id")) & F.col("_etext").eqNullSafe(F.col("text"))
    return rows.select(
        "code", "id", "new_text",
        F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
        .when(F.col("text").eqNullSafe(F.col("new_text")), "current")
        .when(same, "apply").otherwise("stale").alias("decision"),
    )


def apply_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (code, id, text...) with the planned texts put in; all other cells stay."""
    accepted = plan.where("decision = 'apply'").select("id", F.col("new_text").alias("_new"))
    return rows.join(accepted, "id", "left").withColumn("text", F.coalesce("_new", "text")).drop("_new").select(*rows.columns)


def update_violations(before: DataFrame, plan: DataFrame, written: DataFrame) -> DataFrame:
    """Rows of a written table that differ from the expected result; empty after a clean update."""
    wanted = apply_plan(before, plan)
    extra = written.exceptAll(wanted).withColumn("problem", F.lit("unexpected_row"))
    lost = wanted.exceptAll(written).withColumn("problem", F.lit("missing_row"))
    return extra.unionByName(lost)


def with_descriptions(rows: DataFrame, texts: DataFrame, field: str = "full_description") -> DataFrame:
    """Put reviewed texts into rows by code; rows without a text keep theirs."""
    new = texts.select(F.col("code").alias("e_code"), F.col("new_text").alias("_new"))
    return rows.join(new, "e_code", "left").withColumn(field, F.coalesce("_new", field)).drop("_new").select(*rows.columns)


def changed_snapshots(snapshots: dict[str, DataFrame], texts: DataFrame, key: str = "ingredient_id") -> DataFrame:
    """Names of the snapshots a set of texts would change, with the number of changed rows."""
    parts = [
        snapshot_diff(df, with_descriptions(df, texts), key).agg(F.count(F.lit(1)).alias("changed")).select(
            F.lit(name).alias("snapshot"), "changed")
        for name, df in snapshots.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("changed > 0")


CORRECTION_CONTENT = ("user_id", "request_id", "token_index", "token_raw", "corrected_text", "input_sha256")


def correction_outcomes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Save outcome per correction: new, repeat or conflict, and whether its request is saved.

    Identifiers are compared with the stored table and with earlier items of the same batch
    (``arrival`` order). One conflict rejects its whole request.
    """
    content = F.sha2(F.to_json(F.struct(*CORRECTION_CONTENT), {"ignoreNullFields": "false"}), 256)
    rows = incoming.withColumn("_hash", content)
    first = rows.groupBy("id").agg(F.min_by("_hash", "arrival").alias("_first"), F.min("arrival").alias("_arrival"))
    known = stored.withColumn("_stored", content).select("id", "_stored")
    judged = rows.join(first, "id").join(known, "id", "left").withColumn(
        "outcome",
        F.when(F.col("_stored").isNull() & (F.col("arrival") == F.col("_arrival")), "new")
        .when(F.coalesce("_stored", "_first") == F.col("_hash"), "repeat").otherwise("conflict"),
    )
    conflicts = judged.where("outcome = 'conflict'").select("request_id").distinct().withColumn("_bad", F.lit(True))
    return judged.join(conflicts, "request_id", "left").withColumn("saved", F.col("_bad").isNull()).drop(
        "_hash", "_first", "_arrival", "_stored", "_bad")


def review_queue_rows(outcomes: DataFrame) -> DataFrame:
    """Review-queue rows of newly saved corrections: candidates, never trusted labels."""
    return outcomes.where("outcome = 'new' and saved").select(
        F.col("id").alias("review_id"), F.col("request_id").cast("string").alias("request_id"), "token_raw",
        F.col("corrected_text").alias("candidate_canonical_name"), F.lit(0).cast("decimal(5,4)").alias("match_score"),
        F.lit(False).alias("was_accepted"), F.lit(False).alias("is_hazard"), F.lit("pending").alias("status"),
    )


def review_order(queue: DataFrame) -> DataFrame:
    """Review order: by status, hazards first, oldest first."""
    return queue.orderBy("status", F.desc("is_hazard"), "created_at", "review_id")


def validation_outcomes(requests: DataFrame, validations: DataFrame, runs: DataFrame, photos: DataFrame) -> DataFrame:
    """Decision per validation update (run_id, revision, status, verified_text, codes)."""
    have_photo = photos.select("run_id").distinct().withColumn("_photo", F.lit(True))
    current = validations.select("run_id", F.col("revision").alias("_revision"), F.col("status").alias("before_status"))
    rows = (
        requests.join(runs.select("run_id", "stage"), "run_id", "left").join(current, "run_id", "left")
        .join(have_photo, "run_id", "left")
        .withColumn("_codes", code_lists(F.col("codes")))
    )
    confirmed = F.col("status") == "confirmed"
    incomplete = (F.btrim("verified_text") == "") | F.col("_photo").isNull()
    return rows.select(
        "run_id", "before_status", F.col("status").alias("after_status"),
        F.col("_codes.codes").alias("codes"),
        F.when(F.col("stage").isNull(), "missing").when(F.col("_revision") != F.col("revision"), "stale_revision")
        .when(F.size("_codes.rejected") > 0, "invalid_code")
        .when(confirmed & ~F.col("stage").isin("completed", "aborted"), "run_not_finished")
        .when(confirmed & incomplete, "incomplete_evidence").otherwise("accepted").alias("outcome"),
    )


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """Classify recognition attempts and list detected codes and hit restrictions.

    Needs ``ocr_status``, ``composition``, ``codes`` (codes of matched ingredients) and
    ``exclusions`` (codes of the run).
    """
    ok = F.col("ocr_status") == "success"
    blank = F.coalesce(collapse_spaces(F.col("composition")), F.lit("")) == ""
    status = F.when(ok & blank, "needs_retake").when(ok, "success").when(
        F.col("ocr_status") == "needs_retake", "needs_retake").otherwise("error")
    found = F.array_sort(F.array_distinct(F.transform(F.filter("codes", lambda c: c.isNotNull()), lambda c: F.upper(c))))
    none = F.array().cast("array<string>")
    good = status == "success"
    return attempts.withColumns({
        "result_status": status,
        "detected_codes": F.when(good, found).otherwise(none),
        "matched_restrictions": F.when(good, restricted_codes(found, F.col("exclusions"))).otherwise(none),
    })


def restricted_codes(codes: Column, exclusions: Column) -> Column:
    return F.array_sort(F.array_intersect(codes, exclusions))


def text_codes(text: Column) -> Column:
    """Upper-case code of a token text as a one-element list; used where no catalog is at hand."""
    return F.array_compact(F.array(F.upper(first_code(text))))


def display_outcomes(reports: DataFrame, attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Accept a displayed time unless it contradicts the stored one or the server's time."""
    rows = reports.join(runs.select("run_id", "stage"), "run_id", "left").join(
        attempts.select("run_id", "attempt_id", "status", "server_ms", "e2e_ms"), ["run_id", "attempt_id"], "left")
    return rows.select(
        "run_id", "attempt_id", "reported_ms",
        F.when(~F.col("stage").eqNullSafe("app_active"), "stage_closed")
        .when(F.col("status").isNull() | (F.col("status") == "processing"), "not_ready")
        .when(F.col("e2e_ms").isNotNull() & (F.col("e2e_ms") != F.col("reported_ms")), "already_recorded")
        .when(F.col("reported_ms") + DISPLAY_TOLERANCE_MS < F.col("server_ms"), "below_server_time")
        .otherwise("accepted").alias("outcome"),
    )


def recovered_attempts(attempts: DataFrame, now: Column) -> DataFrame:
    """Attempts after recovery: processing ones are interrupted, missing visibility times filled.

    Technical timings stay null: none is invented.
    """
    running = F.col("status") == "processing"
    return attempts.withColumns({
        "status": F.when(running, "interrupted").otherwise(F.col("status")),
        "error": F.when(running, "Прервано участником после потери связи").otherwise(F.col("error")),
        "finished_at": F.coalesce("finished_at", now),
        "displayed_at": F.coalesce("displayed_at", now),
    })


def audit_rows(changes: DataFrame, event: str, actor: Column, run_id: str, details: list[str]) -> DataFrame:
    return changes.select(
        actor.alias("actor_id"), F.lit(event).alias("event"), F.col(run_id).alias("run_id"),
        F.to_json(F.struct(*details)).alias("details"),
    )
