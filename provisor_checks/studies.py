"""Studies, corrections and exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from provisor.operators import changes, studies
from provisor.sinks import exports
from provisor.sources import photos
from provisor_checks.registry import check


@check("win_9_stage_replay", """
    SELECT run_id, least(n, 5) AS accepted, n - least(n, 5) AS rejected,
      CASE least(n, 5) WHEN 1 THEN 'manual_active' WHEN 2 THEN 'app_ready' WHEN 3 THEN 'app_active' WHEN 4 THEN 'labeling' ELSE 'completed' END AS stage,
      CASE WHEN n >= 2 THEN 1000 END AS manual_duration_ms
    FROM (SELECT run_id, count(*) AS n FROM stage_actions GROUP BY 1)""")
def _(t):
    at = F.timestamp_seconds(F.col("revision")).cast("timestamp_ntz")
    rows = t.stage_actions.select(
        "run_id", F.col("revision").alias("no"), at.alias("at"), "revision", "action", F.lit(None).cast("string").alias("payload_error"),
        F.lit(True).alias("skip_label"))
    out = studies.replay_stages(rows)
    return out.select("run_id", "accepted", F.size("rejected").cast("long").alias("rejected"), "stage", F.col("manual_duration_ms").cast("int").alias("manual_duration_ms"))


OVERVIEW = """ov AS (SELECT r.*, v.status AS validation_status, c.case_title, s.study_title, coalesce(p.n, 0) AS photo_count FROM study_runs r
      JOIN study_validations v ON r.run_id = v.run_id JOIN cases c ON r.case_id = c.case_id JOIN studies s ON r.study_id = s.study_id
      LEFT JOIN (SELECT run_id, count(*) AS n FROM study_photos GROUP BY 1) p ON r.run_id = p.run_id)"""


def overview(t):
    return studies.run_overview(t.study_runs, t.study_validations, t.cases, t.studies, t.study_photos)


@check("jon_19_run_overview", "WITH " + OVERVIEW + "SELECT run_id, case_title, study_title, validation_status, photo_count FROM ov")
def _(t):
    return overview(t).select("run_id", "case_title", "study_title", "validation_status", "photo_count")


@check("flt_11_filtered_studies", "WITH " + OVERVIEW + """
    SELECT run_id FROM ov WHERE study_id = 3 AND validation_status = 'unreviewed' AND created_at >= TIMESTAMP '1995-01-01'
      AND run_id IN (SELECT run_id FROM study_attempts WHERE ocr_status IN ('error', 'needs_retake'))""")
def _(t):
    attempts = t.study_attempts.select("run_id", F.col("ocr_status").alias("status"))
    return studies.filter_overview(
        overview(t), study_id=3, validation="unreviewed", since=dt.datetime(1995, 1, 1), with_errors_in=attempts).select("run_id")


@check("jon_25_newest_runs", """
    SELECT run_id, participant_id, case_title, study_title FROM (SELECT r.*, c.case_title, s.study_title,
      row_number() OVER (PARTITION BY participant_id ORDER BY created_at DESC, run_id) AS n FROM study_runs r
      JOIN cases c ON r.case_id = c.case_id JOIN studies s ON r.study_id = s.study_id) WHERE n <= 5""")
def _(t):
    return studies.newest_runs(t.study_runs, t.cases, t.studies, 5).select("run_id", "participant_id", "case_title", "study_title")


def attempts(t):
    codes = F.array(F.when(F.col("ingredient_id") % 3 == 0, F.concat(F.lit("e"), (100 + F.col("ingredient_id") % 900).cast("string"))))
    exclusions = F.array(F.lit("E103"), F.lit("E400"), F.concat(F.lit("E"), (100 + F.col("ingredient_id") % 450).cast("string")))
    return t.study_attempts.withColumn("codes", codes).withColumn("exclusions", exclusions)


CLASSIFIED = """cl AS (SELECT *, CASE WHEN ocr_status = 'success' AND composition = ' ' THEN 'needs_retake' ELSE ocr_status END AS result_status,
      CASE WHEN ingredient_id % 3 = 0 THEN 'E' || CAST(100 + ingredient_id % 900 AS VARCHAR) END AS code FROM study_attempts)"""


@check("chg_7_attempt_outcomes", "WITH " + CLASSIFIED + """
    SELECT run_id, attempt_id, result_status, CASE WHEN result_status = 'success' THEN coalesce(code, '') ELSE '' END AS detected FROM cl""")
def _(t):
    return changes.attempt_outcomes(attempts(t)).select("run_id", "attempt_id", "result_status", F.array_join("detected_codes", "|").alias("detected"))


@check("jon_20_matched_restrictions", "WITH " + CLASSIFIED + """
    SELECT run_id, attempt_id, CASE WHEN result_status = 'success' AND (code IN ('E103', 'E400') OR code = 'E' || CAST(100 + ingredient_id % 450 AS VARCHAR)) THEN code ELSE '' END AS restricted FROM cl""")
def _(t):
    return changes.attempt_outcomes(attempts(t)).select("run_id", "attempt_id", F.array_join("matched_restrictions", "|").alias("restricted"))


@check("chg_8_display_outcomes", """
    SELECT a.run_id, a.attempt_id, CAST(a.server_ms - 500 - (a.ingredient_id % 4) * 400 AS BIGINT) AS reported_ms, CASE WHEN r.stage <> 'app_active' THEN 'stage_closed'
      WHEN a.status = 'processing' THEN 'not_ready' WHEN a.e2e_ms IS NOT NULL AND a.e2e_ms <> a.server_ms - 500 - (a.ingredient_id % 4) * 400 THEN 'already_recorded'
      WHEN a.server_ms - 500 - (a.ingredient_id % 4) * 400 + 1000 < a.server_ms THEN 'below_server_time' ELSE 'accepted' END AS outcome
    FROM study_attempts a LEFT JOIN study_runs r ON a.run_id = r.run_id""")
def _(t):
    reports = t.study_attempts.select("run_id", "attempt_id", (F.col("server_ms") - 500 - (F.col("ingredient_id") % 4) * 400).alias("reported_ms"))
    return changes.display_outcomes(reports, t.study_attempts, t.study_runs)


@check("chg_15_recovered_attempts", """
    SELECT run_id, attempt_id, CASE WHEN status = 'processing' THEN 'interrupted' ELSE status END AS status, e2e_ms, TRUE AS shown FROM study_attempts""")
def _(t):
    rows = t.study_attempts.withColumns({
        "error": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp_ntz"), "displayed_at": F.lit(None).cast("timestamp_ntz")})
    out = changes.recovered_attempts(rows, F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    return out.select("run_id", "attempt_id", "status", "e2e_ms", F.col("displayed_at").isNotNull().alias("shown"))


VALIDATED = """va AS (SELECT r.run_id, v.status AS before_status, CASE WHEN r.run_id % 2 = 0 THEN 'confirmed' ELSE 'clarification' END AS after_status,
      CASE WHEN r.run_id % 7 = 0 THEN 9 ELSE v.revision END AS given, v.revision, v.verified_text, r.stage, r.run_id % 11 = 0 AS bad_code,
      r.run_id IN (SELECT run_id FROM study_photos) AS photo FROM study_runs r JOIN study_validations v ON r.run_id = v.run_id),
    vo AS (SELECT run_id, before_status, after_status, CASE WHEN given <> revision THEN 'stale_revision' WHEN bad_code THEN 'invalid_code'
      WHEN after_status = 'confirmed' AND stage = 'app_active' THEN 'run_not_finished' WHEN after_status = 'confirmed' AND (verified_text = '' OR NOT photo) THEN 'incomplete_evidence'
      ELSE 'accepted' END AS outcome FROM va)"""


def validations(t):
    requests = t.study_validations.select(
        "run_id", F.when(F.col("run_id") % 7 == 0, 9).otherwise(F.col("revision")).alias("revision"),
        F.when(F.col("run_id") % 2 == 0, "confirmed").otherwise("clarification").alias("status"), "verified_text",
        F.when(F.col("run_id") % 11 == 0, F.array(F.lit("sorbate"))).otherwise(F.array(F.lit("E 202"), F.lit("e-202"))).alias("codes"))
    return changes.validation_outcomes(requests, t.study_validations, t.study_runs, t.study_photos)


@check("chg_6_validation_outcomes", "WITH " + VALIDATED + """
    SELECT run_id, before_status, after_status, outcome, CASE WHEN run_id % 11 = 0 THEN '' ELSE 'E202' END AS codes FROM vo""")
def _(t):
    return validations(t).withColumn("codes", F.array_join("codes", "|"))


@check("chg_16_audit_rows", "WITH " + VALIDATED + """
    SELECT 7 AS actor_id, 'validation_updated' AS event, run_id, '{"before_status":"' || before_status || '","after_status":"' || after_status || '"}' AS details FROM vo WHERE outcome = 'accepted'""")
def _(t):
    accepted = validations(t).where("outcome = 'accepted'")
    return changes.audit_rows(accepted, "validation_updated", F.lit(7), "run_id", ["before_status", "after_status"])


INCOMING = """inc AS (SELECT o_custkey AS id, o_orderkey AS arrival, o_orderkey // 3 AS request_id, CAST(o_custkey % 20 AS INTEGER) AS token_index, o_orderstatus AS token_raw,
      'fix ' || o_orderstatus AS corrected_text, 'abc' AS input_sha256, 1 AS user_id FROM orders),
    sto AS (SELECT id, arrival, request_id, token_index, token_raw, corrected_text, input_sha256, user_id FROM inc WHERE arrival % 50 = 0)"""


def correction_tables(t):
    incoming = t.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("arrival"), F.floor(F.col("o_orderkey") / 3).alias("request_id"),
        (F.col("o_custkey") % 20).cast("int").alias("token_index"), F.col("o_orderstatus").alias("token_raw"),
        F.concat(F.lit("fix "), "o_orderstatus").alias("corrected_text"), F.lit("abc").alias("input_sha256"), F.lit(1).alias("user_id"))
    first = incoming.where("arrival % 50 = 0").groupBy("id").agg(F.min("arrival").alias("arrival"))
    return incoming, incoming.join(first, ["id", "arrival"], "left_semi")


OUTCOMES = INCOMING + """,
    st AS (SELECT * FROM sto QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1),
    fi AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1),
    ju AS (SELECT i.*, CASE WHEN s.id IS NULL AND i.arrival = f.arrival THEN 'new'
      WHEN (coalesce(s.request_id, f.request_id), coalesce(s.token_raw, f.token_raw)) = (i.request_id, i.token_raw) THEN 'repeat' ELSE 'conflict' END AS outcome
      FROM inc i JOIN fi f ON i.id = f.id LEFT JOIN st s ON i.id = s.id),
    ou AS (SELECT *, request_id NOT IN (SELECT request_id FROM ju WHERE outcome = 'conflict') AS saved FROM ju)"""


@check("chg_1_correction_outcomes", "WITH " + OUTCOMES + "SELECT id, arrival, request_id, outcome, saved FROM ou")
def _(t):
    return changes.correction_outcomes(*correction_tables(t)).select("id", "arrival", "request_id", "outcome", "saved")


@check("chg_1_review_rows", "WITH " + OUTCOMES + """
    SELECT id AS review_id, CAST(request_id AS VARCHAR) AS request_id, corrected_text AS candidate_canonical_name, 'pending' AS status FROM ou WHERE outcome = 'new' AND saved""")
def _(t):
    rows = changes.review_queue_rows(changes.correction_outcomes(*correction_tables(t)))
    return rows.select("review_id", "request_id", "candidate_canonical_name", "status")


@check("ord_3_review_order", """
    SELECT o_orderkey AS review_id, o_orderstatus AS status, o_orderpriority = '1-URGENT' AS is_hazard FROM orders ORDER BY 2, 3 DESC, o_orderdate, 1""")
def _(t):
    queue = t.orders.select(
        F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("is_hazard"),
        F.col("o_orderdate").alias("created_at"))
    return changes.review_order(queue).drop("created_at")


def answered_runs(t):
    manual = F.create_map(F.concat(F.lit("E"), (100 + F.col("run_id") % 9).cast("string")), F.lit("present"), F.lit("E999"), F.lit("unknown"))
    app = F.create_map(F.lit("E999"), F.when(F.col("run_id") % 2 == 0, "absent").otherwise("present"))
    return t.study_runs.withColumns({"manual_answers": manual, "app_answers": app})


@check("prj_19_answer_rows", """
    SELECT run_id, 'manual' AS method, 'E' || CAST(100 + run_id % 9 AS VARCHAR) AS e_code, 'present' AS answer FROM study_runs
    UNION ALL SELECT run_id, 'manual', 'E999', 'unknown' FROM study_runs
    UNION ALL SELECT run_id, 'app', 'E999', CASE WHEN run_id % 2 = 0 THEN 'absent' ELSE 'present' END FROM study_runs""")
def _(t):
    return exports.answer_rows(answered_runs(t))


@check("prj_20_blinded_details", "SELECT run_id, study_id, participant_id, case_id, stage FROM study_runs")
def _(t):
    return exports.blinded(answered_runs(t)).drop("created_at")


@check("snk_4_safe_sheets", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '''=' || o_orderstatus ELSE o_orderstatus END AS note,
      CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders""")
def _(t):
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("="), "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("note"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"))
    return exports.safe_cells(rows)


@check("snk_6_photo_manifest", """
    SELECT l_orderkey AS run_id, l_partkey AS photo_id, 'photos/' || l_orderkey || '/' || l_partkey || '.png' AS file, l_partkey IN (SELECT ps FROM (SELECT p_partkey AS ps, p_size FROM part) WHERE p_size > 25) AS available,
      l_partkey IN (SELECT ps FROM (SELECT p_partkey AS ps, p_size FROM part) WHERE p_size > 25) AS included FROM lineitem WHERE l_returnflag = 'A'""")
def _(t):
    rows = t.study_photos.withColumns({"sha256": F.sha2(F.col("photo_id").cast("string"), 256), "mime_type": F.lit("image/png")})
    files = t.part.where("p_size > 25").select(F.col("p_partkey").alias("photo_id"))
    return photos.export_manifest(rows, files, True).drop("sha256")


@check("src_10_photo_manifest", """
    SELECT doc_id AS photo_id, CAST(octet_length(encode(text)) AS INTEGER) AS size_bytes, sha256(text) AS sha256,
      CASE WHEN doc_id % 2 = 0 THEN 'image/png' END AS mime_type FROM (SELECT doc_id, text FROM documents)""")
def _(t):
    from pyspark.sql import functions as S

    rows = t.documents.select(F.col("doc_id").alias("photo_id"), F.col("text"))
    content = rows.select("photo_id", S.to_binary("text", S.lit("utf-8")).alias("content"))
    out = photos.manifest(content)
    signed = photos.manifest(rows.select("photo_id", F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("text", "utf-8")).alias("content")))
    kinds = signed.where("photo_id % 2 = 0").select("photo_id", F.col("mime_type").alias("_mime"))
    return out.join(kinds, "photo_id", "left").select("photo_id", "size_bytes", "sha256", F.col("_mime").alias("mime_type"))
