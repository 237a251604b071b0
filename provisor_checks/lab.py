"""Scan-run experiments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from provisor.operators import experiments as lab
from provisor.operators.spread import complete_sum
from provisor_checks.registry import check

NOW = dt.datetime(2024, 1, 30, 20, 0, 0)

FIRST = "min(relative_ms) FILTER (WHERE source = 'browser' AND event_name = '{n}' AND seq = {a})"
SUMMARY_CTE = """
    winners AS (SELECT run_id, min(task_no) AS winner_no FROM lab_tasks WHERE sufficient GROUP BY 1),
    t AS (SELECT run_id, count(*) FILTER (WHERE kind = 'ocr') AS ocr_calls, count(*) AS api_calls,
      CASE WHEN count(*) FILTER (WHERE kind = 'ocr' AND cpu_ms IS NULL) = 0 THEN sum(cpu_ms) FILTER (WHERE kind = 'ocr') END AS ocr_cpu_time_ms,
      max(rss_bytes) FILTER (WHERE kind = 'ocr') AS peak,
      count(*) FILTER (WHERE kind = 'ocr' AND status = 'running') > 0 AS pending_worker FROM lab_tasks GROUP BY 1),
    f AS (SELECT run_id, event_name, arg_min(relative_ms, seq) AS ms FROM lab_events WHERE source = 'browser' GROUP BY 1, 2),
    e AS (SELECT run_id, max(ms) FILTER (WHERE event_name = 'result_displayed') AS shown, max(ms) FILTER (WHERE event_name = 'camera_ready') AS ready,
      max(ms) FILTER (WHERE event_name = 'frame_selected') AS picked FROM f GROUP BY 1),
    c AS (SELECT run_id, count(*) FILTER (WHERE event_name = 'frame_considered') AS considered, count(*) FILTER (WHERE event_name = 'frame_selected') AS sent,
      count(*) FILTER (WHERE event_name = 'frame_rejected') AS rejected FROM lab_events WHERE source = 'browser' GROUP BY 1),
    summaries AS (SELECT r.*, coalesce(t.ocr_calls, 0) AS ocr_calls, coalesce(t.api_calls, 0) AS api_calls,
      CAST(t.ocr_cpu_time_ms AS BIGINT) AS ocr_cpu_time_ms, t.peak AS tesseract_child_rss_peak_bytes, coalesce(t.pending_worker, FALSE) AS pending_worker,
      CASE WHEN r.valid_result THEN e.shown END AS end_to_end_ms, e.ready AS camera_setup_ms,
      CASE WHEN e.ready IS NOT NULL AND e.picked IS NOT NULL THEN greatest(0.0, e.picked - e.ready) END AS frame_wait_ms,
      coalesce(c.considered, 0) AS frames_considered, coalesce(c.sent, 0) AS frames_sent, coalesce(c.rejected, 0) AS frames_rejected
      FROM lab_runs r LEFT JOIN t ON r.run_id = t.run_id LEFT JOIN e ON r.run_id = e.run_id LEFT JOIN c ON r.run_id = c.run_id)"""
SUMMARY_COLUMNS = (
    "run_id ocr_calls api_calls ocr_cpu_time_ms tesseract_child_rss_peak_bytes pending_worker end_to_end_ms "
    "camera_setup_ms frame_wait_ms frames_considered frames_sent frames_rejected"
).split()


def tasks(t):
    return t.lab_tasks.withColumnsRenamed({"cpu_ms": "ocr_cpu_time_ms", "rss_bytes": "tesseract_child_rss_peak_bytes"})


def runs(t):
    winners = t.lab_tasks.where("sufficient").groupBy("run_id").agg(F.min("task_no").alias("winner_no"))
    return t.lab_runs.join(winners, "run_id", "left")


def summaries(t):
    return lab.run_summaries(runs(t), tasks(t), t.lab_events)


@check("agg_7_run_summaries", "WITH " + SUMMARY_CTE + "SELECT " + ", ".join(SUMMARY_COLUMNS) + " FROM summaries")
def _(t):
    return summaries(t).select(*SUMMARY_COLUMNS)


RANK = "arg_min(end_to_end_ms, end_to_end_ms) FILTER (WHERE rn = greatest(1, ceil(k * {p})))"


@check("agg_8_group_report", "WITH " + SUMMARY_CTE + """,
    kept AS (SELECT *, row_number() OVER (PARTITION BY protocol_version, mode, config_no ORDER BY end_to_end_ms NULLS LAST) AS rn,
      count(end_to_end_ms) OVER (PARTITION BY protocol_version, mode, config_no) AS k FROM summaries WHERE NOT excluded_from_analysis)
    SELECT protocol_version, mode, config_no, count(*) AS n, count(*) FILTER (WHERE valid_result) AS success,
      count(*) FILTER (WHERE status = 'running') AS running, count(end_to_end_ms) AS timed_successes,
      min(end_to_end_ms) FILTER (WHERE rn = greatest(1, ceil(k * 0.5))) AS p50, min(end_to_end_ms) FILTER (WHERE rn = greatest(1, ceil(k * 0.95))) AS p95,
      CAST(sum(ocr_calls) AS BIGINT) AS ocr_calls, CAST(sum(api_calls) AS BIGINT) AS api_calls,
      CASE WHEN count(*) FILTER (WHERE ocr_calls <> 0 AND ocr_cpu_time_ms IS NULL) = 0 THEN CAST(sum(coalesce(ocr_cpu_time_ms, 0)) AS DOUBLE) END AS ocr_cpu_time_ms,
      max(tesseract_child_rss_peak_bytes) AS tesseract_child_rss_peak_bytes,
      round(count(*) FILTER (WHERE valid_result) / count(*), 9) AS success_rate FROM kept GROUP BY 1, 2, 3""")
def _(t):
    out = lab.group_report(summaries(t), ["protocol_version", "mode", "config_no"])
    return out.select(
        "protocol_version", "mode", "config_no", "n", "success", "running", "timed_successes", "p50", "p95", "ocr_calls",
        "api_calls", "ocr_cpu_time_ms", "tesseract_child_rss_peak_bytes", F.round("success_rate", 9).alias("success_rate"),
    )


def conditioned(t):
    """Runs with an environment whose start time differs from run to run."""
    env = F.create_map(F.lit("started_at_utc"), F.col("started_at").cast("string"), F.lit("device"), F.concat(F.lit("d"), (F.col("case_id") % 4).cast("string")),
                       F.lit("browser"), F.lit("b"))
    own = lab.with_condition(summaries(t).withColumn("environment", F.when(F.col("case_id") != 7, env)))
    return own.drop("environment")


@check("agg_8_conditions", "WITH " + SUMMARY_CTE + """,
    x AS (SELECT *, CASE WHEN case_id <> 7 THEN '{"browser":"b","device":"d' || (case_id % 4) || '"}' ELSE '{}' END AS environment_text FROM summaries WHERE NOT excluded_from_analysis),
    y AS (SELECT *, sha256('{"protocol_version":"' || protocol_version || '","mode":"' || mode || '","config_no":' || config_no || ',"environment":' || environment_text || '}') AS condition_key FROM x),
    kept AS (SELECT *, row_number() OVER (PARTITION BY condition_key ORDER BY end_to_end_ms NULLS LAST) AS rn, count(end_to_end_ms) OVER (PARTITION BY condition_key) AS k FROM y),
    g AS (SELECT condition_key, protocol_version, mode, config_no, environment_text, count(*) AS n, count(*) FILTER (WHERE valid_result) AS success,
      count(*) FILTER (WHERE status = 'running') AS running, CAST(0 AS BIGINT) AS frame_reviewed, CAST(0 AS BIGINT) AS complete_frames, CAST(0 AS BIGINT) AS quality_reviewed, CAST(0 AS BIGINT) AS quality_successes,
      CAST(NULL AS DOUBLE) AS mean_ingredient_recall, count(end_to_end_ms) AS timed_successes, CAST(sum(ocr_calls) AS BIGINT) AS ocr_calls, CAST(sum(api_calls) AS BIGINT) AS api_calls,
      CASE WHEN count(*) FILTER (WHERE ocr_calls <> 0 AND ocr_cpu_time_ms IS NULL) = 0 THEN CAST(sum(coalesce(ocr_cpu_time_ms, 0)) AS DOUBLE) END AS ocr_cpu_time_ms,
      CASE WHEN count(*) FILTER (WHERE ocr_calls <> 0) = 0 THEN CAST(0 AS DOUBLE) END AS shared,
      CASE WHEN count(*) FILTER (WHERE api_calls <> 0) = 0 THEN CAST(0 AS DOUBLE) END AS total_transfer_bytes, CASE WHEN count(*) FILTER (WHERE ocr_calls <> 0) = 0 THEN CAST(0 AS DOUBLE) END AS ocr_image_bytes,
      max(tesseract_child_rss_peak_bytes) AS tesseract_child_rss_peak_bytes, min(end_to_end_ms) FILTER (WHERE rn = greatest(1, ceil(k * 0.5))) AS p50, min(end_to_end_ms) FILTER (WHERE rn = greatest(1, ceil(k * 0.95))) AS p95,
      count(*) FILTER (WHERE ocr_calls <> 0) AS called FROM kept GROUP BY ALL)
    SELECT * EXCLUDE (shared, called), round(success / n, 9) AS success_rate, CAST(NULL AS DOUBLE) AS frame_completeness_rate, CAST(NULL AS DOUBLE) AS quality_success_rate,
      round(ocr_cpu_time_ms / n, 6) AS ocr_cpu_per_run_ms, CAST(NULL AS DOUBLE) AS ocr_cpu_per_complete_scan_ms, round(total_transfer_bytes / n, 6) AS transfer_per_run_bytes, CAST(NULL AS DOUBLE) AS bytes_per_complete_scan,
      shared / n AS shared_process_cpu_per_run_ms, CASE WHEN success > 0 THEN shared / success END AS shared_process_cpu_per_success_ms,
      CAST(NULL AS BIGINT) AS shared_process_rss_peak_bytes, CAST(NULL AS BIGINT) AS ocr_process_tree_rss_peak_bytes,
      CASE WHEN ocr_cpu_time_ms IS NOT NULL THEN 'sampled_process_tree' ELSE 'not_measured' END AS measurement_quality FROM g""")
def _(t):
    """Every column of the report, per condition with its environment."""
    out = lab.group_report(conditioned(t), lab.CONDITION)
    return out.withColumns({"success_rate": F.round("success_rate", 9), "ocr_cpu_per_run_ms": F.round("ocr_cpu_per_run_ms", 6), "transfer_per_run_bytes": F.round("transfer_per_run_bytes", 6)})


@check("exact_percentiles", """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
      count(*) OVER (PARTITION BY event_type) AS k FROM events)
    SELECT event_type, max(value) FILTER (WHERE rn = ceil(k * 0.5)) AS p50, max(value) FILTER (WHERE rn = ceil(k * 0.95)) AS p95,
      max(value) FILTER (WHERE rn = ceil(k * 0.99)) AS p99 FROM r GROUP BY 1""")
def _(t):
    from provisor.operators.spread import exact_percentiles

    return exact_percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 10.0)


@check("agg_9_complete_sums", """
    SELECT run_id, CASE WHEN count(*) FILTER (WHERE cpu_ms IS NULL) = 0 THEN CAST(sum(cpu_ms) AS BIGINT) END AS cpu_ms FROM lab_tasks GROUP BY 1""")
def _(t):
    return t.lab_tasks.groupBy("run_id").agg(complete_sum(F.col("cpu_ms")).alias("cpu_ms"))


@check("agg_10_traffic_totals", """
    WITH n AS (SELECT run_id, count(*) AS tasks FROM lab_tasks WHERE status = 'finished' GROUP BY 1),
    x AS (SELECT run_id, count(*) AS rows, count(*) FILTER (WHERE upload_bytes >= 0 AND download_bytes >= 0) AS usable,
      sum(upload_bytes + download_bytes) AS total, coalesce(sum(upload_bytes) FILTER (WHERE kind = 'ocr'), 0) AS ocr_up FROM lab_tasks GROUP BY 1)
    SELECT r.run_id, CASE WHEN coalesce(x.rows, 0) = coalesce(n.tasks, 0) AND coalesce(x.usable, 0) = coalesce(x.rows, 0) THEN CAST(coalesce(x.total, 0) AS BIGINT) END AS total_transfer_bytes,
      CASE WHEN coalesce(x.rows, 0) = coalesce(n.tasks, 0) AND coalesce(x.usable, 0) = coalesce(x.rows, 0) THEN CAST(coalesce(x.ocr_up, 0) AS BIGINT) END AS ocr_upload_bytes
    FROM lab_runs r LEFT JOIN n ON r.run_id = n.run_id LEFT JOIN x ON r.run_id = x.run_id""")
def _(t):
    traffic = t.lab_tasks.select(
        "run_id", F.lit("browser").alias("source"), F.col("task_no").alias("seq"), F.lit("task_traffic").alias("event_name"),
        F.lit(0.0).alias("relative_ms"), "kind", F.col("upload_bytes").alias("upload_json_bytes"),
        F.col("download_bytes").alias("download_json_bytes"), F.lit(True).alias("submission_acknowledged"),
    )
    out = lab.run_summaries(runs(t), tasks(t).where("status = 'finished'"), traffic)
    return out.select("run_id", "total_transfer_bytes", "ocr_upload_bytes")


@check("agg_11_selection_totals", """
    SELECT count(*) AS n_total, count(*) FILTER (WHERE excluded_from_analysis) AS n_excluded FROM lab_runs WHERE mode = '1-URGENT'""")
def _(t):
    return lab.selection_totals(lab.select_runs(t.lab_runs, mode="1-URGENT", exclusion="all"))


@check("agg_21_quality_reviews", """
    SELECT run_id, m AS matched_count, round_even(m / n, 4) AS ingredient_recall, m / n >= 0.8 AS quality_success
    FROM (SELECT o_orderkey AS run_id, CAST(o_custkey % 9 + 1 AS INTEGER) AS n, CAST(o_orderkey % (o_custkey % 9 + 1) + 1 AS INTEGER) AS m FROM orders)""")
def _(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 9 + 1).alias("reference_count"),
        F.sequence(F.lit(0), (F.col("o_orderkey") % (F.col("o_custkey") % 9 + 1)).cast("int")).alias("matched_indices"),
    )
    return lab.quality_review(rows).select("run_id", "matched_count", "ingredient_recall", "quality_success")


@check("win_4_first_events", """
    SELECT run_id, event_name, min(seq) AS seq, arg_min(relative_ms, seq) AS relative_ms FROM lab_events WHERE source = 'browser' GROUP BY 1, 2""")
def _(t):
    return lab.first_events(t.lab_events)


@check("win_7_representative_tasks", """
    WITH w AS (SELECT run_id, min(task_no) AS winner_no FROM lab_tasks WHERE sufficient GROUP BY 1),
    l AS (SELECT run_id, max(task_no) AS last_no FROM lab_tasks WHERE kind = 'ocr' GROUP BY 1),
    x AS (SELECT r.run_id, CASE WHEN o.task_no IS NOT NULL THEN o.task_no WHEN r.outcome <> 'valid_barcode' THEN l.last_no END AS task_no
      FROM lab_runs r LEFT JOIN w ON r.run_id = w.run_id LEFT JOIN lab_tasks o ON o.run_id = w.run_id AND o.task_no = w.winner_no AND o.kind = 'ocr'
      LEFT JOIN l ON r.run_id = l.run_id)
    SELECT run_id, task_no FROM x WHERE task_no IS NOT NULL""")
def _(t):
    return lab.representative_tasks(runs(t), t.lab_tasks)


@check("win_8_server_sequence", """
    WITH b AS (SELECT run_id, max(seq) AS base FROM lab_events WHERE source = 'server' GROUP BY 1)
    SELECT e.run_id, e.seq AS event_no, row_number() OVER (PARTITION BY e.run_id ORDER BY e.ts, e.seq) - 1 + coalesce(b.base + 1, 0) AS seq
    FROM lab_events e LEFT JOIN b ON e.run_id = b.run_id WHERE e.source = 'browser'""")
def _(t):
    new = t.lab_events.where("source = 'browser'").select("run_id", F.col("seq").alias("event_no"), "ts")
    out = lab.server_sequence(new, t.lab_events, F.date_trunc("HOUR", "ts"))
    return out.select("run_id", "event_no", "seq")


@check("win_10_latest_import", "SELECT arg_max(sha256(text), doc_id) AS input_sha256 FROM documents")
def _(t):
    return lab.latest_import(t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("input_sha256")))


LOG = """log AS (SELECT l_orderkey AS run_id, (CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) * 10000 + l_suppkey AS seq,
      l_returnflag = 'R' AS excluded, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'bad_setup' ELSE 'other' END END AS reason,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'note' END AS comment, l_linenumber FROM lineitem)"""


def exclusion_log(t):
    return t.sql(LOG[LOG.index("(") + 1:-1])


@check("chg_3_applied_exclusions", "WITH " + LOG + """,
    p AS (SELECT *, lag(excluded) OVER w AS e, lag(reason) OVER w AS r, lag(comment) OVER w AS c FROM log WINDOW w AS (PARTITION BY run_id ORDER BY seq))
    SELECT run_id, seq, excluded, reason, comment FROM p
    WHERE NOT (coalesce(e, FALSE) = excluded AND (NOT excluded OR (r IS NOT DISTINCT FROM reason AND c IS NOT DISTINCT FROM comment)))""")
def _(t):
    return lab.applied_exclusions(exclusion_log(t), F.floor(F.col("seq") / 40960000)).select("run_id", "seq", "excluded", "reason", "comment")


@check("chg_3_exclusion_state", "WITH " + LOG + """
    SELECT run_id, excluded, reason, comment FROM log QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1""")
def _(t):
    return lab.exclusion_state(exclusion_log(t))


DELETED = """
    d AS (SELECT run_id, CASE WHEN status = 'running' OR run_id IN (SELECT run_id FROM lab_tasks WHERE status = 'running') THEN 'refused' ELSE 'deleted' END AS outcome
      FROM lab_runs WHERE case_id = 7)"""


@check("chg_4_deletion_outcome", "WITH " + DELETED + "SELECT run_id, outcome FROM d")
def _(t):
    return lab.deletion_outcome(t.lab_runs.where("case_id = 7"), t.lab_runs, t.lab_tasks)


@check("chg_4_remaining_tasks", "WITH " + DELETED + """
    SELECT run_id, task_no, kind FROM lab_tasks WHERE run_id NOT IN (SELECT run_id FROM d WHERE outcome = 'deleted')""")
def _(t):
    outcome = lab.deletion_outcome(t.lab_runs.where("case_id = 7"), t.lab_runs, t.lab_tasks)
    return lab.without_runs(outcome, t.lab_tasks)[0].select("run_id", "task_no", "kind")


@check("chg_5_finished_runs", """
    WITH w AS (SELECT run_id, min(task_no) AS winner_no FROM lab_tasks GROUP BY 1),
    q AS (SELECT r.run_id, CASE r.case_id % 4 WHEN 0 THEN 'valid_ocr' WHEN 1 THEN 'valid_barcode' WHEN 2 THEN 'timeout' ELSE 'cancelled' END AS requested, w.winner_no
      FROM lab_runs r JOIN w ON r.run_id = w.run_id),
    j AS (SELECT q.*, r.status, coalesce(t.sufficient AND t.kind = CASE WHEN requested = 'valid_ocr' THEN 'ocr' ELSE 'lookup' END, FALSE) AS proven,
      requested LIKE 'valid%' AS valid FROM q JOIN lab_runs r ON q.run_id = r.run_id LEFT JOIN lab_tasks t ON t.run_id = q.run_id AND t.task_no = q.winner_no)
    SELECT run_id, CASE WHEN status <> 'running' THEN 'unchanged' WHEN valid AND NOT proven THEN 'rejected' WHEN requested = 'cancelled' THEN 'interrupted' ELSE 'finished' END AS result,
      valid AND proven AND status = 'running' AS valid_result FROM j""")
def _(t):
    winners = t.lab_tasks.groupBy("run_id").agg(F.min("task_no").alias("winner_no"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("valid_ocr", "valid_barcode", "timeout", "cancelled")]), (F.col("case_id") % 4 + 1).cast("int"))
    requests = t.lab_runs.select("run_id", kinds.alias("requested")).join(winners, "run_id")
    return lab.finished_runs(requests, t.lab_runs, t.lab_tasks)


@check("flt_12_selected_runs", """
    SELECT run_id FROM lab_runs WHERE mode = '2-HIGH' AND outcome = 'valid_ocr' AND started_at >= TIMESTAMP '1996-01-01' AND started_at <= TIMESTAMP '1999-12-31' AND NOT excluded_from_analysis""")
def _(t):
    return lab.select_runs(
        t.lab_runs, mode="2-HIGH", outcome="valid_ocr", since=dt.datetime(1996, 1, 1), until=dt.datetime(1999, 12, 31)
    ).select("run_id")


@check("flt_18_overdue_runs", """
    SELECT run_id FROM lab_runs WHERE status = 'running' AND TIMESTAMP '2000-01-01 00:00:20' > started_at + (run_max_ms + 15000) * INTERVAL 1 MILLISECOND""")
def _(t):
    return lab.overdue(t.lab_runs, dt.datetime(2000, 1, 1, 0, 0, 20)).select("run_id")


@check("ord_2_run_history", "SELECT run_id FROM lab_runs WHERE NOT excluded_from_analysis ORDER BY started_at DESC, run_id LIMIT 30 OFFSET 60")
def _(t):
    return lab.history(lab.select_runs(t.lab_runs), 30, 60).select("run_id")


@check("ord_2_deep_history", "SELECT run_id FROM lab_runs WHERE NOT excluded_from_analysis ORDER BY started_at DESC, run_id LIMIT 30 OFFSET 900")
def _(t):
    from provisor.operators.paging import OrderedPages

    runs = lab.select_runs(t.lab_runs).select("run_id", "started_at")
    return OrderedPages(runs, [F.desc("started_at"), "run_id"], "history-pages", 250).page(30, 900).select("run_id")


@check("ord_4_export_guard", "SELECT count(*) > 200 AS over_limit FROM lab_runs WHERE mode = '5-LOW'")
def _(t):
    return lab.over_limit(t.lab_runs.where("mode = '5-LOW'"), 200)


@check("snk_5_export_documents", """
    SELECT run_id, source, seq // 5000 AS part_no, string_agg(seq || ':' || event_name, '|' ORDER BY seq) AS events FROM lab_events GROUP BY ALL""")
def _(t):
    docs = lab.export_documents(t.lab_events.select("run_id", "source", "seq", "event_name", "relative_ms"))
    text = F.transform("events", lambda e: F.concat(e["seq"].cast("string"), F.lit(":"), e["event_name"]))
    return docs.select("run_id", "source", "part_no", F.array_join(text, "|").alias("events"))


def export(t):
    from provisor.sinks.run_export import export_parts

    audit = t.lab_runs.where("run_id % 3 = 0").select("run_id", (F.col("run_id") * 2).alias("id"), F.lit("excluded").alias("action")).unionByName(
        t.lab_runs.where("run_id % 3 = 0").select("run_id", (F.col("run_id") * 2 + 1).alias("id"), F.lit("restored").alias("action")))
    own = lab.event_metrics(t.lab_events).select("run_id", "frames_considered")
    return export_parts(
        t.lab_runs.select("run_id", "case_id", "mode", "excluded_from_analysis"), t.cases, t.lab_events.select("run_id", "source", "seq", "event_name"),
        t.lab_tasks.select("run_id", "task_no", "kind", "cpu_ms", F.col("requested_at").cast("timestamp").alias("requested_at")),
        audit, own, t.lab_runs.groupBy("mode").agg(F.count(F.lit(1)).alias("n")), part_rows=2)


EXPORT_SQL = """
    WITH chosen AS (SELECT run_id, case_id, mode FROM lab_runs WHERE NOT excluded_from_analysis),
    rows_of AS (
      SELECT run_id, 'run' AS section, 1 AS no, '{"run_id":' || run_id || ',"case_id":' || case_id || ',"mode":"' || mode || '","excluded_from_analysis":false}' AS item FROM chosen
      UNION ALL SELECT run_id, 'case', 1, '{"case_id":' || k.case_id || ',"case_title":"' || case_title || '"}' FROM chosen c JOIN cases k ON c.case_id = k.case_id
      UNION ALL SELECT e.run_id, 'events', row_number() OVER (PARTITION BY e.run_id ORDER BY source, seq), '{"run_id":' || e.run_id || ',"source":"' || source || '","seq":' || seq || ',"event_name":"' || event_name || '"}'
        FROM lab_events e JOIN chosen c ON e.run_id = c.run_id
      UNION ALL SELECT t.run_id, 'tasks', row_number() OVER (PARTITION BY t.run_id ORDER BY requested_at, task_no), '{"run_id":' || t.run_id || ',"task_no":' || task_no || ',"kind":"' || kind || '","cpu_ms":'
        || coalesce(CAST(cpu_ms AS VARCHAR), 'null') || ',"requested_at":"' || strftime(requested_at, '%Y-%m-%dT00:00:00.000Z') || '"}' FROM lab_tasks t JOIN chosen c ON t.run_id = c.run_id
      UNION ALL SELECT run_id, 'exclusion_audit', i + 1, '{"run_id":' || run_id || ',"id":' || (run_id * 2 + i) || ',"action":"' || CASE i WHEN 0 THEN 'excluded' ELSE 'restored' END || '"}'
        FROM (SELECT run_id, unnest([0, 1]) AS i FROM chosen WHERE run_id % 3 = 0)
      UNION ALL SELECT e.run_id, 'measured_summary', 1, '{"run_id":' || e.run_id || ',"frames_considered":' || count(*) FILTER (WHERE source = 'browser' AND event_name = 'frame_considered') || '}'
        FROM lab_events e JOIN chosen c ON e.run_id = c.run_id GROUP BY e.run_id
      UNION ALL SELECT NULL, 'aggregates', 1, '{"mode":"' || mode || '","n":' || count(*) || '}' FROM lab_runs GROUP BY mode),
    parts AS (SELECT CAST(run_id AS VARCHAR) AS run_id, section, CAST((no - 1) // 2 AS BIGINT) AS part_no, count(*) AS rows, CAST(sum(strlen(item)) AS BIGINT) AS bytes, string_agg(item, ',' ORDER BY no, item) AS items FROM rows_of GROUP BY 1, 2, 3)"""


@check("snk_5_run_export", EXPORT_SQL + " SELECT * FROM parts")
def _(t):
    """Every section of every chosen run; parts of two rows, so that lists go on in further parts."""
    return export(t).withColumn("items", F.array_join("items", ","))


@check("snk_5_export_manifest", EXPORT_SQL + " SELECT run_id, section, count(*) AS parts, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts GROUP BY 1, 2")
def _(t):
    from provisor.sinks.run_export import manifest

    return manifest(export(t))


@check("str_5_expired_heartbeats_batch", """
    SELECT run_id FROM lab_events GROUP BY run_id HAVING max(ts) < TIMESTAMP '2024-01-30 19:57:00'""")
def _(t):
    return lab.expired_heartbeats(t.lab_events, NOW).select("run_id")
