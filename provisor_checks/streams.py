"""Streams over the driver tables; each must equal its batch SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from provisor.operators import changes
from provisor.session import shared_dir
from provisor.streaming import jobs
from provisor.streaming.keyed_log import KeyedLog
from provisor_checks.labels import COUNTS, DICT_CTE, RESOLVED, VERDICT, VERDICT_COLUMNS, catalog
from provisor_checks.registry import check

DAY = dt.date(2025, 6, 1)


def event_stream(t):
    """The events table as a stream, with the columns of the derived event log."""
    raw = jobs.read_stream(t.spark, t.dir, "events.parquet", t.events.schema)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in (
        ("view", "frame_considered"), ("click", "frame_selected"), ("error", "frame_rejected"), ("signup", "camera_ready"),
        ("purchase", "result_displayed")) for x in pair]), F.col("event_type"))
    return raw.select(
        F.col("user_id").alias("run_id"), F.lit("browser").alias("source"), F.floor(F.col("event_id") / 2).alias("seq"), name.alias("event_name"),
        F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") / 200).cast("double").alias("relative_ms"), F.lit("{}").alias("details"), "event_id")


def folders(t, name):
    base = shared_dir(t.spark, name)
    return f"{base}/out", f"{base}/checkpoint"


@check("str_1_label_stream", r"WITH " + DICT_CTE + r""",
    keyed AS (SELECT doc_id AS product_id, pos, token, CASE WHEN regexp_matches(token, '(^|[^\p{L}\p{N}_])[eE][\s-]?\d{3,4}[a-z]?($|[^\p{L}\p{N}_(])')
        AND NOT regexp_matches(token, '(?i)(^|[^\p{L}\p{N}_])(without|free\s+from)($|[^\p{L}\p{N}_])')
        THEN lower('E' || regexp_extract(token, '[eE][\s-]?(\d{3,4}[a-z]?)', 1)) END AS code,
      trim(regexp_replace(replace(lower(token), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS name
      FROM (SELECT doc_id, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id,
        list_filter(list_transform(regexp_split_to_array(text, '[,;()\[\]{}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents))),"""
       + RESOLVED + "," + COUNTS + VERDICT)
def _(t):
    """Documents arrive as label texts."""
    stream = jobs.read_stream(t.spark, t.dir, "documents.parquet", t.documents.schema).select(F.col("doc_id").alias("product_id"), "text")
    out, checkpoint = folders(t, "label-stream")
    jobs.label_verdicts(stream, catalog(t), out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select(*VERDICT_COLUMNS)


@check("str_2_event_intake", """
    WITH e AS (SELECT user_id, event_id, event_id // 2 AS seq, event_type, floor(value / 200) AS v FROM events
      UNION ALL SELECT user_id, event_id + 1000000000, event_id // 2, event_type, floor(value / 200) + event_id % 3 FROM events WHERE event_id % 10 = 0)
    SELECT event_id, user_id AS run_id, seq, CASE WHEN first_value(event_id) OVER w = event_id THEN 'new'
      WHEN first_value(event_type) OVER w = event_type AND first_value(v) OVER w = v THEN 'repeat' ELSE 'conflict' END AS outcome
    FROM e WINDOW w AS (PARTITION BY user_id, seq ORDER BY event_id)""")
def _(t):
    """Four files in order of arrival, one micro-batch each; the last repeats deliveries two days later."""
    first = t.events.select(
        F.col("user_id").alias("run_id"), F.lit("browser").alias("source"), F.floor(F.col("event_id") / 2).alias("seq"),
        F.col("event_type").alias("event_name"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") / 200).cast("double").alias("relative_ms"),
        F.lit("{}").alias("details"), "event_id")
    third = F.floor(F.col("event_id") * 3 / (first.agg(F.max("event_id")).first()[0] + 1))
    again = first.where("event_id % 10 = 0").withColumn("relative_ms", F.col("relative_ms") + F.col("event_id") % 3).withColumn(
        "ts", F.col("ts") + F.expr("interval 2 days")).withColumn("event_id", F.col("event_id") + 1000000000)
    base = shared_dir(t.spark, "event-intake")
    for part in (*(first.where(third == i) for i in range(3)), again):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = t.spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    judged = jobs.run_available(jobs.event_intake(stream), f"{base}/out", f"{base}/checkpoint")
    return judged.select(F.col("arrival").alias("event_id"), "run_id", "seq", "outcome")


@check("str_2_event_intake_batch", """
    WITH e AS (SELECT event_id, user_id, event_id // 2 AS seq, event_type, floor(value / 200) AS v FROM events)
    SELECT event_id, user_id AS run_id, seq, CASE WHEN first_value(event_id) OVER w = event_id THEN 'new'
      WHEN first_value(event_type) OVER w = event_type AND first_value(v) OVER w = v THEN 'repeat' ELSE 'conflict' END AS outcome
    FROM e WINDOW w AS (PARTITION BY user_id, seq ORDER BY event_id)""")
def _(t):
    events = t.events.select(
        F.col("user_id").alias("run_id"), F.lit("browser").alias("source"), F.floor(F.col("event_id") / 2).alias("seq"),
        F.col("event_type").alias("event_name"), F.floor(F.col("value") / 200).alias("relative_ms"), F.lit("{}").alias("details"), "event_id")
    return jobs.event_intake_batch(events, "event_id").select("event_id", "run_id", "seq", "outcome")


@check("str_3_running_counters", """
    SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS considered, count(*) FILTER (WHERE event_type = 'click') AS sent,
      count(*) FILTER (WHERE event_type = 'error') AS rejected FROM events GROUP BY 1""")
def _(t):
    slices = jobs.run_available_updates(jobs.running_counters(event_stream(t)), *folders(t, "counters"), ["run_id", "slice_start"])
    return jobs.counters_of_runs(slices).select("run_id", "considered", "sent", "rejected")


@check("str_3_counters_of_four_batches", """
    SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS considered, count(*) FILTER (WHERE event_type = 'click') AS sent,
      count(*) FILTER (WHERE event_type = 'error') AS rejected FROM events GROUP BY 1""")
def _(t):
    """Four micro-batches in order of time; slices leave the state between them, sums stay whole."""
    name = F.when(F.col("event_type") == "view", "frame_considered").when(F.col("event_type") == "click", "frame_selected").when(F.col("event_type") == "error", "frame_rejected")
    events = t.events.select(F.col("user_id").alias("run_id"), name.alias("event_name"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = events.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    part = F.floor((F.unix_timestamp("ts") - first) * 4 / (last - first + 1))
    base = shared_dir(t.spark, "counter-batches")
    for i in range(4):
        events.where(part == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    slices = jobs.run_available_updates(jobs.running_counters(stream), f"{base}/out", f"{base}/checkpoint", ["run_id", "slice_start"])
    return jobs.counters_of_runs(slices).select("run_id", "considered", "sent", "rejected")


@check("str_4_late_events", """
    SELECT e.event_id, e.user_id AS run_id, e.ts > TIMESTAMP '2024-01-10 00:00:00' + e.user_id * INTERVAL 1 HOUR AS late FROM events e""")
def _(t):
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct().withColumn(
        "finished_at", (F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("run_id").cast("int"))).cast("timestamp"))
    flagged = jobs.flag_late(event_stream(t).select("run_id", "ts", "event_id"), runs)
    return jobs.run_available(flagged.select("event_id", "run_id", "late"), *folders(t, "late"))


@check("str_5_heartbeat_sessions", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 180 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
    SELECT user_id AS run_id, count(*) AS events, strftime(max(ts) + INTERVAL 180 SECOND, '%Y-%m-%d %H:%M:%S') AS expired_at FROM s GROUP BY user_id, no""")
def _(t):
    events = t.events.select(F.col("user_id").alias("run_id"), "ts")
    out = jobs.heartbeat_expiries(events, "1 minute")
    return out.withColumn("expired_at", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss"))


LATE = """
    WITH e AS (SELECT user_id, ts, event_id, least(event_id * 4 // (max(event_id) OVER () + 1) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, 3) AS part FROM events),
    m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 90500 MILLISECOND AS mark, max(max(ts)) OVER () - INTERVAL 90500 MILLISECOND AS done FROM e GROUP BY part),
    k AS (SELECT user_id, ts, done FROM e JOIN m USING (part) WHERE mark IS NULL OR ts > mark),
    g AS (SELECT user_id, ts, done, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 180 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, done, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
    SELECT user_id AS run_id, count(*) AS events, strftime(max(ts) + INTERVAL 180 SECOND, '%Y-%m-%d %H:%M:%S') AS expired_at FROM s
    GROUP BY user_id, no, done HAVING max(ts) + INTERVAL 180 SECOND <= done"""


@check("str_5_heartbeat_stream", LATE)
def _(t):
    """Four micro-batches by arrival; every seventh event arrives one batch late, most of those behind the watermark."""
    last = t.events.agg(F.max("event_id")).first()[0]
    part = F.least(F.floor(F.col("event_id") * 4 / (last + 1)) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.lit(3))
    events = t.events.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), part.alias("part"))
    base = shared_dir(t.spark, "heartbeats")
    for i in range(4):
        events.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = t.spark.readStream.schema("run_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = jobs.run_available(jobs.heartbeat_stream(stream, "90500 milliseconds"), f"{base}/out", f"{base}/checkpoint")
    return out.withColumn("expired_at", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss"))


# Windows of an hour from a first hit to the next first hit, and the number of each hit inside its window.
HIT_WINDOWS = """nx AS (SELECT DISTINCT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM k),
    w AS (SELECT user_id, min(ts) AS start FROM k GROUP BY 1 UNION ALL SELECT nx.user_id, nx.nxt FROM w JOIN nx ON nx.user_id = w.user_id AND nx.ts = w.start WHERE nx.nxt IS NOT NULL),
    o AS (SELECT k.user_id, k.ts, max(w.start) OVER (PARTITION BY k.user_id ORDER BY k.ts) AS start FROM k LEFT JOIN w ON w.user_id = k.user_id AND w.start = k.ts),
    h AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, start ORDER BY ts) AS hits FROM o)"""


@check("str_6_hits_in_order", "WITH RECURSIVE" + LATE[LATE.index("\n    WITH ") + 9:LATE.index(",\n    g AS")].replace("k AS (", "kept AS (") + """,
    k AS (SELECT user_id, ts FROM kept WHERE ts <= done),
    """ + HIT_WINDOWS + """ SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, hits, hits <= 3 AS allowed FROM h""")
def _(t):
    """Four micro-batches by arrival; every seventh hit comes one batch late."""
    last = t.events.agg(F.max("event_id")).first()[0]
    part = F.least(F.floor(F.col("event_id") * 4 / (last + 1)) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.lit(3))
    hits = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), part.alias("part"))
    base = shared_dir(t.spark, "hits")
    for i in range(4):
        hits.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = t.spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = jobs.run_available(jobs.ordered_throttle(stream, 3, 3600, "90500 milliseconds"), f"{base}/out", f"{base}/checkpoint")
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@check("str_6_throttled_hits", "WITH RECURSIVE k AS (SELECT user_id, ts FROM events), " + HIT_WINDOWS + """
    SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS hits, count(*) FILTER (WHERE hits <= 3) AS allowed FROM h GROUP BY 1""")
def _(t):
    hits = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.throttle_batch(hits, 3, 3600).groupBy("key").agg(F.count(F.lit(1)).alias("hits"), F.count_if("allowed").alias("allowed"))


@check("str_7_correction_intake", """
    WITH bad AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 = 0),
    d AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 3 AS batch_id, 'new' AS outcome FROM orders
      UNION ALL SELECT o_orderkey, o_custkey, 1, 'repeat' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = 0
      UNION ALL SELECT o_orderkey, o_custkey, 2, 'conflict' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 = 0
      UNION ALL SELECT o_orderkey, o_custkey, 2, 'repeat' FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 = 0)
    SELECT 'c' || id AS id, CAST(batch_id AS BIGINT) AS batch_id, outcome, batch_id < 2 OR c NOT IN (SELECT c FROM bad) AS saved,
      outcome = 'new' AND (batch_id < 2 OR c NOT IN (SELECT c FROM bad)) AS stored FROM d""")
def _(t):
    """Three micro-batches: new corrections, then repeats beside new ones, then conflicts as well, each of which rejects its request."""
    base = t.orders.select(
        F.concat(F.lit("c"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("arrival"), F.col("o_custkey").cast("string").alias("request_id"),
        F.lit(0).alias("token_index"), F.lit("raw").alias("token_raw"), F.col("o_orderstatus").alias("corrected_text"),
        F.col("o_orderpriority").alias("input_sha256"), F.lit(None).cast("string").alias("user_id"), "o_orderkey")
    third, fifth = F.col("o_orderkey") % 3, F.col("o_orderkey") % 5 == 0
    other = F.concat("corrected_text", F.lit("?"))
    parts = [base.where(third == 0), base.where((third == 1) | ((third == 0) & fifth)),
             base.where((third == 2) | ((third == 1) & fifth)).unionByName(
                 base.where((third == 0) & (F.col("o_orderkey") % 7 == 0)).withColumn("corrected_text", other))]
    folder = shared_dir(t.spark, "corrections")
    for part in parts:
        part.drop("o_orderkey").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(base.drop("o_orderkey").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.correction_intake(stream, f"{folder}/stored", f"{folder}/queue").option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    judged = t.spark.read.parquet(f"{folder}/queue/outcomes").withColumn("batch_id", F.col("batch_id").cast("long"))
    log = KeyedLog(t.spark, f"{folder}/stored", "id", base.select(*changes.CORRECTION_CONTENT, "id").schema)
    kept = log.read(3).select("id", F.lit(True).alias("_kept"))
    stored = F.coalesce("_kept", F.lit(False)) & (F.col("outcome") == "new")
    return judged.join(kept, "id", "left").select("id", "batch_id", "outcome", "saved", stored.alias("stored"))


@check("str_8_stage_stream", """
    SELECT run_id, revision AS no, revision < 5 AS accepted FROM stage_actions""")
def _(t):
    raw = jobs.read_stream(t.spark, t.dir, "conversations.parquet", t.conversations.schema)
    names = F.array(*[F.lit(x) for x in ("start_manual", "finish_manual", "start_app", "finish_app", "annotate", "save_app", "abort")])
    actions = raw.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("no"), F.timestamp_seconds("turn").alias("at"), F.col("turn").alias("revision"),
        F.get(names, (F.col("turn") % 7).cast("int")).alias("action"), F.lit(None).cast("string").alias("payload_error"))
    return jobs.run_available(jobs.stage_stream(actions), *folders(t, "stages")).select("run_id", "no", "accepted")
