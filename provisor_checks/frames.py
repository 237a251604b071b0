"""Frames and recognised words."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisor.operators import frames as fr
from provisor_checks.registry import check

WIDTH = 8
STATS = """st AS (SELECT run_id, frame_no, list_avg(list_transform(fp, lambda v: CAST(v AS DOUBLE))) AS mean,
      list_stddev_pop(list_transform(fp, lambda v: CAST(v AS DOUBLE))) AS contrast,
      list_sum(list_transform(range(2, 65), lambda i: abs(CAST(fp[i] AS DOUBLE) - CAST(fp[i - 1] AS DOUBLE)))) / 64 AS edge,
      list_var_pop(list_transform(list_filter(range(9, 57), lambda i: i % 8 <> 0 AND i % 8 <> 7),
        lambda i: CAST(fp[i] AS DOUBLE) + CAST(fp[i + 2] AS DOUBLE) + CAST(fp[i - 7] AS DOUBLE) + CAST(fp[i + 9] AS DOUBLE) - 4 * CAST(fp[i + 1] AS DOUBLE))) AS sharpness FROM frames)"""


def with_stats(frames):
    return frames.withColumns(fr.frame_statistics(F.col("fp"), WIDTH))


@check("agg_20_frame_statistics", "WITH " + STATS + """
    SELECT run_id, frame_no, round(mean, 6) AS mean, round(contrast, 6) AS contrast, round(edge, 6) AS edge, round(sharpness, 6) AS sharpness FROM st""")
def _(t):
    out = with_stats(t.frames)
    return out.select("run_id", "frame_no", *[F.round(c, 6).alias(c) for c in ("mean", "contrast", "edge", "sharpness")])


MOVED = """mv AS (SELECT run_id, frame_no, fp, lag(fp) OVER (PARTITION BY run_id ORDER BY frame_no) AS prev FROM frames),
    mo AS (SELECT run_id, frame_no, CASE WHEN prev IS NOT NULL THEN list_avg(list_transform(range(1, 65), lambda i: abs(CAST(fp[i] AS DOUBLE) - CAST(prev[i] AS DOUBLE)))) END AS movement FROM mv)"""


def moved(t):
    return fr.with_movement(t.frames, F.floor(F.col("frame_no") / 256))


@check("win_5_frame_movement", "WITH " + MOVED + "SELECT run_id, frame_no, round(movement, 6) AS movement FROM mo")
def _(t):
    return moved(t).select("run_id", "frame_no", F.round("movement", 6).alias("movement"))


@check("win_5_segment_movement", """
    WITH f AS (SELECT *, CASE WHEN frame_no % 11 < 4 THEN 640 ELSE 480 END AS width, CASE WHEN frame_no % 17 < 9 THEN 0 ELSE 90 END AS turn FROM frames),
    c AS (SELECT *, CASE WHEN lag(width) OVER w = width AND lag(turn) OVER w = turn THEN 0 ELSE 1 END AS fresh, lag(fp) OVER w AS prev FROM f WINDOW w AS (PARTITION BY run_id ORDER BY frame_no)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY frame_no) AS segment FROM c)
    SELECT run_id, frame_no, CAST(segment AS BIGINT) AS segment,
      round(CASE WHEN fresh = 0 THEN list_avg(list_transform(range(1, 65), lambda i: abs(CAST(fp[i] AS DOUBLE) - CAST(prev[i] AS DOUBLE)))) END, 6) AS movement FROM s""")
def _(t):
    """Width and angle come and go; movement starts anew with each segment."""
    shaped = t.frames.withColumns({
        "width": F.when(F.col("frame_no") % 11 < 4, 640).otherwise(480), "height": F.lit(480),
        "angle": F.when(F.col("frame_no") % 17 < 9, F.lit(10)).otherwise(F.lit(80))})
    bucket = F.floor(F.col("frame_no") / 256)
    cut = fr.with_segments(shaped, bucket)
    return fr.with_movement(cut, bucket, ("run_id", "segment")).select("run_id", "frame_no", "segment", F.round("movement", 6).alias("movement"))


@check("flt_16_frame_outcomes", "WITH " + STATS + "," + MOVED + """
    SELECT s.run_id, s.frame_no, CASE WHEN 130 + 2000 * mean < 30 THEN 'too_dark' WHEN 130 + 2000 * mean > 235 THEN 'too_bright' WHEN edge * 16 < 2 THEN 'low_edges'
      WHEN movement IS NOT NULL AND movement * 180 > 20 THEN 'moving' WHEN s.frame_no % 5 = 0 THEN 'duplicate' ELSE 'ok' END AS outcome
    FROM st s JOIN mo m ON s.run_id = m.run_id AND s.frame_no = m.frame_no""")
def _(t):
    out = with_stats(moved(t))
    outcome = fr.frame_outcome(130 + 2000 * F.col("mean"), F.col("edge") * 16, F.col("movement") * 180, F.col("frame_no") % 5 == 0)
    return out.select("run_id", "frame_no", outcome.alias("outcome"))


@check("ord_5_best_frames", """
    WITH s AS (SELECT l_orderkey AS run_id, CAST(l_quantity AS BIGINT) AS score, l_partkey * 10000 + l_suppkey AS frame_no FROM lineitem)
    SELECT run_id, max(score) AS score, min(frame_no) FILTER (WHERE score = m) AS frame_no FROM (SELECT *, max(score) OVER (PARTITION BY run_id) AS m FROM s) GROUP BY run_id""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_quantity").cast("long").alias("score"), (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("frame_no"))
    return fr.best_frames(rows, ["run_id"])


@check("win_6_selected_frames")
def _(t):
    rows = with_stats(moved(t)).select(
        "run_id", "frame_no", (F.col("frame_no") * 250).alias("at_ms"), F.transform("fp", lambda v: v * 255).alias("fp"),
        fr.frame_score(F.col("sharpness"), F.col("contrast"), F.col("mean"), F.col("movement")).alias("score"), F.lit("ok").alias("outcome"))
    return fr.select_frames(rows)


@check("agg_18_text_lines", """
    SELECT page_no, line_no, string_agg(word, ' ' ORDER BY word_no, word) AS line FROM words WHERE trim(word) <> '' GROUP BY 1, 2""")
def _(t):
    return fr.text_lines(t.words, ["page_no", "line_no"])


@check("agg_18_page_confidence", """
    SELECT page_no, coalesce(round_even(avg(conf) FILTER (WHERE trim(word) <> '' AND conf >= 0) / 100, 3), 0.0) AS confidence FROM words GROUP BY 1""")
def _(t):
    return fr.page_confidence(t.words, ["page_no"])


@check("agg_19_upscale_factors", """
    WITH m AS (SELECT page_no, coalesce(median(height) FILTER (WHERE trim(word) <> '' AND conf > 30), 0.0) AS h FROM words GROUP BY 1)
    SELECT page_no, h AS median_height, CASE WHEN h > 0 THEN round_even(least(greatest(34 / h, 1.0), 4.0), 2) ELSE 2.0 END AS factor FROM m""")
def _(t):
    return fr.upscale_factors(t.words, ["page_no"])
