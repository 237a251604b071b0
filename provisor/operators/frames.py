"""Camera frame fingerprints and recognised word tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.operators.spread import previous_value, round_half_even, running_total, scan_in_order

# Acceptance limits of a frame, recognition and upscaling limits.
MIN_MEAN, MAX_MEAN, MIN_EDGE, MAX_MOVEMENT, DUPLICATE_BELOW = 30, 235, 2, 20, 3
MIN_CONFIDENCE = 0.45
MIN_WORD_CONFIDENCE = 30
TARGET_WORD_HEIGHT, MIN_SCALE, MAX_SCALE, DEFAULT_SCALE = 34, 1.0, 4.0, 2.0
POOL_SIZE, POOL_MS = 3, 750


def recognition_gate(text: Column, confidence: Column) -> Column:
    """Blank text or a confidence below the limit asks for another photo."""
    weak = (F.btrim(text) == "") | (confidence < MIN_CONFIDENCE)
    return F.when(F.coalesce(weak, F.lit(True)), "needs_retake").otherwise("success")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def mean_difference(left: Column, right: Column) -> Column:
    """Mean absolute difference of two arrays of one length."""
    return _mean(F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b)))


def frame_statistics(fp: Column, width: int) -> dict[str, Column]:
    """Mean, contrast, edge and sharpness of a gray-level array with rows of ``width`` values."""
    x = F.transform(fp, lambda v: v.cast("double"))
    n = F.size(x)
    mean = _mean(x)
    # Moments in one fold; the variance is the population one.
    moments = F.aggregate(
        x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")),
    )
    contrast = F.sqrt(F.greatest(F.lit(0.0), moments["q"] / n - F.pow(moments["s"] / n, 2)))
    steps = F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda a, b: F.abs(a - b))
    edge = F.aggregate(steps, F.lit(0.0), lambda a, v: a + v) / n
    inner = F.filter(F.sequence(F.lit(width), n - width - 1), lambda i: (i % width != 0) & (i % width != width - 1))
    bends = F.transform(
        inner,
        lambda i: F.get(x, i - 1) + F.get(x, i + 1) + F.get(x, i - width) + F.get(x, i + width) - 4 * F.get(x, i),
    )
    bend = F.aggregate(
        bends, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")),
    )
    sharpness = F.greatest(F.lit(0.0), bend["q"] / F.size(inner) - F.pow(bend["s"] / F.size(inner), 2))
    return {"mean": mean, "contrast": contrast, "edge": edge, "sharpness": sharpness}


def frame_score(sharpness: Column, contrast: Column, brightness: Column, movement: Column) -> Column:
    """Ranking score of a frame among its neighbours."""
    return (
        F.log1p(sharpness) * 2 + contrast / 10 - F.abs(brightness - 128) / 35
        - F.coalesce(movement, F.lit(0.0)) / 15
    )


def with_segments(
    frames: DataFrame, bucket: Column, keys: tuple[str, ...] = ("run_id",), order: str = "frame_no", geometry: tuple[str, ...] = ("width", "height", "angle")
) -> DataFrame:
    """``frames`` with ``segment``: numbers from 1 the stretches of a run without a change of geometry.

    A run that returns to an earlier geometry starts a new segment. Angles count
    modulo 360. Both the look back and the numbering are cut into buckets, so a segment may cross
    their borders.
    """
    turn = lambda c: F.pmod(F.col(c), F.lit(360)) if c == "angle" else F.col(c)
    shaped = frames.withColumn("_shape", F.struct(*[turn(c).alias(c) for c in geometry]))
    before = previous_value(shaped, list(keys), bucket, order, "_shape", "_earlier")
    fresh = (~F.col("_shape").eqNullSafe(F.col("_earlier"))).cast("long")
    return running_total(before, list(keys), bucket, order, fresh, "segment").drop("_shape", "_earlier")


def with_movement(frames: DataFrame, bucket: Column, keys: tuple[str, ...] = ("run_id",), order: str = "frame_no") -> DataFrame:
    """Mean difference from the previous frame of the same run (and segment, if among the keys; see ``with_segments``)."""
    before = previous_value(frames, list(keys), bucket, order, "fp", "_previous")
    return before.withColumn("movement", mean_difference(F.col("fp"), F.col("_previous"))).drop("_previous")


def frame_outcome(mean: Column, edge: Column, movement: Column, duplicate: Column) -> Column:
    return (
        F.when(mean < MIN_MEAN, "too_dark").when(mean > MAX_MEAN, "too_bright").when(edge < MIN_EDGE, "low_edges")
        .when(F.coalesce(movement > MAX_MOVEMENT, F.lit(False)), "moving")
        .when(F.coalesce(duplicate, F.lit(False)), "duplicate").otherwise("ok")
    )


def best_frames(frames: DataFrame, pool: list[str], score: str = "score", order: str = "frame_no") -> DataFrame:
    """Best frame of each pool: highest score, earliest on ties."""
    top = frames.groupBy(*pool).agg(F.max(score).alias(score))
    return frames.join(top, [*pool, score]).groupBy(*pool, score).agg(F.min(order).alias(order))


SELECTION_SCHEMA = "run_id long, pool_no long, frame_no long, candidates int, score double"


def select_frames(frames: DataFrame) -> DataFrame:
    """Pools of up to three accepted frames or 750 ms; the best one of each pool is sent.

    A frame closer than the limit to the frame sent last is a duplicate and joins no pool, so
    the result depends on what was sent before: one ordered pass per run that only keeps the
    open pool. Needs ``run_id, frame_no, at_ms, fp, score, outcome``.
    """
    import numpy as np
    import pandas as pd

    def scan(batches):
        run = sent = started = None
        pool, pool_no = [], 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.run_id != run:
                    run, sent, started, pool, pool_no = row.run_id, None, None, [], 0
                started = row.at_ms if started is None else started
                fp = np.asarray(row.fp, dtype="float64")
                repeat = sent is not None and np.abs(fp - sent).mean() < DUPLICATE_BELOW
                if row.outcome == "ok" and not repeat:
                    pool.append((row.score, row.frame_no, fp))
                if len(pool) < POOL_SIZE and row.at_ms - started < POOL_MS:
                    continue
                if pool:
                    best = max(pool, key=lambda item: item[0])
                    sent = best[2]
                    out.append((run, pool_no, best[1], len(pool), best[0]))
                    pool_no += 1
                pool, started = [], None
            yield pd.DataFrame(out, columns=["run_id", "pool_no", "frame_no", "candidates", "score"])

    needed = frames.select("run_id", "frame_no", "at_ms", "fp", "score", "outcome")
    return scan_in_order(needed, ["run_id"], ["at_ms", "frame_no"], scan, SELECTION_SCHEMA)


def text_lines(words: DataFrame, keys: list[str], order: str = "word_no") -> DataFrame:
    """Text of each recognised line (bounded by the width of an image), blank words dropped."""
    kept = words.where(F.btrim("word") != "")
    parts = F.array_sort(F.collect_list(F.struct(order, "word")))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda w: w["word"]), " ").alias("line"))


def page_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence of non-blank words with a confidence of at least zero, on a 0-1 scale."""
    counted = (F.btrim("word") != "") & (F.col("conf") >= 0)
    mean = F.avg(F.when(counted, F.col("conf").cast("double")))
    return words.groupBy(*keys).agg(F.coalesce(round_half_even(mean / 100, 3), F.lit(0.0)).alias("confidence"))


def upscale_factors(words: DataFrame, keys: list[str]) -> DataFrame:
    """Median height of confident words and the scale factor that brings it to the target."""
    counted = (F.btrim("word") != "") & (F.col("conf") > MIN_WORD_CONFIDENCE)
    heights = words.where(counted).groupBy(*keys, "height").agg(F.count(F.lit(1)).alias("n"))
    pages = words.select(*keys).distinct()
    # Heights are pixel counts, so the per-page histogram stays small; the median reads it.
    exact = _weighted_median(heights, keys)
    height = F.coalesce("median_height", F.lit(0.0))
    factor = F.least(F.greatest(F.lit(TARGET_WORD_HEIGHT) / F.nullif(height, F.lit(0.0)), F.lit(MIN_SCALE)), F.lit(MAX_SCALE))
    return (
        pages.join(exact, keys, "left")
        .select(*keys, height.alias("median_height"),
                F.when(height > 0, round_half_even(factor, 2)).otherwise(DEFAULT_SCALE).alias("factor"))
    )


def _weighted_median(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Median per key of a histogram (height, n): mean of the two middle ranks."""
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("height").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = histogram.select(*keys, "height", "n", upto.alias("_upto"), total.alias("_total"))

    def at(rank: Column) -> Column:
        return F.min(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank), F.col("height")))

    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2.0).alias("median_height"))
