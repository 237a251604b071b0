"""Mixing of sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.llm.common import shielded
from provisor.operators.spread import numbered, running_total
from provisor.session import cut_lineage

_WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that one window sorts together.
BUCKET_DOCS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` plus ``target``, and ``_nth``, the source's number.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight,
    round by round, until no target is above. Two sums per round reach the driver.
    """
    order = F.col("source").asc_nulls_last()
    ranged = cut_lineage(sizes.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "sources")
    named = numbered(ranged, [], F.col("_range"), [order], "_nth", start=0).drop("_range")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_nth") % len(weights)).cast("int") + 1)
    weighed = cut_lineage(named.withColumn("_weight", weight), "weights")
    limit = F.col("source_size") * most
    share, total = None, weighed.agg(F.sum("source_size")).first()[0] or 0
    while True:
        capped = F.lit(False) if share is None else F.lit(share) * F.col("_weight") > limit
        done, rest = weighed.agg(F.sum(F.when(capped, limit).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("_weight")))).first()
        now = (total - done) / rest if rest else share or 0.0
        if now == share:
            break
        share = now
    return weighed.withColumn("target", F.least(limit.cast("double"), F.col("_weight") * F.lit(float(share)))).drop("_weight")


def takes(sized: DataFrame, weights=(5, 2, 1), most: int = 3, seed: str = "") -> DataFrame:
    """``sized(doc_id, source, size, ...)`` plus source_size, target and taken words.

    Every document gets a hash-random key. Within its source the documents are cut into ranges
    of the key, so that a range holds about ``BUCKET_DOCS`` of them; running sums inside ranges
    and of whole ranges give the words before each document. A source is taken as many whole
    times as its target holds, and then, in key order, up to the exact rest: the document at the
    cut gives its first words. Equal ids are ordered by the other columns; a null id has the key
    of an empty text, a null or negative size counts as 0.
    """
    sized = sized.withColumn("size", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    goals = targets(per, weights, most)
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))
    key = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    rows = sized.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_key", key)
    bucket = F.floor(F.col("_key") / F.lit(float(1 << 60)) * F.ceil(F.col("_docs") / BUCKET_DOCS))
    ties = [F.col(c) for c in ["_key", *sized.columns]]
    summed = running_total(rows, ["_nth"], bucket, F.struct(*ties), F.col("size"), "_upto")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size") - (F.col("_upto") - F.col("size"))
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return summed.withColumn("taken", taken.cast("long")).drop("_nth", "_docs", "_key", "_upto")


def mix(docs: DataFrame, weights=(5, 2, 1), most: int = 3, seed: str = "") -> DataFrame:
    """doc_id, size (words), source_size, target and taken for every row of ``docs(doc_id, source, text)``.

    See ``targets`` and ``takes``. Null text has no words. Other columns are ignored.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return takes(sized, weights, most, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights=(5, 2, 1), most: int = 3, seed: str = "") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document stands as often as it is taken.

    A document that is taken in part gives its first words, joined by one space; ``n_chars``,
    where present, follows. Rows that agree in doc_id, source and text are told apart by their
    number only. Other columns may have any names.
    """
    docs, names = shielded(docs, "doc_id", "source", "text", "n_chars")
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    sized = cut_lineage(keyed.select("doc_id", "source", word_count(F.col("text")).alias("size"), "_text"), "sizes")
    plan = takes(sized, weights, most, seed).where("taken > 0").groupBy("doc_id", "source", "_text").agg(
        F.first("size").alias("_size"), F.collect_list("taken").alias("_taken"))
    plan = plan.select(F.struct("doc_id", "source", "_text").alias("_row"), "_size", "_taken")
    rows = keyed.withColumn("_row", F.struct("doc_id", "source", "_text")).dropDuplicates(["_row"])
    rows = rows.join(plan, rows["_row"].eqNullSafe(plan["_row"])).select(*docs.columns, "_size", F.explode("_taken").alias("_words"))
    copies = F.ceil(F.col("_words") / F.col("_size")).cast("int")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    left = F.col("_words") - (F.col("_copy") - 1) * F.col("_size")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    rows = rows.withColumn("text", F.when(left < F.col("_size"), part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns).toDF(*names)
