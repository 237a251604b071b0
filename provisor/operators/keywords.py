"""Words close to keywords, found by an index of deletions where there are many keywords.

Two words at most ``d`` edits apart have a common remainder once each loses at most ``d`` letters.
So every distinct word and keyword is listed under its remainders, they meet by an equi-join on
those, and only such pairs have their distance computed. A word has hundreds of remainders, so up
to ``FEW`` keywords of a bound are compared with each distinct word instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.session import cut_lineage

#: Keywords of one bound that are compared with every word; listing a word's remainders takes the time of thousands of distances.
FEW = 1_000


def remainders(word: Column, most: int) -> Column:
    """The word and all it can become by losing up to ``most`` letters, each once."""

    def shorter(w: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, cuts).otherwise(F.array().cast("array<string>"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)), F.array(word), lambda seen, _: F.array_union(seen, F.flatten(F.transform(seen, shorter))))


def close_words(words: DataFrame, keywords: DataFrame, most: int = 3) -> DataFrame:
    """word, keyword and distance of all pairs within the keyword's ``bound`` of edits.

    ``words(word)`` may repeat, ``keywords(keyword, bound)`` has a bound of 0 to ``most`` each; the
    largest counts if a keyword stands twice. Nulls match nothing, other columns are ignored. Words whose length
    no keyword can reach get no remainders, and the work grows with distinct words, not with pairs.
    """
    keywords = keywords.where("keyword is not null and bound is not null").groupBy("keyword").agg(F.max(F.least("bound", F.lit(most))).alias("bound"))
    keywords = cut_lineage(keywords, "keywords")
    sizes = dict(keywords.groupBy("bound").agg(F.count(F.lit(1))).collect())  # a row per bound
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not left to AQE
    words = cut_lineage(words.where("word is not null").select("word").distinct().repartition(parts, "word"), "words")
    pairs = None
    for bound in range(most + 1):
        own = keywords.where(F.col("bound") == bound).select("keyword")
        if bound and sizes.get(bound, 0) <= FEW:
            near = (F.abs(F.length("word") - F.length("keyword")) <= bound) & (F.levenshtein("word", "keyword", bound) >= 0)
            found = words.join(F.broadcast(own), near).withColumn("distance", F.levenshtein("word", "keyword"))
        else:
            found = _by_remainders(words, own, bound)
        pairs = found if pairs is None else pairs.unionAll(found)
    return pairs


def _by_remainders(words: DataFrame, own: DataFrame, bound: int) -> DataFrame:
    reach = own.select(F.explode(F.sequence(F.length("keyword") - bound, F.length("keyword") + bound)).alias("_length")).distinct()
    able = words.join(reach, F.length("word") == F.col("_length"), "left_semi")

    def listed(df: DataFrame, name: str) -> DataFrame:
        rest = remainders(F.col(name), bound) if bound else F.array(name)
        return df.select(name, F.explode(rest).alias("_rest"))

    met = listed(able, "word").join(listed(own, "keyword"), "_rest").select("word", "keyword").distinct()
    return met.withColumn("distance", F.levenshtein("word", "keyword")).where(F.col("distance") <= bound)


def first_keywords(placed: DataFrame, keywords: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, place, word, keyword and distance of each document's earliest word close to a keyword.

    ``placed(doc_id, place, word)``. Of several keywords the nearest counts, then the first by
    alphabet; documents without a close word have no row.
    """
    near = close_words(placed, keywords, most).groupBy("word").agg(F.min(F.struct("distance", "keyword")).alias("_near"))
    near = cut_lineage(near, "near-words")  # its size is known then: a small one is broadcast and no placed word moves
    found = placed.select("doc_id", "place", "word").join(near, "word")
    first = found.groupBy("doc_id").agg(F.min(F.struct("place", "word", "_near")).alias("_first"))
    return first.select("doc_id", "_first.place", "_first.word", "_first._near.keyword", "_first._near.distance")
