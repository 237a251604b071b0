"""Words of all documents against the words of names, within two or three edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from provisor.operators.keywords import close_words, first_keywords
from provisor_checks.registry import check

_NAMES = (("part", "p_name"), ("part", "p_type"), ("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))
_HEAD = """WITH named AS (""" + " UNION ALL ".join(
    f"SELECT unnest(regexp_extract_all(lower({c}), '[a-z]+')) AS keyword FROM {t}" for t, c in _NAMES) + """),
    keywords AS (SELECT DISTINCT keyword, CASE WHEN length(keyword) <= 7 THEN 2 ELSE 3 END AS bound FROM named WHERE length(keyword) >= 5),
    listed AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents),
    placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM listed),
    pairs AS (SELECT word, keyword, levenshtein(word, keyword) AS distance FROM (SELECT DISTINCT word FROM placed)
      JOIN keywords ON abs(length(word) - length(keyword)) <= bound WHERE levenshtein(word, keyword) <= bound)"""


def _keywords(t) -> DataFrame:
    named = [getattr(t, table).select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))).alias("keyword")) for table, c in _NAMES]
    return reduce(DataFrame.unionAll, named).where(F.length("keyword") >= 5).distinct().withColumn(
        "bound", F.when(F.length("keyword") <= 7, 2).otherwise(3))


def _placed(t) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("place", "word"))


@check("jon_23_close_words", _HEAD + " SELECT word, keyword, distance FROM pairs")
def _(t):
    return close_words(_placed(t), _keywords(t))


@check("jon_23_first_keywords", _HEAD + """,
    near AS (SELECT word, keyword, distance FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, keyword) = 1)
    SELECT doc_id, place, word, keyword, distance FROM placed JOIN near USING (word)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1""")
def _(t):
    return first_keywords(_placed(t), _keywords(t))
