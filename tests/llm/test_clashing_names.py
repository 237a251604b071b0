from pyspark.sql import functions as F

from provisor.llm.lines import remove_repeated_lines
from provisor.llm.mixing import mixed
from tests.llm.helpers import corpus, frame

ODD = ["_bucket", "_bits", "_lines", "_removed", "_id", "_maybe", "_row", "_words", "_size", "_text", "_copy"]


def odd(spark):
    docs = frame(spark, corpus(n=24)).select("doc_id", "text", "source", "n_chars")
    return docs.select("*", *[F.lit(f"kept {c}").alias(c) for c in ODD])


def plain(df):
    return sorted(tuple(r) for r in df.select(F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce("text", F.lit("-"))).collect())


def test_columns_with_internal_names_stay_as_they_are(spark):
    docs = odd(spark)
    for operator in (remove_repeated_lines, mixed):
        got = operator(docs)
        assert got.columns == docs.columns
        assert [tuple(r) for r in got.select(*ODD).distinct().collect()] == [tuple(f"kept {c}" for c in ODD)]
        assert plain(got) == plain(operator(docs.drop(*ODD)))
