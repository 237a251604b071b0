"""Queries over documents of which some are empty, missing, blank or without tokens, against their SQL."""

import duckdb
import pytest
from conftest import frame

from provisor.plans import analysis
from provisor.session import shared_dir
from provisor_checks import load_all
from provisor_checks.labels import catalog
from provisor_checks.registry import ORACLES, QUERIES
from provisor_checks.tables import Tables

load_all()
TEXTS = ["", None, " \n ", ",;", "that.", "One. That two. Three.", "name 3, colour (E103); salt", " ".join(f"w{i}" for i in range(30))]


@pytest.fixture(scope="module")
def folder(spark):
    base = shared_dir(spark, "empty-texts")
    frame(spark, "doc_id long, text string", *enumerate(TEXTS)).coalesce(1).write.parquet(f"{base}/documents.parquet")
    parts = [(i, "name", "brand", "type", i % 50) for i in range(30)]
    frame(spark, "p_partkey long, p_name string, p_brand string, p_type string, p_size int", *parts).coalesce(1).write.parquet(f"{base}/part.parquet")
    return base


def both(spark, folder, name):
    """Rows of a query by their first column, checked against the rows of its SQL."""
    con = duckdb.connect()
    for table in ("documents", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = {r[0]: tuple(r[1:]) for r in QUERIES[name](spark, folder).select(*columns).collect()}
    assert got == {r[0]: r[1:] for r in want.fetchall()}
    return got


def test_sentences_of_an_empty_text(spark, folder):
    got = both(spark, folder, "fn_12_description_sentences")
    assert [got[i][0] for i in range(6)] == [None, None, " \n ", ",;", None, "One. Three."]


def test_excerpt_of_a_text_without_words(spark, folder):
    got = both(spark, folder, "fn_19_excerpt")
    assert [got[i] for i in range(5)] == [("", False), (None, None), ("", False), (",;", False), ("that.", False)]
    assert got[7][1] and got[7][0].endswith("w24…")


def test_stream_judges_labels_with_tokens(spark, folder):
    """The batch job keeps a row of zero counts for labels without tokens; the stream gives them no verdict."""
    assert set(both(spark, folder, "str_1_label_stream")) == {4, 5, 6, 7}


def test_batch_keeps_labels_without_tokens(spark, folder):
    labels = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("doc_id", "product_id")
    got = {r.product_id: (r.matched, r.unmatched, r.incomplete) for r in analysis.analyse_labels(labels, catalog(Tables(spark, folder))).collect()}
    assert set(got) == set(range(len(TEXTS))) and [got[i] for i in range(4)] == [(0, 0, True)] * 4
