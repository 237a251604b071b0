import duckdb
from conftest import frame

from provisor.session import shared_dir
from provisor.sources import pages as pg
from provisor_checks import load_all
from provisor_checks.registry import ORACLES, QUERIES

PAGES = "page_id long, url string, html string"


def test_title_with_unended_references(spark):
    """A title cut inside ``&amp;`` ends in ``&amp``, which HTML reads as ``&``; the SQL left it as it stands."""
    load_all()
    folder = shared_dir(spark, "page-heads")
    titles = ["a&&amp", "b &amp; c", "&lt;d&gt", "e &amp;lt;"]
    frame(spark, PAGES, *[(i, f"http://h.example/{i}", f"<h1>{t}</h1><p>x</p>") for i, t in enumerate(titles)]).write.parquet(f"{folder}/pages.parquet")
    got = {tuple(r) for r in QUERIES["src_6_page_heads"](spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert set(con.execute(ORACLES["src_6_page_heads"]).fetchall()) == got == {(0, "a&&"), (1, "b & c"), (2, "<d>"), (3, "e &lt;")}


def test_nodes_leave_a_worker_in_pieces(spark, monkeypatch):
    """A worker kept the nodes of a whole batch of pages, up to 10,000 pages, whatever their size."""
    monkeypatch.setattr(pg, "NODE_ROWS", 50)
    pages = frame(spark, PAGES, *[(i, f"u{i}", "<p>word</p>" * (7 * i)) for i in range(40)]).coalesce(1)
    nodes = pg.page_nodes(pages)
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    rows = nodes.groupBy("page_key").count().collect()
    assert {r.page_key: r["count"] for r in rows} == {f"u{i}": 7 * i for i in range(1, 40)}
    assert max(len(x) for x in pg.in_pieces(iter([((i,), 1) for i in range(120)]), ["n"])) == 50
