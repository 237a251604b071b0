import base64
import json
import os

import pytest
from conftest import frame
from pyspark.sql import functions as F

from provisor import schemas
from provisor.operators import quality
from provisor.plans import flatten, profiles, regulatory, supplement
from provisor.session import shared_dir
from provisor.sinks import exports, snapshots
from provisor.sources import bundles, pages, photos, products

UUID = "00000000-0000-4000-8000-00000000000{}"


def local(spark, name):
    path = shared_dir(spark, name)
    os.makedirs(path)
    return path


def test_bundle_scan(spark):
    path = local(spark, "bundle") + "/catalog.json"
    doc = {t: [] for t in schemas.BUNDLE_COLUMNS}
    row = dict.fromkeys(schemas.BUNDLE_COLUMNS["ingredients"].split())
    row.update(id=UUID.format(1), kind="ingredient", canonical_name_ru="Вода", is_active=True)
    doc.update(ingredients=[row], metadata={"dataset": "d", "schema_version": 2})
    with open(path, "w", encoding="utf-8-sig") as f:
        json.dump(doc, f, ensure_ascii=False)
    tables = bundles.read_bundle(spark, path)
    bundles.require_version(tables)
    named = schemas.to_operator_names({t: tables[t] for t in schemas.BUNDLE_COLUMNS})
    assert named["ingredients"].first().name == "Вода" and named["ingredient_rules"].count() == 0
    assert schemas.conform(schemas.to_bundle_names(named)["ingredients"].drop("category"), "ingredients").schema == schemas.table_schema("ingredients")
    assert bundles.bundle_contract(spark, path).count() == 0
    row["extra"] = 1
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False)
    assert {(r.rule, r.table_name, r.key) for r in bundles.bundle_contract(spark, path).collect()} == {("unexpected_column", "ingredients", "extra")}


def test_products(spark):
    path = local(spark, "products") + "/p.json"
    rows = [{"code": "1", "product_name": "", "generic_name": "Сок", "brands": "Б", "categories": " , Напитки,x", "ingredients_text": " ",
             "ingredients": [{"text": "вода", "ingredients": [{"id": "en:sugar"}, {"text": "соль", "ingredients": [{"ingredients": [{"ingredients": [{"text": "deep"}], "text": "x"}], "id": "ru:йод"}]}]}]},
            {"code": "2", "ingredients_text": "вода, сахар", "categories_tags": ["en:plant-based-foods"]}]
    with open(path, "w") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    df = products.read_products(spark, path)
    requests = frame(spark, "barcode string", ("1",), ("2",), ("3",))
    got = {r.barcode: (r.product_name, r.outcome) for r in products.lookup(requests, df).collect()}
    assert got == {"1": ("Сок", "no_composition"), "2": ("Продукт без названия", "analysable"), "3": (None, "not_found")}
    shown = {r.code: (r.name, r.category) for r in products.display_fields(df).collect()}
    assert shown == {"1": ("Сок", "Напитки"), "2": ("Продукт без названия", "plant based foods")}
    text = {r.code: r.composition for r in products.composition_text(df).collect()}
    assert text == {"1": "вода, sugar, соль, йод, x, deep", "2": "вода, сахар"}


PAGE = """<html><body><h1>E100 – Куркумин</h1><article class="node node--additive"><span class="addicon__name">E100</span>
<div class="addprop--origin"><a href="/ru/o/1">растение</a></div><div class="addprop--category"><a href="/ru/c/2">краситель</a></div>
<div class="field--additive-synonyms"><div class="field__content">turmeric, куркума; CI</div></div>
<div class="field--additive-info"><p> </p><p>Первый <b>абзац</b>.<script>x()</script></p><h2>Свойства</h2><p>Жёлтый.</p><li>Стойкий.</li>
<a href="/ru/additives/e101">E101</a><a href="https://who.example.org/doc">док</a></div></article>
<div id="block-views-block-related-documents-related-documents"><div class="node__content"><div class="field--node-link"><a href="/ru/doc/7">Регламент</a></div></div></div></body></html>"""


def test_article_pages(spark):
    url = "https://site.example.org/ru/additives/e100"
    nodes = pages.page_nodes(frame(spark, "page_id int, url string, html string", (1, url, PAGE)))
    a = pages.article_profiles(nodes).first()
    assert (a.e_code, a.name, a.description_excerpt, a.has_article, a.valid) == ("E100", "Куркумин", "Первый абзац .", True, True)
    assert a.synonyms == ["turmeric", "куркума", "CI"]
    assert {(r.tag_type, r.title) for r in pages.article_tags(nodes).collect()} == {("origin", "растение"), ("category", "краситель")}
    assert [r.section for r in pages.article_sections(nodes).collect()] == ["Свойства"]
    refs = {(r.url, r.relation) for r in pages.article_references(nodes).collect()}
    assert refs == {("https://who.example.org/doc", "article_link"), ("https://site.example.org/ru/doc/7", "mentioned_in_document")}
    assert [r.related_url for r in pages.related_articles(nodes).collect()] == ["https://site.example.org/ru/additives/e101"]
    assert {r.section: r.note for r in pages.reading_notes(nodes).collect()} == {"Введение": "Первый абзац .", "Свойства": "Жёлтый. Стойкий."}


def test_index_pages(spark):
    html = ('<div><span class="addicon__name">E100</span><a class="addicon__link" href="/ru/additives/e100">x</a></div>'
            '<div><span class="addicon__name"> E101 </span><a class="addicon__link" href="e101">y</a></div><ul class="pager"><a href="?page=2">next</a></ul>')
    df = frame(spark, "url string, html string", ("https://s.example.org/ru/additives?page=1", html))
    assert {(r.entry_url, r.code) for r in pages.index_entries(pages.page_nodes(df)).collect()} == {
        ("https://s.example.org/ru/additives/e100", "E100"), ("https://s.example.org/ru/e101", "E101")}
    assert pages.next_pages(pages.page_nodes(df)).first().next_url == "https://s.example.org/ru/additives?page=2"


def test_photos(spark):
    png = base64.b64encode(bytes.fromhex("89504E470D0A1A0A") + b"x").decode()
    rows = frame(spark, "photo_id string, image_base64 string", ("a", "data:image/png;base64," + png), ("b", base64.b64encode(b"text").decode()), ("c", "***"))
    listed = photos.manifest(photos.from_base64(rows))
    assert {r.photo_id: (r.outcome, r.mime_type) for r in listed.collect()} == {"a": ("accepted", "image/png"), "b": ("unknown_type", None), "c": ("empty", None)}
    twice = frame(spark, "photo_id string, sha256 string", ("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"))
    assert [r.photo_id for r in photos.conflicts(twice).collect()] == ["b"]
    folder = local(spark, "photos")
    with open(f"{folder}/p1", "wb") as f:
        f.write(bytes.fromhex("FFD8FF00"))
    assert photos.manifest(photos.read_files(spark, folder)).first().mime_type == "image/jpeg"


def test_snapshots(spark):
    root = local(spark, "snapshots") + "/store"
    ing = "ingredient_id string, name string, is_active boolean"
    first = {"ingredients": frame(spark, ing, ("1", "a", True), ("2", "b", True))}
    assert snapshots.load_if_empty(first, root) == "loaded"
    assert snapshots.load_if_empty(first, root) == "preserved"
    more = {"ingredients": frame(spark, ing, ("1", "a", True), ("2", "c", True), ("3", "d", True))}
    assert snapshots.apply_additions(first, more, {"ingredients": "ingredient_id"}, root) == {"ingredients": 2}
    assert snapshots.current_version(spark, root) == 2
    with pytest.raises(ValueError):
        snapshots.apply_additions(more, first, {"ingredients": "ingredient_id"}, root)
    snapshots.write_snapshot({"ingredients": more["ingredients"].withColumn("is_active", F.lit(False))}, root)
    with pytest.raises(ValueError):
        snapshots.load_if_empty(first, root)
    snapshots.backup(first["ingredients"], root + "/backup")
    with pytest.raises(Exception):
        snapshots.backup(first["ingredients"], root + "/backup")


def test_a_dead_write_is_taken_over(spark, monkeypatch):
    """A writer dies between two tables: readers keep the old version, others wait for its lease, then go on."""
    root = local(spark, "snapshots-dead") + "/store"
    table = lambda name: frame(spark, "id string", (name,))
    read = lambda: {n: [r.id for r in df.collect()] for n, df in snapshots.read_current(spark, root, ["a", "b"]).items()}
    snapshots.write_snapshot({"a": table("a1"), "b": table("b1")}, root)
    broken = table("b2").select(F.raise_error(F.lit("killed")).cast("string").alias("id"))
    with monkeypatch.context() as dead:
        dead.setattr(snapshots, "_give_up", lambda *_: None)  # a killed process tidies nothing up
        with pytest.raises(Exception, match="killed"):
            snapshots.write_snapshot({"a": table("a2"), "b": broken}, root)
    assert read() == {"a": ["a1"], "b": ["b1"]} and snapshots.current_version(spark, root) == 1
    with pytest.raises(snapshots.SnapshotBusy):
        snapshots.write_snapshot({"a": table("a3"), "b": table("b3")}, root)
    snapshots.write_snapshot({"a": table("a4"), "b": table("b4")}, root, lease=0)
    assert read() == {"a": ["a4"], "b": ["b4"]} and snapshots.current_version(spark, root) == 2
    with pytest.raises(Exception, match="killed"):
        snapshots.write_snapshot({"a": table("a5"), "b": broken}, root)
    snapshots.write_snapshot({"a": table("a6"), "b": table("b6")}, root)  # the failed writer gave its claim up
    assert read() == {"a": ["a6"], "b": ["b6"]} and snapshots.current_version(spark, root) == 3


def test_a_writer_that_lost_its_version_cannot_publish(spark):
    root = local(spark, "snapshots-lost") + "/store"
    files = snapshots._Files(spark, root)

    class Slow(dict):
        """While these tables are written, another writer takes the version over."""

        def items(self):
            yield from super().items()
            if "v00000001.1" not in files.names("claims"):
                files.create("claims/v00000001.1")

    with pytest.raises(snapshots.SnapshotBusy):
        snapshots.write_snapshot(Slow(a=frame(spark, "id string", ("x",))), root)
    assert snapshots.current_version(spark, root) == 0


def test_export_sheets(spark):
    out = local(spark, "export") + "/x"
    runs = spark.sql("select 1 run_id, map('E1','present') manual_answers, map('E1','absent') app_answers, '=x' note")
    none = spark.createDataFrame([], "run_id int")
    exports.write_sheets(exports.sheets(runs, none, none, none, none), out)
    rows = spark.read.option("header", True).csv(f"{out}/answers").collect()
    assert {(r.method, r.answer) for r in rows} == {("manual", "present"), ("app", "absent")}
    assert spark.read.option("header", True).csv(f"{out}/runs").first().note == "'=x"


def test_flat_catalog(spark):
    rule = ("rule_id string, ingredient_id string, source_id string, title string, citation string, conditions struct<regulatory_status:string,evaluation:string,"
            "verification_status:string,match_policy:string,evidence:array<struct<source_id:string,url:string,locator:string,verification_status:string,appendix:int>>,"
            "transition:struct<months:int,transition_end:string>>")
    ev = ("s1", "https://a.example.org", "p. 1", "ok", 2)
    rules = frame(spark, rule, ("r1", "i1", "s1", "t", "c", ("PHASE_OUT", "notice", "ok", None, [ev, ev], (36, "2027-02-27"))), ("r2", "i1", "s1", "t", "c", ("BANNED", "notice", "ok", None, [ev], None)))
    tag = "array<struct<title:string,url:string>>"
    frag = (f"fragment_id string, record_kind string, source_id string, ingredient_id string, title string, url string, verification_status string, fetched_at string, source_url string, "
            f"has_article boolean, full_description_status string, external_urls array<string>, file_urls array<string>, categories {tag}, origins {tag}, references {tag}, "
            "related_urls array<string>, legacy_id string, method string")
    doc = ("d1", "document_reference", "own", None, "Doc", "https://w.own.example.org/d", "v", None, None, None, None, ["https://x.example.org", "https://x.example.org"], ["https://own.example.org/f"], None, None, None, None, None, None)
    prof = ("p1", "additive_profile", "own", "i1", None, None, None, None, "https://own.example.org/e1", True, "paraphrased", None, None,
            [("краситель", "https://own.example.org/c"), ("краситель", "https://own.example.org/c")], None, [("ref", "https://w.own.example.org/d")], ["https://own.example.org/e1", "https://own.example.org/e9"], None, None)
    match = ("m1", "regulatory_match", "s1", "i1", *[None] * 13, "old1", "exact_e_code")
    merged = {
        "regulatory_sources": frame(spark, "source_id string, code string, url string", ("s1", "ACT", "https://a.example.org"), ("own", "OWN", "https://own.example.org")),
        "ingredients": frame(spark, "ingredient_id string, kind string, e_code string, name string, description string, full_description string", ("i1", "food_additive", "E1000", "n", "Одно. Про own сайт.", "own.")),
        "ingredient_aliases": frame(spark, "alias_id string, ingredient_id string, alias string, source string", ("a1", "i1", "n", "OWN")),
        "ingredient_rules": rules, "source_fragments": frame(spark, frag, doc, prof, match),
    }
    tables, found = flatten.build_catalog(merged, "OWN", ["own.example.org"], ["own"])
    assert found.collect() == []
    assert {t: df.count() for t, df in tables.items()} == {
        "regulatory_sources": 1, "ingredients": 1, "ingredient_aliases": 1, "ingredient_rules": 2, "rule_evidence": 3, "rule_transitions": 1, "documents": 1,
        "document_links": 1, "ingredient_profiles": 1, "ingredient_tags": 1, "ingredient_references": 1, "ingredient_relations": 1, "ingredient_matches": 1}
    row = tables["ingredients"].first()
    assert (row.description, row.full_description) == ("Одно.", None)
    assert tables["ingredient_aliases"].first().source is None and tables["documents"].first().source_id is None
    assert tables["ingredient_references"].first().document_id == "d1"
    planted = {**merged, "ingredient_rules": rules.withColumn("source_id", F.lit("own"))}
    assert "depends_on_excluded_source" in {r.rule for r in flatten.build_catalog(planted, "OWN", ["own.example.org"], ["own"])[1].collect()}


def test_profile_bundle(spark):
    schema = "e_code string, name string, source_url string, has_article boolean, description_excerpt string, synonyms array<string>, functions array<string>, origins array<string>, danger int"
    records = frame(spark, schema, ("E100", "Куркумин", "u1", True, "w " * 5, ["turmeric", "E100"], ["краситель"], ["растение"], 3), ("E101", "Рибофлавин", "u2", False, None, [], [], [], 1))
    bundle = profiles.profile_bundle(records, frame(spark, "code string, new_text string", ("E100", "text"), ("E101", "text")), "P")
    rows = {r.e_code: r for r in bundle["ingredients"].collect()}
    assert rows["E100"].description == "Куркумин (E100). Функции: краситель. растение." and rows["E101"].full_description is None
    assert {r.alias for r in bundle["ingredient_aliases"].collect()} == {"E100", "Куркумин", "turmeric", "E101", "Рибофлавин"}
    assert {r.full_description_status for r in bundle["source_fragments"].collect()} == {"paraphrased", "no_source_article"}
    assert "danger" not in bundle["source_fragments"].columns
    assert profiles.profile_violations(bundle).count() == 0
    long = bundle["source_fragments"].withColumn("description_excerpt", F.repeat(F.lit("w "), 30))
    assert {r.rule for r in profiles.profile_violations({**bundle, "source_fragments": long}).collect()} == {"excerpt_too_long"}


def test_regulatory_build(spark):
    src = frame(spark, "source_id string, code string, url string", ("s1", "ACT", "https://act.example.org"))
    ing = frame(spark, "ingredient_id string, kind string, e_code string, name string, name_en string, is_active boolean",
                ("i121", "x", "E121", "old", None, True), ("i100", "x", "E100", "Куркумин", None, True), ("i102", "x", "E102", "Тартразин", None, True))
    alias = frame(spark, "alias_id string, ingredient_id string, alias string, source string", ("a1", "i121", "позиция исключена с 2024", "x"), ("a2", "i100", "куркума", "x"))
    rule = "rule_id string, ingredient_id string, source_id string, rule_type string, title string, explanation string, citation string, source_text string, appendix int, `table` int, severity string, regulatory_status string, match_policy string, effective_from string"
    rules = frame(spark, rule, ("r1", "i100", "s1", "permitted_food_additive", "t", None, "c", "row text", 2, 1, "regulatory", None, None, None),
                  ("r2", "i102", "s1", "mandatory_warning_label", "t", "text", "пункт 4", None, None, None, "regulatory", None, None, None),
                  ("r3", None, "s1", "regulatory_text", "t", "text", "c", None, None, None, "regulatory", None, None, None))
    bundle = {"regulatory_sources": src, "ingredients": ing, "ingredient_aliases": alias, "ingredient_rules": rules}
    seed = frame(spark, "status string, code string, name string, name_en string, category string, item_key string",
                 ("BANNED", "E121", "Цитрусовый красный 2", "Citrus Red 2", "краситель", "E121"), ("PHASE_OUT", None, "Порошок", "Powder", "c", "powder"))
    acts = spark.sql("""select 'BANNED' status, 's2' source_id, 'PUB' source_code, 'https://pub.example.org' url, 'позиция ' locator_head, 'official_explanation' document_role,
        'verified_official_publication' act_status, 4 pdf_page, 'why' explanation, cast(null as string) effective_from, cast(null as struct<transition_end:string>) transition
        union all select 'PHASE_OUT', 's1', 'ACT', 'https://act.example.org', 'перечень ', 'normative_act', 'verified_primary', 40, 'why', '2024-02-27', named_struct('transition_end', '2027-02-27')""")
    notices = frame(spark, "code string, locator string, url string, source_id string, source_code string, pdf_page int", ("E102", "часть 4.4", "https://act.example.org", "s1", "ACT", 11))
    fresh = frame(spark, "code string, locator string, url string, source_id string, source_code string, pdf_page int, effective_from string", ("E100", "подпункт 7", "https://act.example.org", "s1", "ACT", 41, "2024-02-27"))
    prefs = frame(spark, "id string, name string, code string, category string, description string", ("gluten", "Глютен", None, "c", "d"))
    out = regulatory.build_regulatory([bundle, bundle], seed, acts, frame(spark, "item_key string, alias string", ("E121", "E-красный")),
                                      frame(spark, "form string", ("powder",)), notices, fresh, prefs)
    rows = {r.title if r.regulatory_status in ("BANNED", "PHASE_OUT") else r.rule_id: r for r in out["ingredient_rules"].collect()}
    assert set(rows) == {"BANNED: Цитрусовый красный 2", "PHASE_OUT: Порошок", "r1", "r2"}
    assert [r.rule_id for r in out["source_fragments"].collect()] == ["r3"]
    assert rows["r1"].regulatory_status == "PERMITTED_WITH_CONDITIONS" and len(rows["r1"].evidence) == 2 and rows["r1"].effective_from == "2024-02-27"
    assert rows["r1"].evidence[0].locator == "ACT, приложение 2, таблица 1, позиция: row text"
    assert (rows["r2"].regulatory_status, rows["r2"].severity) == ("ATTENTION", "attention")
    names = {r.ingredient_id: r.name for r in out["ingredients"].collect()}
    assert names["i121"] == "Цитрусовый красный 2" and len(names) == 5
    aliases = {r.alias for r in out["ingredient_aliases"].collect()}
    assert {"Е121", "E-121", "E 121", "Citrus Red 2", "E-красный", "куркума", "Глютен", "gluten"} <= aliases and "Powder" not in aliases
    assert [r.alias for r in out["retired_aliases"].collect()] == ["позиция исключена с 2024"]
    assert regulatory.regulatory_violations(out).collect() == []
    assert {r.rule_id for r in regulatory.rules_to_review(out["ingredient_rules"]).collect()} >= {"r1"}


def test_supplement(spark):
    text = "string"
    tables = {
        "regulatory_sources": frame(spark, "source_id string, code string, title string, url string", ("s0", "OLD", "t", "u")),
        "ingredients": frame(spark, "ingredient_id string, kind string, e_code string, name string, name_en string, category string, description string, full_description string, is_active boolean",
                             ("i121", "food_additive", "E121", "old name", None, None, None, None, True)),
        "ingredient_aliases": frame(spark, "alias_id string, ingredient_id string, alias string, normalized_alias string, language string, source string, confidence decimal(3,2)", ("a", "i121", "E121", "e121", "en", None, None)),
        "ingredient_tags": frame(spark, "tag_id string, ingredient_id string, tag_type string, name string", ("t", "i121", "origin", "kept")),
        "ingredient_rules": spark.createDataFrame([], "rule_id string, ingredient_id string, source_id string, regulatory_status string, title string, explanation string, citation string"),
        "rule_evidence": spark.createDataFrame([], "evidence_id string, rule_id string, source_id string, url string, locator string"),
    }
    assert text
    items = frame(spark, "e_code string, name string, name_en string, category string, origin string, description string, full_description string, aliases array<string>, locator string, explanation string, title string, pdf_url string, pdf_page int",
                  ("E121", "Красный", "Red", "краситель", "синтетика", "d", "f", ["CI 1"], "стр. 4", "why", "Запрет", "pdf", 4), ("E123", "Амарант", "Amaranth", "c", None, "d", "f", [], "стр. 4", "why", "Запрет", "pdf", 4))
    source = {"source_id": "s1", "code": "PUB", "title": "t", "url": "u"}
    out, found = supplement.supplement_catalog(tables, items, source, F.col("e_code") != "E123")
    assert found.count() == 0
    assert {t: df.count() for t, df in out.items()} == {"regulatory_sources": 2, "ingredients": 2, "ingredient_aliases": 6, "ingredient_tags": 3, "ingredient_rules": 2, "rule_evidence": 2}
    assert "Амарант" not in {r.alias for r in out["ingredient_aliases"].collect()}
    again, _ = supplement.supplement_catalog(out, items, source, F.col("e_code") != "E123")
    assert {t: df.count() for t, df in again.items()} == {t: df.count() for t, df in out.items()}


def test_violations_fire(spark):
    items = frame(spark, "request_id string, id string, token_index int, token_raw string, corrected_text string", ("r", "1", 0, "a", " "), ("r", "1", 0, "a", "b"))
    assert {r.rule for r in quality.correction_rules(items).collect()} == {"text_length", "duplicate_item_id", "duplicate_token_index"}
    log = frame(spark, "run_id int, excluded boolean, reason string, comment string", (1, True, None, None), (2, True, "other", None), (3, False, "other", None), (4, True, "bad_setup", None))
    assert {(r.key, r.rule) for r in quality.failing_rows("log", log, "run_id", quality.exclusion_rules()).collect()} == {("1", "exclusion_documented"), ("2", "exclusion_documented"), ("3", "restore_bare")}
    refs = frame(spark, "id int, reference_ingredients array<string>", (1, ["Соль", "соль"]), (2, ["", "a"]), (3, ["a"]))
    assert {(r.key, r.rule) for r in quality.failing_rows("cases", refs, "id", quality.reference_list_rules()).collect()} == {("1", "reference_unique"), ("2", "reference_length")}
    with pytest.raises(ValueError):
        quality.require_clean(quality.correction_rules(items))
