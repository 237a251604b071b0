from conftest import frame
from pyspark.sql import functions as F

from provisor.plans import merging, taxonomy
from provisor.sources import taxonomy as source


def lines(spark, text):
    return source.number_lines(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")


BASE = "ingredient_id string, kind string, e_code string, name string, name_en string, is_active boolean"
ALIASES = "alias_id string, ingredient_id string, alias string, normalized_alias string, language string, source string, confidence decimal(3,2), position int"


def base(spark):
    return {
        "ingredients": frame(spark, BASE, ("i330", "food_additive", "E330", "Лимонная кислота", "citric acid", True),
                             ("i123", "food_additive", "E123", "Амарант", "amaranth", True)),
        "ingredient_aliases": spark.createDataFrame([], ALIASES),
    }


def test_taxonomy_text(spark):
    """Three blocks of one key over two files, an escaped backslash, a tie on position and a nameless line."""
    one = ("stopwords:fr: de, du\n\n"
           "ru: Рожь, ржаная мука\nfr: seigle\n\n"
           "de: Roggen\\\\Korn, Mehl\\, grob\nru: мука\n< ru: Рожь\nallergens:en: gluten\n")
    two = "ru: рожь, третье имя\nallergens:en: none\nallergens:de: Gluten\n\nen: ,\nnutrition:en: lost\n\nru: Рожь\nthis line says nothing\n"
    both = source.number_lines(spark.createDataFrame([("a", one), ("b", two)], "file string, text string"), "file", "text")
    p = source.parse_taxonomy(both)
    assert {r.key for r in p["entries"].collect()} == {"ru:рожь", "ru:мука"}
    names = {(r.key, r.language, r.name) for r in p["names"].collect()}
    assert names == {("ru:рожь", "ru", "Рожь"), ("ru:рожь", "ru", "ржаная мука"), ("ru:рожь", "fr", "seigle"), ("ru:рожь", "ru", "рожь"),
                     ("ru:рожь", "ru", "третье имя"), ("ru:мука", "de", "Roggen\\Korn"), ("ru:мука", "de", "Mehl, grob"), ("ru:мука", "ru", "мука")}
    first = {r.name: (r.position.file, r.position.i) for r in p["names"].where("key = 'ru:рожь' and language = 'ru'").collect()}
    assert first["Рожь"] == ("a", 0) and first["ржаная мука"] == ("a", 1) and first["третье имя"] == ("b", 1)
    assert [(r.key, r.name) for r in p["parents"].collect()] == [("ru:мука", "Рожь")]
    assert {(r.key, r.property, r.language, r.value) for r in p["properties"].collect()} == {
        ("ru:мука", "allergens", "en", "gluten"), ("ru:рожь", "allergens", "en", "none"), ("ru:рожь", "allergens", "de", "Gluten")}
    assert source.property_conflicts(p["properties"]).isEmpty()
    assert p["ignored_directives"].count() == 1 and p["duplicate_blocks"].count() == 2
    assert [r.line for r in p["empty_names"].collect()] == ["en: ,"]
    assert [r.line for r in p["unparsed_lines"].collect()] == ["this line says nothing"]


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """A file larger than a split is read by several tasks; numbers and blocks run across the splits."""
    texts = {"a.txt": "\ufeffen: first\r\n" + "".join(f"en: name {i}, other {i}\nvegan:en: v{i}\n\n" for i in range(300)) + "en: page\x0cen: feed",
             "b.txt": "\n\nen: alone\n", "empty.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    small.conf.set("spark.sql.files.openCostInBytes", "0")
    raw = small.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    got = {}
    for r in source.read_lines(small, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    want = {name: [x.strip() for x in text.lstrip("\ufeff").splitlines()] for name, text in texts.items() if text}
    assert raw > 5 and {k: [v[i + 1] for i in range(len(v))] for k, v in got.items()} == want
    blocks = source.with_blocks(source.read_lines(small, str(tmp_path))).where("line != ''").groupBy("file", "block").count()
    assert blocks.count() == 302


def test_taxonomy_matching(spark):
    """Parents in a circle, one code under two languages, two codes in one block, an unknown parent."""
    text = (
        "en: orange peel\nru: цедра\n< en: lemon rind\n\nen: lemon rind\nru: корка лимона\n< en: orange peel\n\n"
        "en: sour crystals, E330\nde: Säure, e 330\nru: кристаллы\n< en: orange peel\n< en: fruit\n\n"
        "en: red no 2, E123\nru: красный\n\nen: two dyes, E123, E330\nru: смесь\n\nen: only english\n"
    )
    tables, report = taxonomy.enrich_catalog(base(spark), lines(spark, text), "TAXONOMY")
    entries = {r.key: r for r in tables["taxonomy_entries"].collect()}
    assert (entries["en:sour crystals"].ingredient_id, entries["en:red no 2"].ingredient_id) == ("i330", "i123")
    assert entries["en:two dyes"].ingredient_id is None and entries["en:only english"].ingredient_id is None
    assert {r.match_method: r.n for r in report["match_methods"].collect()} == {
        "exact_e_code": 2, "new_ordinary_ingredient": 2, "code_review_required": 1, "untranslated": 1}
    ids = {key: r.entry_id for key, r in entries.items()}
    assert {(r.entry_id, r.parent_reference, r.parent_entry_id) for r in tables["taxonomy_parents"].collect()} == {
        (ids["en:orange peel"], "en:lemon rind", ids["en:lemon rind"]), (ids["en:lemon rind"], "en:orange peel", ids["en:orange peel"]),
        (ids["en:sour crystals"], "en:orange peel", ids["en:orange peel"]), (ids["en:sour crystals"], "en:fruit", None)}
    assert [r.reason for r in report["unresolved_parents"].collect()] == ["missing"]
    assert tables["ingredients"].count() == 4
    active = {(r.ingredient_id, r.alias) for r in tables["ingredient_aliases"].collect()}
    assert ("i330", "sour crystals") in active and ("i123", "красный") in active
    again, _ = taxonomy.enrich_catalog(base(spark), lines(spark, text), "TAXONOMY")
    assert again["ingredient_aliases"].exceptAll(tables["ingredient_aliases"]).count() == 0


def test_quarantine_reasons(spark):
    from provisor.operators.aliases import quarantine

    ingredients = frame(spark, BASE, ("a", "x", "E100", "Один", None, True), ("b", "x", None, "Два", None, True))
    rows = [("a", "общее", 1), ("b", "Общее!", 2), ("a", "E200", 3), ("a", "***", 4), ("a", "x1", 5), ("a", "E-100", 6), ("a", "Имя", 7), ("a", "имя", 8)]
    aliases = spark.createDataFrame([(i, a, "ru", p) for i, a, p in rows], "ingredient_id string, alias string, language string, position int")
    got = {r.position: r.reason for r in quarantine(aliases, ingredients).collect()}
    assert got == {1: "ambiguous_name", 2: "ambiguous_name", 3: "e_code_mismatch", 4: "empty_normalized_alias", 5: "name_fragment", 6: None, 7: None}


def merge_inputs(spark):
    """Waxes and herbs: a shared code, a name that two of the new side claim, aliases around the length limit."""
    ing = "ingredient_id string, e_code string, name string, name_en string, category string, kind string, full_description string, position int"
    alias = "alias_id string, ingredient_id string, alias string, language string, source string"
    rule = ("rule_id string, ingredient_id string, source_id string, rule_type string, regulatory_status string, evaluation string, "
            "verification_status string, match_policy string, resolved_ingredient_ids array<string>, group_ingredient_id string")
    src = "source_id string, code string"
    item = lambda key, code, name, english, position: (key, code, name, english, None, "food_additive", f"text of {key}", position)
    primary = {
        "ingredients": frame(spark, ing, item("n-wax", "E901", "Воск", None, 1), item("n-mint", "E950", "Мята", None, 2), item("n-mint-oil", "E951", "мята", None, 3)),
        "ingredient_aliases": spark.createDataFrame([], alias), "ingredient_rules": spark.createDataFrame([], rule),
        "regulatory_sources": frame(spark, src, ("s1", "NEW")),
    }
    law = lambda key, owner, kind, status: (key, owner, "s2", kind, status, "reference_only", "extracted_not_verified", None, [owner], None)
    legacy = {
        "ingredients": frame(spark, ing, item("l-wax", "e901", "Пчелиный воск", "BEESWAX", 1), item("l-mint", None, "Мята", None, 2)),
        "ingredient_aliases": frame(spark, alias, ("a1", "l-wax", "я" * 180, "ru", "x"), ("a2", "l-wax", "ю" * 181, "ru", "x")),
        "ingredient_rules": frame(spark, rule, law("r1", "l-wax", "permitted_food_additive", "PERMITTED_WITH_CONDITIONS"),
                                  law("r2", "l-mint", "regulatory_status", "PHASE_OUT"), law("r3", "l-mint", "maximum_use_level", "PERMITTED_WITH_CONDITIONS")),
        "regulatory_sources": frame(spark, src, ("s2", "OLD")),
    }
    return primary, legacy, spark.createDataFrame([], "form string")


def test_catalog_merge(spark):
    primary, legacy, ambiguous = merge_inputs(spark)
    tables, report = merging.merge_catalogs(primary, legacy, ambiguous)
    matches = {(r.ingredient_id, r.legacy_ingredient_id) for r in tables["ingredient_matches"].collect()}
    assert matches == {("n-wax", "l-wax"), ("n-mint", "l-mint")}  # the second to claim the name has to be reviewed
    assert {(r.ingredient_id, r.candidate_id) for r in report["unmatched"].collect()} == {("n-mint-oil", "l-mint")}
    assert {(r.rule_id, r.ingredient_id, *r.resolved_ingredient_ids) for r in tables["ingredient_rules"].collect()} == {
        ("r1", "n-wax", "n-wax"), ("r2", "n-mint", "n-mint")}
    assert report["excluded_rules"].agg(F.sum("n")).first()[0] == 1
    assert {r.alias for r in tables["ingredient_aliases"].collect()} == {"я" * 180, "BEESWAX"}
    assert [r.alias for r in report["rejected_aliases"].collect()] == ["ю" * 181]
    profiles = primary["ingredients"].select("ingredient_id", "full_description")
    assert merging.merged_violations(tables, profiles, primary["regulatory_sources"]).isEmpty()
    wrong = {**tables, "ingredient_rules": tables["ingredient_rules"].withColumn("rule_type", F.lit("sweetener_use"))}
    assert [r.rule for r in merging.merged_violations(wrong, profiles, primary["regulatory_sources"]).select("rule").distinct().collect()] == ["not_a_status_rule"]
