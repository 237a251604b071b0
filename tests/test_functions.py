import sys
import time
import unicodedata
import uuid

import pytest
from conftest import frame
from pyspark.sql import functions as F

from provisor import functions as fn
from provisor.functions import text as text_fn


def run(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", column.alias("o")).orderBy("i").select("o").collect()]


def test_split_label(spark):
    texts = [
        "шоколад (сахар, какао, эмульгатор E322(i)), соль", "E450(ixyz)", "E450(viii",
        " , ;()", "a[b{c}]; d", "",
    ]
    assert run(spark, fn.split_label(F.col("v")), texts) == [
        ["шоколад", "сахар", "какао", "эмульгатор E322(i)", "соль"], ["E450(ixyz)"], ["E450(viii"],
        [], ["a", "b", "c", "d"], [],
    ]


def test_first_code(spark):
    cases = {
        "Е 161g": "E161g", "E-161G": "E161g", "краситель (Е161g)": "E161g", "Е924а": "E924a",
        "E-322 (I)": "E322(i)", "E450(xv)": "E450(xv)", "E450(viii": None, "E450(ixyz)": None,
        "E12345": None, "E123abc": None, "name123": None, "Е100б": "E100b", "Е100в": "E100b",
    }
    assert run(spark, fn.first_code(F.col("v")), list(cases)) == list(cases.values())


def test_strict_code_and_lists(spark):
    cases = {"Е-160a(ii)": "E160A(II)", "E386э": None, "contains E100": None, "E101i": "E101I",
             "E101(i)": "E101(I)", None: None}
    assert run(spark, fn.strict_code(F.col("v")), list(cases)) == list(cases.values())
    out = run(spark, fn.code_lists(F.col("v")), [["Е 202", "E-202", "e924a"], ["сорбат калия"]], "array<string>")
    assert [(r.codes, r.rejected) for r in out] == [(["E202", "E924A"], []), ([], ["сорбат калия"])]


def reference_normal_form(value):
    folded = unicodedata.normalize("NFKC", value).casefold().replace("ё", "е")
    kept = "".join(c if c.isalnum() or c == "_" else " " for c in folded)
    return " ".join(kept.split())


def test_normal_form_of_every_character(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    chars += [chr(c) for c in range(0xF900, 0xFFFE)]
    texts = [f"A{c}b {c}" for c in chars]
    df = spark.createDataFrame([(t,) for t in texts], "v string").repartition(4)
    got = {r.v: (r.o, r.s) for r in df.select(
        "v", fn.normalize_text(F.col("v")).alias("o"), text_fn.needs_full_unicode(F.col("v")).alias("s")
    ).collect()}
    wrong = [(t, got[t]) for t in texts if got[t][0] != reference_normal_form(t)]
    assert wrong == []
    assert not got["AЖb Ж"][1] and not got["Aéb é"][1] and got["A½b ½"][1]


def test_filters_pass_the_normal_form(spark, tmp_path):
    """The expression is deterministic: a filter on another column reaches the scan below it."""
    path = str(tmp_path / "texts")
    spark.createDataFrame([(1, "Ab"), (2, "Ä½")], "id long, v string").write.parquet(path)
    rows = spark.read.parquet(path).select("id", fn.normalize_text(F.col("v")).alias("o")).where("id = 2")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,2)]" in plan
    assert [tuple(r) for r in rows.collect()] == [(2, "ä1 2")]


def test_negation(spark):
    values = ["без E216", "WITHOUT salt", "free   from milk", "безе", "E211"]
    assert run(spark, fn.is_negated(F.col("v")), values) == [True, True, True, False, False]


def test_composition(spark):
    block = "Состав: вода, сахар. Произведено на предприятии, где используется арахис."
    texts = [block, "CОСТAВ: вода; соль, Срок годности 5 дней", "просто текст", "а, б\nв Может содержать орехи. Калорийность 5"]
    got = run(spark, F.struct(fn.composition_block(F.col("v")).alias("c"), fn.allergen_block(F.col("v")).alias("a")), texts)
    assert got[0].c == "вода, сахар" and "арахис" in got[0].a
    assert got[1].c == "вода; соль" and got[1].a == ""
    assert got[2].c == "просто текст"
    assert got[3].c == "а, б в" and got[3].a == "содержать орехи"


def test_composition_block_of_long_texts(spark):
    """The work of a text follows its words near a keyword's length, not every run of letters and signs."""
    pad = "the house of a cat, см. 12; " * 60_000
    texts = [f"\U0001f600 İ {pad}CОСТAВ: вода {pad}Может быть", "состава составаяя: соль. может"]
    began = time.monotonic()
    got = run(spark, fn.fuzzy_spans(F.col("v"), ["состав"]), texts)
    assert time.monotonic() - began < 6
    at = len(pad) + 5  # a lower-cased İ counts twice
    assert tuple(got[0]) == (at, at + 6) and tuple(got[1]) == (0, 7)


def test_clean_composition(spark):
    cases = {
        "Состав: сахар ;соль\r\n• вода | Е 100. Срок годности: 5": "сахар, соль, вода E 100",
        "ИНГРЕДИЕНТЫ — мука , масло": "мука, масло", None: "", "  , ;": "",
    }
    assert run(spark, fn.clean_composition(F.col("v")), list(cases)) == list(cases.values())


@pytest.mark.parametrize("status,text,expected", [
    ("success", "Состав: сахар, соль, вода, мука пшеничная.", True), ("success", "", False),
    ("success", None, False), ("needs_retake", "сахар, соль", False), ("error", "сахар, соль", False),
    ("success", "xyz", False), ("success", "E100", True),
])
def test_sufficient(spark, status, text, expected):
    df = frame(spark, "s string, t string", (status, text))
    assert df.select(fn.is_sufficient(F.col("s"), F.col("t"))).first()[0] is expected


def test_names(spark):
    cases = {"KONJAC (KONJAC FLOUR)): (i) Камедь": "KONJAC (KONJAC FLOUR)",
             "GUM ARABIC (ACACIA GUM": "GUM ARABIC", "E100": None, "сорбат": None, "ab": None, None: None}
    assert run(spark, fn.english_name(F.col("v")), list(cases)) == list(cases.values())
    assert run(spark, fn.escaped_names(F.col("v")), [r"sugar, brown\, sugar , ,a\\b"]) == [["sugar", "brown, sugar", "a\\b"]]
    text = "Первое предложение. Источник WIKI говорит. Третье!"
    assert run(spark, fn.clean_description(F.col("v"), ["wiki"]), [text, "wiki.", "", None]) == [
        "Первое предложение. Третье!", None, "", None]
    long = " ".join(f"w{i}" for i in range(30))
    got = run(spark, fn.excerpt(F.col("v")), [long, "a b", " "])
    assert got[0].truncated and got[0].excerpt.endswith("w24…") and got[1].excerpt == "a b"
    assert got[2].excerpt is None


def test_name_uuid(spark):
    expected = str(uuid.uuid5(uuid.NAMESPACE_URL, "shop/v1/alias/сахар/7"))
    df = frame(spark, "a string, b int", ("сахар", 7))
    assert df.select(fn.name_uuid("shop/v1", "alias", F.col("a"), F.col("b"))).first()[0] == expected


def test_cells(spark):
    values = ["=1+1", "  -x", "\tq", "plain", None, "@a", "5-2"]
    assert run(spark, fn.export_cell(F.col("v")), values) == ["'=1+1", "'  -x", "'\tq", "plain", "", "'@a", "5-2"]
    assert run(spark, fn.web_url(F.col("v")), ["https://a.b/c", "ftp://x", "javascript:1", None]) == ["https://a.b/c", None, None, None]
    assert run(spark, fn.documented_code(F.col("v")), ["TR_TS_029_2012 x", None]) == ["ТР ТС 029/2012 x", ""]
    df = spark.sql("select map('a', '1', 'b', '2') l, map('b', '3') r")
    assert df.select(fn.json_merge(F.col("l"), F.col("r"))).first()[0] == {"a": "1", "b": "3"}


def test_corrections(spark):
    schema = "t string, c array<struct<token_index:int,token_raw:string,corrected_text:string>>"
    df = frame(
        spark, schema,
        ("шоколад (водда, E322(i)), соль", [(1, "водда", "вода")]),
        ("шоколад (водда, E322(i)), соль", [(1, "вода", "сок")]),
        ("шоколад", [(4, "шоколад", "сок")]),
        ("", [(0, "", "сок")]),
    )
    got = [r[0] for r in df.select(F.array_join(fn.apply_corrections(fn.split_label(F.col("t")), F.col("c")), ", ")).collect()]
    assert got == ["шоколад, вода, E322(i), соль", None, None, "сок"]


def test_assessment(spark):
    import datetime as dt
    schema = "status string, evaluation string, policy string, end date, text string, by string"
    end = dt.date(2027, 2, 27)
    df = frame(
        spark, schema,
        ("BANNED", "notice", "exact_only", None, "t", "e_code"),
        ("BANNED", "reference_only", None, None, "t", "e_code"),
        ("BANNED", "notice", "exact_only", None, "t", "similarity"),
        ("PHASE_OUT", "reference_only", None, end, "t", "alias"),
        ("PERMITTED_WITH_CONDITIONS", "notice", None, None, None, "alias"),
    )
    def go(day):
        return [tuple(r[0]) for r in df.select(fn.assess(
            *[F.col(c) for c in ("status", "evaluation", "policy", "end", "text")],
            matched_by=F.col("by"), on=day)).collect()]
    before = go(dt.date(2027, 2, 26))
    assert [s for s, _ in before] == ["forbidden", "neutral", "neutral", "attention", "neutral"]
    assert before[3][1] == "t" and before[2][1] != "t"
    assert go(end)[3][0] == "attention" and "завершен" in go(end)[3][1]
    assert "завершен" in go(dt.date(2030, 1, 1))[3][1]


def test_descriptions_list_excluded_ingredients(spark):
    """Order of the label, equal ones once, code before name, missing names as empty entries."""
    from provisor.operators import verdict

    rows = spark.createDataFrame(
        [(1, 0, 10, 0, True), (1, 1, 11, 3, True), (1, 2, 10, 0, True), (1, 3, 12, 0, True), (2, 0, 11, 3, False), (3, 0, None, None, False), (4, 0, 13, 0, True)],
        "product_id long, pos int, ingredient_id long, weight int, personal boolean")
    names = spark.createDataFrame([(10, None, "salt"), (11, "E100", "colour"), (12, "", "salt")], "ingredient_id long, e_code string, name string")
    judged = verdict.verdicts(verdict.label_counts(rows, with_hits=True))
    got = {r.product_id: r.description for r in verdict.described(judged, names).collect()}
    assert got[1] == verdict.DESCRIPTIONS["personal"] + "salt, E100 colour"
    assert got[2] == verdict.DESCRIPTIONS["forbidden"] and got[3] == verdict.DESCRIPTIONS["incomplete"]
    assert got[4] == verdict.DESCRIPTIONS["personal"]
