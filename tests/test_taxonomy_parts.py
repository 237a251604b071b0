from provisor.sources.taxonomy import number_lines, parse_taxonomy


def test_parts_read_classified_lines_that_are_written_once(spark):
    text = "en: milk\nvegan:en: no\n< en: food\n\nen: food\nru: еда\n\n# note\nnonsense\n"
    parts = parse_taxonomy(number_lines(spark.createDataFrame([("t", text)], "file string, text string"), "file", "text"))
    for df in parts.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "posexplode(split" not in plan
    assert sorted(r.key for r in parts["entries"].collect()) == ["en:food", "en:milk"]
    assert [(r.key, r.name) for r in parts["parents"].collect()] == [("en:milk", "food")]
