import datetime as dt

import pytest
from conftest import frame
from pyspark.sql import functions as F

from provisor.operators import changes, experiments as lab, frames, studies, verdict
from provisor.operators import resolve, rules

NOW = dt.datetime(2026, 1, 1, 12, 0, 0)


def replay(spark, *actions):
    schema = ("run_id long, no long, at timestamp_ntz, revision long, action string, answers map<string,string>, external_search_used boolean, "
              "attempt_displayed boolean, skip_label boolean, user_label_text string, codes array<string>")
    keys = ("answers", "external_search_used", "attempt_displayed", "skip_label", "user_label_text")
    rows = [(1, i, NOW + dt.timedelta(seconds=a.get("s", i)), a["rev"], a["action"], *[a.get(k) for k in keys], ["E202"]) for i, a in enumerate(actions)]
    df = studies.action_payload(frame(spark, schema, *rows), F.col("codes"))
    return studies.replay_stages(df).first()


def test_stage_replay(spark):
    out = replay(
        spark, dict(rev=0, action="start_manual", s=0), dict(rev=1, action="finish_manual", s=5),
        dict(rev=1, action="finish_manual", answers={"E202": "present"}, s=6), dict(rev=1, action="finish_manual", answers={"E211": "absent"}, external_search_used=False, s=7),
        dict(rev=1, action="start_app", s=8), dict(rev=0, action="save_manual", answers={}, s=9),
        dict(rev=1, action="finish_manual", answers={"E202": "unknown"}, external_search_used=False, s=42))
    assert out.stage == "app_ready" and out.manual_duration_ms == 42000 and out.revision == 2
    assert [r.reason for r in out.rejected] == ["missing_answers", "search_flag_missing", "foreign_answers", "wrong_stage", "stale_revision"]


def test_stage_end(spark):
    steps = [dict(rev=0, action="start_manual"), dict(rev=1, action="finish_manual", answers={"E202": "absent"}, external_search_used=True),
             dict(rev=2, action="start_app"), dict(rev=3, action="finish_app", answers={"E202": "absent"}, attempt_displayed=True),
             dict(rev=4, action="annotate"), dict(rev=4, action="annotate", skip_label=True), dict(rev=5, action="abort")]
    out = replay(spark, *steps)
    assert (out.stage, out.labeling_status, out.accepted) == ("completed", "skipped", 5)
    assert [r.reason for r in out.rejected] == ["label_missing", "wrong_stage"]
    assert replay(spark, dict(rev=0, action="abort")).stage == "aborted"


SUMMARY = ("protocol_version string, status string, valid_result boolean, excluded_from_analysis boolean, end_to_end_ms double, "
           "shared_process_cpu_delta_ms double, shared_process_rss_peak_bytes long, ocr_calls long, api_calls long, ocr_cpu_time_ms double, "
           "total_transfer_bytes long, ocr_image_bytes long, frame_complete boolean, quality_reviewed boolean, quality_success boolean")


def summary(ms, cpu, peak, calls, excluded=False, ocr_cpu=None, transfer=None, image=None, complete=None, reviewed=False, success=None):
    return ("t", "finished", True, excluded, float(ms), float(cpu), peak, calls, calls, ocr_cpu, transfer, image, complete, reviewed, success)


def test_group_report(spark):
    df = frame(spark, SUMMARY, summary(100, 10, 1000, 1), summary(200, 20, 2000, 2), summary(99999, 99999, 9, 99, True))
    g = lab.group_report(df, ["protocol_version"]).first()
    assert (g.n, g.success, g.p50, g.p95, g.ocr_calls, g.api_calls) == (2, 2, 100, 200, 3, 3)
    assert (g.shared_process_cpu_per_run_ms, g.shared_process_cpu_per_success_ms, g.shared_process_rss_peak_bytes) == (15, 15, 2000)
    assert lab.group_report(frame(spark, SUMMARY, summary(1, 1, 1, 1, True)), ["protocol_version"]).count() == 0


def test_frame_completeness(spark):
    row = lambda complete, ok: summary(5000, 50, 1000000, 1, False, 90.0, 4000, 2500, complete, True, ok)
    g = lab.group_report(frame(spark, SUMMARY, row(False, True), row(True, False)), ["protocol_version"]).first()
    assert (g.complete_frames, g.frame_completeness_rate, g.ocr_cpu_time_ms) == (1, 0.5, 180)
    assert (g.bytes_per_complete_scan, g.ocr_cpu_per_complete_scan_ms) == (8000, 180)
    assert lab.group_report(frame(spark, SUMMARY, row(None, True)), ["protocol_version"]).first().bytes_per_complete_scan is None


def test_export_guard(spark):
    assert lab.require_at_most(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        lab.require_at_most(spark.range(4), 3)


ING = "ingredient_id string, name string, e_code string, is_active boolean"
ALIAS = "ingredient_id string, alias string, normalized_alias string, confidence double"


def resolved(spark, text, ingredients, aliases):
    dictionary = resolve.match_dictionary(
        frame(spark, ING, *ingredients), spark.createDataFrame(aliases, ALIAS), spark.createDataFrame([], "normalized_alias string"))
    tokens = resolve.with_lookup_key(resolve.label_tokens(frame(spark, "product_id int, text string", (1, text))))
    return resolve.resolve_tokens(tokens, dictionary).orderBy("pos").collect()


def test_resolver(spark):
    rows = resolved(spark, "water, E450(xv), watter, water", [("w", "вода", None, True)], [("w", "water", "water", 1.0)])
    assert [r.ingredient_id for r in rows] == ["w", None, None, "w"]
    rows = resolved(spark, "без E216, E211", [("a", "x", "E999", True)], [("a", "q", "q", 1.0)])
    assert [(r.by, r.key) for r in rows] == [("name", "без e216"), ("code", "e211")]
    owners = [("one", "ambiguous", "ambiguous", 1.0), ("two", "ambiguous", "ambiguous", 1.0), ("three", "unique", "unique", .5), ("three", "unique", "unique", .9)]
    rows = resolved(spark, "ambiguous, unique", [(i, i, None, True) for i in ("one", "two", "three")], owners)
    assert [(r.ingredient_id, r.match_score) for r in rows] == [(None, None), ("three", .9)]
    rows = resolved(spark, "ambiguous", [("one", "x", None, True), ("two", "x", None, False)], owners[:2])
    assert rows[0].ingredient_id == "one"


def test_verdict_levels(spark):
    schema = "product_id int, ingredient_id string, pos int, weight int, personal boolean"
    rows = [(1, "w", 0, -1, False), (2, "w", 0, -1, True), (3, "a", 0, 3, False), (3, None, 1, None, False), (4, "a", 0, 1, True), (5, None, None, None, None)]
    got = {r.product_id: (r.level, r.risk_score, r.reasons, r.incomplete) for r in verdict.verdicts(verdict.label_counts(frame(spark, schema, *rows))).collect()}
    assert got == {1: ("unknown", 0, 0, True), 2: ("risky_for_user", 95, 1, True), 3: ("dangerous", 96, 1, True), 4: ("risky_for_user", 95, 2, False), 5: ("unknown", 0, 0, True)}


def test_word_table(spark):
    words = frame(spark, "page int, row int, word_no int, word string, conf double, height int",
                  (1, 1, 0, "", -1.0, 0), (1, 1, 1, "вода", 90.5, 17), (1, 1, 2, "сахар", 80.5, 17), (2, 1, 0, " ", -1.0, 5))
    assert [r.line for r in frames.text_lines(words, ["page", "row"]).collect()] == ["вода сахар"]
    assert {r.page: r.confidence for r in frames.page_confidence(words, ["page"]).collect()} == {1: 0.855, 2: 0.0}
    assert {r.page: r.factor for r in frames.upscale_factors(words, ["page"]).collect()} == {1: 2.0, 2: 2.0}


def test_frame_pools(spark):
    flat = lambda v: [float(v)] * 4
    schema = "run_id long, frame_no long, at_ms long, fp array<double>, score double, outcome string"
    rows = [(1, 0, 0, flat(10), 1.0, "ok"), (1, 1, 250, flat(50), 3.0, "ok"), (1, 2, 500, flat(90), 2.0, "ok"),
            (1, 3, 750, flat(51), 9.0, "ok"), (1, 4, 1000, flat(120), 1.0, "moving"), (1, 5, 1250, flat(120), 1.0, "ok"), (1, 6, 1500, flat(130), 1.0, "ok")]
    got = [tuple(r) for r in frames.select_frames(frame(spark, schema, *rows)).collect()]
    assert got == [(1, 0, 1, 3, 3.0), (1, 1, 5, 2, 1.0)]


def test_severity_of_rules(spark):
    schema = "rule_id string, ingredient_id string, source_id string, regulatory_status string, evaluation string, match_policy string, explanation string, effective_from date, effective_to date"
    day = dt.date(2025, 1, 1)
    rows = [("r1", "a", "s", "BANNED", "notice", None, "why", None, None), ("r2", "a", "s", "PHASE_OUT", "notice", None, None, None, day),
            ("r3", "b", "s", "PERMITTED_WITH_CONDITIONS", "notice", None, None, day, None), ("r4", "c", "s", "BANNED", "notice", None, None, dt.date(2025, 1, 2), None)]
    sources = frame(spark, "source_id string, code string, title string, url string, effective_from date, effective_to date", ("s", "S", "t", "u", None, None))
    terms = spark.createDataFrame([], "rule_id string, transition_end date")
    assessed = rules.assessed_rules(rules.valid_rules(frame(spark, schema, *rows), sources, day), terms, day, "alias")
    ingredients = frame(spark, "ingredient_id string", ("a",), ("b",), ("c",))
    got = {r.ingredient_id: (r.severity, r.rules) for r in rules.severity_of_ingredients(ingredients, assessed).collect()}
    assert got == {"a": ("forbidden", 2), "b": ("neutral", 1), "c": ("unknown", 0)}


def test_update_plan_guards(spark):
    current = frame(spark, "code string, id string, text string", ("E1", "1", "old"), ("E2", "2", "x"), ("E3", "3", None), ("E4", "4", "a"), ("E4", "5", "b"))
    texts = frame(spark, "code string, new_text string", ("E1", "new"), ("E2", "x"), ("E3", "new"), ("E4", "n"), ("E9", "n"))
    expected = frame(spark, "code string, id string, text string", ("E1", "1", "old"), ("E3", "3", "other"))
    plan = changes.plan_updates(current, texts, expected)
    assert {r.code: r.decision for r in plan.collect()} == {"E1": "apply", "E2": "current", "E3": "stale", "E4": "duplicate", "E9": "missing"}
    after = changes.apply_plan(current, plan)
    assert changes.update_violations(current, plan, after).count() == 0
    assert changes.update_violations(current, plan, current).count() == 2
