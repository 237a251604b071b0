import datetime as dt
import json

import pytest
from conftest import frame
from provisor.operators.experiments import with_condition
from provisor.session import shared_dir
from provisor.sinks.run_export import export_parts, manifest, write_export

AT = dt.datetime(2024, 5, 1)


def tables(spark):
    return (
        frame(spark, "run_id long, case_id long, excluded_from_analysis boolean, item string", (1, 7, False, "x"), (2, 7, None, None), (3, 8, True, "z")),
        frame(spark, "case_id long, run_id string, item string", (7, "clash", "y")),
        frame(spark, "run_id long, source string, seq long, no long", (1, "server", 0, 5), (1, "browser", 1, 5), (1, "browser", 0, 5), (1, None, None, 5), (3, "browser", 0, 5), (None, "browser", 0, 5)),
        frame(spark, "run_id long, task_no long, requested_at timestamp", (1, 2, AT), (1, 1, AT), (1, 3, None)),
        spark.createDataFrame([], "run_id long, id long"),
        frame(spark, "run_id long, n long", (1, 4)),
    )


def test_export_keeps_every_row_of_chosen_runs(spark):
    """Nulls first, no limit on a list, clashing names, an empty table, excluded runs only when asked for."""
    parts = export_parts(*tables(spark), part_rows=3)
    got = {(r.run_id, r.section, r.part_no): [json.loads(i) for i in r["items"]] for r in parts.collect()}
    assert {k[0] for k in got} == {"1", "2"} and got["1", "case", 0] == [{"case_id": 7, "run_id": "clash", "item": "y"}]
    events = got["1", "events", 0] + got["1", "events", 1]
    assert [(e["source"], e["seq"]) for e in events] == [(None, None), ("browser", 0), ("browser", 1), ("server", 0)]
    assert [x["task_no"] for x in got["1", "tasks", 0]] == [3, 1, 2]
    assert {r.run_id for r in export_parts(*tables(spark), include_excluded=True).collect()} == {"1", "2", "3"}
    assert {(r.run_id, r.section): r.rows for r in manifest(parts).collect()}["1", "events"] == 4


def test_an_export_beyond_its_limit_fails(spark):
    parts, path = export_parts(*tables(spark)), shared_dir(spark, "export")
    with pytest.raises(ValueError):
        write_export(parts, path, max_runs=1)
    with pytest.raises(ValueError):
        write_export(parts, path, max_bytes=100)
    assert write_export(parts, path).count() == spark.read.json(f"{path}/manifest").count() == 7


def test_conditions_leave_out_the_start(spark):
    runs = frame(spark, "run_id long, protocol_version string, mode string, config_no long, environment map<string,string>",
                 (1, "p", "m", 0, {"b": "1", "a": "2", "started_at_utc": "x"}), (2, "p", "m", 0, {"a": "2", "started_at_utc": "y", "b": "1"}),
                 (3, "p", "m", 0, None), (4, "p", "m", 0, {"started_at_utc": "z"}), (5, None, "m", 0, {}))
    key = {r.run_id: r.condition_key for r in with_condition(runs).collect()}
    assert key[1] == key[2] and key[3] == key[4] and len(set(key.values())) == 3
