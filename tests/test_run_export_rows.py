import json
import re

from conftest import frame
from provisor.sinks.run_export import export_parts
from test_run_export import tables


def test_lists_move_to_their_bucket_before_they_are_json(spark):
    parts = export_parts(*tables(spark))
    plan = parts._jdf.queryExecution().optimizedPlan().toString().split("\n")
    deep = [re.search(r"[A-Za-z]", x).start() if re.search(r"[A-Za-z]", x) else 0 for x in plan]
    moves = [i for i, x in enumerate(plan) if "RepartitionByExpression" in x]
    assert len(moves) == 3 or len(moves) == 2  # an empty log may be left out
    for i in moves:
        end = next((j for j in range(i + 1, len(plan)) if deep[j] <= deep[i]), len(plan))
        assert not any("to_json" in x for x in plan[i:end])


def test_columns_of_a_list_may_have_names_of_the_export(spark):
    runs, cases, events, tasks, audit, own = tables(spark)
    events = frame(spark, "run_id long, source string, seq long, _bucket long, _order0 long, _row string", (1, "browser", 1, 8, 9, "r"), (1, "browser", 0, 8, 9, "r"))
    got = {(r.run_id, r.section): r["items"] for r in export_parts(runs, cases, events, tasks, audit, own).collect()}
    assert [json.loads(x) for x in got["1", "events"]] == [
        {"run_id": 1, "source": "browser", "seq": n, "_bucket": 8, "_order0": 9, "_row": "r"} for n in (0, 1)]
