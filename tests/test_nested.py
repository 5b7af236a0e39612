"""Nested event records as four linked tables."""

import json

from pyspark.sql import functions as F

from matchweave.sources import nested

SHOT = {
    "id": "e2", "index": 2, "period": 1, "minute": 3, "second": 7, "type": {"id": 16, "name": "Shot"}, "team": {"id": 1, "name": "A"}, "player": {"id": 9, "name": "P"}, "location": [101.5, 40], "related_events": ["e1", "e9"],
    "shot": {"statsbomb_xg": 0.25, "outcome": {"id": 97, "name": "Goal"}, "freeze_frame": [{"location": [110, 40], "player": {"id": 7, "name": "K"}, "position": {"id": 1, "name": "GK"}, "teammate": False}, {"player": {"id": 8}, "teammate": True}]}, "extra": 1,
}
START = {"id": "e1", "index": 1, "type": {"id": 35, "name": "Starting XI"}, "related_events": ["e2"], "tactics": {"formation": 433, "lineup": [{"player": {"id": k, "name": f"p{k}"}, "position": {"id": k, "name": "x"}, "jersey_number": k} for k in (4, 9)]}}
PASS = {"id": "e3", "index": 3, "pass": {"recipient": {"id": 4, "name": "p4"}, "end_location": [5, 6]}, "related_events": []}


def test_four_tables_from_one_file(spark, tmp_path):
    (tmp_path / "11.json").write_text(json.dumps([START, SHOT, PASS], indent=1))
    (tmp_path / "12.json").write_text(json.dumps([PASS | {"related_events": ["e1"]}]))
    got = nested.nested_events(spark, str(tmp_path), multiline=True)
    assert {k: v.schema.fieldNames() for k, v in got.items()} == {k: nested._names(k) for k in nested.TABLES}
    assert {k: v.schema.simpleString() for k, v in got.items()} == {k: spark.createDataFrame([], v).schema.simpleString() for k, v in nested.TABLES.items()}
    events = {(r["game"], r["event_id"]): r for r in got["events"].collect()}
    assert len(events) == 4 and events["11", "e2"]["x"] == 101.5 and events["11", "e2"]["outcome_name"] == "Goal" and events["11", "e1"]["tactics_formation"] == "433"
    assert (events["11", "e1"]["tactics_id"], events["11", "e2"]["tactics_id"], events["12", "e3"]["end_y"], events["12", "e3"]["pass_recipient_id"]) == ("e1", None, 6.0, 4)
    assert sorted(map(tuple, got["related"].collect())) == [("11", "e1", 0, "e2", True), ("11", "e2", 0, "e1", True), ("11", "e2", 1, "e9", False), ("12", "e3", 0, "e1", False)]
    assert sorted(map(str, got["freeze_frames"].collect())) == sorted(map(str, spark.createDataFrame([("11", "e2", 0, 7, "K", 1, "GK", 110.0, 40.0, False), ("11", "e2", 1, 8, None, None, None, None, None, True)], nested.TABLES["freeze_frames"]).collect()))
    assert sorted(map(tuple, got["players"].collect())) == [("11", "e1", 0, 4, "p4", 4, "x", 4), ("11", "e1", 1, 9, "p9", 9, "x", 9)]
    for part in ("related", "freeze_frames", "players"):  # no row without its event
        assert got[part].join(got["events"], ["game", "event_id"], "left_anti").count() == 0
    plan = got["players"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "location" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], nested.NESTED_EVENT)
    assert {k: v.count() for k, v in nested.split_events(none, F.lit("g")).items()} == dict.fromkeys(nested.TABLES, 0)
    one = spark.createDataFrame([("e", None)], "id string, x int")
    one = none.unionByName(one.select("id"), allowMissingColumns=True)
    assert {k: v.count() for k, v in nested.split_events(one, F.lit(None)).items()} == {"events": 1, "related": 0, "freeze_frames": 0, "players": 0}
