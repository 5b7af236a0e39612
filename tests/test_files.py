"""Scans, writers, streaming and the driver's contract."""

import glob
import importlib
import random

import pytest
from pyspark.sql import functions as F

from matchweave import schemas
from matchweave.sources import files, readers, scratch
from matchweave.streaming.windows import tumbling_counts

ROSTER = ",game_id,team_id,player_id,player_name,is_starter,minutes_played,jersey_number,starting_position\n"


def test_roster_scan_with_empty_files(spark, tmp_path):
    (tmp_path / "77_players.csv").write_text(ROSTER + "0,77,1,5,José Ñ,True,90,9,FW\n1,77,1,6,B,False,0,12,Sub\n")
    (tmp_path / "78_players.csv").write_text("\n\n\n\n")
    df = files.with_file_key(files.read_csv(spark, str(tmp_path), schemas.ROSTER), r"(\d+)_players", "file_game")
    rows = df.orderBy("row").collect()
    assert [(r["file_game"], r["player_name"], r["is_starter"], r["starting_position"]) for r in rows] == [(77, "José Ñ", True, "FW"), (77, "B", False, "Sub")]


def test_bad_files_are_left_out_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("game_id,home_team,away_team\n1,A,B\n2,A,C\n")
    (tmp_path / "b.csv").write_text("game_id,home_team,away_team\n3,A,D\nx,A,E\n")
    df = files.read_csv(spark, str(tmp_path), schemas.SCHEDULE)
    assert df.count() == 4
    assert {r["game_id"] for r in files.good_files(df, [F.col("game_id").isNotNull()]).collect()} == {1, 2}
    corrupt = files.read_csv(spark, str(tmp_path), schemas.SCHEDULE, keep_corrupt=True).cache()
    assert [r[files.CORRUPT] for r in corrupt.where(f"{files.CORRUPT} is not null").collect()] == ["x,A,E"]


def test_trailing_spaces_and_space_in_names_are_data(spark, tmp_path):
    header = schemas.TEAM_GAME_STAT.fieldNames()
    (tmp_path / "s.csv").write_text(",".join(header) + "\n" + ",".join(["v "] * 4 + ["2025-08-01"] + [""] * (len(header) - 5)) + "\n")
    r = files.read_csv(spark, str(tmp_path), schemas.TEAM_GAME_STAT).first()
    assert r["game"] == "v " and r["Opp Formation"] is None and str(r["date"]) == "2025-08-01"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "game_id long, t string")
    files.write_csv(df, f"{tmp_path}/i", index_by=["game_id"])
    back = spark.read.option("header", True).schema("row int, game_id long, t string").csv(f"{tmp_path}/i")
    assert sorted(map(tuple, back.collect())) == [(0, 1, "a"), (1, 2, "b"), (2, 3, "c")]
    files.write_per_key(df, f"{tmp_path}/k", "game_id")
    assert len(glob.glob(f"{tmp_path}/k/game_id=*")) == 3
    files.write_json(df, f"{tmp_path}/j")
    assert sorted(map(tuple, files.read_json(spark, f"{tmp_path}/j", df.schema).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_index_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "`a.b` int, _row_index_part int")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = files.with_index(df, ["a.b", "_row_index_part"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [tuple(r)[1:] for r in sorted(got)] == order and sorted(r["row_index"] for r in got) == list(range(3000))
    assert files.with_index(df.where("false"), ["a.b"]).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "standard").mkdir()
    (tmp_path / "standard" / "s.csv").write_text("league,season,team,player,nation,pos,age,born,90s,Gls,Per 90 Gls\nL,2526,T,P,eng ENG,MF,20-100,2005,1.5,3,2.0\n")
    (tmp_path / "passing").mkdir()
    (tmp_path / "passing" / "p.csv").write_text("league,season,team,player,nation,pos,age,born,90s,Cmp\nL,2526,T,P,eng ENG,MF,20-100,2005,1.5,\n")
    first, second = readers.all_season_stats(spark, str(tmp_path), {"standard": ["Gls", "Per 90 Gls"], "passing": ["Cmp"]})
    assert (first.first()["Gls"], first.first()["90s"], second.first()["Cmp"]) == (3.0, 1.5, None)

    names = "game_id,team,player,player_id,minute,second,type,outcome_type,x,y,end_x,end_y,is_shot,is_goal,blocked_x,blocked_y,goal_mouth_y,goal_mouth_z\n"
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "game_7.csv").write_text(names + "".join(f",T,P,{k},{k},0,Pass,Successful,1,2,3,4,,,,,,\n" for k in (9, 3, 5)))
    (tmp_path / "ev" / "game_8.csv").write_text("\n\n\n\n")
    got = readers.match_events(spark, f"{tmp_path}/ev", r"game_(\d+)").orderBy("seq").collect()
    assert [(r["game_id"], r["seq"], r["player_id"], r["is_shot"]) for r in got] == [(7, 0, 9, None), (7, 1, 3, None), (7, 2, 5, None)]

    (tmp_path / "77_players.csv").write_text(ROSTER + "0,77,1,5,A,True,90,9,FW\n1,78,1,6,B,False,0,12,Sub\n")
    rosters = readers.roster(spark, f"{tmp_path}/77_players.csv")
    assert {r["file_game"] for r in rosters.collect()} == {77} and [r["player_id"] for r in readers.player_details(rosters, 78).collect()] == [6]
    (tmp_path / "w.json").write_text('{"seq": 1, "location": [60.5, 40], "type": "Shot"}\n')
    assert readers.wide_events(spark, f"{tmp_path}/w.json").first()["location"] == [60.5, 40.0]
    (tmp_path / "l.csv").write_text("id,player_id,position_id\ne1,5,23\n")
    assert readers.lineups(spark, f"{tmp_path}/l.csv").first() == ("e1", 5, 23)
    for read, schema in ((readers.schedule, schemas.SCHEDULE), (readers.matches, schemas.MATCH), (readers.competitions, schemas.COMPETITION), (readers.parsed_events, schemas.PARSED_EVENT), (readers.team_match_stats, schemas.TEAM_MATCH_STAT), (readers.team_game_stats, schemas.TEAM_GAME_STAT)):
        (tmp_path / "one.csv").write_text(",".join(schema.fieldNames()) + "\n" + ",".join("" for _ in schema.fieldNames()[1:]) + "1\n")
        assert read(spark, f"{tmp_path}/one.csv").schema.fieldNames() == schema.fieldNames() and read(spark, f"{tmp_path}/one.csv").count() == 1


def test_collect_team(spark, tmp_path):
    schedule = spark.createDataFrame([(1, "A", "B"), (2, "C", "A"), (3, "C", "B"), (4, "A", "A")], schemas.SCHEDULE)
    events = spark.createDataFrame([(g, s) for g in (1, 2, 3, 4) for s in range(3)], "game_id long, seq long")
    files.collect_team(schedule, events, "A", f"{tmp_path}/team")
    assert sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{tmp_path}/team/game_id=*")) == ["1", "2", "4"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/team").count() == 9


def test_scratch_tables_are_dropped(spark):
    held = scratch.Scratch(spark)
    assert held.table(spark.range(3), "t").count() == 3
    held.drop()
    with pytest.raises(Exception, match="[Pp]ath|exist"):
        spark.read.parquet(f"{held.path}/t")


def test_team_games_home_first(spark):
    df = spark.createDataFrame([(1, "A", "B"), (2, "C", "A"), (3, "C", "B")], schemas.SCHEDULE)
    assert [r["game_id"] for r in files.team_games(df, "A").collect()] == [1, 2]


def test_tumbling_counts_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" if k % 3 else "y") for k in range(0, 4000, 37)], "s long, type string").select(F.timestamp_seconds("s").alias("ts"), "type")
    df.write.parquet(f"{tmp_path}/in")
    stream = tumbling_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, tumbling_counts(df, "ts", "type").collect()))


def test_contract_names_agree():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "pass_network" in entry.queries()
