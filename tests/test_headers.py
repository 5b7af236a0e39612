"""CSV by header names, and files set aside with a verdict."""

import os

import pytest
from pyspark.sql import functions as F

from matchweave import schemas
from matchweave.schemas import table_schema
from matchweave.sources import files, headers, quarantine, readers


def written(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_columns_go_by_name(spark, tmp_path):
    path = written(
        tmp_path / "s",
        declared="game_id,home_team,away_team\n1,A,B\n",
        reordered="away_team,home_team,game_id\nB,A,2\n",
        indexed=",game_id,home_team,away_team\n0,3,A,B\n1,4,A,C\n",
        extra='season,game_id, home_team ,"away_team",note\n2526,5,A,B,"x,y"\n',
        absent="﻿game_id,away_team\n6,B\n",
        blank="\n\n\n",
        only_header="game_id,home_team,away_team\n",
    )
    got = readers.schedule(spark, path)
    assert got.schema.fieldNames() == schemas.SCHEDULE.fieldNames()
    assert sorted(map(tuple, got.collect())) == [(1, "A", "B"), (2, "A", "B"), (3, "A", "B"), (4, "A", "C"), (5, "A", "B"), (6, None, "B")]
    found = headers.layouts(spark, path)
    assert sorted(len(x.files) for x in found) == [1, 1, 1, 1, 1, 2] and sum(x.names == () for x in found) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 5  # one a distinct header, blank files none


def test_roster_index_keeps_its_name(spark, tmp_path):
    path = written(tmp_path / "r", **{"8_players": "player_id,game_id,player_name,unknown\n5,8,Ñ,1\n", "9_players": ",game_id,player_id\n7,9,6\n"})
    got = [tuple(r) for r in readers.roster(spark, path).select("row", "game_id", "player_id", "player_name", "file_game").collect()]
    assert sorted(got, key=str) == sorted([(None, 8, 5, "Ñ", 8), (7, 9, 6, None, 9)], key=str)


def test_wrong_headers_raise_and_missing_files_too(spark, tmp_path):
    with pytest.raises(ValueError, match="no declared column"):
        files.read_csv(spark, written(tmp_path / "a", x="a,b\n1,2\n"), schemas.SCHEDULE)
    with pytest.raises(ValueError, match="repeats home_team"):
        files.read_csv(spark, written(tmp_path / "b", x="home_team,home_team\n1,2\n"), schemas.SCHEDULE)
    assert files.read_csv(spark, written(tmp_path / "c", x="\n\n"), schemas.SCHEDULE).count() == 0


def test_split_files_keep_order_and_header(spark, tmp_path):
    n = 30_000
    path = written(tmp_path / "big", one="b,a\n" + "".join(f"{k % 7},{k}\n" for k in range(n)), two="a\n" + "".join(f"{k}\n" for k in range(5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = files.in_file_order(files.read_csv(spark, path, table_schema("a int, b int"), file="file", block="block"), "seq")
        got = rows.where("file like '%one.csv'")
        assert got.select("block").distinct().count() > 8
        assert [tuple(r) for r in got.orderBy("seq").select("seq", "a", "b").collect()] == [(k, k, k % 7) for k in range(n)]
        assert [tuple(r) for r in rows.where("file like '%two.csv'").orderBy("seq").select("seq", "a", "b").collect()] == [(k, k, None) for k in range(5)]
        text = (tmp_path / "big" / "one.csv").read_text().splitlines()
        (tmp_path / "big" / "one.csv").write_text("\n".join([*text[:25_000], "oops,1", "1,2,3", *text[25_000:]]) + "\n")
        good, verdict = quarantine.checked_scan(spark, path, table_schema("a int, b int"))
        bad = verdict.where("reason is not null").collect()
        assert [tuple(r)[1:] for r in bad] == [("no int in b", 25_000, "oops,1", n + 2, 2)] and good.count() == 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_every_fault_is_named(spark, tmp_path):
    path = written(
        tmp_path / "q",
        good="game_id,home_team,away_team\n1,A,B\n2,B,\n",
        moved="away_team,game_id,home_team\nB,3,A\n",
        cut="game_id,home_team,away_team\n4,A,B\n5,A",
        short="game_id,home_team,away_team\n4,A\n5,A,B\n",
        long='game_id,home_team,away_team\n4,"A, or",B\n\n5,A,B,C\n',
        value="home_team,away_team,game_id\nA,B,6\nA,B,six\nA,B,7x\n",
        rule="game_id,home_team,away_team\n8,A,A\n",
        header="id,home,away\n9,A,B\n",
        lacks="game_id,home_team\n9,A\n",
        twice="game_id,home_team,home_team,away_team\n9,A,A,B\n",
        empty="\n\n\n\n",
    )
    good, verdict = quarantine.checked_scan(spark, path, schemas.SCHEDULE, required=("game_id", "away_team"), conditions={"two teams": ~F.col("home_team").eqNullSafe(F.col("away_team"))}, file="from")
    assert sorted((*tuple(r)[:3], os.path.basename(r["from"])) for r in good.fillna("-").collect()) == [(1, "A", "B", "good.csv"), (2, "B", "-", "good.csv"), (3, "A", "B", "moved.csv")]
    found = {os.path.basename(r["file"])[:-4]: tuple(r)[1:] for r in verdict.collect()}
    assert found == {
        "good": (None, None, None, 2, 0), "moved": (None, None, None, 1, 0), "cut": ("truncated", 2, "5,A", 2, 1), "short": ("too few fields", 1, "4,A", 2, 1),
        "long": ("too many fields", 2, "5,A,B,C", 2, 1), "value": ("no bigint in game_id", 2, "A,B,six", 3, 2), "rule": ("two teams", 1, "8,A,A", 1, 1),
        "header": ("header lacks game_id, away_team", 0, "id,home,away", 0, 0), "lacks": ("header lacks away_team", 0, "game_id,home_team", 0, 0),
        "twice": ("header repeats home_team", 0, "game_id,home_team,home_team,away_team", 0, 0), "empty": (None, None, None, 0, 0),
    }
    good, verdict = quarantine.checked_scan(spark, written(tmp_path / "n", empty="\n"), schemas.SCHEDULE, file="from")
    assert good.count() == 0 and good.columns == [*schemas.SCHEDULE.fieldNames(), "from"] and verdict.count() == 1
