"""Landed files of each source, read with declared schemas.

Each reader takes a file, folder, glob or list of them and matches columns by
the names in each file's header, one scan a distinct header. Nothing here fetches
from the network; the files are what a source's connector left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave import schemas
from matchweave.sources import files

Paths = str | list[str]
#: The kinds of season tables.
SEASON_KINDS = ["standard", "shooting", "passing", "defense", "possession"]


def season_stats(spark: SparkSession, paths: Paths, measures: list[str]) -> DataFrame:
    """Player season stats of one kind: the key and person columns, then ``measures`` as doubles."""
    return files.read_csv(spark, paths, T.StructType([*schemas.PLAYER_SEASON_STAT.fields, *[T.StructField(m, T.DoubleType()) for m in measures]]))


def all_season_stats(spark: SparkSession, folder: str, measures: dict[str, list[str]]) -> list[DataFrame]:
    """The season tables of each kind, from the folders of those names."""
    return [season_stats(spark, f"{folder}/{kind}", measures[kind]) for kind in SEASON_KINDS if kind in measures]


def team_match_stats(spark: SparkSession, paths: Paths) -> DataFrame:
    return files.read_csv(spark, paths, schemas.TEAM_MATCH_STAT)


def team_game_stats(spark: SparkSession, paths: Paths) -> DataFrame:
    return files.read_csv(spark, paths, schemas.TEAM_GAME_STAT)


def schedule(spark: SparkSession, paths: Paths) -> DataFrame:
    return files.read_csv(spark, paths, schemas.SCHEDULE)


def match_events(spark: SparkSession, paths: Paths, pattern: str | None = None) -> DataFrame:
    """Events of games; ``pattern`` takes a missing game_id from the path. Empty files give no rows.

    ``seq`` is the row's place in its file, which is the order of events.
    """
    events = files.in_file_order(files.read_csv(spark, paths, schemas.MATCH_EVENT, file="file", block="block"), "seq")
    if pattern:
        events = events.withColumn("game_id", F.coalesce("game_id", F.regexp_extract("file", pattern, 1).try_cast("long")))
    return events.drop("file", "block")


def roster(spark: SparkSession, paths: Paths, pattern: str = r"(\d+)_players") -> DataFrame:
    """Rosters, with the game that each file's name says (file_game)."""
    return files.with_file_key(files.read_csv(spark, paths, schemas.ROSTER, index="row", file="file"), pattern, "file_game", "file").drop("file")


def player_details(rosters: DataFrame, game_id: int) -> DataFrame:
    """One game's roster."""
    return rosters.where(F.col("game_id") == game_id).select("player_id", "player_name", "team_id", "is_starter", "starting_position")


def competitions(spark: SparkSession, paths: Paths) -> DataFrame:
    return files.read_csv(spark, paths, schemas.COMPETITION)


def matches(spark: SparkSession, paths: Paths) -> DataFrame:
    return files.read_csv(spark, paths, schemas.MATCH)


def wide_events(spark: SparkSession, paths: Paths) -> DataFrame:
    """Events with a [x, y] location, one JSON record a line."""
    return files.read_json(spark, paths, schemas.WIDE_EVENT)


def parsed_events(spark: SparkSession, paths: Paths) -> DataFrame:
    return files.read_csv(spark, paths, schemas.PARSED_EVENT)


def lineups(spark: SparkSession, paths: Paths) -> DataFrame:
    return files.read_csv(spark, paths, schemas.LINEUP)
