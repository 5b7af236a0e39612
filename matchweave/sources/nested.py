"""Nested event records split into four linked tables in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.sources.scratch import Scratch

_NAMED = "struct<id:bigint,name:string>"
#: The fields of a nested event record that the tables take.
NESTED_EVENT = (
    f"id string, `index` bigint, period int, timestamp string, minute int, second int, type {_NAMED}, team {_NAMED}, player {_NAMED}, position {_NAMED}, location array<double>, related_events array<string>, "
    f"tactics struct<formation:bigint,lineup:array<struct<player:{_NAMED},position:{_NAMED},jersey_number:int>>>, "
    f"pass struct<recipient:{_NAMED},end_location:array<double>,outcome:{_NAMED}>, substitution struct<replacement:{_NAMED}>, "
    f"shot struct<statsbomb_xg:double,outcome:{_NAMED},freeze_frame:array<struct<location:array<double>,player:{_NAMED},position:{_NAMED},teammate:boolean>>>"
)
#: Each table's columns. All have the record's game and event; ``place`` counts an event's rows from 0.
TABLES = {
    "events": "game string, event_id string, seq long, period int, timestamp string, minute int, second int, type_id long, type_name string, team_id long, team_name string, player_id long, player_name string, "
    "position_id long, x double, y double, end_x double, end_y double, outcome_name string, pass_recipient_id long, pass_recipient_name string, substitution_replacement_id long, "
    "substitution_replacement_name string, shot_xg double, tactics_formation string, tactics_id string",
    "related": "game string, event_id string, place int, related_id string, related_known boolean",
    "freeze_frames": "game string, event_id string, place int, player_id long, player_name string, position_id long, position_name string, x double, y double, teammate boolean",
    "players": "game string, event_id string, place int, player_id long, player_name string, position_id long, position_name string, jersey_number int",
}
_PART = "_part"


def _names(part: str) -> list[str]:
    return [field.split()[0] for field in TABLES[part].split(", ")]


def _rows(array: Column, fields: dict[str, Column]) -> Column:
    """An array's elements with their places; ``fields`` are taken from the element ``x``."""
    return F.transform(F.coalesce(array, F.array()), lambda x, k: F.struct(k.cast("int").alias("place"), *[f(x).alias(n) for n, f in fields.items()]))


def split_events(records: DataFrame, game: Column) -> dict[str, DataFrame]:
    """Nested records (``NESTED_EVENT``) as tables: events, related, freeze_frames and players.

    ``game`` gives each record's match. Every row of the other three names its
    event, by (game, event_id); an event's rows are numbered from 0 in the record's
    order. Players are those of an event's line-up, freeze frames those of a shot.
    ``related_known`` says whether the related event is in the same game. A null or
    empty array gives no rows, a null element of one a row of nulls; fields of other
    names are ignored.

    The records are read once: each becomes one row a table's row, all written
    together in folders by table, and a reader of one table opens its folder alone.
    """
    held = Scratch(records.sparkSession)
    at = lambda c, k: F.get(c, F.lit(k))
    place, end = F.col("location"), F.col("pass.end_location")
    event = F.struct(
        F.col("index").alias("seq"), "period", "timestamp", "minute", "second", F.col("type.id").alias("type_id"), F.col("type.name").alias("type_name"), F.col("team.id").alias("team_id"), F.col("team.name").alias("team_name"),
        F.col("player.id").alias("player_id"), F.col("player.name").alias("player_name"), F.col("position.id").alias("position_id"), at(place, 0).alias("x"), at(place, 1).alias("y"), at(end, 0).alias("end_x"), at(end, 1).alias("end_y"),
        F.coalesce("shot.outcome.name", "pass.outcome.name").alias("outcome_name"), F.col("pass.recipient.id").alias("pass_recipient_id"), F.col("pass.recipient.name").alias("pass_recipient_name"),
        F.col("substitution.replacement.id").alias("substitution_replacement_id"), F.col("substitution.replacement.name").alias("substitution_replacement_name"), F.col("shot.statsbomb_xg").alias("shot_xg"),
        F.col("tactics.formation").cast("string").alias("tactics_formation"), F.when(F.col("tactics.formation").isNotNull(), F.col("id")).alias("tactics_id"),
    )
    person = {"player_id": lambda x: x["player"]["id"], "player_name": lambda x: x["player"]["name"], "position_id": lambda x: x["position"]["id"], "position_name": lambda x: x["position"]["name"]}
    rows = {
        "events": F.array(event),
        "related": _rows(F.col("related_events"), {"related_id": lambda x: x}),
        "freeze_frames": _rows(F.col("shot.freeze_frame"), person | {"x": lambda x: at(x["location"], 0), "y": lambda x: at(x["location"], 1), "teammate": lambda x: x["teammate"]}),
        "players": _rows(F.col("tactics.lineup"), person | {"jersey_number": lambda x: x["jersey_number"]}),
    }
    # One element for each row of any table: its own struct is set, the others are null.
    tag = lambda part: lambda x: F.struct(F.lit(part).alias(_PART), *[(x if p == part else F.lit(None)).alias(p) for p in rows])
    tagged = F.concat(*[F.transform(rows[part], tag(part)) for part in rows])
    kinds = records.select(*[F.get(a, F.lit(0)).alias(p) for p, a in rows.items()]).schema
    shape = f"array<struct<{_PART}:string,{','.join(f'{p}:{kinds[p].dataType.simpleString()}' for p in rows)}>>"
    flat = records.select(game.cast("string").alias("game"), F.col("id").alias("event_id"), F.explode(tagged.cast(shape)).alias("row")).select("game", "event_id", "row.*")
    flat.write.partitionBy(_PART).parquet(f"{held.path}/rows")
    out = {}
    for part in rows:
        # The folder of a table that has no rows isn't there; the parent's schema is, and the filter opens that folder alone.
        read = records.sparkSession.read.schema(flat.schema).parquet(f"{held.path}/rows").where(F.col(_PART) == part)
        out[part] = read.select("game", "event_id", f"{part}.*")
    known = out["events"].select("game", F.col("event_id").alias("related_id")).distinct().withColumn("_known", F.lit(True))
    out["related"] = out["related"].join(known, ["game", "related_id"], "left").withColumn("related_known", F.coalesce("_known", F.lit(False)))
    return {part: df.select(*_names(part)) for part, df in out.items()}


def nested_events(spark: SparkSession, paths: str | list[str], pattern: str = r"([^/]+)\.json", multiline: bool = False) -> dict[str, DataFrame]:
    """``split_events`` of JSON files, the game from each file's name; a record a line, or with ``multiline`` one array a file."""
    records = spark.read.schema(NESTED_EVENT).option("multiLine", multiline).json(paths)
    return split_events(records, F.regexp_extract("_metadata.file_path", pattern, 1))
