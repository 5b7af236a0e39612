"""Shot tables ready to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions.columns import differs
from matchweave.functions.geometry import mirror_x, mirror_y, scale_x, scale_y


def team_names(events: DataFrame) -> DataFrame:
    """First and last team of each game by name; the same if there is only one."""
    return events.groupBy("game_id").agg(F.min("team").alias("home"), F.max("team").alias("away"))


def shot_split(events: DataFrame) -> DataFrame:
    """Shots with side, outcome class and drawing place.

    A shot that isn't known to be a goal is no goal. The second team's shots are
    mirrored to the other end.
    """
    shots = events.where(F.col("is_shot") == F.lit(True)).join(team_names(events), "game_id")
    own = F.col("team") == F.col("home")
    return shots.withColumns({
        "side": F.when(own, "home").otherwise("away"),
        "result": F.when(differs(F.col("is_goal"), True), "no goal").otherwise("goal"),
        "draw_x": F.when(own, mirror_x(F.col("x"))).otherwise(scale_x(F.col("x"))),
        "draw_y": F.when(own, mirror_y(F.col("y"))).otherwise(scale_y(F.col("y"))),
    })


def split_location(df: DataFrame, column: str = "location") -> DataFrame:
    """x and y from an array column; null where it is shorter."""
    return df.withColumns({"x": F.get(column, F.lit(0)), "y": F.get(column, F.lit(1))})
