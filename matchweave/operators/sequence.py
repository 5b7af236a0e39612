"""Operators over ordered events. Spark has no row order: each takes its order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_value(df: DataFrame, column: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add the following row's ``column`` within ``by``; null on the last row."""
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(*by).orderBy(*order)))


def forward_fill(df: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Replace nulls by the last value before them within ``by``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def pair_number(df: DataFrame, order: list[str], by: list[str], size: int = 2, name: str = "pair") -> DataFrame:
    """Number rows in groups of ``size`` from 0, in order, within ``by``."""
    return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def received_and_performed(events: DataFrame, target: Column, teams: Column) -> DataFrame:
    """Per game, successful actions of ``teams`` whose next event is the target's (branch 0) and the target's own actions (branch 1).

    An event that is both stands in both. One scan: the branches are an exploded
    array, not a union.
    """
    nxt = F.lead("player_id").over(Window.partitionBy("game_id").orderBy("seq"))
    rows = events.withColumn("receiver", nxt)
    received = (F.col("receiver") == target) & (F.col("outcome_type") == "Successful") & teams
    performed = F.col("player_id") == target
    branches = F.filter(F.array(F.when(received, 0), F.when(performed, 1)), lambda b: b.isNotNull())
    return rows.select("game_id", "seq", "player_id", "type", "outcome_type", (F.col("minute") * 60 + F.col("second")).alias("clock"), "minute", "second", F.explode(branches).alias("branch"))


def responses(events: DataFrame, target: Column, teams: Column, actions: list[str]) -> DataFrame:
    """What a target player does right after receiving the ball.

    ``events`` has game_id, seq, team, player_id, type, outcome_type, minute and
    second. Received and performed actions are taken in clock order, received before
    performed on ties. A row by another player followed by the target's with one of
    ``actions`` is a response. Returns game_id, seq, outcome_type and seconds.
    """
    both = received_and_performed(events, target, teams)
    w = Window.partitionBy("game_id").orderBy("minute", "second", "branch", "seq")
    after = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("seq", "player_id", "type", "outcome_type", "clock")])
    hit = ~F.col("player_id").eqNullSafe(target) & (F.col("next_player_id") == target) & F.col("next_type").isin(actions)
    return after.where(hit).select("game_id", F.col("next_seq").alias("seq"), F.col("next_outcome_type").alias("outcome_type"), (F.col("next_clock") - F.col("clock")).alias("seconds"))


def response_accuracy(found: DataFrame) -> DataFrame:
    """Mean and sample variance over games of each game's share of outcomes other than Unsuccessful."""
    good = F.when(F.col("outcome_type") == "Unsuccessful", 0.0).otherwise(1.0)
    return found.groupBy("game_id").agg(F.avg(good).alias("share")).agg(F.avg("share").alias("mean_accuracy"), F.var_samp("share").alias("variance"))


def responses_by_pattern(events: DataFrame, target: Column, teams: Column, actions: list[str]) -> DataFrame:
    """``responses`` as a declared pattern: a row by another player, then at once the target's action."""
    from matchweave.operators.patterns import Step, match_pattern

    both = received_and_performed(events, target, teams)
    steps = [Step("received", ~F.col("player_id").eqNullSafe(target)), Step("action", (F.col("player_id") == target) & F.col("type").isin(actions))]
    found = match_pattern(both, steps, ["game_id"], ["minute", "second", "branch", "seq"], ["seq", "outcome_type"], F.col("clock"))
    return found.select("game_id", F.col("action_seq").alias("seq"), F.col("action_outcome_type").alias("outcome_type"), F.col("seconds").cast("int").alias("seconds"))
