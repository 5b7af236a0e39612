"""Passing networks: edges, nodes, team shape and drawing sizes.

All functions work on every game and team at once; nothing is split by team.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.columns import clamp_alpha
from matchweave.functions.geometry import pass_angle, scale_x, scale_y
from matchweave.operators.joins import checked_join, stack, unique
from matchweave.operators.ranks import medians
from matchweave.operators.sequence import forward_fill, next_value

SIDE = ["game_id", "team"]


def successful_passes(events: DataFrame) -> DataFrame:
    """Completed passes on the target pitch with angle and receiver.

    The receiver is the passer of the team's next completed pass, so the filter
    comes before the look-ahead; the last pass has none.
    """
    kept = events.where((F.col("type") == "Pass") & (F.col("outcome_type") == "Successful"))
    angle = pass_angle(F.col("x"), F.col("y"), F.col("end_x"), F.col("end_y"))
    kept = kept.withColumns({"pass_angle": angle, "pass_angle_abs": F.abs(angle), "x": scale_x(F.col("x")), "y": scale_y(F.col("y")), "end_x": scale_x(F.col("end_x")), "end_y": scale_y(F.col("end_y"))})
    return next_value(kept, "player_id", SIDE, ["seq"], "receiver")


def edges(passes: DataFrame) -> DataFrame:
    """(game_id, team, pos_min, pos_max, pass_count), undirected; a pass without a receiver is a loop."""
    ends = passes.select(*SIDE, F.least("player_id", "receiver").alias("pos_min"), F.greatest("player_id", "receiver").alias("pos_max"))
    return ends.where("pos_min is not null").groupBy(*SIDE, "pos_min", "pos_max").agg(F.count("*").alias("pass_count"))


def _with_medians(df: DataFrame, by: list[str], values: dict[str, Column], others: list[Column], most: int | None) -> DataFrame:
    """``others`` and the medians of ``values`` by group.

    Without ``most`` in one aggregation, which holds a group's values; with it, groups of
    more rows take theirs from counted ranges (``ranks.medians``). The result is the same.
    """
    if most is None:
        return df.groupBy(*by).agg(*[F.median(v).alias(n) for n, v in values.items()], *others)
    found = medians(df.select(*by, *[v.alias(n) for n, v in values.items()]), by, list(values), most).withColumnsRenamed({b: f"_{b}" for b in by})
    same = functools.reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    grouped = df.groupBy(*by).agg(*others)
    return grouped.join(found, same).select(*by, *values, *grouped.columns[len(by) :])


def locations(passes: DataFrame, most: int | None = None) -> DataFrame:
    """Median place and number of passes of each player; ``most`` bounds the rows of a median held at once."""
    rows = passes.where("player_id is not null")
    return _with_medians(rows, [*SIDE, "player_id"], {"x": F.col("x"), "y": F.col("y")}, [F.count("player_id").alias("passes")], most)


def with_roster(places: DataFrame, roster: DataFrame, teams: DataFrame) -> DataFrame:
    """Full outer join to the match roster: every team sees the whole match's roster."""
    seen = teams.select(*SIDE).distinct().join(roster, "game_id")
    return places.join(seen, [*SIDE, "player_id"], "full_outer")


def verticality(passes: DataFrame, most: int | None = None) -> DataFrame:
    """How far forward passes (at most 90 degrees off) go straight ahead, 0 to 100, rounded half to even; ``most`` as in ``locations``."""
    ahead = F.when(F.col("pass_angle_abs").between(0, 90), F.col("pass_angle_abs"))
    found = _with_medians(passes, SIDE, {"ahead": ahead}, [F.count("*").alias("_n")], most)
    return found.select(*SIDE, F.bround((1 - F.col("ahead") / 90) * 100, 2).alias("verticality"))


def team_lines(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Defence, attack and middle of each team from its nodes; ``most`` as in ``locations``.

    The defaults 30 and 90 hold only if the match has no player of that role;
    with such players but without a place for any, the line is null.
    """
    back, front = F.col("position") == "DC", F.col("position").isin("FW", "AMC")
    forward = F.when(F.count_if(front) > 0, F.avg(F.when(front, F.col("x")))).otherwise(F.lit(90.0))
    found = _with_medians(nodes, SIDE, {"_back": F.when(back, F.col("x")), "team_median": F.col("x")}, [F.count_if(back).alias("_backs"), forward.alias("forward")], most)
    defense = F.when(F.col("_backs") > 0, F.col("_back")).otherwise(F.lit(30.0)).alias("defense")
    out = found.select(*SIDE, defense, "forward", "team_median")
    return out.withColumns({"band_low": F.least("defense", "forward"), "band_high": F.greatest("defense", "forward")})


def attach_places(pairs: DataFrame, places: DataFrame, start: str, end: str, key: str, by: list[str]) -> DataFrame:
    """Inner joins of a place table to both ends of each edge; the end's columns get _end."""
    first = places.withColumnRenamed(key, start)
    second = places.withColumnsRenamed({c: c + "_end" for c in places.columns if c not in (*by, key)} | {key: end})
    return pairs.join(first, [*by, start]).join(second, [*by, end])


def share_of_max(column: str, by: list[str]) -> Column:
    return F.col(column) / F.max(column).over(Window.partitionBy(*by))


def drawable(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with both ends' places, line width and opacity."""
    placed = attach_places(pairs, places.select(*SIDE, "player_id", "x", "y"), "pos_min", "pos_max", "player_id", SIDE)
    share = share_of_max("pass_count", SIDE)
    return placed.withColumns({"width": share * 15, "alpha": share * 0.6 + 0.3})


def directed_pairs(passes: DataFrame) -> DataFrame:
    """Passes per (player, recipient); rows without a recipient are dropped.

    The pair is also given as one joined text, null if either end is missing.
    """
    named = passes.withColumn("pair", F.concat(F.col("player_id").cast("string"), F.col("recipient").cast("string"))).where("pair is not null")
    return named.groupBy("game_id", "team", "player_id", "recipient", "pair").agg(F.count("seq").alias("number_pass"))


def most_minutes(events: DataFrame, n: int = 11) -> DataFrame:
    """Each team's ``n`` players with the widest range of minutes; ties by player."""
    spans = events.where("player_id is not null").groupBy(*SIDE, "player_id").agg((F.max("minute") - F.min("minute")).alias("minutes_played"))
    place = F.row_number().over(Window.partitionBy(*SIDE).orderBy(F.desc_nulls_last("minutes_played"), "player_id"))
    return spans.withColumn("place", place).where(F.col("place") <= n)


def directed_network(first_half: DataFrame, n: int = 11, least_alpha: float = 0.1) -> DataFrame:
    """Directed pass network of each team's ``n`` most used players in the first half."""
    passes = first_half.where("type = 'Pass'")
    places = passes.where("player_id is not null").groupBy(*SIDE, "player_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    placed = attach_places(directed_pairs(passes), places, "player_id", "recipient", "player_id", SIDE)
    chosen = most_minutes(first_half, n).select(*SIDE, "player_id")
    kept = placed.join(chosen, [*SIDE, "player_id"], "left_semi").join(chosen.withColumnRenamed("player_id", "recipient"), [*SIDE, "recipient"], "left_semi")
    share = share_of_max("number_pass", SIDE)
    return kept.withColumns({"width": share, "line_width": share + 0.5, "alpha": clamp_alpha(share, least_alpha)})


def with_markers(nodes: DataFrame) -> DataFrame:
    """Add marker: s for a substitute, o for a starter and for a player of whom it isn't known."""
    return nodes.withColumn("marker", F.when(F.coalesce("is_starter", F.lit(True)), "o").otherwise("s"))


def outcome_split(events: DataFrame, outcomes: tuple[str, str] = ("Successful", "Unsuccessful")) -> DataFrame:
    """Each player's actions (of any type) by outcome: count, first and last place in the game."""
    kept = events.where(F.col("outcome_type").isin(*outcomes))
    return kept.groupBy(*SIDE, "player_id", "outcome_type").agg(F.count("*").alias("actions"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def fill_formation(events: DataFrame) -> DataFrame:
    """Give every event the formation that its team last announced.

    A row with tactics_formation announces it under its own id.
    """
    marked = events.withColumn("tactics_id", F.when(F.col("tactics_formation").isNotNull(), F.col("id")).otherwise(F.col("tactics_id")))
    return forward_fill(marked, ["tactics_id", "tactics_formation"], SIDE, ["seq"])


def with_substitutes(lineup: DataFrame, substitutions: DataFrame) -> DataFrame:
    """Lineup plus each substitute in the place of the player replaced, one level deep.

    Both sides must be unique on (tactics_id, player_id).
    """
    came = checked_join(lineup, substitutions, ["tactics_id", "player_id"], "inner", "1:1")
    came = came.select("tactics_id", F.col("replacement_id").alias("player_id"), "position")
    return stack(lineup, came)


def formation_network(events: DataFrame, lineup: DataFrame, formation: str, least_alpha: float = 0.3) -> DataFrame:
    """Pass network between positions while a team plays ``formation``.

    ``events`` are filled (``fill_formation``) and have recipient; ``lineup`` has
    tactics_id, player_id and position, unique on the first two.
    """
    lineup = unique(lineup.select("tactics_id", "player_id", "position"), ["tactics_id", "player_id"])  # checked once for both joins
    placed = events.where(F.col("tactics_formation") == formation).join(lineup, ["tactics_id", "player_id"], "left")
    receipt = lineup.select("tactics_id", F.col("player_id").alias("recipient"), F.col("position").alias("position_receipt"))
    placed = placed.join(receipt, ["tactics_id", "recipient"], "left")
    passes = placed.where("type = 'Pass' and position is not null and position_receipt is not null")
    pairs = passes.groupBy(*SIDE, F.least("position", "position_receipt").alias("pos_min"), F.greatest("position", "position_receipt").alias("pos_max")).agg(F.count("seq").alias("pass_count"))
    touches = placed.where("type in ('Pass', 'BallTouch') and position is not null")
    places = touches.groupBy(*SIDE, "position").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("y").alias("count"))
    out = attach_places(pairs, places, "pos_min", "pos_max", "position", SIDE)
    share = share_of_max("pass_count", SIDE)
    return out.withColumns({"width": share * 18, "alpha": clamp_alpha(share, least_alpha), "marker_size": share_of_max("count", SIDE) * 3000})


def formations_by_team(filled: DataFrame) -> DataFrame:
    """Each team's formations in a game, sorted, as an array."""
    return filled.groupBy(*SIDE).agg(F.array_sort(F.collect_set("tactics_formation")).alias("formations"))
