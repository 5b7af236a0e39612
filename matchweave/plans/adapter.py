"""The driver's tables seen as match data.

``events`` become match events of eight games a day, by range of users, with two
teams each; rosters and lineups are derived from who took part. The SQL twin of
each view is in ``catalog``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions.columns import lookup

#: Position codes by number.
POSITIONS = {
    1: "GK", 2: "RB", 3: "RCB", 4: "CB", 5: "LCB", 6: "LB", 7: "RWB", 8: "LWB", 9: "RDM", 10: "CDM", 11: "LDM", 12: "RM", 13: "RCM", 14: "CM", 15: "LCM", 16: "LM",
    17: "RW", 18: "RAM", 19: "CAM", 20: "LAM", 21: "LW", 22: "RCF", 23: "ST", 24: "LCF", 25: "SS",
}
ROLES = dict(enumerate("DC MC AMC FW FWL GK Sub".split()))
TYPES = {"purchase": "Pass", "click": "TakeOn", "view": "BallTouch", "signup": "Shot", "error": "Foul"}
FORMATIONS = dict(enumerate(["433", "442", "352"]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    number = F.regexp_extract("props", "([0-9]+)", 1)
    value, ts = F.col("value"), F.col("ts")
    shot = F.col("event_type") == "signup"
    return raw.select(
        (F.date_format(ts, "yyyyMMdd").cast("int") * 8 + F.floor(F.col("user_id") / 2) % 8).cast("bigint").alias("game_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("player_id"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("team"), lookup(F.col("event_type"), TYPES).alias("type"),
        F.when(number.try_cast("int") < 70, "Successful").otherwise("Unsuccessful").alias("outcome_type"),
        F.when(F.hour(ts) < 12, 1).otherwise(2).alias("period"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute"), F.second(ts).alias("second"),
        (value % 100).alias("x"), number.try_cast("double").alias("y"), (value * 7 % 100).alias("end_x"), (value * 3 % 100).alias("end_y"),
        shot.alias("is_shot"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 == 0).alias("is_goal"),
        F.when(shot, lookup((F.col("event_id") % 3).cast("int"), FORMATIONS)).alias("tactics_formation"),
    )


def teams(events: DataFrame) -> DataFrame:
    return events.select("game_id", "team").distinct()


def roster(events: DataFrame) -> DataFrame:
    """game_id, player_id, position, is_starter; every third player is missing from it."""
    seen = events.where("player_id % 3 <> 0").select("game_id", "player_id").distinct()
    position = lookup((F.col("player_id") % 7).cast("int"), ROLES)
    return seen.withColumns({"position": position, "is_starter": F.when(F.col("player_id") % 11 != 0, position != "Sub")})


def lineup(events: DataFrame) -> DataFrame:
    """tactics_id, player_id, position for every announced formation and the team's eleven most used players of that game."""
    from matchweave.operators.network import most_minutes

    formations = events.where("tactics_formation is not null").select("game_id", "team", F.col("seq").alias("tactics_id"))
    players = most_minutes(events, 11).select("game_id", "team", "player_id")
    position = lookup(((F.col("player_id") * 7 + F.col("tactics_id")) % 25 + 1).cast("int"), POSITIONS)
    return formations.join(players, ["game_id", "team"]).select("tactics_id", "player_id", position.alias("position"))


def filled_events(events: DataFrame) -> DataFrame:
    from matchweave.operators.network import fill_formation
    from matchweave.operators.sequence import next_value

    with_id = events.withColumns({"id": F.col("seq"), "tactics_id": F.lit(None).cast("bigint")})
    return next_value(fill_formation(with_id), "player_id", ["game_id", "team"], ["seq"], "recipient")


def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides per order year-month: wide stats of urgent and other orders, as a team-match table.

    Customers are counted beside the other stats: counted with them, Spark would first add
    up prices by customer. Prices of a file that is read in one piece are added in its order, as the SQL does.
    """
    o = table(spark, sf_dir, "orders")
    side = F.when(F.col("o_orderkey") % 2 == 0, "H").otherwise("A")
    o = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("game"), side.alias("side"), F.col("o_totalprice").cast("double").alias("price"), "o_custkey", "o_orderstatus")
    sums = o.groupBy("game", "side").agg(F.count("*").alias("orders"), F.sum("price").alias("price"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    buyers = o.groupBy(F.col("game").alias("_game"), F.col("side").alias("_side")).agg(F.countDistinct("o_custkey").alias("customers"))
    same = F.col("game").eqNullSafe(F.col("_game")) & (F.col("side") == F.col("_side"))
    return sums.join(buyers, same).select("game", "side", "orders", "price", "customers", "finished")


def player_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Five stat tables on (league, team, player), from customers, orders and line items."""
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("league"), F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("pos"), F.col("c_acctbal").cast("double").alias("balance"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("player"), F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("extended"), F.col("l_discount").cast("double").alias("discount"))
    key = ["league", "team", "player"]
    sold = o.groupBy("player").agg(F.count("*").alias("orders"), F.sum("price").alias("value"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    items = o.select("o_orderkey", "player").join(line, "o_orderkey").groupBy("player").agg(F.count("*").alias("lines"), F.sum("quantity").alias("value"), F.avg("discount").alias("discount Pct"), F.max("extended").alias("largest"))
    standard = c.select(*key, "pos", "balance", (F.col("player") % 40 / 2.0).alias("90s"))
    first = c.select(*key).join(sold, "player").select(*key, "orders", "value", "done")
    second = c.select(*key).join(items, "player").select(*key, "lines", "value", "discount Pct", "largest")
    third = c.select(*key, (F.col("balance") * 2).alias("value"), (F.col("player") % 13).alias("cards"))
    fourth = c.select(*key, (F.col("player") % 17 * 1.0).alias("saves"), (F.col("player") % 2000 + 1990).alias("born"))
    return [standard, first, second, third, fourth]
