"""Named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchweave.functions import columns, geometry
from matchweave.operators import compare, network, sequence, shots, similarity
from matchweave.operators.joins import join_chain, stack
from matchweave.plans import adapter
from matchweave.schemas import table_schema
from matchweave.sources import files, nested, quarantine
from matchweave.sources.scratch import Scratch

TEAM = "NATION_7"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_EVENTS = """
ev AS (SELECT cast(strftime(ts, '%Y%m%d') AS bigint) * 8 + user_id // 2 % 8 AS game_id, event_id AS seq, user_id AS player_id,
  CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS team,
  CASE event_type WHEN 'purchase' THEN 'Pass' WHEN 'click' THEN 'TakeOn' WHEN 'view' THEN 'BallTouch' WHEN 'signup' THEN 'Shot' WHEN 'error' THEN 'Foul' END AS type,
  CASE WHEN cast(regexp_extract(props, '([0-9]+)', 1) AS int) < 70 THEN 'Successful' ELSE 'Unsuccessful' END AS outcome_type,
  CASE WHEN extract(hour from ts) < 12 THEN 1 ELSE 2 END AS period,
  cast(extract(hour from ts) * 60 + extract(minute from ts) AS int) AS minute, cast(floor(extract(second from ts)) AS int) AS second,
  value % 100 AS x, cast(regexp_extract(props, '([0-9]+)', 1) AS double) AS y, value * 7 % 100 AS end_x, value * 3 % 100 AS end_y,
  event_type = 'signup' AS is_shot, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 = 0 END AS is_goal,
  CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN '433' WHEN 1 THEN '442' ELSE '352' END END AS tactics_formation
 FROM events),
"""
_PASSES = _EVENTS + """
ok AS (SELECT *, lead(player_id) OVER (PARTITION BY game_id, team ORDER BY seq) AS receiver,
  abs(degrees(atan2((end_y - y) * 0.8e0, (end_x - x) * 1.2e0))) AS off, x * 1.2e0 AS px, y * 0.8e0 AS py
 FROM ev WHERE type = 'Pass' AND outcome_type = 'Successful'),
edge AS (SELECT game_id, team, least(player_id, receiver) AS pos_min, greatest(player_id, receiver) AS pos_max, count(*) AS pass_count FROM ok GROUP BY 1, 2, 3, 4),
loc AS (SELECT game_id, team, player_id, median(px) AS x, median(py) AS y, count(player_id) AS passes FROM ok GROUP BY 1, 2, 3),
"""
_NODES = _PASSES + """
roster AS (SELECT DISTINCT game_id, player_id, CASE player_id % 7 WHEN 0 THEN 'DC' WHEN 1 THEN 'MC' WHEN 2 THEN 'AMC' WHEN 3 THEN 'FW' WHEN 4 THEN 'FWL' WHEN 5 THEN 'GK' ELSE 'Sub' END AS position,
  CASE WHEN player_id % 11 <> 0 THEN player_id % 7 <> 6 END AS is_starter FROM ev WHERE player_id % 3 <> 0),
seen AS (SELECT t.game_id, t.team, r.player_id, r.position, r.is_starter FROM (SELECT DISTINCT game_id, team FROM ev) t JOIN roster r ON t.game_id = r.game_id),
node AS (SELECT coalesce(l.game_id, s.game_id) AS game_id, coalesce(l.team, s.team) AS team, coalesce(l.player_id, s.player_id) AS player_id, l.x, l.y, l.passes, s.position, s.is_starter
 FROM loc l FULL OUTER JOIN seen s ON l.game_id = s.game_id AND l.team = s.team AND l.player_id = s.player_id),
"""
_DIRECTED = _EVENTS + """
half AS (SELECT *, lead(player_id) OVER (PARTITION BY game_id, team ORDER BY seq) AS recipient FROM ev WHERE period = 1),
pr AS (SELECT game_id, team, player_id, recipient, cast(player_id AS varchar) || cast(recipient AS varchar) AS pair, count(seq) AS number_pass
 FROM half WHERE type = 'Pass' AND recipient IS NOT NULL GROUP BY 1, 2, 3, 4),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, team ORDER BY minutes_played DESC, player_id) AS place
  FROM (SELECT game_id, team, player_id, max(minute) - min(minute) AS minutes_played FROM half GROUP BY 1, 2, 3)) WHERE place <= 11),
"""
_CODES = "CASE (player_id * 7 + tactics_id) % 25 + 1 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in adapter.POSITIONS.items()) + " END"
_FILLED = _EVENTS + f"""
fill AS (SELECT game_id, seq, player_id, team, type, outcome_type, x, y,
  last_value(CASE WHEN tactics_formation IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS tactics_id, last_value(tactics_formation IGNORE NULLS) OVER w AS tactics_formation,
  lead(player_id) OVER (PARTITION BY game_id, team ORDER BY seq) AS recipient
 FROM ev WINDOW w AS (PARTITION BY game_id, team ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
used AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, team ORDER BY minutes DESC, player_id) AS place
  FROM (SELECT game_id, team, player_id, max(minute) - min(minute) AS minutes FROM ev GROUP BY 1, 2, 3)) WHERE place <= 11),
lineup AS (SELECT tactics_id, player_id, {_CODES} AS position FROM
 (SELECT f.seq AS tactics_id, p.player_id FROM ev f JOIN used p ON f.game_id = p.game_id AND f.team = p.team WHERE f.tactics_formation IS NOT NULL)),
"""
_RESPONSE = _EVENTS + """
nx AS (SELECT *, lead(player_id) OVER (PARTITION BY game_id ORDER BY seq) AS receiver FROM ev),
both_ AS (SELECT *, 0 AS branch FROM nx WHERE receiver = 14 AND outcome_type = 'Successful' AND team = 'A' UNION ALL SELECT *, 1 AS branch FROM nx WHERE player_id = 14),
aft AS (SELECT *, lead(seq) OVER w AS n_seq, lead(player_id) OVER w AS n_player, lead(type) OVER w AS n_type, lead(outcome_type) OVER w AS n_outcome, lead(minute * 60 + second) OVER w AS n_clock
 FROM both_ WINDOW w AS (PARTITION BY game_id ORDER BY minute, second, branch, seq)),
resp AS (SELECT game_id, n_seq AS seq, n_outcome AS outcome_type, n_clock - (minute * 60 + second) AS seconds FROM aft
 WHERE player_id IS DISTINCT FROM 14 AND n_player = 14 AND n_type IN ('Pass', 'TakeOn', 'BallTouch', 'Clearance')),
"""
_STATS = """
st AS (SELECT strftime(o_orderdate, '%Y-%m') AS game, CASE WHEN o_orderkey % 2 = 0 THEN 'H' ELSE 'A' END AS side, count(*) AS orders, sum(o_totalprice) AS price,
  count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1, 2),
lg AS (SELECT game, side, 'orders' AS category, cast(orders AS double) AS value FROM st UNION ALL SELECT game, side, 'price', price FROM st
 UNION ALL SELECT game, side, 'customers', cast(customers AS double) FROM st UNION ALL SELECT game, side, 'finished', cast(finished AS double) FROM st),
cmp AS (SELECT game, category, max(CASE WHEN side = 'H' THEN value END) AS a, max(CASE WHEN side = 'A' THEN value END) AS b FROM lg GROUP BY 1, 2),
shr AS (SELECT game, category, a, b, a / CASE WHEN a + b = 0 THEN 1 ELSE a + b END AS share_a, b / CASE WHEN a + b = 0 THEN 1 ELSE a + b END AS share_b FROM cmp),
"""
_WIDE = """
sold AS (SELECT o_custkey AS player, count(*) AS orders, sum(o_totalprice) AS value, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1),
items AS (SELECT o_custkey AS player, count(*) AS lines, sum(l_quantity) AS value, avg(l_discount) AS disc, max(l_extendedprice) AS largest FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
wide AS (SELECT c_nationkey % 5 AS league, c_nationkey AS team, c_custkey AS player, c_mktsegment AS pos, c_acctbal AS balance, c_custkey % 40 / 2.0e0 AS nineties,
  s.orders, s.value, s.done, i.lines, i.value AS value_items, i.disc, i.largest, c_acctbal * 2 AS value_balance, c_custkey % 13 AS cards, c_custkey % 17 * 1.0e0 AS saves, c_custkey % 2000 + 1990 AS born
 FROM customer JOIN sold s ON s.player = c_custkey JOIN items i ON i.player = c_custkey),
"""
_R90 = lambda c: f"round(coalesce({c} / nullif(nineties, 0), 0), 6) AS {c}"


def _query(sql: str | None = None, ctes: str = ""):
    """Register a function under its name, with its SQL twin."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (f"WITH {ctes.strip().rstrip(',')} " if ctes else "") + sql
        return f

    return add


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Round to 6 places, so that the order of additions doesn't show."""
    return df.withColumns({n: F.round(n, 6) for n in names})


@_query("SELECT * FROM edge", _PASSES)
def pass_network(spark, d):
    return network.edges(network.successful_passes(adapter.match_events(spark, d)))


@_query(
    "SELECT e.game_id, e.team, e.pos_min, e.pos_max, e.pass_count, round(a.x, 6) AS x, round(a.y, 6) AS y, round(b.x, 6) AS x_end, round(b.y, 6) AS y_end, "
    "round(e.pass_count / max(e.pass_count) OVER (PARTITION BY e.game_id, e.team) * 15e0, 6) AS width, round(0.3e0 + e.pass_count / max(e.pass_count) OVER (PARTITION BY e.game_id, e.team) * 0.6e0, 6) AS alpha "
    "FROM edge e JOIN loc a ON a.game_id = e.game_id AND a.team = e.team AND a.player_id = e.pos_min JOIN loc b ON b.game_id = e.game_id AND b.team = e.team AND b.player_id = e.pos_max",
    _PASSES,
)
def pass_network_drawable(spark, d):
    passes = network.successful_passes(adapter.match_events(spark, d))
    return _r(network.drawable(network.edges(passes), network.locations(passes)), "x", "y", "x_end", "y_end", "width", "alpha")


def _nodes(spark, d):
    events = adapter.match_events(spark, d)
    return network.with_roster(network.locations(network.successful_passes(events)), adapter.roster(events), adapter.teams(events))


@_query("SELECT game_id, team, player_id, round(x, 6) AS x, round(y, 6) AS y, passes, position, is_starter, CASE WHEN coalesce(is_starter, true) THEN 'o' ELSE 's' END AS marker FROM node", _NODES)
def player_locations(spark, d):
    return network.with_markers(_r(_nodes(spark, d), "x", "y"))


_LINES = (
    "SELECT game_id, team, CASE WHEN count(*) FILTER (WHERE position = 'DC') > 0 THEN median(CASE WHEN position = 'DC' THEN x END) ELSE 30.0e0 END AS defense, "
    "CASE WHEN count(*) FILTER (WHERE position IN ('FW', 'AMC')) > 0 THEN avg(CASE WHEN position IN ('FW', 'AMC') THEN x END) ELSE 90.0e0 END AS forward, median(x) AS team_median FROM node GROUP BY 1, 2"
)


@_query(f"SELECT game_id, team, round(defense, 6) AS defense, round(forward, 6) AS forward, round(team_median, 6) AS team_median, round(least(defense, forward), 6) AS band_low, round(greatest(defense, forward), 6) AS band_high FROM ({_LINES})", _NODES)
def team_metrics(spark, d):
    return _r(network.team_lines(_nodes(spark, d)), "defense", "forward", "team_median", "band_low", "band_high")


@_query("SELECT game_id, team, round_even((1 - median(CASE WHEN off BETWEEN 0 AND 90 THEN off END) / 90) * 100, 2) AS verticality FROM ok GROUP BY 1, 2", _PASSES)
def verticality(spark, d):
    return network.verticality(network.successful_passes(adapter.match_events(spark, d)))


def _half(spark, d):
    first = adapter.match_events(spark, d).where("period = 1")
    return sequence.next_value(first, "player_id", ["game_id", "team"], ["seq"], "recipient")


@_query("SELECT * FROM pr", _DIRECTED)
def directed_passes(spark, d):
    return network.directed_pairs(_half(spark, d).where("type = 'Pass'"))


@_query("SELECT * FROM top", _DIRECTED)
def top_players(spark, d):
    return network.most_minutes(_half(spark, d), 11)


@_query(
    "SELECT game_id, team, player_id, recipient, pair, number_pass, round(x, 6) AS x, round(y, 6) AS y, round(x_end, 6) AS x_end, round(y_end, 6) AS y_end, round(width, 6) AS width, round(width + 0.5e0, 6) AS line_width, round(width * 0.9e0 + 0.1e0, 6) AS alpha FROM ("
    "SELECT p.*, a.x, a.y, b.x AS x_end, b.y AS y_end, p.number_pass / max(p.number_pass) OVER (PARTITION BY p.game_id, p.team) AS width FROM pr p "
    "JOIN avgloc a ON a.game_id = p.game_id AND a.team = p.team AND a.player_id = p.player_id JOIN avgloc b ON b.game_id = p.game_id AND b.team = p.team AND b.player_id = p.recipient "
    "SEMI JOIN top t ON t.game_id = p.game_id AND t.team = p.team AND t.player_id = p.player_id SEMI JOIN top u ON u.game_id = p.game_id AND u.team = p.team AND u.player_id = p.recipient)",
    _DIRECTED + "avgloc AS (SELECT game_id, team, player_id, avg(x) AS x, avg(y) AS y FROM half WHERE type = 'Pass' GROUP BY 1, 2, 3),",
)
def directed_network(spark, d):
    return _r(network.directed_network(_half(spark, d), 11), "x", "y", "x_end", "y_end", "width", "line_width", "alpha")


@_query("SELECT game_id, team, seq, player_id, tactics_id, tactics_formation FROM fill", _FILLED)
def formation_fill(spark, d):
    return adapter.filled_events(adapter.match_events(spark, d)).select("game_id", "team", "seq", "player_id", "tactics_id", "tactics_formation")


@_query(
    "SELECT e.game_id, e.team, e.pos_min, e.pos_max, e.pass_count, round(a.x, 6) AS x, round(a.y, 6) AS y, a.n AS count, round(b.x, 6) AS x_end, round(b.y, 6) AS y_end, b.n AS count_end, "
    "round(e.pass_count / max(e.pass_count) OVER w * 18e0, 6) AS width, round(e.pass_count / max(e.pass_count) OVER w * 0.7e0 + 0.3e0, 6) AS alpha, round(a.n / max(a.n) OVER w * 3000e0, 6) AS marker_size "
    "FROM pe e JOIN pl a ON a.game_id = e.game_id AND a.team = e.team AND a.position = e.pos_min JOIN pl b ON b.game_id = e.game_id AND b.team = e.team AND b.position = e.pos_max WINDOW w AS (PARTITION BY e.game_id, e.team)",
    _FILLED + """
pos AS (SELECT f.*, l.position, m.position AS position_receipt FROM fill f LEFT JOIN lineup l ON l.tactics_id = f.tactics_id AND l.player_id = f.player_id
 LEFT JOIN lineup m ON m.tactics_id = f.tactics_id AND m.player_id = f.recipient WHERE f.tactics_formation = '433'),
pe AS (SELECT game_id, team, least(position, position_receipt) AS pos_min, greatest(position, position_receipt) AS pos_max, count(seq) AS pass_count FROM pos
 WHERE type = 'Pass' AND position IS NOT NULL AND position_receipt IS NOT NULL GROUP BY 1, 2, 3, 4),
pl AS (SELECT game_id, team, position, avg(x) AS x, avg(y) AS y, count(y) AS n FROM pos WHERE type IN ('Pass', 'BallTouch') AND position IS NOT NULL GROUP BY 1, 2, 3),""",
)
def formation_network(spark, d):
    events = adapter.match_events(spark, d)
    return _r(network.formation_network(adapter.filled_events(events), adapter.lineup(events), "433"), "x", "y", "x_end", "y_end", "width", "alpha", "marker_size")


@_query("SELECT game_id, team, array_to_string(list_sort(list(DISTINCT tactics_formation) FILTER (WHERE tactics_formation IS NOT NULL)), ',') AS formations FROM fill GROUP BY 1, 2", _FILLED)
def formations_by_team(spark, d):
    found = network.formations_by_team(adapter.filled_events(adapter.match_events(spark, d)))
    return found.withColumn("formations", F.when(F.size("formations") > 0, F.array_join("formations", ",")))


@_query(
    "SELECT tactics_id, player_id, position FROM lineup UNION ALL SELECT s.tactics_id, s.replacement_id AS player_id, l.position FROM sub s JOIN lineup l ON l.tactics_id = s.tactics_id AND l.player_id = s.player_id",
    _FILLED + "sub AS (SELECT tactics_id, player_id, min(recipient) AS replacement_id FROM fill WHERE type = 'Foul' AND tactics_id IS NOT NULL AND recipient IS NOT NULL GROUP BY 1, 2),",
)
def substitute_positions(spark, d):
    events = adapter.match_events(spark, d)
    came = adapter.filled_events(events).where("type = 'Foul' and tactics_id is not null and recipient is not null").groupBy("tactics_id", "player_id").agg(F.min("recipient").alias("replacement_id"))
    return network.with_substitutes(adapter.lineup(events), came)


def _responses(spark, d):
    return sequence.responses(adapter.match_events(spark, d), F.lit(14), F.col("team") == "A", ["Pass", "TakeOn", "BallTouch", "Clearance"])


@_query("SELECT * FROM resp", _RESPONSE)
def response_actions(spark, d):
    return _responses(spark, d)


@_query("SELECT round(avg(share), 6) AS mean_accuracy, round(var_samp(share), 6) AS variance FROM (SELECT game_id, avg(CASE WHEN outcome_type = 'Unsuccessful' THEN 0.0e0 ELSE 1.0e0 END) AS share FROM resp GROUP BY 1)", _RESPONSE)
def response_accuracy(spark, d):
    return _r(sequence.response_accuracy(_responses(spark, d)), "mean_accuracy", "variance")


_SHOTS = "sh AS (SELECT e.*, n.home, n.away, e.team = n.home AS own FROM ev e JOIN (SELECT game_id, min(team) AS home, max(team) AS away FROM ev GROUP BY 1) n ON n.game_id = e.game_id WHERE is_shot),"


@_query(
    "SELECT game_id, seq, player_id, team, CASE WHEN own THEN 'home' ELSE 'away' END AS side, CASE WHEN is_goal IS DISTINCT FROM true THEN 'no goal' ELSE 'goal' END AS result, "
    "round(CASE WHEN own THEN 120 - x * 1.2e0 ELSE x * 1.2e0 END, 6) AS draw_x, round(CASE WHEN own THEN 80 - y * 0.8e0 ELSE y * 0.8e0 END, 6) AS draw_y FROM sh",
    _EVENTS + _SHOTS,
)
def shot_split(spark, d):
    return _r(shots.shot_split(adapter.match_events(spark, d)).select("game_id", "seq", "player_id", "team", "side", "result", "draw_x", "draw_y"), "draw_x", "draw_y")


@_query("SELECT seq, round(120 - x * 1.2e0, 6) AS mirror_x, round(80 - y * 0.8e0, 6) AS mirror_y, round(x * 1.2e0, 6) AS scaled_x, round(y * 0.8e0, 6) AS scaled_y FROM ev WHERE is_shot", _EVENTS)
def shot_mirror(spark, d):
    x, y = F.col("x"), F.col("y")
    df = adapter.match_events(spark, d).where("is_shot")
    return _r(df.select("seq", geometry.mirror_x(x).alias("mirror_x"), geometry.mirror_y(y).alias("mirror_y"), geometry.scale_x(x).alias("scaled_x"), geometry.scale_y(y).alias("scaled_y")), "mirror_x", "mirror_y", "scaled_x", "scaled_y")


@_query("SELECT game_id, min(team) AS home, max(team) AS away FROM ev GROUP BY 1", _EVENTS)
def team_names(spark, d):
    return shots.team_names(adapter.match_events(spark, d))


@_query("SELECT vec_id, round(cast(embedding[1] AS double), 6) AS x, round(cast(embedding[2] AS double), 6) AS y, round(abs(cast(embedding[1] AS double)) * 300 + 100, 4) AS size FROM embeddings")
def marker_size(spark, d):
    df = shots.split_location(adapter.table(spark, d, "embeddings"), "embedding")
    size = geometry.marker_size(F.abs(F.col("x").cast("double")))
    return df.select("vec_id", F.round(F.col("x").cast("double"), 6).alias("x"), F.round(F.col("y").cast("double"), 6).alias("y"), F.round(size, 4).alias("size"))


@_query("SELECT game_id, team, player_id, outcome_type, count(*) AS actions, min(seq) AS first_seq, max(seq) AS last_seq FROM ev WHERE outcome_type IN ('Successful', 'Unsuccessful') GROUP BY 1, 2, 3, 4", _EVENTS)
def player_outcomes(spark, d):
    return network.outcome_split(adapter.match_events(spark, d))


def _long_stats(spark, d):
    return compare.unpivot(adapter.order_stats(spark, d), ["game", "side"], ["orders", "price", "customers", "finished"])


@_query("SELECT game, side, category, round(value, 4) AS value FROM lg", _STATS)
def stat_unpivot(spark, d):
    return _long_stats(spark, d).withColumn("value", F.round("value", 4))


@_query("SELECT game, category, round(a, 4) AS a, round(b, 4) AS b, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b FROM shr", _STATS)
def stat_compare(spark, d):
    found = _r(compare.shares(_long_stats(spark, d), ["game"], "side", "H", "A"), "share_a", "share_b")
    return found.withColumns({"a": F.round("a", 4), "b": F.round("b", 4)})


@_query("SELECT game, category, round(share_a * 20, 6) AS bar_a, round(share_b * 20, 6) AS bar_b, round(share_a * 20, 6) AS start_b FROM shr", _STATS)
def bar_track(spark, d):
    found = compare.bar_track(compare.shares(_long_stats(spark, d), ["game"], "side", "H", "A"))
    return _r(found.select("game", "category", "bar_a", "bar_b", "start_b"), "bar_a", "bar_b", "start_b")


@_query("SELECT game, side, category, round(sum(value) OVER (PARTITION BY game, side ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM lg", _STATS)
def stat_cumulative(spark, d):
    return compare.running_total(_long_stats(spark, d), ["game", "side"], ["category"]).select("game", "side", "category", F.round("running", 4).alias("running"))


@_query("SELECT o_custkey, o_orderkey, cast(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 2) AS bigint) AS pair FROM orders")
def pair_number(spark, d):
    return sequence.pair_number(adapter.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], ["o_custkey"])


@_query(
    f"SELECT game_id, home_team, away_team FROM sch WHERE home_team = '{TEAM}' UNION ALL SELECT game_id, home_team, away_team FROM sch WHERE away_team = '{TEAM}'",
    "sch AS (SELECT o_orderkey AS game_id, h.n_name AS home_team, a.n_name AS away_team FROM orders JOIN nation h ON h.n_nationkey = o_orderkey % 25 JOIN nation a ON a.n_nationkey = o_custkey % 25 WHERE o_orderkey % 25 <> o_custkey % 25)",
)
def schedule_team(spark, d):
    o, n = adapter.table(spark, d, "orders"), adapter.table(spark, d, "nation")
    home, away = n.select(F.col("n_nationkey").alias("h"), F.col("n_name").alias("home_team")), n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("away_team"))
    games = o.select(F.col("o_orderkey").alias("game_id"), (F.col("o_orderkey") % 25).alias("h"), (F.col("o_custkey") % 25).alias("a")).where("h <> a")
    return files.team_games(games.join(home, "h").join(away, "a").select("game_id", "home_team", "away_team"), TEAM)


def _wide(spark, d):
    first, *rest = adapter.player_tables(spark, d)
    return join_chain(first, list(zip(rest, ["_sold", "_items", "_balance", "_keeper"], strict=True)), ["league", "team", "player"])


@_query(
    "SELECT league, team, player, pos, round(balance, 6) AS balance, nineties AS \"90s\", orders, round(value, 4) AS value, done, lines, round(value_items, 4) AS value_items, round(disc, 6) AS \"discount Pct\", round(largest, 6) AS largest, "
    "round(value_balance, 6) AS value_balance, cards, saves, born FROM wide",
    _WIDE,
)
def wide_join(spark, d):
    df = _r(_wide(spark, d), "balance", "discount Pct", "largest", "value_balance")
    return df.withColumns({"value": F.round("value", 4), "value_items": F.round("value_items", 4)})


def _rates(spark, d):
    return similarity.per_90(similarity.chosen_players(_wide(spark, d), "MA", 1997), "90s", ["league", "team", "player", "born"])


_MEASURES = ["balance", "orders", "value", "done", "lines", "value_items", "largest", "value_balance", "cards", "saves"]


@_query(f"SELECT player, nineties AS \"90s\", round(disc, 6) AS \"discount Pct\", {', '.join(_R90(c) for c in _MEASURES)} FROM wide WHERE pos LIKE '%MA%' AND born >= 1997", _WIDE)
def per90(spark, d):
    return _r(_rates(spark, d).select("player", "90s", "discount Pct", *_MEASURES), "discount Pct", *_MEASURES)


@_query(
    f"SELECT player, {', '.join(f'round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 5) AS {c}' for c in _MEASURES)} "
    f"FROM (SELECT player, {', '.join(f'coalesce({c} / nullif(nineties, 0), 0) AS {c}' for c in _MEASURES)} FROM wide WHERE pos LIKE '%MA%' AND born >= 1997)",
    _WIDE,
)
def zscore(spark, d):
    df = similarity.standardise(_rates(spark, d).select("player", *_MEASURES), _MEASURES)
    return df.select("player", *[F.round(c, 5).alias(c) for c in _MEASURES])


@_query("SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_type LIKE '%PROMO%' AND p_size >= 10")
def string_filter(spark, d):
    df = adapter.table(spark, d, "part").where(F.col("p_type").contains("PROMO") & (F.col("p_size") >= 10))
    return _r(df.select("p_partkey", *[c for c in columns.numeric_columns(df) if c != "p_partkey"]), "p_retailprice")


@_query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem")
def dtype_select(spark, d):
    df = columns.without_matching(adapter.table(spark, d, "lineitem"), r"^l_(tax|disc).*")
    return df.select(*columns.float_and_long_columns(df))


def _scaled_features(spark, d):
    names = [f"f{i}" for i in range(64)]
    base = adapter.table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return similarity.assemble(similarity.standardise(base, names), names)


@_query()
def pca_ratio(spark, d):
    """Explained shares of all principal components of standardised vectors."""
    return spark.createDataFrame(similarity.explained(_scaled_features(spark, d), 64), "component int, share double, running double")


@_query(
    "SELECT vec_id, round(1 - list_cosine_similarity(cast(embedding AS double[]), cast((SELECT embedding FROM embeddings WHERE vec_id = 7) AS double[])), 6) AS distance FROM embeddings WHERE vec_id <> 7 "
    "ORDER BY 1 - list_cosine_similarity(cast(embedding AS double[]), cast((SELECT embedding FROM embeddings WHERE vec_id = 7) AS double[])), vec_id LIMIT 9"
)
def knn_cosine(spark, d):
    return similarity.nearest(adapter.table(spark, d, "embeddings"), 7, 9).withColumn("distance", F.round("distance", 6))


@_query()
def pca_neighbours(spark, d):
    """Nine neighbours of vector 7 among the first 23 principal components of standardised vectors."""
    scaled = _scaled_features(spark, d)
    return similarity.nearest(similarity.project(scaled, similarity.fit_pca(scaled, 23)), 7, 9, vector="components")


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    """Nations written one folder per region and read back in one scan, the region from each file's path."""
    path = _scratch(spark)
    files.write_per_key(adapter.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "n_regionkey")
    back = files.with_file_key(files.read_csv(spark, f"{path}/*", table_schema("n_nationkey int, n_name string")), r"n_regionkey=(\d+)", "region")
    return back.select("n_nationkey", "n_name", F.col("region").cast("int").alias("n_regionkey"))


@_query("SELECT cast(row_number() OVER (ORDER BY s_suppkey) - 1 AS int) AS row, s_suppkey, s_name FROM supplier")
def csv_with_index(spark, d):
    path = _scratch(spark)
    files.write_csv(adapter.table(spark, d, "supplier").select("s_suppkey", "s_name"), path, index_by=["s_suppkey"])
    return files.read_csv(spark, path, table_schema("row int, s_suppkey bigint, s_name string"))


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey >= 23)")
def good_files(spark, d):
    """Nations in files by region; a file with a nation of number 23 or more is left out whole."""
    path = _scratch(spark)
    files.write_per_key(adapter.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "n_regionkey")
    return files.good_files(files.read_csv(spark, f"{path}/*", table_schema("n_nationkey int, n_name string")), [F.col("n_nationkey") < 23])


def _month_files(spark, d, lines, header):
    """A folder of text files, one a month of orders: the month's ``header`` and then its ``lines``, by order key."""
    path = _scratch(spark)
    o = adapter.table(spark, d, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), "o_orderkey", "o_custkey", "o_orderstatus")
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("m").orderBy("o_orderkey")) - 1)
    o = o.withColumn("text", F.concat_ws("\n", F.when(F.col("i") == 0, header), lines))
    o.repartition("m").sortWithinPartitions("m", "i").select("m", "text").write.partitionBy("m").text(path)
    return f"{path}/*"


_MONTHS = "o AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY year(o_orderdate) * 12 + month(o_orderdate) ORDER BY o_orderkey) AS i FROM orders),"
_LAYOUT = table_schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string")


@_query("SELECT m, o_orderkey, CASE WHEN m % 5 <> 4 THEN o_custkey END AS o_custkey, o_orderstatus FROM o", _MONTHS)
def csv_by_name(spark, d):
    """Orders in files by month whose headers differ: as declared, turned round, with row numbers, with other columns, with one missing."""
    kind, key, cust, status = F.col("m") % 5, F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    header = F.element_at(F.array(*map(F.lit, ["o_orderkey,o_custkey,o_orderstatus", "o_orderstatus,o_custkey,o_orderkey", ",o_orderkey,o_custkey,o_orderstatus", "note,o_orderkey,x,o_custkey,o_orderstatus", "o_orderstatus,o_orderkey"])), kind + 1)
    row = lambda *c: F.concat_ws(",", *[x.cast("string") for x in c])
    line = F.when(kind == 0, row(key, cust, status)).when(kind == 1, row(status, cust, key)).when(kind == 2, row(F.col("i"), key, cust, status)).when(kind == 3, row(F.lit('"a, b"'), key, F.lit(7), cust, status)).otherwise(row(status, key))
    found = files.read_csv(spark, _month_files(spark, d, line, header), _LAYOUT, file="file")
    return files.with_file_key(found, r"m=(\d+)", "m", "file").select("m", "o_orderkey", "o_custkey", "o_orderstatus")


_DAMAGE = (
    "SELECT m, CASE m % 7 WHEN 1 THEN 'no bigint in o_custkey' WHEN 2 THEN 'truncated' WHEN 3 THEN 'header lacks o_custkey' WHEN 4 THEN 'too many fields' WHEN 5 THEN 'a status' END AS reason, "
    "CASE m % 7 WHEN 1 THEN 2 WHEN 2 THEN count(*) WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN count(*) END AS first_bad_row, "
    "CASE m % 7 WHEN 1 THEN max(CASE WHEN i = 2 THEN o_orderkey || ',c' || o_custkey || ',' || o_orderstatus END) WHEN 2 THEN cast(max(o_orderkey) AS varchar) WHEN 3 THEN 'o_orderkey,cust,o_orderstatus' "
    "WHEN 4 THEN max(CASE WHEN i = 1 THEN o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',1' END) WHEN 5 THEN max_by(o_orderkey || ',' || o_custkey || ',?', i) END AS first_bad_line, "
    "CASE WHEN m % 7 IN (0, 6) THEN count(*) ELSE 0 END AS kept FROM o GROUP BY m HAVING count(*) > 1"
)


@_query(_DAMAGE, _MONTHS)
def quarantine_verdicts(spark, d):
    """Orders in files by month, many of them damaged: each file's verdict and how many of its rows are kept."""
    kind, key, cust, status = F.col("m") % 7, F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    last = F.col("i") == F.count("*").over(Window.partitionBy("m")) - 1
    line = (
        F.when((kind == 1) & (F.col("i") % 5 == 1), F.concat(key, F.lit(",c"), cust, F.lit(","), status)).when((kind == 2) & last, key)
        .when((kind == 4) & (F.col("i") % 3 == 0), F.concat_ws(",", key, cust, status, F.lit("1"))).when((kind == 5) & last, F.concat_ws(",", key, cust, F.lit("?"))).otherwise(F.concat_ws(",", key, cust, status))
    )
    header = F.when(kind == 3, "o_orderkey,cust,o_orderstatus").otherwise("o_orderkey,o_custkey,o_orderstatus")
    good, verdicts = quarantine.checked_scan(spark, _month_files(spark, d, line, header), _LAYOUT, ("o_orderkey", "o_custkey"), {"a status": F.col("o_orderstatus") != "?"}, file="file")
    kept = files.with_file_key(good, r"m=(\d+)", "m", "file").groupBy("m").agg(F.count("*").alias("kept"))
    found = files.with_file_key(verdicts.where("n_rows <> 1"), r"m=(\d+)", "m", "file").join(kept, "m", "left")
    return found.select("m", "reason", "first_bad_row", "first_bad_line", F.coalesce("kept", F.lit(0)).alias("kept"))


@_query(
    "SELECT 'events' AS part, game_id AS game, 'e' || seq AS event_id, 0 AS place, type AS ref, NULL AS known FROM n "
    "UNION ALL SELECT 'related', game_id, 'e' || seq, 0, 'e' || nxt, true FROM n WHERE nxt IS NOT NULL UNION ALL SELECT 'related', game_id, 'e' || seq, CASE WHEN nxt IS NULL THEN 0 ELSE 1 END, 'gone', false FROM n WHERE seq % 50 = 0 "
    "UNION ALL SELECT 'freeze_frames', game_id, 'e' || seq, k, cast(player_id + k AS varchar), k % 2 = 0 FROM n, (SELECT unnest(range(3)) AS k) WHERE is_shot "
    "UNION ALL SELECT 'players', game_id, 'e' || seq, k, cast(player_id + k AS varchar), NULL FROM n, (SELECT unnest(range(11)) AS k) WHERE tactics_formation IS NOT NULL",
    _EVENTS + "n AS (SELECT *, lead(seq) OVER (PARTITION BY game_id ORDER BY seq) AS nxt FROM ev),",
)
def nested_split(spark, d):
    """Events written as nested JSON (related events, freeze frames of shots, line-ups of formations) and split into linked tables, all stacked."""
    ev = sequence.next_value(adapter.match_events(spark, d), "seq", ["game_id"], ["seq"], "nxt")
    player = lambda k: F.struct((F.col("player_id") + k).alias("id"), F.lit("p").alias("name"))
    frame = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.array("x", "y").alias("location"), player(k).alias("player"), (k % 2 == 0).alias("teammate")))
    squad = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct(player(k).alias("player"), (k + 1).alias("jersey_number")))
    name = F.concat(F.lit("e"), F.col("seq"))
    related = F.array_compact(F.array(F.concat(F.lit("e"), F.col("nxt")), F.when(F.col("seq") % 50 == 0, "gone")))
    records = ev.select(
        "game_id", name.alias("id"), F.col("seq").alias("index"), F.struct(F.col("type").alias("name")).alias("type"), related.alias("related_events"),
        F.when(F.col("is_shot"), F.struct(frame.alias("freeze_frame"))).alias("shot"), F.when(F.col("tactics_formation").isNotNull(), F.struct(F.col("tactics_formation").cast("bigint").alias("formation"), squad.alias("lineup"))).alias("tactics"),
    )
    path = _scratch(spark)
    files.write_json(records, path)
    parts = nested.split_events(spark.read.schema(f"game_id bigint, {nested.NESTED_EVENT}").json(path), F.col("game_id"))
    none = F.lit(None).cast("boolean")
    shown = {
        "events": (F.lit(0), F.col("type_name"), none), "related": (F.col("place"), F.col("related_id"), F.col("related_known")),
        "freeze_frames": (F.col("place"), F.col("player_id").cast("string"), F.col("teammate")), "players": (F.col("place"), F.col("player_id").cast("string"), none),
    }
    rows = [parts[p].select(F.lit(p).alias("part"), F.col("game").cast("bigint").alias("game"), "event_id", place.alias("place"), ref.alias("ref"), known.alias("known")) for p, (place, ref, known) in shown.items()]
    return functools.reduce(DataFrame.unionByName, rows)


@_query("SELECT seq, player_id, type, outcome_type, game_id FROM ev WHERE game_id % 5 = 3 OR (game_id % 7 = 3 AND game_id % 5 <> game_id % 7)", _EVENTS)
def team_collection(spark, d):
    """The events of one team's games, home and away, exported one folder per game and read back."""
    path, events = _scratch(spark), adapter.match_events(spark, d).select("seq", "player_id", "type", "outcome_type", "game_id")
    named = lambda n: F.concat(F.lit("T"), (F.col("game_id") % n).cast("string"))
    schedule = events.select("game_id").distinct().select("game_id", named(5).alias("home_team"), named(7).alias("away_team"))
    files.collect_team(schedule, events, "T3", path)
    found = files.read_csv(spark, f"{path}/*", table_schema("seq bigint, player_id bigint, type string, outcome_type string"))
    return files.with_file_key(found, r"game_id=(\d+)", "game_id")


@_query("SELECT game, category, CASE category WHEN 'orders' THEN 0 WHEN 'customers' THEN 1 WHEN 'finished' THEN 2 END AS place, printf('%.1f', floor(a)) AS a_label, printf('%.1f', floor(b)) AS b_label FROM cmp", _STATS)
def stat_labels(spark, d):
    found = compare.shares(_long_stats(spark, d), ["game"], "side", "H", "A").withColumns({"a": F.floor("a"), "b": F.floor("b")})
    return compare.labelled(compare.with_ordinal(found, ["orders", "customers", "finished"]), ["a", "b"]).select("game", "category", "place", "a_label", "b_label")


@_query("SELECT game, side, cast(floor(max(value) FILTER (category = 'orders')) AS bigint) || ',' || cast(floor(max(value) FILTER (category = 'customers')) AS bigint) AS row FROM lg GROUP BY 1, 2", _STATS)
def stat_matrix(spark, d):
    found = compare.matrix(_long_stats(spark, d), ["game", "side"], ["orders", "customers"])
    return found.select("game", "side", F.array_join(F.transform("values", lambda v: F.floor(v).cast("string")), ",").alias("row"))


@_query("SELECT p_partkey AS key, p_size, NULL AS s_nationkey FROM part UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def stacked(spark, d):
    part = adapter.table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size")
    return stack(part, adapter.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey"))


@_query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(spark, d):
    path = _scratch(spark)
    df = adapter.table(spark, d, "region").select("r_regionkey", "r_name")
    files.write_json(df, path)
    return files.read_json(spark, path, df.schema)


@_query("SELECT cast(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS bigint) AS row_index, o_totalprice, o_orderkey FROM orders")
def row_index(spark, d):
    return files.with_index(adapter.table(spark, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])


@_query("SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from matchweave.streaming.windows import tumbling_counts

    found = tumbling_counts(adapter.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type")
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@_query("SELECT * FROM resp", _RESPONSE)
def response_pattern(spark, d):
    """``response_actions`` through a declared pattern."""
    return sequence.responses_by_pattern(adapter.match_events(spark, d), F.lit(14), F.col("team") == "A", ["Pass", "TakeOn", "BallTouch", "Clearance"])


@_query(
    "SELECT game_id, pass_seq, won_seq, shot_seq, cast(secs AS double) AS seconds FROM (SELECT a.game_id, a.seq AS pass_seq, b.seq AS won_seq, c.seq AS shot_seq, c.clock - a.clock AS secs, row_number() OVER (PARTITION BY a.game_id, a.i ORDER BY c.i, b.i) AS k "
    "FROM n a JOIN n b ON b.game_id = a.game_id AND b.i - a.i BETWEEN 1 AND 3 JOIN n c ON c.game_id = a.game_id AND c.i - b.i BETWEEN 1 AND 4 "
    "WHERE a.type = 'Pass' AND a.outcome_type = 'Successful' AND b.type IN ('TakeOn', 'BallTouch') AND c.is_shot AND c.clock - a.clock <= 3600) WHERE k = 1",
    _EVENTS + "n AS (SELECT *, minute * 60 + second AS clock, row_number() OVER (PARTITION BY game_id ORDER BY seq) AS i FROM ev),",
)
def attack_pattern(spark, d):
    """Completed pass, take-on or touch at most two events between, shot at most three between, all within an hour."""
    from matchweave.operators.patterns import Step, match_pattern

    done = (F.col("type") == "Pass") & (F.col("outcome_type") == "Successful")
    steps = [Step("pass", done), Step("won", F.col("type").isin("TakeOn", "BallTouch"), 2), Step("shot", F.col("is_shot"), 3)]
    return match_pattern(adapter.match_events(spark, d), steps, ["game_id"], ["seq"], ["seq"], F.col("minute") * 60 + F.col("second"), 3600)


@_query("SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS price, round(median(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1, 2")
def range_medians(spark, d):
    """Medians of four groups that hold all line items, found by counted ranges (as for groups of any size)."""
    from matchweave.operators.ranks import medians

    found = medians(adapter.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"], most=1000)
    return found.select("l_returnflag", "l_linestatus", F.round("l_extendedprice", 6).alias("price"), F.round("l_quantity", 6).alias("quantity"))


@_query(
    "SELECT id, other, round(d, 6) AS distance, place FROM (SELECT *, cast(row_number() OVER (PARTITION BY id ORDER BY d, other) AS int) AS place FROM "
    "(SELECT a.vec_id AS id, b.vec_id AS other, round(1 - list_cosine_similarity(cast(a.embedding AS double[]), cast(b.embedding AS double[])), 12) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE place <= 9"
)
def nearest_all(spark, d):
    """Nine neighbours of every vector."""
    from matchweave.operators.neighbours import nearest_of_all

    return nearest_of_all(adapter.table(spark, d, "embeddings"), 9)[0].withColumn("distance", F.round("distance", 6))


@_query("SELECT game_id, seq, player_id, type FROM ev", _EVENTS)
def game_export(spark, d):
    """All events exported by game in files of at most 50 rows and read back by the manifest."""
    from matchweave.sources.exports import export_keyed, read_export

    path = _scratch(spark)
    export_keyed(adapter.match_events(spark, d).select("game_id", "seq", "player_id", "type"), path, "game_id", ["seq"], rows_per_file=50)
    return read_export(spark, path, "game_id bigint, seq bigint, player_id bigint, type string", "game_id")


@_query("SELECT game_id, CASE WHEN game_id % 3 = 0 THEN 2 ELSE 1 END AS version, team, pos_min, pos_max, pass_count FROM edge", _PASSES)
def kept_networks(spark, d):
    """Edges of every game after three batches: the passes of two halves of the games, some of them torn, and the torn games again; one batch twice."""
    from matchweave.streaming.kept import KeptNetworks

    passes = network.successful_passes(adapter.match_events(spark, d)).select("game_id", "team", "player_id", "receiver", "x", "y", "seq")
    torn = F.col("game_id") % 3 == 0
    first, again = passes.where(~torn | (F.col("seq") % 2 == 0)).withColumn("version", F.lit(1).cast("long")), passes.where(torn).withColumn("version", F.lit(2).cast("long"))
    kept = KeptNetworks(_scratch(spark))
    for number, batch in ((0, first.where("game_id % 2 = 0")), (1, first.where("game_id % 2 = 1")), (2, again), (0, first.where("game_id % 2 = 0"))):
        kept.merge(batch, number)
    return kept.edges(spark)


def _streamed(spark, d, columns, build, mode):
    """What ``build`` makes of the match events as a stream: their files first, then, from the checkpoint, one far later event of no game."""
    from matchweave.streaming.ordered import keyed_state

    path, taken = _scratch(spark), ["game_id", "team", "seq", "ts", *columns]
    stamped = adapter.match_events(spark, d).join(adapter.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts")), "seq").select(*taken)
    last = stamped.groupBy().agg(F.max("ts").alias("ts")).select(*[(F.col("ts") + F.expr("interval 2 days") if c == "ts" else F.lit(-1 if c == "game_id" else None).cast(stamped.schema[c].dataType)).alias(c) for c in taken])
    for landed in (stamped, last):
        landed.write.mode("append").parquet(f"{path}/in")
        with keyed_state(spark):
            rows = build(spark.readStream.schema(stamped.schema).parquet(f"{path}/in"))
            started = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/out/batch={k}")).start()
        started.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch").where("game_id >= 0")


@_query("SELECT game_id, team, seq, player_id, lead(player_id) OVER (PARTITION BY game_id, team ORDER BY seq) AS receiver FROM ev", _EVENTS)
def stream_receivers(spark, d):
    """Each event's next player of its team, found on a stream with keyed state."""
    from matchweave.streaming.ordered import stream_next_value

    return _streamed(spark, d, ["player_id"], lambda s: stream_next_value(s, "player_id", ["game_id", "team"], "ts", "seq", "receiver", idle_seconds=86_400), "append")


@_query("SELECT game_id, team, seq, tactics_id, tactics_formation FROM fill", _FILLED)
def stream_formations(spark, d):
    """The formation in force at each event: the last version of a stream that corrects itself."""
    from matchweave.streaming.ordered import latest, stream_forward_fill

    announced = lambda s: s.withColumn("tactics_id", F.when(F.col("tactics_formation").isNotNull(), F.col("seq")))
    updates = _streamed(spark, d, ["tactics_formation"], lambda s: stream_forward_fill(announced(s), ["tactics_id", "tactics_formation"], ["game_id", "team"], "ts", "seq"), "update")
    return latest(updates, ["game_id", "team", "seq"])


def _scratch(spark: SparkSession) -> str:
    """A new folder of this application in the shared place."""
    return Scratch(spark).path


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
