"""Hand-computed cases of the event, network, comparison and similarity operators."""

import math

import pytest
from pyspark.sql import functions as F

from matchweave.functions import columns, geometry
from matchweave.operators import compare, joins, network, sequence, shots, similarity

EVENT = "game_id int, seq long, team string, player_id long, type string, outcome_type string, x double, y double, end_x double, end_y double"


def passes(spark, players, outcomes=None):
    outcomes = outcomes or ["Successful"] * len(players)
    return spark.createDataFrame([(1, k, "T", p, "Pass", o, 10.0, 10.0, 20.0, 10.0) for k, (p, o) in enumerate(zip(players, outcomes, strict=True))], EVENT)


@pytest.mark.parametrize(("players", "outcomes"), [([10, 20, 10, 10, 30], None), ([10, 99, 20, 10, 10, 30], ["Successful", "Unsuccessful"] + ["Successful"] * 4)])
def test_edges_with_loops_and_filter_before_look_ahead(spark, players, outcomes):
    got = {(r["pos_min"], r["pos_max"]): r["pass_count"] for r in network.edges(network.successful_passes(passes(spark, players, outcomes))).collect()}
    assert got == {(10, 20): 2, (10, 10): 1, (10, 30): 1, (30, 30): 1}


def test_verticality(spark):
    moves = [(10.0, 0.0), (2.0, 3.0), (-1.0, 0.0)]
    df = spark.createDataFrame([(1, k, "T", 5, "Pass", "Successful", 50.0, 50.0, 50 + dx, 50 + dy) for k, (dx, dy) in enumerate(moves)], EVENT)
    angles = [round(r["pass_angle"], 6) for r in network.successful_passes(df).orderBy("seq").collect()]
    assert angles == [0, 45, 180]
    assert network.verticality(network.successful_passes(df)).first()["verticality"] == 75.0


def test_half_even_round(spark):
    assert spark.range(1).select(F.bround(F.lit(0.125), 2)).first()[0] == 0.12


def lines(spark, rows):
    df = spark.createDataFrame([(1, "T", p, x) for p, x in rows], "game_id int, team string, position string, x double")
    return network.team_lines(df).first()


def test_team_lines_and_defaults(spark):
    r = lines(spark, [("DC", 40.0), ("DC", None), ("FW", 80.0), ("FWL", 90.0)])
    assert (r["defense"], r["forward"], r["team_median"]) == (40, 80, 80)
    r = lines(spark, [("MC", 50.0)])
    assert (r["defense"], r["forward"], r["band_low"], r["band_high"]) == (30, 90, 30, 90)
    assert lines(spark, [("DC", None), ("MC", 50.0)])["defense"] is None


def test_roster_of_the_whole_match_joins_each_team(spark):
    places = spark.createDataFrame([(1, "A", 1, 5.0), (1, "B", 2, 6.0)], "game_id int, team string, player_id long, x double")
    roster = spark.createDataFrame([(1, 1, "DC"), (1, 3, "FW")], "game_id int, player_id long, position string")
    got = {(r["team"], r["player_id"]): (r["x"], r["position"]) for r in network.with_roster(places, roster, places.select("game_id", "team")).collect()}
    assert got == {("A", 1): (5, "DC"), ("A", 3): (None, "FW"), ("B", 2): (6, None), ("B", 1): (None, "DC"), ("B", 3): (None, "FW")}


def test_responses(spark):
    rows = [(1, "A", "Pass", "Successful", 10, 0), (2, "X", "Pass", "Unsuccessful", 10, 2), (3, "A", "Pass", "Successful", 10, 10), (4, "X", "Foul", "Successful", 10, 12), (5, "B", "Pass", "Successful", 10, 20), (6, "X", "TakeOn", "Successful", 10, 21)]
    df = spark.createDataFrame([(1, s, "T", p, t, o, m, c) for s, p, t, o, m, c in rows], "game_id int, seq long, team string, player_id string, type string, outcome_type string, minute int, second int")
    got = sequence.responses(df, F.lit("X"), F.col("team") == "T", ["Pass", "TakeOn", "BallTouch", "Clearance"]).orderBy("seq").collect()
    assert [(r["outcome_type"], r["seconds"]) for r in got] == [("Unsuccessful", 2), ("Successful", 1)]


def test_an_event_in_both_branches_stands_twice(spark):
    rows = [(1, "B", "Pass", "Successful"), (2, "X", "Pass", "Successful"), (3, "X", "Shot", "Successful")]
    df = spark.createDataFrame([(1, s, "T", p, t, o, 0, s) for s, p, t, o in rows], "game_id int, seq long, team string, player_id string, type string, outcome_type string, minute int, second int")
    both = sequence.received_and_performed(df, F.lit("X"), F.lit(True))
    assert sorted((r["seq"], r["branch"]) for r in both.collect()) == [(1, 0), (2, 0), (2, 1), (3, 1)]
    assert [(r["seq"], r["seconds"]) for r in sequence.responses(df, F.lit("X"), F.lit(True), ["Pass"]).collect()] == [(2, 1)]
    assert sequence.responses(df, F.lit("Y"), F.lit(True), ["Pass"]).count() == 0


def test_accuracy_and_null_outcome(spark):
    df = spark.createDataFrame([(1, "Unsuccessful"), (1, "Successful"), (2, "Successful")], "game_id int, outcome_type string")
    r = sequence.response_accuracy(df).first()
    assert (r["mean_accuracy"], r["variance"]) == (0.75, 0.125)
    one = sequence.response_accuracy(spark.createDataFrame([(1, None)], "game_id int, outcome_type string")).first()
    assert one["mean_accuracy"] == 1.0 and one["variance"] is None


def test_forward_fill_is_per_team_and_idempotent(spark):
    rows = [("T", 1, "e1", "433"), ("T", 2, None, None), ("T", 3, "e3", "442"), ("T", 4, None, None), ("V", 1, None, None), ("V", 2, "e9", "352")]
    df = spark.createDataFrame([(1, t, s, i, f) for t, s, i, f in rows], "game_id int, team string, seq int, a string, b string")
    once = sequence.forward_fill(df, ["a", "b"], ["game_id", "team"], ["seq"])
    assert [r["a"] for r in once.orderBy("team", "seq").collect()] == ["e1", "e1", "e3", "e3", None, "e9"]
    again = sequence.forward_fill(once, ["a", "b"], ["game_id", "team"], ["seq"])
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_directed_pairs(spark):
    df = spark.createDataFrame([(1, "T", 1, 2, 1), (1, "T", 1, 2, 2), (1, "T", 2, 1, 3), (1, "T", 1, None, 4)], "game_id int, team string, player_id long, recipient long, seq long")
    got = network.directed_pairs(df)
    assert {r["pair"]: r["number_pass"] for r in got.collect()} == {"12": 2, "21": 1}
    widths = got.select("pair", network.share_of_max("number_pass", ["game_id", "team"]).alias("w"))
    assert {r["pair"]: r["w"] for r in widths.collect()} == {"12": 1.0, "21": 0.5}


def test_most_minutes_breaks_ties_by_player(spark):
    df = spark.createDataFrame([(1, "T", p, m) for p in (3, 1, 2) for m in (0, 10)] + [(1, "T", 9, 0), (1, "T", 9, 90)], "game_id int, team string, player_id long, minute int")
    assert [r["player_id"] for r in network.most_minutes(df, 3).orderBy("place").collect()] == [9, 1, 2]


def test_substitute_takes_the_place(spark):
    lineup = spark.createDataFrame([("t1", 1, "ST"), ("t1", 3, "GK")], "tactics_id string, player_id long, position string")
    came = spark.createDataFrame([("t1", 1, 2)], "tactics_id string, player_id long, replacement_id long")
    got = {r["player_id"]: r["position"] for r in network.with_substitutes(lineup, came).collect()}
    assert got == {1: "ST", 2: "ST", 3: "GK"}


def test_checked_join_fails_on_any_action(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, l string")
    good = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k long, r string")
    bad = spark.createDataFrame([(1, "x"), (7, "y"), (7, "z")], "k long, r string")
    assert joins.checked_join(left, good, ["k"], "left", "m:1").count() == 3
    for use in (lambda d: d.collect(), lambda d: d.select("l").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="not unique"):
            use(joins.checked_join(left, bad, ["k"], "left", "m:1"))
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(left, good, ["k"], "inner", "1:1").collect()


def test_join_chain_suffixes(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3)], "k int, v int")
    out = joins.join_chain(a, [(b, "_b")], ["k"])
    assert out.columns == ["k", "v", "v_b"] and out.first() == (1, 2, 3)


def test_exactly_one(spark):
    df = spark.range(3)
    assert joins.exactly_one(df, F.col("id") == 1, "id") == 1
    for condition in (F.col("id") > 0, F.col("id") > 9):
        with pytest.raises(ValueError, match="exactly one"):
            joins.exactly_one(df, condition, "id")


def test_shares_and_bars(spark):
    long = spark.createDataFrame([("g", "H", "s", 3.0), ("g", "A", "s", 1.0), ("g", "H", "z", 0.0), ("g", "A", "z", 0.0)], "game string, side string, category string, value double")
    got = {r["category"]: r for r in compare.bar_track(compare.shares(long, ["game"], "side", "H", "A")).collect()}
    assert (got["s"]["share_a"], got["s"]["share_b"], got["s"]["bar_a"]) == (0.75, 0.25, 15)
    assert (got["z"]["share_a"], got["z"]["share_b"]) == (0, 0)


def test_unpivot_casts_and_running_total(spark):
    df = spark.createDataFrame([("g", "1", "x", 3.0)], "game string, a string, b string, c double")
    long = compare.unpivot(df, ["game"], ["a", "b", "c"])
    assert {r["category"]: r["value"] for r in long.collect()} == {"a": 1.0, "b": None, "c": 3.0}
    assert [r["running"] for r in compare.running_total(long, ["game"], ["category"]).orderBy("category").collect()] == [1, 1, 4]


def test_per_90(spark):
    df = spark.createDataFrame([(5.0, 2.0, 7.0), (0.0, 0.0, 7.0), (3.0, 0.0, 7.0), (None, 2.0, 7.0), (math.nan, 2.0, 7.0)], "v double, `90s` double, `Cmp%` double")
    got = similarity.per_90(df, "90s", []).collect()
    assert [r["v"] for r in got] == [2.5, 0, 0, 0, 0] and {r["Cmp%"] for r in got} == {7.0} and got[0]["90s"] == 2


def test_standard_scores(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (3.0, 4.0)], "a double, b double")
    got = similarity.standardise(df, ["a", "b"]).collect()
    assert [round(r["a"], 6) for r in got] == [-1.224745, 0, 1.224745] and {r["b"] for r in got} == {0.0}


def test_nearest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "vec_id int, embedding array<double>")
    got = [(r["vec_id"], round(r["distance"], 6)) for r in similarity.nearest(df, 0, 9).collect()]
    assert got == [(1, 0), (2, 0.292893), (3, 1), (4, 2)]


def test_pca_explains_like_numpy(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((60, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
    found = similarity.explained(df, 5)
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert [r[1] for r in found] == pytest.approx((values / values.sum()).tolist())
    assert found[-1][2] == pytest.approx(1)


def test_missing_safe_split_and_mirror(spark):
    rows = [(1, 1, "A", True, True), (1, 2, "A", True, False), (1, 3, "B", True, None), (1, 4, "B", None, True)]
    df = spark.createDataFrame([(*r, 90.0, 50.0) for r in rows], "game_id int, seq int, team string, is_shot boolean, is_goal boolean, x double, y double")
    got = {r["seq"]: (r["result"], r["draw_x"], r["draw_y"]) for r in shots.shot_split(df).collect()}
    assert got == {1: ("goal", 12, 40), 2: ("no goal", 12, 40), 3: ("no goal", 108, 40)}


def test_pair_number(spark):
    got = sequence.pair_number(spark.range(4), ["id"], []).orderBy("id").collect()
    assert [r["pair"] for r in got] == [0, 0, 1, 1]


def test_drawable_edge_and_marker(spark):
    pairs = spark.createDataFrame([(1, "T", 1, 2, 2), (1, "T", 1, 1, 4)], "game_id int, team string, pos_min long, pos_max long, pass_count long")
    places = spark.createDataFrame([(1, "T", 1, 5.0, 6.0), (1, "T", 2, 7.0, 8.0)], "game_id int, team string, player_id long, x double, y double")
    r = network.drawable(pairs, places).where("pos_max = 2").first()
    assert (r["width"], round(r["alpha"], 9), r["x"], r["x_end"], r["y_end"]) == (7.5, 0.6, 5, 7, 8)
    assert spark.range(1).select(geometry.marker_size(F.lit(0.5))).first()[0] == 250


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3)], "a long, b double, c string, `d%` int")
    assert columns.numeric_columns(df, ["a"]) == ["b", "d%"] and columns.float_and_long_columns(df) == ["a", "b"]
    assert columns.without_matching(df, "^[ab]").columns == ["c", "d%"]
    assert columns.names_without(["90s", "x Pct", "goals"], ["90s", "Pct"]) == ["goals"]
    assert df.select(columns.lookup(F.col("a"), {1: "one"}), columns.lookup(F.col("a") + 1, {1: "one"})).first() == ("one", None)


def test_location_of_short_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0],), (None,)], "location array<double>")
    assert [(r["x"], r["y"]) for r in shots.split_location(df).collect()] == [(1, 2), (3, None), (None, None)]


def test_stack_with_different_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, only_a string"), spark.createDataFrame([(2, 5), (2, 5)], "k long, only_b int")
    assert sorted(map(tuple, joins.stack(a, b).collect()), key=str) == [(1, "x", None), (2, None, 5), (2, None, 5)]


def test_unique_is_checked_once_for_two_joins(spark):
    lineup = spark.createDataFrame([(1, 1, "GK"), (1, 2, "ST")], "tactics_id long, player_id long, position string")
    rows = [(1, "T", s, 1, p, r, "433", "Pass", float(s), 2.0) for s, (p, r) in enumerate([(1, 2), (2, 1), (2, 1), (1, 9)])]
    events = spark.createDataFrame(rows, "game_id long, team string, seq long, tactics_id long, player_id long, recipient long, tactics_formation string, type string, x double, y double")
    found = network.formation_network(events, lineup, "433")
    assert [(r["pos_min"], r["pos_max"], r["pass_count"], r["count"], r["count_end"]) for r in found.collect()] == [("GK", "ST", 3, 2, 2)]
    with pytest.raises(Exception, match="not unique"):
        network.formation_network(events, lineup.union(lineup), "433").collect()


def test_markers_outcomes_and_drawn_width(spark):
    nodes = spark.createDataFrame([(1, True), (2, False), (3, None)], "player_id int, is_starter boolean")
    assert [r["marker"] for r in network.with_markers(nodes).orderBy("player_id").collect()] == ["o", "s", "o"]
    got = network.outcome_split(passes(spark, [1, 1, 2], ["Successful", "Unsuccessful", None])).collect()
    assert sorted((r["player_id"], r["outcome_type"], r["actions"], r["first_seq"]) for r in got) == [(1, "Successful", 1, 0), (1, "Unsuccessful", 1, 1)]
    half = spark.createDataFrame([(1, "T", k, p, r, "Pass", k, 1.0, 2.0) for k, (p, r) in enumerate([(1, 2), (1, 2), (2, 1)])], "game_id int, team string, seq long, player_id long, recipient long, type string, minute int, x double, y double")
    assert {r["pair"]: (r["width"], r["line_width"]) for r in network.directed_network(half).collect()} == {"12": (1.0, 1.5), "21": (0.5, 1.0)}


def test_ordinals_labels_and_matrix(spark):
    long = spark.createDataFrame([("g", "a", 1.25), ("g", "b", 3.0), ("h", "b", None)], "game string, category string, value double")
    got = compare.labelled(compare.with_ordinal(long, ["b", "a"]), ["value"]).orderBy("game", "category").collect()
    assert [(r["place"], r["value_label"]) for r in got] == [(1, "1.3"), (0, "3.0"), (0, None)]
    assert {r["game"]: r["values"] for r in compare.matrix(long, ["game"], ["b", "a"]).collect()} == {"g": [3.0, 1.25], "h": [None, None]}


def test_optional_player_filters(spark):
    df = spark.createDataFrame([("MF,FW", 1998, 9.0, "L1"), ("MF", 1990, 9.0, "L1"), ("GK", 2000, 9.0, "L1"), ("MF", 2000, 2.0, "L2"), ("MF", None, 9.0, "L1")], "pos string, born int, `90s` double, league string")
    count = lambda **how: similarity.chosen_players(df, "MF", 1997, **how).count()
    assert (count(), count(least_minutes=5), count(league="L2"), count(least_minutes=5, league="L2")) == (2, 1, 1, 0)


def test_neighbours_among_components_like_numpy(spark):
    import numpy as np

    x = np.random.default_rng(2).standard_normal((40, 6)) * [5, 3, 2, 1, 0.5, 9] + 2
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "vec_id long, " + ", ".join(f"{n} double" for n in names))
    scaled = similarity.assemble(similarity.standardise(df, names), names)
    got = similarity.nearest(similarity.project(scaled, similarity.fit_pca(scaled, 3)), 7, 5, vector="components").collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    p = z @ np.linalg.svd(z, full_matrices=False)[2][:3].T
    distance = 1 - p @ p[7] / np.linalg.norm(p, axis=1) / np.linalg.norm(p[7])
    order = [k for k in np.argsort(distance) if k != 7][:5]
    assert [r["vec_id"] for r in got] == order and [r["distance"] for r in got] == pytest.approx(distance[order].tolist())
    assert [r[1] for r in similarity.explained(scaled, 6)] == pytest.approx((np.linalg.svd(z, compute_uv=False) ** 2 / (z**2).sum()).tolist())


def test_prices_are_added_in_the_order_of_the_file(spark, tmp_path):
    import datetime
    import random

    from matchweave.plans import adapter, catalog

    rng, day = random.Random(1), datetime.datetime(1996, 1, 5)
    prices = [rng.randrange(10**5, 5 * 10**7) / 100 for _ in range(2000)]
    in_order = 0.0
    for p in prices:
        in_order += p
    prices.append(1e6 - round(in_order % 1e6, 2))  # the exact sum is a whole number, so the floor hangs on the order
    in_order += prices[-1]
    rows = [(2 * k, k * 7 % 13, "F", p, day) for k, p in enumerate(prices)] + [(1, None, "O", 1.0, day), (3, 5, "O", 1.0, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["game"], r["side"]): tuple(r)[2:] for r in adapter.order_stats(spark, str(tmp_path)).collect()}
    assert got == {("1996-01", "H"): (2001, in_order, 13, 2001), ("1996-01", "A"): (1, 1.0, 0, 0), (None, "A"): (1, 1.0, 1, 0)}
    label = catalog.stat_labels(spark, str(tmp_path)).where("game = '1996-01' and category = 'price'").first()["a_label"]
    assert label == f"{math.floor(in_order):.1f}"
