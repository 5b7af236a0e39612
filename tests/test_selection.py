"""Exact medians of huge groups, neighbours of all rows and declared patterns, against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.operators import neighbours, network, patterns, ranks, sequence
from matchweave.sources.scratch import Scratch


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_medians_equal_median_whatever_is_large(spark, most):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1.5, rng.random(), rng.random(), float("nan") if rng.random() < 0.1 else 2.0]), rng.choice([7.0, 7.0, None])) for _ in range(500)]
    rows += [("one", 4.0, None), ("none", None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, `x.y` double, z double").repartition(6)
    got = ranks.medians(df, ["g"], ["x.y", "z"], most=most)
    want = df.groupBy("g").agg(F.median("`x.y`").alias("x.y"), F.median("z").alias("z"))
    near = lambda t: sorted((str(r[0]), *[None if v is None else round(v, 9) if v == v else "nan" for v in r[1:]]) for r in t.collect())
    assert got.columns == want.columns and near(got) == near(want)


def test_team_shape_of_huge_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, None]), rng.choice("AB"), rng.choice([None, *range(5)]), rng.choice(["DC", "FW", "MC", None]), rng.choice([None, rng.random() * 120]), rng.random(), rng.random() * 180) for _ in range(300)]
    df = spark.createDataFrame(rows, "game_id int, team string, player_id long, position string, x double, y double, pass_angle_abs double")
    for make in (network.locations, network.verticality, network.team_lines):
        plain, ranged = make(df), make(df, most=10)
        assert plain.columns == ranged.columns and sorted(map(str, plain.collect())) == sorted(map(str, ranged.collect()))


def test_ranks_of_one_value(spark):
    df = spark.createDataFrame([("g", 1)] * 400 + [(None, 2)] * 3, "g string, v int").repartition(7)
    got = ranks.ranked(df, ["g"], ["v"], "r", "n", Scratch(spark), send=0).collect()
    assert sorted(r["r"] for r in got if r["g"]) == list(range(400)) and {r["n"] for r in got if r["g"] is None} == {3}


def brute(ids, x, k):
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    d = np.round(1 - np.einsum("id,jd->ij", u, u), 12)
    return {(ids[i], ids[j], n + 1) for i in range(len(ids)) for n, j in enumerate(sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[i, j], ids[j]))[:k])}


def test_neighbours_of_all_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    x = np.vstack([centres[rng.integers(0, 6, 300)] + 0.05 * rng.normal(size=(300, 12)), np.repeat(centres[:1], 60, axis=0), rng.normal(size=(20, 12))])
    ids = rng.permutation(len(x)).tolist()
    bad = [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0] * 5), (None, [1.0] * 12), (1004, [None] * 12)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + bad, "vec_id long, embedding array<double>").repartition(5)
    got, computed = neighbours.nearest_of_all(df, k=5, pivots=8, block=32, group=4)
    assert {(r["id"], r["other"], r["place"]) for r in got.collect()} == brute(ids, x, 5)
    own, other = computed.first()
    assert own + other < len(x) * (len(x) - 1) / 2  # far fewer than all ordered pairs


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got, _ = neighbours.nearest_of_all(df, k=9)
    assert sorted((r["id"], r["place"], r["other"], round(r["distance"], 6)) for r in got.collect()) == [(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)]
    got, computed = neighbours.nearest_of_all(df.where("vec_id > 5"))
    assert got.count() == 0 and computed.count() == 1


def plain_matches(rows, accept, gaps, within):
    """Of all step combinations from each start, the one that ends first, then has the earliest steps."""
    out = set()
    for start in range(len(rows)):
        if not accept[0](rows[start]):
            continue
        found = []
        for rest in itertools.product(*[range(1, g + 2) for g in gaps[1:]]):
            places = [start, *itertools.accumulate(rest, initial=start)][1:]
            if places[-1] < len(rows) and all(f(rows[p]) for f, p in zip(accept, places, strict=True)) and (within is None or all(rows[p][1] is not None for p in places) and rows[places[-1]][1] - rows[start][1] <= within):
                found.append(tuple(places))
        if found:
            out.add(min(found, key=lambda p: (p[-1], p)))
    return out


@pytest.mark.parametrize("within", [None, 9.0])
def test_patterns_equal_all_combinations(spark, within):
    rng = random.Random(8)
    groups = {g: [(k, rng.choice([None, *[2.0 * k] * 9]), rng.choice("abcd")) for k in range(150)] for g in ("x", None, "z")}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g string, k long, clock double, type string").repartition(5)
    gaps = [0, 2, 1]
    steps = [patterns.Step(n, F.col("type").isin(*kinds), gap) for n, kinds, gap in zip("pqr", ("ab", "bc", "ca"), gaps, strict=True)]
    got = patterns.match_pattern(df, steps, ["g"], ["k"], ["k", "type"], F.col("clock"), within)
    assert got.columns == ["g", "p_k", "p_type", "q_k", "q_type", "r_k", "r_type", "seconds"]
    for g, rows in groups.items():
        accept = [lambda r, kinds=kinds: r[2] in kinds for kinds in ("ab", "bc", "ca")]
        want = plain_matches(rows, accept, gaps, within)
        assert {(r["p_k"], r["q_k"], r["r_k"]) for r in got.collect() if r["g"] == g} == want
    assert patterns.match_pattern(df.where("false"), steps, ["g"], ["k"], ["k"]).count() == 0


def test_responses_are_a_pattern(spark):
    rows = [(1, k, "T", p, t, o, 10, s) for k, (p, t, o, s) in enumerate([(2, "Pass", "Successful", 0), (7, "Pass", "Unsuccessful", 2), (2, "Pass", "Successful", 10), (7, "Foul", "Successful", 12), (3, "Pass", "Successful", 20), (7, "TakeOn", "Successful", 21)])]
    df = spark.createDataFrame(rows, "game_id long, seq long, team string, player_id long, type string, outcome_type string, minute int, second int")
    how = (F.lit(7), F.col("team") == "T", ["Pass", "TakeOn"])
    assert sorted(map(tuple, sequence.responses_by_pattern(df, *how).collect())) == sorted(map(tuple, sequence.responses(df, *how).collect())) == [(1, 1, "Unsuccessful", 2), (1, 5, "Successful", 1)]


def test_neighbours_are_sent_by_groups(spark):
    """A group's task returns k rows a row, however many blocks it meets."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24))  # no structure: all blocks meet
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    kept = []
    table = Scratch.table
    try:
        Scratch.table = lambda self, df, name: kept.append((name, found := table(self, df, name))) or found
        got, _ = neighbours.nearest_of_all(df, k=3, pivots=4, block=8)
    finally:
        Scratch.table = table
    assert {(r["id"], r["other"], r["place"]) for r in got.collect()} == brute(list(range(600)), x, 3)
    outside = dict(kept)["outside"]
    assert outside.where("id is not null").groupBy("id").count().agg(F.max("count")).first()[0] <= 8 * 3
