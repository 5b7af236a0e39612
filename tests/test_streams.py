"""Streams against batch, for any split of the input into files, and over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from matchweave.operators import sequence
from matchweave.streaming import ordered

SCHEMA = "game_id long, team string, seq long, ts timestamp, player_id long, formation string, tactics_id long"


def match_rows(seed=1, n=120):
    rng, rows = random.Random(seed), []
    for game in (1, 2):
        clock = 1_700_000_000 + 86_400 * game
        for seq in range(n):
            clock += rng.randrange(1, 30)
            formation = rng.choice(["433", "442", "352"]) if rng.random() < 0.08 else None
            rows.append((game, rng.choice(["A", "B", None]), seq, clock, rng.choice([None, *range(9)]), formation, seq if formation else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s")).select(*[f.split()[0] for f in SCHEMA.split(", ")])


def run(spark, folder, parts, build, mode):
    """Land ``parts`` one after another, a micro-batch each, the query stopped and started from its checkpoint now and then."""
    def once():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        with ordered.keyed_state(spark):
            q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")).start()
        q.awaitTermination()

    for k, rows in enumerate(parts):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k % 2:
            once()
    once()
    return spark.read.parquet(f"{folder}/out").drop("batch")


FAR = (9, "Z", 0, 1_800_000_000, 1, None, None)


@pytest.mark.parametrize(("late", "shuffled", "cuts"), [("100 days", True, 3), ("60 seconds", False, 5)])
def test_next_value_stream_equals_batch(spark, tmp_path, late, shuffled, cuts):
    rows = match_rows()
    order = sorted(rows, key=lambda r: (r[0], r[3] + random.Random(r[2]).randrange(25)))  # out of order by less than ``late``
    if shuffled:
        random.Random(5).shuffle(order)
    parts = [order[len(order) * k // cuts : len(order) * (k + 1) // cuts] for k in range(cuts)]
    build = lambda s: ordered.stream_next_value(s, "player_id", ["game_id", "team"], "ts", "seq", "receiver", late, 3600)
    got = run(spark, str(tmp_path), [*parts, [FAR]], build, "append").where("game_id < 9")
    want = sequence.next_value(frame(spark, rows), "player_id", ["game_id", "team"], ["seq"], "receiver").drop("ts")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(("late", "shuffled", "cuts"), [("100 days", True, 4), ("60 seconds", False, 3)])
def test_forward_fill_stream_corrects_itself(spark, tmp_path, late, shuffled, cuts):
    rows = match_rows(2)
    order = sorted(rows, key=lambda r: (r[0], r[3] + random.Random(r[2]).randrange(25)))
    if shuffled:
        random.Random(6).shuffle(order)
    parts = [order[len(order) * k // cuts : len(order) * (k + 1) // cuts] for k in range(cuts)]
    parts[1] += parts[0][-3:]  # sent again
    build = lambda s: ordered.stream_forward_fill(s, ["formation", "tactics_id"], ["game_id", "team"], "ts", "seq", late)
    updates = run(spark, str(tmp_path), parts, build, "update")
    got = ordered.latest(updates, ["game_id", "team", "seq"])
    want = sequence.forward_fill(frame(spark, rows), ["formation", "tactics_id"], ["game_id", "team"], ["seq"]).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert updates.count() >= len(rows) + (20 if shuffled else 0)  # corrections came out
