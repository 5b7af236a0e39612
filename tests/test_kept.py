"""Kept networks against full rebuilds, and exports that readers see whole or not at all."""

import glob
import random
import shutil

import pytest
from pyspark.sql import functions as F

from matchweave.operators import network
from matchweave.sources import exports
from matchweave.streaming.kept import KeptNetworks, keep_networks

PASSES = "game_id long, version long, team string, player_id long, receiver long, x double, y double"


def passes(rng, game, version, n):
    return [(game, version, rng.choice("AB"), rng.choice([None, *range(6)]), rng.choice([None, *range(6)]), float(rng.randrange(100)), 1.0) for _ in range(n)]


def rebuilt(spark, rows):
    newest = {}
    for r in rows:
        newest[r[0]] = max(newest.get(r[0], r[1]), r[1])
    kept = spark.createDataFrame([r for r in rows if r[1] == newest[r[0]]], PASSES)
    nodes = kept.where("player_id is not null").groupBy("game_id", "version", "team", "player_id").agg(F.count("*").alias("passes"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    edges = network.edges(kept).join(kept.select("game_id", "version").distinct(), "game_id").select("game_id", "version", "team", "pos_min", "pos_max", "pass_count")
    return sorted(map(str, edges.collect())), sorted(map(str, nodes.collect()))


def seen(spark, kept):
    return sorted(map(str, kept.edges(spark).collect())), sorted(map(str, kept.nodes(spark).collect()))


def test_replayed_and_resent_games(spark, tmp_path):
    rng, kept = random.Random(7), KeptNetworks(str(tmp_path / "net"))
    batches = [
        passes(rng, 1, 1, 40) + passes(rng, 2, 1, 30), passes(rng, 1, 1, 25) + passes(rng, 3, 1, 5),  # a game over two batches
        passes(rng, 2, 2, 33), passes(rng, 2, 1, 9) + passes(rng, 4, 5, 3), [(3, 2, "A", None, None, 1.0, 1.0)],  # sent again; too late; again without a pass
    ]
    for k, rows in enumerate(batches):
        kept.merge(spark.createDataFrame(rows, PASSES), k)
        assert seen(spark, kept) == rebuilt(spark, [r for b in batches[: k + 1] for r in b])
    all_ = [r for b in batches for r in b]
    for k in (3, 0):
        kept.merge(spark.createDataFrame(batches[k], PASSES), k)
        assert seen(spark, kept) == rebuilt(spark, all_)
    kept.compact(spark)
    assert seen(spark, kept) == rebuilt(spark, all_) and not glob.glob(f"{tmp_path}/net/edges/*")
    more = passes(rng, 4, 6, 8) + passes(rng, 1, 1, 8)
    kept.merge(spark.createDataFrame(more, PASSES), len(batches))
    assert seen(spark, kept) == rebuilt(spark, all_ + more)


def test_networks_of_a_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = [passes(rng, 1, 1, 20), passes(rng, 2, 1, 20), passes(rng, 1, 2, 15)]
    for part in rows:
        spark.createDataFrame(part, PASSES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(PASSES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        keep_networks(stream, f"{tmp_path}/net", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert seen(spark, KeptNetworks(f"{tmp_path}/net")) == rebuilt(spark, [r for part in rows for r in part])


def test_export_parts_are_bounded_and_in_order(spark, tmp_path):
    path, schema = str(tmp_path / "x"), "game_id long, seq long, text string"
    rows = [(1, k, f"t{k}") for k in range(1000)] + [(2, 5, "a"), (2, 1, None), (None, 1, "n")]
    df = spark.createDataFrame(rows, schema).repartition(7)
    assert exports.export_keyed(df, path, "game_id", ["seq"], rows_per_file=64) == 1
    assert sorted(map(str, exports.read_export(spark, path, schema, "game_id").collect())) == sorted(map(str, df.collect()))
    files = spark.read.parquet(*glob.glob(f"{path}/data/*")).select("game_id", "_part", "seq", F.col("_metadata.file_path").alias("f"))
    sizes = files.groupBy("game_id", "_part").agg(F.countDistinct("f").alias("files"), F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).collect()
    assert all(r["files"] == 1 and r["n"] <= 64 for r in sizes) and sorted(r["a"] for r in sizes if r["game_id"] == 1) == list(range(0, 1000, 64))
    assert exports.export_keyed(df.where("game_id = 2"), path, "game_id", ["seq"], form="csv") == 2
    assert exports.read_export(spark, path, schema, "game_id", form="csv").count() == 2 and exports.read_export(spark, path, schema, "game_id", 1).count() == 1003
    assert exports.export_keyed(df.where("false"), path, "game_id", ["seq"]) == 3 and exports.read_export(spark, path, schema, "game_id").count() == 0


def test_half_an_export_is_not_seen(spark, tmp_path):
    path, schema = str(tmp_path / "x"), "game_id long, seq long"
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, path, schema, "game_id")
    df = spark.range(100).select((F.col("id") % 3).alias("game_id"), F.col("id").alias("seq"))
    exports.export_keyed(df, path, "game_id", ["seq"], 10)
    broken = df.withColumn("seq", F.when(F.col("seq") == 77, F.raise_error("lost").cast("long")).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="lost"):
        exports.export_keyed(broken, path, "game_id", ["seq"], 10)
    shutil.copytree(f"{path}/manifests/1", f"{path}/manifests/2", ignore=lambda *_: ["_SUCCESS", "._SUCCESS.crc"])  # the driver was lost as it published
    assert exports.published(spark, path) == [1] and exports.read_export(spark, path, schema, "game_id").count() == 100
    shutil.rmtree(glob.glob(f"{path}/data/*/game_id=1/_part=2")[0])
    with pytest.raises(ValueError, match="manifest"):
        exports.read_export(spark, path, schema, "game_id")


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.range(400).select((F.col("id") % 2).alias("game_id"), F.col("id").alias("seq"))
    exports.export_keyed(df, path, "game_id", ["seq"], 5)
    files = [f.rsplit("/", 1)[-1] for f in glob.glob(f"{path}/data/*/game_id=*/_part=*/*.parquet")]
    assert len(files) == 80 and len({f.split("-")[1] for f in files}) > 8
    exports.export_keyed(df, path, "game_id", ["seq"], 5, files_per_task=2)
    assert exports.read_export(spark, path, "game_id long, seq long", "game_id").count() == 400


def test_no_job_holds_all_files_of_an_export(spark, tmp_path):
    path, schema = str(tmp_path / "x"), "game_id long, seq long"
    df = spark.range(800).select(F.when(F.col("id") % 8 != 0, F.least(F.col("id") % 8, F.lit(3))).alias("game_id"), F.col("id").alias("seq"))  # a null game, a hot one
    exports.export_keyed(df, path, "game_id", ["seq"], 10, files_per_folder=20)
    held = [len(glob.glob(f"{f}/game_id=*/_part=*/*.parquet")) for f in glob.glob(f"{path}/data/*")]
    assert sum(held) == 80 and len(held) > 1 and max(held) < 50
    before = spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize")
    back = exports.read_export(spark, path, schema, "game_id")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert not any(f"{path}/data" in f for f in back.inputFiles()) and spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize") == before
    shutil.rmtree(glob.glob(f"{path}/data/*/game_id=3/_part=7")[0])
    with pytest.raises(ValueError, match="manifest"):
        exports.read_export(spark, path, schema, "game_id")
