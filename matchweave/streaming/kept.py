"""Passing networks that micro-batches keep up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from matchweave.sources.exports import published
from matchweave.sources.scratch import delete, files_below

_EDGE = ["game_id", "version", "team", "pos_min", "pos_max"]
_NODE = ["game_id", "version", "team", "player_id"]
_SUMS = {"edges": ["pass_count"], "nodes": ["passes", "sum_x", "sum_y"]}


class KeptNetworks:
    """Edges and nodes of every game in a folder, as sums that batches add.

    Rows are completed passes with game_id, version, team, player_id, receiver, x and
    y. Each batch's sums are written under its number, so a batch that runs again
    replaces itself. A game counts at its highest version only: sending it
    again under a higher one replaces it, whatever batch holds the older rows, and an
    older version that comes late changes nothing.
    """

    def __init__(self, path: str):
        self.path = path

    def merge(self, batch: DataFrame, number: int) -> None:
        """Add a micro-batch; suits ``foreachBatch``. Sums are taken before the shuffle."""
        ends = batch.select("game_id", "version", "team", F.least("player_id", "receiver").alias("pos_min"), F.greatest("player_id", "receiver").alias("pos_max"))
        edges = ends.where("pos_min is not null").groupBy(*_EDGE).agg(F.count("*").alias("pass_count"))
        nodes = batch.where("player_id is not null").groupBy(*_NODE).agg(F.count("*").alias("passes"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
        # A game whose new version has no edge or node must still replace the old one.
        games = batch.select("game_id", "version").distinct()
        for name, table in (("edges", edges), ("nodes", nodes), ("games", games)):
            table.write.mode("overwrite").parquet(f"{self.path}/{name}/{number}")

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        """All batches since the last compaction, and that one's table."""
        base = (published(spark, self.path, f"base_{name}") or [None])[-1]
        numbers = [k for k in published(spark, self.path, name) if base is None or k > base]
        folders = [f"{self.path}/{name}/{k}" for k in numbers] + ([f"{self.path}/base_{name}/{base}"] if base is not None else [])
        return spark.read.parquet(*folders)

    def _sums(self, spark: SparkSession, name: str) -> DataFrame:
        keys = _EDGE if name == "edges" else _NODE
        newest = self._table(spark, "games").groupBy("game_id").agg(F.max("version").alias("version"))
        rows = self._table(spark, name).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS[name]])
        same = F.col("a.game_id").eqNullSafe(F.col("b.game_id")) & (F.col("a.version") == F.col("b.version"))
        return rows.alias("a").join(newest.alias("b"), same, "left_semi")

    def edges(self, spark: SparkSession) -> DataFrame:
        """(game_id, version, team, pos_min, pos_max, pass_count) of each game's last version, undirected."""
        return self._sums(spark, "edges")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(game_id, version, team, player_id, passes, x, y): the mean place of each player's passes."""
        sums = self._sums(spark, "nodes")
        return sums.select(*_NODE, "passes", (F.col("sum_x") / F.col("passes")).alias("x"), (F.col("sum_y") / F.col("passes")).alias("y"))

    def compact(self, spark: SparkSession) -> None:
        """Put all batches so far into one table without replaced versions; their folders go once it is complete.

        Run it between micro-batches. A batch that has been put in must not run again.
        """
        last = published(spark, self.path, "games")[-1]
        tables = {"edges": self._sums(spark, "edges"), "nodes": self._sums(spark, "nodes"), "games": self._table(spark, "games").groupBy("game_id").agg(F.max("version").alias("version"))}
        for name in ("edges", "nodes", "games"):  # readers take each table's own base and the batches after it
            tables[name].write.mode("overwrite").parquet(f"{self.path}/base_{name}/{last}")
        for name in tables:
            for folder in {f.rsplit("/", 1)[0] for f in files_below(spark, f"{self.path}/{name}")}:
                if folder.rsplit("/", 1)[1].isdigit() and int(folder.rsplit("/", 1)[1]) <= last:
                    delete(spark, folder)


def keep_networks(passes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the networks of a stream of passes in ``path``; start it with a trigger."""
    return passes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(KeptNetworks(path).merge)
