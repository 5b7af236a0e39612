"""Shared pieces: broadcast by size, Arrow batches, whole groups in a stream, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.sources.scratch import Scratch


def sized(table: DataFrame, rows: int) -> DataFrame:
    """A written ``table`` of narrow rows, marked for broadcast if it has at most ``rows`` of them."""
    return F.broadcast(table) if table.count() <= rows else table


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Arrow batches end at ``most`` bytes in this session, so a worker's memory doesn't follow 10,000 texts.

    Spark takes the limit from the session when a query runs, so the setting stays;
    a smaller one is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > most:
        spark.conf.set(key, most)


def map_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches sorted by integer ``keys`` so that no group is split.

    Holds at most one group plus one batch.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        if len(at):
            cut = int(at[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(*cols: np.ndarray) -> np.ndarray:
    """Start offsets of runs of equal key tuples, with the total at the end."""
    n = len(cols[0])
    change = np.ones(n, dtype=bool)
    if n:
        change[1:] = False
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of ``n`` nodes (vectorised label passing)."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def connected_components(edges: DataFrame, a: str, b: str, task_rows: int = 1 << 16) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Alternates large-star and small-star steps, each a pre-aggregated minimum
    and a join whose hot partitions Spark may split, so a node with very many
    neighbours is never gathered in one place. Null ends and self-loops are
    dropped. Every round is written to the shared folder and the one before it
    deleted, until the edges are stars. No edges give no rows. A round's tables are written by
    one task for each ``task_rows`` edges, as a file costs more than a small graph's rows.
    """
    spark = edges.sparkSession
    held = Scratch(spark)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = held.table(e.where("u > v").distinct(), "edges")
    tasks = max(1, -(-e.count() // task_rows))
    written = lambda t, name: held.table(t.coalesce(tasks), name)

    def settled(x: DataFrame) -> bool:
        """Whether the edges are stars: every node has one edge upwards or only edges from below."""
        ends = x.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(x.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").coalesce(tasks).isEmpty()

    while not settled(e):
        before, held = held, Scratch(spark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written first: a join of two plain shuffles is one that Spark splits where a node is hot.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "large_minima")
        small = (
            large.join(low, "u")
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = written(small, "edges")
        before.drop()
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
