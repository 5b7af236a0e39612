"""Merkle manifest of a dataset by superblocks.

Each row is a leaf, each group of rows a tree of its own, and the groups' roots, in
order, the leaves of one more tree. Indices are bucketed by fanout ** k: one task
collapses k levels of a bucket, and the buckets' roots are reduced again the same
way, so that a group of any size takes log(n) / k rounds and no task holds more than
fanout ** k nodes. On the way back each bucket's nodes get the siblings inside the
bucket followed by those of the bucket's root: lower and upper proof.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.operators.ranks import ranked
from matchweave.sources.scratch import Scratch


def hashed(*texts: Column) -> Column:
    """SHA-256 of texts put together, lowercase hex."""
    return F.sha2(F.encode(F.concat(*texts), "utf-8"), 256)


def field(column: Column) -> Column:
    """Byte count, colon and value; a hyphen for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return hashed(*[field(c) for c in columns])


def fold(digest: Column, left: Column, right: Column) -> Column:
    """The root that a leaf's digest gives with its proof (the siblings before and after it, level by level)."""
    return F.aggregate(F.arrays_zip(left.alias("left"), right.alias("right")), digest, lambda h, s: hashed(s["left"], h, s["right"]))


def depth(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def tree(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes and the ``levels`` rows of nodes above them."""
    out = [nodes]
    for _ in range(levels):
        row = out[-1]
        out.append([hashlib.sha256("".join(row[i : i + fanout]).encode()).hexdigest() for i in range(0, len(row), fanout)])
    return out


def siblings(rows: list[list[str]], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Siblings before and after each node of the lowest row, a column a level (texts put together)."""
    at = np.arange(len(rows[0]))
    sides: tuple[list, list] = ([], [])
    for row in rows[:-1]:
        starts = [i - i % fanout for i in range(len(row))]
        for side, texts in zip(sides, (["".join(row[s:i]) for i, s in enumerate(starts)], ["".join(row[i + 1 : s + fanout]) for i, s in enumerate(starts)]), strict=True):
            side.append(np.array(texts, dtype=object)[at])
        at = at // fanout
    return tuple(np.stack(s, axis=1) if s else np.zeros((len(at), 0), dtype=object) for s in sides)  # type: ignore[return-value]


def collapse(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One bucket to its root; ``n`` is the size of the bucket's group."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        first = bucket.iloc[0]
        nodes = bucket.sort_values("at")["digest"].tolist()
        root = tree(nodes, min(levels, depth(int(first["n"]), fanout)), fanout)[-1][0]
        return pd.DataFrame({"tag": [first["tag"]], "at": [first["bucket"]], "n": [-(-int(first["n"]) // fanout**levels)], "digest": [root]})

    return run


def extend(fanout: int, levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bucket's nodes with their proofs: siblings inside the bucket, then those of its root (the one row of ``upper``)."""

    def run(bucket: pa.Table, upper: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("at")
        nodes, n = bucket["digest"].to_pylist(), bucket["n"][0].as_py()
        lower = siblings(tree(nodes, min(levels, depth(n, fanout)), fanout), fanout)
        out = bucket.drop_columns(["bucket"])
        for name, own in zip(("left", "right"), lower, strict=True):
            above = np.array(upper[name][0].as_py(), dtype=object)
            rows = np.hstack([own, np.broadcast_to(above, (len(nodes), len(above)))])
            ends = pa.array(np.arange(len(nodes) + 1) * rows.shape[1], pa.int32())
            out = out.append_column(name, pa.ListArray.from_arrays(ends, pa.array(rows.ravel().tolist(), pa.string())))
        return out.append_column("subroot", pa.array(upper["subroot"].to_pylist() * len(nodes), pa.string()))

    return run


def superblocks(nodes: DataFrame, fanout: int, levels: int, held: Scratch, name: str) -> list[DataFrame]:
    """``nodes`` (tag, at, n, digest), the roots of their buckets, those roots' and so on, until each tag has one."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while most > 1:
        # A tag that has come to one node needs nothing more.
        some = out[-1].where("n > 1").select("tag", "at", "n", "digest", F.floor(F.col("at") / fanout**levels).alias("bucket"))
        roots = some.groupBy("tag", "bucket").applyInPandas(collapse(fanout, levels), "tag string, at long, n long, digest string")
        out.append(held.table(roots.unionByName(out[-1].where("n = 1").select("tag", "at", "n", "digest")), f"{name}_{len(out)}"))
        most = -(-most // fanout**levels)
    return out


def with_proofs(blocks: list[DataFrame], upper: DataFrame, fanout: int, levels: int, held: Scratch) -> DataFrame:
    """The lowest of ``blocks`` with left, right and subroot; ``upper`` has those of each tag's root."""
    upper = upper.select("tag", F.lit(0).cast("long").alias("at"), "left", "right", "subroot")
    for k in reversed(range(len(blocks) - 1)):
        nodes = blocks[k].withColumn("bucket", F.floor(F.col("at") / fanout**levels))
        above = upper.select("tag", F.col("at").alias("bucket"), "left", "right", "subroot")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.drop("bucket").schema.fields) + ", left array<string>, right array<string>, subroot string"
        many = nodes.where("n > 1").groupBy("tag", "bucket").cogroup(above.groupBy("tag", "bucket"))
        singles = nodes.where("n = 1").join(above, ["tag", "bucket"]).drop("bucket")
        upper = many.applyInArrow(_if_both(extend(fanout, levels), schema), schema).unionByName(singles)
        if k:
            upper = held.table(upper, f"proofs_{uuid.uuid4().hex}")
    return upper if len(blocks) > 1 else blocks[0].join(upper.drop("at"), "tag")


def _if_both(run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``run`` for keys that both sides have; upper rows of single nodes have no bucket beside them."""

    def both(bucket: pa.Table, upper: pa.Table) -> pa.Table:
        if bucket.num_rows:
            return run(bucket, upper)
        lists = pa.array([], pa.list_(pa.string()))
        out = bucket.drop_columns(["bucket"])
        return out.append_column("left", lists).append_column("right", lists).append_column("subroot", pa.array([], pa.string()))

    return both


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf", also: tuple[str, ...] = (), fanout: int = 3, levels: int = 7, send: int = 1_000_000) -> DataFrame:
    """id, leaf, the columns ``also``, subroot, root and proof (left, right) of every row.

    The rows of a group ascend by id (null first, then by leaf); while several nodes
    remain, every ``fanout`` consecutive ones (the last run may have fewer, even one)
    become their hash. The groups' roots, in order of the group's UTF-8 bytes (null
    first), give ``root`` in the same way. ``left`` and ``right`` are the siblings
    before and after the row's node on each level up to the root, put together;
    ``fold`` recomputes the root from them.

    ``leaf_col`` holds a digest in hex, as ``leaf`` makes it. Repeated rows are leaves
    of their own. Other columns are ignored; names that clash with those given
    here are an error. An empty table gives no rows.
    """
    taken = {"tag", "at", "n", "digest", "bucket", "left", "right", "subroot", "root", "_part", "_place", "_id", "_first", "_n", "_p", "_by0", "_start", "_as_read"}
    if clash := taken & {c.lower() for c in (id_col, leaf_col, *also)}:
        raise ValueError(f"names in use: {sorted(clash)}")
    spark = rows.sparkSession
    held = Scratch(spark)
    group = F.col(f"`{group_col}`").cast("string")
    tag = F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("tag")  # null before all others
    leaves = ranked(rows.select(tag, id_col, F.col(leaf_col).alias("digest"), *also), ["tag"], [id_col, "digest"], "at", "n", held, "leaves", send)
    blocks = superblocks(leaves, fanout, levels, held, "block")
    subroots = blocks[-1].select(F.lit("").alias("tag"), F.col("tag").alias("_of"), "digest")
    tops = superblocks(held.table(ranked(subroots, ["tag"], ["_of"], "at", "n", held, "subroots", send), "tops"), fanout, levels, held, "top")
    found = tops[-1].select("digest").first()
    none = F.array().cast("array<string>")
    start = held.table(spark.range(1).select(F.lit("").alias("tag"), none.alias("left"), none.alias("right"), F.lit("").alias("subroot")), "top")
    top = with_proofs(tops, start, fanout, levels, held).select(F.col("_of").alias("tag"), "left", "right", F.col("digest").alias("subroot"))
    out = with_proofs(blocks, held.table(top, "top_proofs"), fanout, levels, held)
    return out.select(id_col, F.col("digest").alias(leaf_col), *also, "subroot", F.lit(found[0] if found else None).cast("string").alias("root"), "left", "right")
