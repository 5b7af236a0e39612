"""Ranks and exact medians of groups of any size, by counted ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.sources.scratch import Scratch

_PLACE = (1 << 33) - 1  # the lower bits of monotonically_increasing_id count rows inside a partition


def ranked(rows: DataFrame, by: list[str], order: list[str], rank: str, size: str, held: Scratch, name: str = "ranked", send: int = 1_000_000) -> DataFrame:
    """Add each row's ``rank`` in its group from 0 (nulls first) and the group's ``size``.

    Rows are sorted into ranges of group and order, equal rows as they lie, so that
    neither a group nor a value is one task's, and written once with their place in
    the range. Each range's rows are then counted by group, which gives every range the
    rank it starts at: one small row a range and group, sent if there are at most
    ``send``. Null keys are a group of their own.
    """
    keys = [f"`{c}`" for c in (*by, *order)]
    ranged = rows.withColumn("_as_read", F.monotonically_increasing_id()).repartitionByRange(*keys, "_as_read").sortWithinPartitions(*keys, "_as_read").drop("_as_read")
    ranged = held.table(ranged.withColumn("_id", F.monotonically_increasing_id()), name)
    ranged = ranged.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit(_PLACE)).alias("_place")).drop("_id")
    counts = ranged.groupBy("_part", *[f"`{c}`" for c in by]).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    group = ", ".join(f"`{c}`" for c in by) or "1"
    before = f"coalesce(sum(_n) over (partition by {group} order by _part rows between unbounded preceding and 1 preceding), 0)"
    starts = held.table(counts.select(F.col("_part").alias("_p"), *[F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by)], (F.expr(before) - F.col("_first")).alias("_start"), F.expr(f"sum(_n) over (partition by {group})").alias(size)), f"{name}_starts")
    if starts.count() <= send:
        starts = F.broadcast(starts)
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_by{k}"))
    return ranged.join(starts, same).select(*[f"`{c}`" for c in rows.columns], (F.col("_place") + F.col("_start")).alias(rank), size)


def medians(df: DataFrame, by: list[str], columns: list[str], most: int = 1_000_000) -> DataFrame:
    """Exact median of each of ``columns`` by group, null if a group has no value; doubles.

    Groups of at most ``most`` rows take Spark's ``median``, which holds a group's
    values at once. Of larger groups only ranges are held: rows are ranked and the
    one or two middle ones picked. Both are exact, so that ``most`` changes no result.
    """
    held = Scratch(df.sparkSession)
    rows = df.select(*[f"`{c}`" for c in by], *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    sizes = held.table(rows.groupBy(*[f"`{c}`" for c in by]).agg((F.count("*") > most).alias("_large")), "sizes")
    large = sizes.where("_large")
    few = large.count()  # at most one in ``most`` rows of the input
    small = rows
    if few:
        marks = large.select(*[F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by)])
        marks = F.broadcast(marks) if few <= 1_000_000 else marks
        same = F.lit(True)
        for k, c in enumerate(by):
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_by{k}"))
        small, rows = rows.join(marks, same, "left_anti"), rows.join(marks, same, "left_semi")
    out = small.groupBy(*[f"`{c}`" for c in by]).agg(*[F.median(f"`{c}`").alias(c) for c in columns])
    if not few:
        return out
    found = large.select(*[f"`{c}`" for c in by])
    for k, c in enumerate(columns):
        own = rows.select(*[f"`{b}`" for b in by], F.col(f"`{c}`").alias("_value")).where("_value is not null")
        middle = ranked(own, by, ["_value"], "_rank", "_size", held, f"ranked_{k}").where("_rank in (floor((_size - 1) / 2), floor(_size / 2))")
        middle = middle.groupBy(*[F.col(f"`{b}`").alias(f"_by{j}") for j, b in enumerate(by)]).agg((F.min("_value") * 0.5 + F.max("_value") * 0.5).alias(f"_m{k}"))
        same = F.lit(True)
        for j, b in enumerate(by):
            same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"_by{j}"))
        found = found.join(middle, same, "left").drop(*[f"_by{j}" for j in range(len(by))])
    return out.unionByName(found.select(*[f"`{b}`" for b in by], *[F.col(f"_m{k}").alias(c) for k, c in enumerate(columns)]))
