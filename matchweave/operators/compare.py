"""Two-sided stat comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unpivot(df: DataFrame, keys: list[str], categories: list[str], name: str = "category", value: str = "value") -> DataFrame:
    """Wide stats to (keys, category, value); values are doubles, text that is no number is null."""
    cast = df.select(*[f"`{k}`" for k in keys], *[F.col(f"`{c}`").try_cast("double").alias(c) for c in categories])
    return cast.unpivot(keys, categories, name, value)


def shares(long: DataFrame, game: list[str], side: str, first, second) -> DataFrame:
    """One row per game and category with both sides' values and shares of the total.

    A total of 0 counts as 1, so both shares are 0.
    """
    own = lambda s: F.max(F.when(F.col(side) == s, F.col("value")))
    both = long.groupBy(*game, "category").agg(own(first).alias("a"), own(second).alias("b"))
    total = F.when(F.col("a") + F.col("b") == 0, 1.0).otherwise(F.col("a") + F.col("b"))
    return both.withColumns({"share_a": F.col("a") / total, "share_b": F.col("b") / total})


def with_ordinal(df: DataFrame, categories: list[str], name: str = "place", category: str = "category") -> DataFrame:
    """Add a category's place in ``categories`` from 0; null for one that isn't in it."""
    return df.withColumn(name, F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(categories) for x in (c, k)]), F.col(category)))


def labelled(df: DataFrame, columns: list[str], pattern: str = "%.1f") -> DataFrame:
    """Add a text of each numeric column, formatted by ``pattern``, under the column's name and _label; null stays null."""
    return df.withColumns({f"{c}_label": F.when(F.col(f"`{c}`").isNotNull(), F.format_string(pattern, F.col(f"`{c}`").cast("double"))) for c in columns})


def matrix(long: DataFrame, keys: list[str], categories: list[str], name: str = "values") -> DataFrame:
    """One array of values per ``keys`` in order of ``categories``; null where a category is missing."""
    at = F.map_from_entries(F.collect_list(F.struct("category", "value")))
    grouped = long.where(F.col("category").isin(categories)).groupBy(*keys, "category").agg(F.max("value").alias("value")).groupBy(*keys).agg(at.alias("_at"))
    return grouped.select(*keys, F.array(*[F.element_at("_at", F.lit(c)) for c in categories]).alias(name))


def running_total(long: DataFrame, by: list[str], order: list[str], value: str = "value", name: str = "running") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn(name, F.sum(value).over(w))


def bar_track(df: DataFrame, length: float = 20.0) -> DataFrame:
    """Bar lengths of both sides on one track and where the second starts."""
    return df.withColumns({"bar_a": F.col("share_a") * length, "bar_b": F.col("share_b") * length, "start_b": F.col("share_a") * length})
