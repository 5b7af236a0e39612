"""Joins that state and check how many rows may match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: list[str], side: str = "right") -> DataFrame:
    """Make the first key raise an error where its row is not unique.

    The check sits in the key itself, so no pruning of columns removes it. Rows
    with a null key match nothing and are not checked. The rows are dealt by the keys
    once, which a join on them uses again.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    fail = F.raise_error(F.concat(F.lit(f"keys of the {side} side are not unique: "), F.to_json(F.struct(*keys))))
    return df.withColumn("_n", n).withColumn(keys[0], F.when(some & (F.col("_n") > 1), fail.cast(df.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))).drop("_n")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """Equi-join on ``on``; ``validate`` is 1:1, 1:m or m:1. A breach fails when an action runs."""
    one_left, one_right = (part == "1" for part in validate.split(":"))
    if one_left:
        left = unique(left, on, "left")
    if one_right:
        right = unique(right, on, "right")
    return left.join(right, on, how)


def suffixed(df: DataFrame, keys: list[str], suffix: str, taken: list[str]) -> DataFrame:
    """Rename the columns besides ``keys`` that are in ``taken``."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keys and c in taken})


def join_chain(first: DataFrame, others: list[tuple[DataFrame, str]], on: list[str]) -> DataFrame:
    """Inner joins on the same keys, one after another; clashing names of each other table get its suffix.

    All tables are hashed on the same keys, so each is shuffled once.
    """
    out = first
    for df, suffix in others:
        out = out.join(suffixed(df, on, suffix, out.columns), on, "inner")
    return out


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, repeated ones too; a column that one side lacks is null there."""
    return first.unionByName(second, allowMissingColumns=True)


def exactly_one(df: DataFrame, condition: Column, column: str):
    """The only row's value; an error if there is none or more than one."""
    rows = df.where(condition).select(column).take(2)
    if len(rows) != 1:
        raise ValueError(f"expected exactly one row, found {'none' if not rows else 'several'}")
    return rows[0][0]
