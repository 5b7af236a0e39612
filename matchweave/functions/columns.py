"""Column helpers that keep the missing-value rules of eager dataframes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def differs(column: Column, value) -> Column:
    """Inequality that keeps missing values: true unless the column holds ``value``."""
    return ~column.eqNullSafe(F.lit(value))


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b; null, NaN and infinite results become ``otherwise``."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    bad = r.isNull() | F.isnan(r) | (F.abs(r) == float("inf"))
    return F.when(bad, F.lit(otherwise)).otherwise(r)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def float_and_long_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.LongType)]


def without_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop the columns whose names match a regular expression."""
    return df.select(*[f"`{c}`" for c in df.columns if not re.match(pattern, c)])


def names_without(names: Iterable[str], parts: Iterable[str]) -> list[str]:
    parts = list(parts)
    return [n for n in names if not any(p in n for p in parts)]


def clamp_alpha(share: Column, least: float) -> Column:
    """Scale a share of 0 to 1 into ``least`` to 1."""
    return share * (1 - least) + least


def lookup(column: Column, table: dict) -> Column:
    """A value from a small dictionary; null if it has no such key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)
