"""File scans and writers for landing-zone data."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.sources import headers
from matchweave.sources.scratch import scratch_table

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, keep_corrupt: bool = False, index: str | None = None, file: str | None = None, block: str | None = None) -> DataFrame:
    """The declared columns of CSV files with headers (a file, folder, glob or list of them), matched by name.

    Files may have their columns in any order. A column that a file lacks is null,
    one that isn't declared is left out, and an unnamed first column, as row numbers
    are written, is left out or, if named by ``index``, read as that declared column.
    Files of the same header are one scan. Empty files give no rows; a file that has
    no declared column or has one twice raises (``quarantine.checked_scan`` sets it
    aside instead). With ``keep_corrupt`` a row that doesn't fit is kept whole in
    ``_corrupt_record``; otherwise its bad fields are null. ``file`` and ``block`` name
    columns for a row's file and the start of its split.
    """
    found = headers.layouts(spark, paths)
    for one in found:
        if fault := headers.faults(one.names, schema):
            raise ValueError(f"{fault}: {', '.join(one.files[:3])}")
    some = [one for one in found if one.names] or found[:1]
    if not some:
        raise FileNotFoundError(str(paths))
    rows = [headers.scan(spark, one, schema, index, CORRUPT if keep_corrupt else None, file, block) for one in some]
    return functools.reduce(DataFrame.unionByName, rows)


def with_file_key(df: DataFrame, pattern: str, name: str, file: str = "_metadata.file_path") -> DataFrame:
    """Add a long key taken from each row's file path by the first group of ``pattern``; null without a match.

    Files of several headers need the column that ``read_csv`` was told to name the file in.
    """
    return df.withColumn(name, F.regexp_extract(file, pattern, 1).try_cast("long"))


def in_file_order(df: DataFrame, name: str, file: str = "file", block: str = "block") -> DataFrame:
    """Add ``name``, each row's place in its file from 0, to rows read with ``file`` and ``block``.

    The rows of a split lie in order of their running number, splits in order of their
    start. Only each split's rows are counted and the counts summed, so that a large
    file isn't one task's.
    """
    placed = scratch_table(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    splits = placed.groupBy(file, block).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.join(splits.withColumn("_before", before), [file, block])
    return numbered.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before")).cast("long")).select(*df.columns, name)


def good_files(df: DataFrame, required: Iterable[Column], file: str = "_metadata.file_path") -> DataFrame:
    """Rows of files in which every row meets all ``required`` conditions; others are dropped whole.

    The file's name is the key; sums are taken before the shuffle.
    """
    named = df.withColumn("_file", F.col(file))
    fails = F.lit(False)
    for condition in required:
        fails = fails | ~F.coalesce(condition, F.lit(False))
    bad = named.where(fails).select("_file").distinct()
    return named.join(bad, "_file", "left_anti").drop("_file")


def read_json(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def write_csv(df: DataFrame, path: str, index_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header; ``index_by`` adds a leading row number from 0 in that order."""
    if index_by:
        df = with_index(df, index_by, "row")
    df.write.mode(mode).option("header", True).csv(path)


def with_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Number rows from 0 in a stated order, without gathering them in one task.

    Rows are sorted into ranges and written once with the number of their range, so
    that counts and rows see the same ranges; a range's first number is the count of
    rows before it.
    """
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    part, inside, before = (free_name(df, f"_{name}_{x}") for x in ("part", "in", "before"))
    ranged = scratch_table(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    numbered = ranged.withColumn(inside, F.row_number().over(Window.partitionBy(part).orderBy(*keys)))
    counts = ranged.groupBy(part).agg(F.count("*").alias("_n"))  # one row for each range
    first = counts.select(part, F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return numbered.join(first, part).select((F.col(inside) + F.col(before) - 1).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_per_key(df: DataFrame, path: str, key: str, form: str = "csv", mode: str = "errorifexists") -> None:
    """One folder per value of ``key`` (say, a game), in one pass."""
    df.repartition(key).write.mode(mode).option("header", True).partitionBy(key).format(form).save(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def collect_team(schedule: DataFrame, events: DataFrame, team: str, path: str, mode: str = "errorifexists") -> None:
    """Write the events of a team's games, home and away, one folder per game_id."""
    games = team_games(schedule, team).select("game_id").distinct()
    write_per_key(events.join(games, "game_id", "left_semi"), path, "game_id", mode=mode)


def team_games(schedule: DataFrame, team: str) -> DataFrame:
    """A team's games, home then away."""
    return schedule.where(F.col("home_team") == team).unionByName(schedule.where(F.col("away_team") == team))
