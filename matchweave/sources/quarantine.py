"""CSV files judged in the pass that reads them: good rows beside a verdict on every file."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.sources import headers
from matchweave.sources.scratch import Scratch

#: Names of the added columns; a declared column can't have them.
FILE, BLOCK, PLACE, REASON, LINE, BAD = "_file", "_block", "_place", "_reason", "_line", "_corrupt_record"
VERDICT = "file string, reason string, first_bad_row long, first_bad_line string, n_rows long, n_bad long"


def misfit(names: list[str], schema: T.StructType, own: T.StructType) -> Column:
    """Why a kept line doesn't fit its header: the count of its fields, or the first column whose value has another type."""
    # One field more than the header has; an empty field is "", only one that isn't there is null.
    cells = F.from_csv(BAD, ", ".join(f"c{k} string" for k in range(len(names) + 1)), {"nullValue": "\x00", "emptyValue": ""})
    declared = set(schema.fieldNames())
    out = F.when(cells[f"c{len(names)}"].isNotNull(), "too many fields").when(cells[f"c{len(names) - 1}"].isNull(), "too few fields")
    for k, field in enumerate(own.fields):
        if field.name in declared:
            cell = cells[f"c{k}"]
            out = out.when((F.length(cell) > 0) & F.col(f"`{field.name}`").isNull(), f"no {field.dataType.simpleString()} in {field.name}")
    return out.otherwise("malformed line")


def judged(spark: SparkSession, layout: headers.Layout, schema: T.StructType, index: str | None, conditions: dict[str, Column]) -> DataFrame:
    """A layout's declared columns with file, split, place in the task, and reason and text of a bad row."""
    rows = headers.scan(spark, layout, schema, index, BAD, FILE, BLOCK)
    bad = F.when(F.col(BAD).isNotNull(), misfit(list(layout.names), schema, headers.layout_schema(layout.names, schema, index)))
    for reason, holds in conditions.items():
        bad = bad.when(~F.coalesce(holds, F.lit(False)), reason)
    text = F.coalesce(F.col(BAD), F.to_csv(F.struct(*[f"`{c}`" for c in schema.fieldNames()])))
    return rows.withColumns({REASON: bad, PLACE: F.monotonically_increasing_id()}).withColumn(LINE, F.when(F.col(REASON).isNotNull(), text)).drop(BAD)


def verdicts_of(rows: DataFrame) -> DataFrame:
    """One row a file, from its splits' counts: the reason, number (from 1, blank lines and header not counted) and text of its first bad row.

    A file whose last row has too few fields is called truncated.
    """
    first = F.min(F.when(F.col(REASON).isNotNull(), F.struct(PLACE, REASON, LINE))).alias("bad")
    splits = rows.groupBy(FILE, BLOCK).agg(F.count("*").alias("n"), F.count(REASON).alias("n_bad"), F.min(PLACE).alias("start"), F.max(PLACE).alias("stop"), first)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("bad")[PLACE] - F.col("start") + F.col("before") + 1
    splits = splits.withColumn("before", before).withColumn("bad", F.when(F.col("bad").isNotNull(), F.struct(number.alias("number"), F.col("bad")[REASON].alias("reason"), F.col("bad")[LINE].alias("line"))))
    files = splits.groupBy(FILE).agg(F.min("bad").alias("bad"), F.sum("n").alias("n_rows"), F.sum("n_bad").alias("n_bad"))
    cut = (F.col("bad.reason") == "too few fields") & (F.col("bad.number") == F.col("n_rows"))
    return files.select(F.col(FILE).alias("file"), F.when(cut, "truncated").otherwise(F.col("bad.reason")).alias("reason"), F.col("bad.number").alias("first_bad_row"), F.col("bad.line").alias("first_bad_line"), "n_rows", "n_bad")


def checked_scan(spark: SparkSession, paths: str | list[str], schema: T.StructType, required: tuple[str, ...] = (), conditions: dict[str, Column] | None = None, index: str | None = None, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of good files, verdict on every file).

    A file is set aside whole if its header lacks a ``required`` column, has no
    declared one or has one twice, if a row doesn't fit (too few or many fields, a
    value of another type), or if a row breaks one of ``conditions`` (reason: what
    must hold; null counts as broken). Columns go by name as in ``files.read_csv``.
    A verdict has the file, its reason (null: good), its first bad row and the row's
    text, and its counts of rows and bad rows; a file with a bad header isn't read, its
    first bad row is 0, the header. An empty file is good. ``file`` names a column for
    a row's file.

    Every file is read once: rows are written to a scratch table with their reasons,
    verdicts are counted from it per split and file, and good rows are what no bad
    file holds.
    """
    held, found = Scratch(spark), headers.layouts(spark, paths)
    wrong = [(one, fault) for one in found if (fault := headers.faults(one.names, schema, required))]
    rest = [one for one in found if one.names and not headers.faults(one.names, schema, required)]
    empty = [(name, None, None, None, 0, 0) for one in found if not one.names for name in one.files]
    known = [(name, fault, 0, ",".join(one.names), 0, 0) for one, fault in wrong for name in one.files]
    verdicts = spark.createDataFrame(empty + known, VERDICT)
    if not rest:
        return spark.createDataFrame([], T.StructType([*schema.fields, *([T.StructField(file, T.StringType())] if file else [])])), verdicts
    rows = functools.reduce(DataFrame.unionByName, [judged(spark, one, schema, index, conditions or {}) for one in rest])
    rows = held.table(rows, "rows")
    verdicts = held.table(verdicts.unionByName(verdicts_of(rows)), "verdicts")
    good = rows.join(verdicts.where("reason is not null").select(F.col("file").alias(FILE)), FILE, "left_anti")
    return good.select(*[f"`{c}`" for c in schema.fieldNames()], *([F.col(FILE).alias(file)] if file else [])), verdicts
