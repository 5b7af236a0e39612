"""CSV files by the names in their headers: files of one header are one scan."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """A header and the files that have it; a header of no names is that of files without a line."""

    names: tuple[str, ...]
    files: tuple[str, ...]


def first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line): each file's first line that isn't blank; null if it has none.

    Small files share a task, which reads them; of a file that Spark splits, each
    split is a task of its own and stops after its first batch of lines.
    """
    one_task = spark.conf.get("spark.sql.files.maxPartitionBytes")
    one_task = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(one_task)

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for line, file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > one_task and (start or file in done):
                    return  # nothing more in this task: a part of a large file has no company
                if not start and file not in done and line.strip():
                    done.add(file)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([line])], names=["file", "line"])

    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size")
    found = lines.mapInArrow(heads, "file string, line string")
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"))
    return listed.join(found, "file", "left")


def names_of(line: str | None) -> tuple[str, ...]:
    """The names of a header line, without blanks around them or a byte order mark."""
    return tuple(n.strip() for n in next(csv.reader([line.lstrip("﻿")]))) if line else ()


def layouts(spark: SparkSession, paths: str | list[str]) -> list[Layout]:
    """The distinct headers with their files. The driver holds the files' names, as Spark's own listing does."""
    groups = first_lines(spark, paths).groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    merged: dict[tuple[str, ...], list[str]] = {}
    for g in groups:
        merged.setdefault(names_of(g["line"]), []).extend(g["files"])
    return [Layout(names, tuple(sorted(files))) for names, files in sorted(merged.items())]


def faults(names: Iterable[str], schema: T.StructType, required: Iterable[str] = ()) -> str | None:
    """What is wrong with a header: a declared column twice, a required one or all of them absent; None if nothing is."""
    names, declared = list(names), schema.fieldNames()
    if not names:
        return None
    if twice := sorted(n for n, k in Counter(names).items() if k > 1 and n in declared):
        return f"header repeats {', '.join(twice)}"
    if absent := [n for n in required if n not in names]:
        return f"header lacks {', '.join(absent)}"
    return None if set(names) & set(declared) else "header has no declared column"


def layout_schema(names: Iterable[str], schema: T.StructType, index: str | None = None) -> T.StructType:
    """Fields by place in the file: declared ones with their type, others as text under a name of their own.

    An unnamed first column is a row index: the declared column ``index``, or left out.
    """
    declared = {f.name: f for f in schema.fields}
    named = [index if not k and not n and index in declared else n for k, n in enumerate(names)]
    return T.StructType([T.StructField(n, declared[n].dataType) if n in declared and n not in named[:k] else T.StructField(f"_other_{k}", T.StringType()) for k, n in enumerate(named)])


def scan(spark: SparkSession, layout: Layout, schema: T.StructType, index: str | None = None, corrupt: str | None = None, file: str | None = None, block: str | None = None) -> DataFrame:
    """The declared columns of a layout's files, absent ones null; ``corrupt`` (the line of a row that doesn't fit), ``file`` and ``block`` (start of its split) are added under those names."""
    own = layout_schema(layout.names, schema, index) if layout.names else schema
    has = set(own.fieldNames())
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
    if corrupt:
        own = T.StructType([*own.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    rows = reader.schema(own).csv(list(layout.files))
    chosen = [F.col(f"`{f.name}`") if f.name in has else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    more = [F.col(corrupt)] if corrupt else []
    more += [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", file), ("file_block_start", block)) if n]
    return rows.select(*chosen, *more)
