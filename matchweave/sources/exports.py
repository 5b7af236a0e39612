"""Exports of keyed tables in parts of bounded size, published by a manifest."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.operators.ranks import ranked
from matchweave.sources.scratch import Scratch, files_below

#: Names an exported table can't have.
PART, ROWS, FOLDER = "_part", "_rows", "_folder"
_LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize", "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def published(spark: SparkSession, path: str, name: str = "manifests") -> list[int]:
    """Numbers of the complete folders below ``path``/``name``, ascending; one without its success mark doesn't count."""
    done = [f.rsplit("/", 2)[-2] for f in files_below(spark, f"{path}/{name}") if f.endswith("/_SUCCESS")]
    return sorted(int(n) for n in done if n.isdigit())


def export_keyed(df: DataFrame, path: str, key: str, order: list[str], rows_per_file: int = 1_000_000, form: str = "parquet", files_per_task: int = 256, files_per_folder: int = 16_384) -> int:
    """Write ``df`` as files of at most ``rows_per_file`` rows of one ``key`` and publish them; returns the export's number.

    A key of more rows is cut into parts by rank in ``order``, so a hot key is spread
    over as many tasks, and a part's rows are in order. Data lie in folders of their
    own; the manifest (key, part, rows, folder), which is all that readers go by, is written
    after them and counts once its success mark is there. A lost executor or driver
    leaves nothing that a reader sees. Null keys are a key; an empty table
    publishes an empty export.

    A file costs its creation more than its rows where files are small, so tasks are dealt by number of
    files (``files_per_task`` at most on average) and not by the bytes that Spark would merge them by.
    Spark's driver holds the names of all files that one job writes or lists, so files are dealt to folders,
    ``files_per_folder`` on average, and folders are written one after another. Runs of a key's parts stay together.
    """
    spark, held = df.sparkSession, Scratch(df.sparkSession)
    number, name, slots = (published(spark, path) or [0])[-1] + 1, f"data/{uuid.uuid4().hex}", 4 * df.sparkSession.sparkContext.defaultParallelism
    placed = ranked(df, [key], order, "_rank", "_size", held).withColumn(PART, F.floor(F.col("_rank") / rows_per_file).cast("int")).drop("_size")
    counts = held.table(placed.groupBy(f"`{key}`", PART).agg(F.count("*").alias(ROWS)), "counts")
    folders = max(1, -(-counts.count() // files_per_folder))
    folder = F.pmod(F.xxhash64(f"`{key}`", F.floor(F.col(PART) / max(1, files_per_folder // 32))), F.lit(folders)).cast("int")
    counts, dealt = counts.withColumn(FOLDER, folder), f"{held.path}/dealt"
    if folders > 1:  # else each folder would read all rows again
        spread = -(-slots // folders)
        placed.withColumn(FOLDER, folder).repartition(folders * spread, FOLDER, F.pmod(F.xxhash64(f"`{key}`", PART), F.lit(spread))).write.partitionBy(FOLDER).parquet(dealt)
    for k, files in sorted(counts.groupBy(FOLDER).count().collect()):
        rows = spark.read.schema(placed.schema).parquet(f"{dealt}/{FOLDER}={k}") if folders > 1 else placed
        tasks = max(-(-files // files_per_task), min(files, slots))
        rows.repartition(tasks, f"`{key}`", PART).sortWithinPartitions(f"`{key}`", PART, "_rank").drop("_rank").write.option("header", True).partitionBy(key, PART).format(form).save(f"{path}/{name}-{k}")
    counts.withColumn(FOLDER, F.concat(F.lit(f"{name}-"), F.col(FOLDER).cast("string"))).write.parquet(f"{path}/manifests/{number}")
    held.drop()
    return number


@contextlib.contextmanager
def _listings_dropped(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Files are listed inside by at most ``tasks`` tasks and not kept by the session; its settings come back after.

    By default a listing takes up to 10,000 tasks, of which the driver keeps a record each, and 250 MB of names are kept.
    """
    before = {k: spark.conf.get(k, None) for k in _LISTINGS}
    for k, v in zip(_LISTINGS, ("0", str(tasks)), strict=True):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def read_export(spark: SparkSession, path: str, schema: str, key: str, number: int | None = None, form: str = "parquet") -> DataFrame:
    """Rows of a published export (the last, unless ``number`` is given); ``schema`` has the key and the other columns.

    Raises if nothing is published, or if the data hold other counts than the manifest says.
    The rows of several folders are copied folder by folder to a scratch table, so that the driver holds the files of one.
    """
    numbers = published(spark, path)
    if not numbers or (number or numbers[-1]) not in numbers:
        raise FileNotFoundError(f"no export {number or ''} in {path}")
    manifest = spark.read.parquet(f"{path}/manifests/{number or numbers[-1]}")
    kept = spark.createDataFrame([], schema)
    folders = sorted(manifest.groupBy(FOLDER).count().collect())
    if not folders:
        return kept
    wide = kept.withColumn(PART, F.lit(0)).schema
    source = spark.read.schema(wide).option("header", True).format(form)
    if len(folders) == 1:
        rows = source.load(f"{path}/{folders[0][FOLDER]}")
    else:
        copy, slots = f"{Scratch(spark).path}/rows", 4 * spark.sparkContext.defaultParallelism
        with _listings_dropped(spark, slots):
            for folder, files in folders:
                source.load(f"{path}/{folder}").coalesce(max(slots, files // 256)).write.mode("append").parquet(copy)
                gc.collect()  # Python's handles on Spark's tables hang in cycles, and each keeps a folder's listing in the driver
        rows = spark.read.schema(wide).parquet(copy)
    found = rows.groupBy(F.col(f"`{key}`").alias("_key"), F.col(PART).alias("_number")).agg(F.count("*").alias("_found"))
    same = manifest[key].eqNullSafe(found["_key"]) & (manifest[PART] == found["_number"]) & (manifest[ROWS] == found["_found"])
    if not manifest.join(found, same, "full").where(f"{PART} is null or _number is null").isEmpty():  # one look at the files for both sides
        raise ValueError(f"the files of {path} are not those of manifest {number or numbers[-1]}")
    return rows.select(*[f"`{c}`" for c in kept.columns])
