"""Tables written once into the shared folder of the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared folder named in ``spark.checkpoint.dir``.

    A local session without that setting takes a folder of its machine. On a
    cluster executors would each write to their own disk and a reader would see a
    part, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "matchweave")
    return f"{root}/matchweave/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def files_below(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder; none if it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    if store.exists(path):
        found = store.listFiles(path, True)
        while found.hasNext():
            out.append(found.next().getPath().toString())
    return out


class Scratch:
    """A folder of tables in the application's scratch folder; ``drop`` deletes them together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.names = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}", set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back.

        Cuts the lineage with files that outlive any executor. A name that is in use gets a number.
        """
        name = name if name not in self.names else f"{name}_{len(self.names)}"
        self.names.add(name)
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder of its own and read back."""
    return Scratch(df.sparkSession).table(df, name)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it once no result of theirs is needed."""
    delete(spark, scratch_root(spark))
