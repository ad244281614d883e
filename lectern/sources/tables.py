"""Named Parquet tables below a folder, and tables kept between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name`: a Parquet file or a folder of them."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach; deleted when the application ends, unless it is a lasting one.

    Only where that is unset (tests on one machine) is a folder of this machine used, and only under
    a local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    if not lasting:
        files.deleteOnExit(at)  # results are read lazily, so nothing is deleted before the driver ends
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_path(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, each: int = 400_000) -> DataFrame:
    """The rows of df parted by keys, about `each` of `rows` in a partition, where the session's number of partitions would give more.

    So what a task holds doesn't grow with the input. Groups, windows and joins by these keys need no further shuffle.
    """
    n = -(-rows // each)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
