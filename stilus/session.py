"""Session helpers: reading the tables of a folder and cutting lineage safely."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER: dict[int, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder` (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, rows read from files, in at least as many partitions as tasks run side by side.

    A table of fewer files or row groups than that would leave cores idle in what is dear per row; its
    rows are dealt out first. A table of more partitions, as any large one is, stays as it lies.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session that every executor can reach.

    It lies under `spark.checkpoint.dir`. Only where that setting is absent and Spark runs in one
    process (tests) is a folder of this machine used; on a cluster without the setting this fails.
    """
    key = id(spark.sparkContext)
    if key not in _FOLDER:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="stilus-")
        _FOLDER[key] = f"{root.rstrip('/')}/stilus-{uuid.uuid4().hex}"
    return _FOLDER[key]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Later stages read the written columns they need instead of computing `df` again, and a lost
    executor costs no more than its running tasks.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what `materialize` wrote in this session."""
    path = _FOLDER.pop(id(spark.sparkContext), None)
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
