"""Shared-folder tables and session settings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and the master is local (tests), a folder of the machine is set as
    checkpoint directory, which is right as all tasks run on that machine.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="treelake-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables of which everything that reads them has itself been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of up to so many rows, 8 bytes each, are broadcast.
BROADCAST_ROWS = 1 << 20


def _among(df: DataFrame, keys: DataFrame, key: Column, how: str) -> DataFrame:
    keys = written(keys.toDF("__key").distinct(), "keys")
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, key == F.col("__key"), how)


def having(df: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """Rows of df whose ``key``, a long, is one of ``keys``, a frame of one column.

    A few keys are broadcast, so that df, which may hold whole texts, isn't shuffled; more are joined by Spark's own choice.
    """
    return _among(df, keys, key, "left_semi")


def lacking(df: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """Rows of df whose ``key`` is null or none of ``keys``; as ``having``."""
    return _among(df, keys, key, "left_anti")


def most_frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """Rows of a written table of counts that are among the ``limit`` most frequent, found from a histogram.

    Of like counts (an eighth of an octave, single counts below 12) either all or none are taken, so that no task sorts or sends more than is kept.
    """
    step = F.floor(8 * F.log2(n)).cast("int")
    used, least = 0, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        used += row["count"]
        if used > limit:
            least = row["step"] + 1
            break
    return counts.where(step >= least)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
