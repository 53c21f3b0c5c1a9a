"""Versions of a table as Parquet folders behind a pointer, through Hadoop's file system so that any store works."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commit(df: DataFrame, folder: str, options: dict[str, str] | None = None) -> str:
    """Write a version and point to it; readers see the old one until the pointer moves."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.options(**(options or {})).parquet(f"{folder}/versions/{name}")
    fs, pointer = _fs(spark, f"{folder}/CURRENT")
    out = fs.create(pointer, True)
    out.write(bytearray(name.encode()))
    out.close()
    return name


def read(spark: SparkSession, folder: str) -> DataFrame:
    fs, pointer = _fs(spark, f"{folder}/CURRENT")
    stream = fs.open(pointer)
    name = bytes(stream.readAllBytes()).decode()
    stream.close()
    return spark.read.parquet(f"{folder}/versions/{name}")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to spark.checkpoint.dir and read again, which cuts its lineage and outlives executors.

    Where that is unset and the master is local (tests), a folder of the machine takes its place.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="treelake-")
        spark.sparkContext.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that are broadcast at most.
FEW = 10_000


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has FEW rows at most; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def store(files: DataFrame, contents: DataFrame, folder: str) -> None:
    """A catalog as versions of two tables in path order: metadata, and contents apart.

    The order gives each file and row group a narrow range of paths, so that a path or a prefix reads few of them;
    ids, which have no order, get Bloom filters.
    """
    ordered = lambda df: df.repartitionByRange("path").sortWithinPartitions("path")
    commit(ordered(files), f"{folder}/files", {"parquet.bloom.filter.enabled#id": "true"})
    commit(ordered(contents), f"{folder}/contents")


def binary_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, size, mtime, content) of files in a store; content is read only where it is asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).selectExpr("path", "length AS size", "unix_millis(modificationTime) AS mtime", "content")
