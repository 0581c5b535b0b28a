"""Shared storage for intermediate tables, so that jobs survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the write that needed them has ended, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set, a folder of this machine, which only a local master shares."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get() if own.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set: executors of {master} share no folder")
        folder = tempfile.mkdtemp(prefix="groundledger-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, stem: str) -> str:
    """A folder of its own in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: lineage ends here.

    The table goes with release(), at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def pieces(spark: SparkSession) -> int:
    """Parts that settle_by() cuts a table into."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """settle(), in buckets of the key: joins, groups and windows by it shuffle nothing of what they read."""
    spark = df.sparkSession
    name = f"settled_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        rows = df.repartition(pieces(spark), key)
        rows.write.format("parquet").bucketBy(pieces(spark), key).option("compression", "zstd").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    out = spark.table(name)
    _PATHS[out] = path
    return out


def release(*settled: DataFrame) -> None:
    """Deletes settled tables that nothing still to be run reads."""
    for df in settled:
        path = _PATHS.pop(df, None)
        if path:
            stem = path.rpartition("/")[2]
            if stem.startswith("settled_"):
                df.sparkSession.sql(f"drop table if exists {stem}")
            system, where = _file_system(df.sparkSession, path)
            system.delete(where, True)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names made from the stems that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
