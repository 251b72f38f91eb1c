"""Tables and checkpoints in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # application -> the folder of a session on one machine


def base(spark: SparkSession) -> str:
    """The shared folder. Where none is set, one of this machine's own is set, but only if this machine is all there is."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="run-shared-")
    return at.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new name under the shared folder."""
    return f"{base(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    sc, at = df.sparkSession.sparkContext, base(df.sparkSession)
    now = sc.getCheckpointDir()
    if now is None or at.split(":")[-1] not in now:
        sc.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: lineage ends, later readers prune columns."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that `stored` wrote and nothing reads any more."""
    sc, files = df.sparkSession.sparkContext, df.inputFiles()
    if files:
        at = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if at.getParent().getName() == base(df.sparkSession).rsplit("/", 1)[-1]:
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores before costly work on each: a table read in fewer pieces than there are cores is dealt out first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
