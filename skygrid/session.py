"""Session helpers: table access, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (local
    mode, tests) a temporary folder of this machine is chosen, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = spark.conf.get("skygrid.local.shared", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="skygrid-")
        spark.conf.set("skygrid.local.shared", own)
    return own


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str, drop_after: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The path is appended to drop_after so that the caller can delete it.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, purpose)
    df.write.parquet(path)
    if drop_after is not None:
        drop_after.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """df as a reliable checkpoint in the shared folder; then the scratch folders are removed, since nothing needs them any more.

    The checkpoint lives as long as a plan refers to it: Spark deletes it afterwards
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(eager=True)
    for path in scratch or ():
        remove(spark, path)
    if scratch:
        scratch.clear()
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system of its scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
