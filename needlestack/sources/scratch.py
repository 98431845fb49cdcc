"""Where intermediate tables go: the shared folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    A cluster names it in spark.checkpoint.dir. Only where nothing is set, as in
    tests on one machine, a new temporary folder is made and registered.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="needlestack-"))
        current = sc.getCheckpointDir()
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is ever overwritten."""
    return f"{checkpoint_root(spark).rstrip('/')}/needlestack/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once as parquet in the shared folder and read it back.

    Used where several jobs read the same derived frame: executors may be lost
    at any time without a recompute, and the lineage is cut.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. Keeps partitions and the order inside them."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
