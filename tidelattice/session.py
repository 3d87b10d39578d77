"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidelattice")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for costly row work on a scan that has fewer splits than cores.

    A scan with enough splits, as on any large table, is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def cut_lineage(df: DataFrame, once: bool = False) -> DataFrame:
    """Materialise `df` reliably so a lost executor does not replay what made it.

    The folder is the one the cluster names in spark.checkpoint.dir; a temporary
    one is set only where no folder is configured (tests on one machine).

    A checkpoint counts its rows first and computes the last stage again to write it.
    With `once` the rows are held in between, for a last stage that costs more than
    holding its rows (a Python pass, windows of lists).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidelattice-ckpt-"))
    if not once:
        return df.checkpoint(eager=True)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.select("*").checkpoint(eager=True)
    finally:
        held.unpersist()
