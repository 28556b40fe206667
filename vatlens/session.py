"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Applied on a cluster only where the deployment did not set them.
_CLUSTER = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def get_session(master: str | None = None, app: str = "vatlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects.

    On a cluster pass ``master=None`` and let spark-submit decide; for local
    runs the shuffle width defaults to the core count instead of 200.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.cpu_count() or 8)
    else:
        # cluster: start wide and let AQE coalesce to ~256 MB partitions, so a
        # 100 TB shuffle never lands in partitions that outgrow executor memory
        from pyspark import SparkConf
        given = SparkConf()
        for k, v in _CLUSTER.items():
            if not given.contains(k):
                conf[k] = v
        if shuffle_partitions:
            conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS / object store) folder there and we use it
    as is. Only a local-mode session without the setting (tests) gets a
    fresh private folder, since no other machine has to read it.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir() or d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster must name a shared folder")
    d = tempfile.mkdtemp(prefix="vatlens-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def shuffle_width(spark: SparkSession) -> int:
    """Current ``spark.sql.shuffle.partitions`` as an int (AQE may coalesce)."""
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present
        return 200


def materialize(df):
    """Cut a long lineage: a reliable checkpoint in the shared checkpoint folder.

    Used before a table is read by several passes (model fits). Unlike
    ``localCheckpoint`` it survives the loss of the executors that wrote it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows from which a table that many passes or much work per row follow is dealt out, and rows a task gets.
APART, TASK_ROWS = 50_000, 500_000


def apart(df, rows: int):
    """A table of ``rows`` rows dealt out evenly: the splits of a file need not hold rows alike (a row group
    lies in one of them), so their number tells nothing."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def spread(df):
    """Before a generator that multiplies rows (bootstrap replicates, density
    grid): if the input has fewer partitions than the cluster has cores, deal
    its rows round-robin over all cores. Large inputs already have enough
    partitions and are left as they are (no extra shuffle)."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df
