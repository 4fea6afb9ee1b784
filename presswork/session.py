"""Session helpers: the settings every plan relies on and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Session settings the results and the plans depend on.
RUNTIME_CONF = {
    # DATE(event_timestamp) carries no zone in the reference.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # coalesce shuffle partitions to the advisory size, not to the default parallelism
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # a large side is pruned by a bloom filter of the filtered side's keys also where that side's scan,
    # before its filter, is far above Spark's 10 MB
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100g",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "presswork",
                  driver_memory: str | None = None) -> SparkSession:
    """A session with the settings the plans rely on. Master, shuffle partitions and memory are left
    to spark-submit unless given: a value set in code would override it."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    given = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.driver.memory": driver_memory}
    for key, value in given.items():
        if value is not None:
            builder = builder.config(key, str(value))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system; it is only filled in
    here (with a scratch folder) when nothing set it and all runs in one process, as in tests.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext on a Spark Connect client: the setting is all there is
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not (sc is not None and sc.master.startswith("local") and "cluster" not in sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="presswork-ckpt-")
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
                   min_partitions: int = 200) -> int:
    """Size shuffles for an input of ``input_bytes``: one initial shuffle partition per
    ``target_partition_bytes`` (``min_partitions`` at least), with AQE coalescing back to the same advisory
    size, so no partition outgrows executor memory and small stages do not fan out.
    At 100 TB that is about 400k."""
    n = max(min_partitions, -(-int(input_bytes) // target_partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(target_partition_bytes, 512 * 1024 * 1024)))
    return n
