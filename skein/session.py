"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every skein job relies on: AQE re-plans joins and coalesces partitions from the
# real shuffle sizes, which is where broadcast decisions get their proven size bound.
_BASE_CONF = {
    # Static broadcasts only below 10 MB: the planner knows the size of a file scan from its
    # listing. Everything else is left to AQE, which measures a finished shuffle stage first.
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.enabled": "true",
    # HotSpot does not JIT-compile methods over 8000 bytes of bytecode; larger whole-stage
    # functions fall back to per-expression code that is split into compilable methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "skein", shuffle_partitions: int | None = None,
              time_zone: str | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect.

    ``master`` is set only when given: on a cluster it comes from spark-submit, and a plain
    ``python`` run falls back to Spark's own local default.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if time_zone:
        b = b.config("spark.sql.session.timeZone", time_zone)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local"):
        ensure_checkpoint_dir(spark)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 256 << 20) -> int:
    """Size the first shuffle for the input at hand; AQE then coalesces small partitions.

    AQE can merge partitions after a shuffle but cannot split them (outside skew joins), so the
    initial partition count must be large enough for the biggest stage: about one per
    ``target_bytes`` of input (100 TB -> ~400k). Returns the number set.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(input_bytes) // int(target_bytes)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(min(int(target_bytes), 256 << 20)))
    return n


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there; it is used as is. Only a local
    master (driver and executors in one process, as in tests) may go without: it gets a private
    folder. On a cluster a machine-local folder would lose data, so the setting is required.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="skein-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for materialised intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/skein/{name}"


def staged(df, name: str):
    """Write ``df`` under the shared checkpoint folder and read it back: its size is then known to the
    planner, and nothing before it is computed again."""
    import uuid

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
