"""Session helpers: building a session, the shared checkpoint folder, and a
size check before any broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "huddle", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and is read, never replaced.  Only
    when it is unset (tests, local runs) a fresh scratch folder is taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        # a machine-local folder is not reachable from other executors
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="huddle-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "table", schema=None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: later jobs start from files every executor can reach (survives the
    loss of executors; never a local checkpoint), and the plan they see is a
    plain scan, with column pruning and filter pushdown.  With the ``schema``
    given, no job reads it from the files."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/huddle-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def _broadcast_limit(spark: SparkSession) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = str(raw).strip().lower()
    mult = 1
    for suffix, m in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("b", 1)):
        if raw.endswith(suffix):
            raw, mult = raw[: -len(suffix)], m
            break
    try:
        val = int(float(raw) * mult)
    except ValueError:
        val = 10 << 20
    return val if val > 0 else 0


def estimated_size(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan, in bytes.

    Without column statistics the estimate of an aggregate or filter is its
    input's size scaled by row width, so it is an upper bound of the real
    output: a side under the limit by this estimate is under it in fact.
    """
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else str(size.toString()))
    except Exception:  # noqa: BLE001 - no estimate means "do not broadcast"
        return 1 << 62


def bounded_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its estimated size is under the
    limit (default: the session's autoBroadcastJoinThreshold).  Beyond it the
    join stays a shuffle join, which AQE may still turn into a broadcast from
    runtime sizes, and whose hot keys AQE's skew-join split handles."""
    spark = df.sparkSession
    lim = _broadcast_limit(spark) if limit is None else limit
    if lim > 0 and estimated_size(df) <= lim:
        return F.broadcast(df)
    return df


def cluster_conf(input_bytes: int, executors_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large run, sized from the input: initial shuffle
    partitions so a partition is about ``target_partition_bytes`` before AQE
    coalesces them, scan splits of the same size, AQE skew-join splitting of
    partitions over 4x the median, and at least two waves of tasks."""
    parts = max(2 * executors_cores, input_bytes // target_partition_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.parquet.filterPushdown": "true",
    }
