"""Session helpers: one place for the configuration the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job relies on: adaptive execution (runtime re-plan, partition
# coalescing, skewed-join splitting), UTC for date arithmetic, and no UI server.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "barlens", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks. On a cluster, use the cluster's session."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints and written intermediates."""
    return spark.conf.get("spark.checkpoint.dir", None) or _sc_dir(spark)


def _sc_dir(spark: SparkSession) -> str | None:
    opt = spark.sparkContext._jsc.sc().getCheckpointDir()
    return opt.get() if opt.isDefined() else None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Where the cluster names none, a folder in the session's
    warehouse, which driver and executors share as well; never a temporary folder of one machine."""
    d = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if _sc_dir(spark) is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
