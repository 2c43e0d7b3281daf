"""Session settings for tests and the benchmark.

On a cluster the caller owns the session; nothing here is required there. The
library only reads ``spark.checkpoint.dir`` from the session when it needs a
shared folder, and sets one only where none is configured (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings the plans rely on. All are defaults in Spark 4 except
# the session time zone; set again so a session with other defaults behaves
# the same.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "linelift", event_log_dir: str | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g")
               # No Python call-site capture per DataFrame call (error-message
               # context only); it costs several JVM round trips per function.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               # Keep the generated classes of every report: the default (100)
               # is below what nine interleaved reports use, and recompiling
               # dominates small runs.
               .config("spark.sql.codegen.cache.maxEntries", "2000"))
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    for k, v in SQL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; a scratch folder only
    for a local master with none configured (tests, the local benchmark)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset on a cluster; name a shared folder")
    local = tempfile.mkdtemp(prefix="linelift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local
