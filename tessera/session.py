"""SparkSession helpers: sensible defaults for local tests and clusters."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera") -> SparkSession:
    """Return the active session, or build a local one for tests/bench.

    On a cluster the session already exists (``getActiveSession``); its
    settings win and nothing here overrides them.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # drop checkpoint files once their DataFrames are garbage-collected
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", "16g")
         # let the JIT compile large generated methods (local JVM we start here)
         .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


# Runtime SQL settings the operators are tuned for; safe to apply to any
# existing session (cluster sessions keep their resource settings).
RECOMMENDED_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Scoring fuses many string expressions into one stage; above ~8 KB of
    # bytecode HotSpot stops JIT-compiling a method, so split earlier.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RECOMMENDED_SQL_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared, reliable folder for ``checkpoint()``: ``spark.checkpoint.dir``.

    Uses the context's checkpoint dir when set (Spark applies the setting at
    start-up), else the session setting. Only a local-mode session without
    either (tests, bench) gets a fresh temporary folder; on a cluster the
    setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's "
                               "distributed file system) before running operators that checkpoint")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)
