"""Session construction with the settings every operator in this package assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the operators rely on. AQE re-plans joins at run time (a join side whose
# measured size is under the broadcast threshold becomes a broadcast hash join, so no
# broadcast is decided from a guess), splits skewed shuffle partitions and coalesces
# small ones. UTC keeps year()/date arithmetic identical to the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Extra settings for a local single-JVM run (tests, bench): the driver is the executor.
LOCAL_CONF = {
    "spark.driver.memory": "16g",
    "spark.sql.files.maxPartitionBytes": "64m",
}


def build_session(
    master: str | None = None,
    app_name: str = "raterspark",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a SparkSession with the package defaults.

    On a cluster leave ``master`` unset so spark-submit decides; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.update(LOCAL_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is. Only when the setting is
    unset (local tests) is ``fallback`` installed. Returns the folder in use, or None.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback:
        spark.conf.set("spark.checkpoint.dir", fallback)
        spark.sparkContext.setCheckpointDir(fallback)
        return fallback
    return None


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for written stages: ``spark.checkpoint.dir``.

    A machine-local folder is installed only where that setting is unset and the session runs
    in one process (tests, notebooks); on a cluster an unset folder is an error.
    """
    found = ensure_checkpoint_dir(spark)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="rater-ckpt-"))
