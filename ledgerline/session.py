"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every job relies on; applied only where the caller has not set them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",  # rows may hold long texts
    "spark.sql.ansi.enabled": "true",
}


# Starting points for a large cluster (apply with build_session(extra=CLUSTER_CONF) or spark-submit --conf).
# Shuffle partitions are set high and AQE coalesces them to ~256 MB each; skewed partitions above 512 MB are
# split; files are read in 256 MB splits; tenant model fits share the cluster through FAIR pools.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.scheduler.mode": "FAIR",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app_name: str = "ledgerline",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session builder. On a cluster, pass your own session instead."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"  # checkpoints go with the frames that use them
    conf["spark.driver.memory"] = os.environ.get("LEDGERLINE_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime SQL settings the operators assume (UTC, AQE) if unset; ship the package to the workers."""
    ship_package(spark)
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            try:
                cur = spark.conf.get(k, None)
            except Exception:  # pragma: no cover - conf access on odd sessions
                cur = None
            if k == "spark.sql.session.timeZone" or cur is None:
                spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the workers once per application, so that Python tasks can import it anywhere.

    Spark's own file server distributes the archive; the driver-local copy is only what it serves from.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerline-src-"), "ledgerline_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` from the session. Only a local-mode session
    (tests, benches) gets a scratch folder of its own when the setting is
    absent; on a cluster a machine-local folder would lose data with the
    executor, so we refuse instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if root:
        if not spark.sparkContext.getCheckpointDir():   # conf given at runtime: make checkpoint() use it
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder below the shared checkpoint folder; the file system drops it when the driver ends."""
    path = f"{checkpoint_root(spark)}/{label}/{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def side_by_side(spark: SparkSession, jobs: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Results of independent pieces of work made of short jobs, submitted from a thread each; the first error is raised."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        begun = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
        return {name: made.result() for name, made in begun.items()}


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)
