"""Session settings and the shared scratch folder.

Everything in the package is lazy DataFrame code; the only session-level
choices are the ones that decide how plans are executed at scale:
adaptive execution (runtime partition coalescing, skew-join splitting,
broadcast demotion from runtime sizes), UTC session time, and Arrow for
the few Pandas-backed parsers.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings applied to every session the package builds or configures.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "tablework", **extra: str) -> SparkSession:
    """Session for tests, benches and local use (UI off, no ports)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TABLEWORK_DRIVER_MEMORY", "8g"))
    )
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or a checkpoint folder already set
    on the context). Only a local-mode session without the setting gets a
    fresh folder of its own; on a cluster the setting is required, since a
    machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS, S3, ...) that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablework-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/tables/{uuid.uuid4().hex[:12]}/{name}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Deletes one written table of ``scratch_path`` that nothing reads any more
    (in the file system of its path); other paths are refused."""
    folder = path.rstrip("/").rsplit("/", 1)[0]
    if not folder.startswith(f"{shared_dir(spark).rstrip('/')}/tables/"):
        raise ValueError(f"not a scratch table: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Zip ``tablework`` once per application and add it to the Python path
    of the workers (Spark hands the file to every executor)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="tablework-pkg-"), "tablework.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
