"""Session helpers: one SparkSession, a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "kestrel",
                shuffle_partitions: int | None = None,
                driver_memory: str | None = "8g") -> SparkSession:
    """Build (or reuse) the session with the settings the library relies on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if (master or "").startswith("local") and driver_memory:
        # local mode: the driver JVM is the whole cluster; Spark's 1g default
        # heap makes GC dominate (only applies when this call starts the JVM)
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per application),
    so pandas UDFs and the logistic fold can import it on any node."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="kestrel-pkg-"), "kestrel.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every entry point relies on: shared checkpoint folder, package on
    the workers, UTC session time zone (matches the SQL oracles)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (it is a shared file system such as HDFS or an
    object store).  Only a local-mode session without it gets a fresh folder
    under the system temp directory, as in tests.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        # local-cluster has executors of their own, so it needs a shared folder like any cluster
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="kestrel-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new, unique table location below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/kestrel/{kind}/{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a staged copy below the shared checkpoint folder once it is used up."""
    if not path.startswith(f"{checkpoint_root(spark)}/kestrel/"):
        raise ValueError(f"not a scratch path of this library: {path}")
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


__all__ = ["get_session", "checkpoint_root", "scratch_path", "shuffle_partitions",
           "remove_scratch", "prepare", "ship_package"]
