"""Session construction and cluster-wide settings.

On a cluster the session already exists and carries the operator's settings;
``build_session`` only fills in what is unset, so a cluster's
``spark.checkpoint.dir`` or shuffle sizing always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults applied only when the key is not already set on the session.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # AQE sizes shuffle partitions at run time: ~128 MB each after a shuffle,
    # so a 100 TB job gets enough reducers without a fixed partition count.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    # Scan splits: text rows are large, keep input partitions ~128 MB.
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Create a session with quarry's defaults, or reuse the active one.

    An existing (cluster) session keeps its settings: only runtime SQL keys
    that are unset there are filled in. ``extra`` and ``shuffle_partitions``
    are explicit requests and apply to a new session.
    """
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in conf.items():
            if k.startswith("spark.sql.") and active.conf.get(k, None) in (None, ""):
                active.conf.set(k, v)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_master(master: str) -> bool:
    """Whether driver and executors are one process (``local[n]``)."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster's shared
    storage). Only when it is unset and the master is local (tests) is a
    scratch folder created and registered; on a cluster an unset folder is an
    error, since executors would write to disks of their own.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not local_master(sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (the ``--py-files`` step
    of spark-submit): zip the package once per SparkContext and add it with
    ``addPyFile``, which distributes it to every executor."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    import quarry
    pkg = os.path.dirname(os.path.abspath(quarry.__file__))
    base = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="quarry-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    sc._quarry_shipped = True
