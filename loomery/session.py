"""Sessions, and getting this package to where its functions run."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that nothing has to be installed there."""
    context = spark.sparkContext
    with _SHIPPING:
        if context.applicationId not in _SHIPPED:
            root = os.path.dirname(os.path.abspath(__file__))
            path = os.path.join(tempfile.mkdtemp(prefix="loomery-"), "loomery_package.zip")
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                for folder, _, names in os.walk(root):
                    for name in sorted(names):
                        if name.endswith(".py"):
                            full = os.path.join(folder, name)
                            z.write(full, os.path.join("loomery", os.path.relpath(full, root)))
            context.addPyFile(path)
            _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the session's own where it is unset.

    Without either, a local session gets one under its temporary folder; on a cluster that would be a folder of the driver's
    alone, and what executors write would be lost, so it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "loomery-checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def session(name: str = "loomery", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC, and the package shipped; conf takes Spark's settings with _ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return ship(builder.getOrCreate())
