"""Session set-up and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, register the file sources and let them
    receive filters. Calling it again costs nothing."""
    from layerscan.sources.shapefile import ShapefileSource
    from layerscan.sources.tiff import RasterSource

    context = spark.sparkContext
    if context.applicationId not in _shipped:
        context.addPyFile(_package_archive())
        _shipped.add(context.applicationId)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # A search over many columns can make a generated method that the JVM refuses to
    # compile; beyond this size Spark then splits it up.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.dataSource.register(ShapefileSource)
    spark.dataSource.register(RasterSource)
    return spark


def _package_archive() -> str:
    """This package as a zip, the form in which Spark ships Python code."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="run-"), "layerscan.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, os.path.dirname(package)))
    return archive


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach, below the session's checkpoint folder.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/layerscan/{purpose}-{uuid.uuid4().hex}"
