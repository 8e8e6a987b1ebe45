"""Getting this package to Python workers that don't have it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table that a query makes: in spark.checkpoint.dir, which all executors see; on one machine in its
    temporary folder if that is unset. It is deleted when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/checkpoints"
    folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application, through Spark's own file distribution.

    The archive stays on the driver, from where executors that start later fetch it, until the driver ends.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp()).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / f"{root.name}-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)
