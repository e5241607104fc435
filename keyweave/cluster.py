"""What every query needs from the session: the package on the workers, and a shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application.

    Under ``spark-submit --py-files`` the package is there already; the second copy is harmless.
    """
    context = spark.sparkContext
    if getattr(context, "_keyweave_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="keyweave-")
    target = os.path.join(folder, f"keyweave-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_ROOT.rglob("*.py")):
            archive.write(file, str(file.relative_to(_ROOT.parent)))
    context.addPyFile(target)
    context._keyweave_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh local one only where that is unset and all runs in one process, as in tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="keyweave-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark writes to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder and read back, so a lost executor costs nothing.

    Spark removes what was written once ``df`` isn't used any more, where the session was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` true; else it stays in the folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Sums by a key, dealt out by more than that key before they are joined on it.

    The join then has to shuffle them by themselves, and not together with what they were summed from:
    so both its sides are plain shuffles, of which Spark splits the partition of a frequent key.
    """
    return df.repartition(*columns)
