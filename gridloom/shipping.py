"""Making this package importable for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to executors that don't find it themselves; nothing to do where it is on their path."""
    root = Path(__file__).parent
    sc = spark.sparkContext
    if not root.is_dir() or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "gridloom.zip" in "".join(sc._python_includes):
        return
    d = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{d}/gridloom", "zip", root.parent, root.name))  # the driver serves it to all executors
