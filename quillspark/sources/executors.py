"""What executors need of this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once a context: their Python need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quillspark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves it to executors until then
    path = os.path.join(folder, "quillspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    context._quillspark_shipped = True
