"""Sends the package to the executors of a session that may not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: Spark copies an archive of the package to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="stratafold-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "stratafold-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, str(Path(package.name) / path.relative_to(package)))
    context.addPyFile(str(archive))
