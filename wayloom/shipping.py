"""Sends this package to executors that do not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once, so functions run on executors can import it."""
    context = spark.sparkContext
    if getattr(context, "_wayloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="wayloom-code-")
    archive = f"{folder}/wayloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, f"wayloom/{p.relative_to(HERE)}")
    context.addPyFile(archive)
    context._wayloom_shipped = True
