"""Makes the package importable for Spark's Python workers where it isn't installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the workers, once for each Spark application; Spark's own file server carries them.

    Not needed, and not done, if the workers find the package by PYTHONPATH or, in local mode, by the working folder.
    """
    context = spark.sparkContext
    found = str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (context.master.startswith("local[") and Path.cwd() == ROOT.parent)
    if not found and context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        archive = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(ROOT.rglob("*.py")):
                out.write(path, path.relative_to(ROOT.parent))
        context.addPyFile(str(archive))
    return spark
