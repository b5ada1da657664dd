"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each application; returns the session."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="paperloom-source-")) / f"{top.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, path.relative_to(top.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
