"""Makes this package importable on executors, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand a zip of the package to the context's executors, once per context."""
    context = spark.sparkContext
    if getattr(context, "_spindrift_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spindrift-")) / "spindrift.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, f"{package.name}/{path.relative_to(package)}")
    context.addPyFile(str(archive))
    context._spindrift_shipped = True
