"""Makes this package importable in Python workers of a session that was
started elsewhere, by sending its modules to the executors once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="strataweave-")) / "strataweave_modules.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(root.rglob("*.py")):
                out.write(module, module.relative_to(root.parent))
        context.addPyFile(str(archive))
        _sent.add(context.applicationId)
    return spark
