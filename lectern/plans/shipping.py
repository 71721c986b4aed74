"""Python functions run on executors, which need this package: it is sent where they would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package once a session, unless ``PYTHONPATH`` has it."""
    app = spark.sparkContext.applicationId
    if app in _done or str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    out = Path(tempfile.mkdtemp(prefix="lectern-code-")) / "lectern.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "lectern").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(out))
    _done.add(app)
