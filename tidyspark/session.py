"""Make this package importable by Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, once an application, unless PYTHONPATH already has it."""
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    name = Path(__file__).resolve().parent.name
    path = Path(tempfile.mkdtemp(prefix=f"{name}-")) / f"{name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((_ROOT / name).rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
