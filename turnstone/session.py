"""Session defaults, and the package for Python workers that don't find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def session(name: str = "turnstone") -> SparkSession:
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application, unless they are local ones that start where it lies or have it on their path."""
    on_path = [Path(p).resolve() for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]]
    sc = spark.sparkContext
    local = sc.master == "local" or sc.master.startswith("local[")
    if local and _ROOT in on_path or sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "turnstone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "turnstone").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
