"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers (``addPyFile``) unless it is installed
    or on PYTHONPATH, as it is where a job is submitted with ``--py-files``."""
    package = Path(__file__).parents[1]
    root, app = str(package.parent), spark.sparkContext.applicationId
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _shipped or root in known or "site-packages" in root or not package.is_dir() or root.startswith(sys.prefix):
        return
    path = Path(tempfile.mkdtemp(prefix="claimwise-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
