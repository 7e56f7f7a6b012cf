"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application.

    Workers that already have it on PYTHONPATH lose nothing: the archive
    (a few hundred KB) is served by the driver through Spark's own file
    server, so no shared folder is needed.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        handle, name = tempfile.mkstemp(prefix="docframe_", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(Path(top.name) / p.relative_to(top)))
        sc.addPyFile(name)
        _shipped.add(sc.applicationId)
    return spark
