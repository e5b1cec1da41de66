"""Make this library importable on workers that were started without it on their path."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Applications that have the package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package through Spark's own file server, once an application, whatever its sessions.

    The driver's PYTHONPATH tells nothing of the executors'. Each file has a name of its own, as the server
    refuses a second file of one name.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = Path(os.path.realpath(tempfile.mkdtemp())) / f"tallyframe-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
