"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application.

    Spark's own file server distributes the archive, so that neither an installation nor a
    shared folder is needed.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="revspark-")) / "revspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_HERE.rglob("*.py")):
            z.write(p, p.relative_to(_HERE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
