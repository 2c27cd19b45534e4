"""Gets the package to the executors' Python workers, wherever the application was started from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of this package to the application, once. Functions that workers run may then import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="loomspan-ship-")) / "loomspan.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(str(made))
    _shipped.add(app)
