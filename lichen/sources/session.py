"""What every query needs of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package's Python files to the executors, once a session; they need not have it installed."""
    sc = spark.sparkContext
    if spark.conf.get(_RECORDS, None) is None:
        spark.conf.set(_RECORDS, "1000")  # texts are long: some megabytes a batch
    if getattr(sc, "_lichen_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="lichen-")) / "lichen.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    sc._lichen_shipped = True
