"""What a session needs before it runs the library's Python code on executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="linkloom-code-")
    target = os.path.join(folder, "linkloom_code.zip")
    Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)
