"""Spark sessions for the engine."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch between the JVM and Python; Spark's own bound counts rows, however long.
BATCH = 8 << 20
_BOUND, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; a master that is already set stays."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, by Spark's own file server; bound Arrow batches."""
    if spark.conf.get(_BOUND, None) in (None, _DEFAULT):
        spark.conf.set(_BOUND, f"{BATCH}b")
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).parent
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, str(Path(root.name) / path.relative_to(root)))
        at = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")
        Path(at).write_bytes(body.getvalue())
        context.addPyFile(at)
    return spark
