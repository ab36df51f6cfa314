"""Session settings, and shipping this package to the executors."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes of a batch that goes to Python: texts are long, and a task holds a batch several times (Arrow's buffers in the JVM, the batch and its values in Python).
BATCH, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(8 << 20)


def session(app: str = "kindred", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; anything else is the cluster's own choice."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a session (it need not be installed there), and bound the batches it gets."""
    context = spark.sparkContext
    if spark.conf.get(BATCH, DEFAULT_BATCH) == DEFAULT_BATCH:  # else someone chose it
        spark.conf.set(BATCH, BATCH_BYTES)
    if getattr(context, "_kindred_shipped", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(f"{PACKAGE.name}/{path.relative_to(PACKAGE)}"), path.read_bytes())
    target = os.path.join(tempfile.mkdtemp(prefix="kindred-code-"), "kindred.zip")  # on the driver; Spark hands it out
    Path(target).write_bytes(held.getvalue())
    context.addPyFile(target)
    context._kindred_shipped = True


def shipped(query: Callable) -> Callable:
    """The query, after ``ship_code``."""

    @functools.wraps(query)
    def run(spark, *args):
        ship_code(spark)
        return query(spark, *args)

    return run
