"""The package's code for the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows and bytes of the batches that go to Python; Spark's own bounds let eight times as much pile up on either side.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, once per application, as ``--py-files`` would.

    Also keeps the batches that are sent to Python small in this session.
    """
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "bibflow.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    packed.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
