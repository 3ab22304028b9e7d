"""Makes this package importable by executors that do not share the driver's folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark context, send the package to the executors as a zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_seqlens_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="seqlens-ship-")  # the driver's own: it hands the file to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "seqlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for place, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    z.write(full, os.path.join("seqlens", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._seqlens_shipped = True
