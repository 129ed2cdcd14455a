"""Sending this package to the executors, so that task functions import there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        out = os.path.join(tempfile.mkdtemp(prefix="lagloom-"), "lagloom-package.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        p = os.path.join(folder, n)
                        z.write(p, os.path.join("lagloom", os.path.relpath(p, top)))
        sc.addPyFile(out)
    _shipped.add(sc.applicationId)
