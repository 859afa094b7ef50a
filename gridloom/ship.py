"""Sends this package to the executors, for stages that run Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: executors may not have the package installed."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "gridloom_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(home)))
    spark.sparkContext.addPyFile(path)
