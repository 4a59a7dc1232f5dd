"""Making this package importable in Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Let workers on this machine, or with the same folders, import the package.

    On a cluster without shared folders pass the package with ``--py-files``.
    """
    home = str(Path(__file__).resolve().parent.parent)
    try:
        environment = spark.sparkContext.environment
    except Exception:  # a remote session ships code on its own
        return spark
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if home not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))
    return spark
