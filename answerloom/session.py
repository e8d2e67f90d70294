"""Making this package importable on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application.

    Does what ``spark-submit --py-files`` does, for sessions started without it.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = f"{tempfile.mkdtemp(prefix='answerloom-package-')}/{package.name}"
    archive = shutil.make_archive(base, "zip", root_dir=package.parent, base_dir=package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
