"""Auditing of code changes against the instructions that authorised them, on Spark."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of all executors; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_changelens_shipped", False):
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="changelens-"), "changelens"), "zip", os.path.dirname(folder), os.path.basename(folder))
    context.addPyFile(made)
    context._changelens_shipped = True
