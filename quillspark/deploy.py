"""Ships this package to the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        name = shutil.make_archive(f"{folder}/quillspark", "zip", os.path.dirname(here), os.path.basename(here))
        kept = os.path.join(tempfile.mkdtemp(), "quillspark.zip")
        shutil.copy(name, kept)
    context.addPyFile(kept)
    _shipped.add(context.applicationId)


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same query, with the package shipped first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run
