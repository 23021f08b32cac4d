"""The flagship query: gravity of a block of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.forward import gravity
from lodestrata.sources.views import Views


def all_cells(v: Views) -> DataFrame:
    """All cells, with a density."""
    return v.cells.select("cell_id", "xc", "yc", "zc", (F.col("cell_id") % 7 * 0.1 + 0.1).alias("density"))


def gravity_of(v: Views, cells: DataFrame) -> DataFrame:
    return gravity(v.stations, cells, 100.0).select("id", F.round("gz", 6).alias("gz"))


def gravity_of_hill(spark: SparkSession, folder: str) -> DataFrame:
    """Gravity of all cells at all stations."""
    v = Views(spark, folder)
    return gravity_of(v, all_cells(v))
