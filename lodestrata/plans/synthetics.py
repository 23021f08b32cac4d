"""Generated surveys, topography and models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, n_stations: int, n_lines: int, limits: tuple[float, float, float, float], height: Column | None = None) -> DataFrame:
    """(id, line_id, x, y, z): stations along x on lines along y within (x0, x1, y0, y1); height is of x and y."""
    x0, x1, y0, y1 = limits
    step = lambda k, n, low, high: F.lit(low) + k.cast("double") * ((high - low) / max(1, n - 1))
    i, j = F.col("id") % n_stations, F.floor(F.col("id") / n_stations)
    flat = spark.range(n_stations * n_lines).select("id", j.cast("int").alias("line_id"), step(i, n_stations, x0, x1).alias("x"), step(j, n_lines, y0, y1).alias("y"))
    return flat.withColumn("z", F.lit(0.0) if height is None else height)


def hill(x: Column, y: Column, height: float = 50.0, width: float = 100.0) -> Column:
    return F.exp(-(x * x + y * y) / (2 * width * width)) * height


def grid_triangles(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(t, v0, v1, v2): two triangles for each quad of a regular grid of nx by ny points."""
    i, j = F.col("q") % (nx - 1), F.floor(F.col("q") / (nx - 1))
    a = (j * nx + i).cast("long")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("h"), a.alias("v0"), (a + 1).alias("v1"), (a + nx + 1).alias("v2")), F.struct(F.lit(1).alias("h"), a.alias("v0"), (a + nx + 1).alias("v1"), (a + nx).alias("v2"))))
    return spark.range((nx - 1) * (ny - 1)).withColumnRenamed("id", "q").select("q", halves.alias("s")).select((F.col("q") * 2 + F.col("s.h")).alias("t"), "s.v0", "s.v1", "s.v2")


def dipole_survey(electrodes: DataFrame, most: int = 9) -> DataFrame:
    """(line_id, c, m): for the current dipole at places c, c + 1 of a line, receiver dipoles m, m + 1 behind it."""
    last = electrodes.groupBy("line_id").agg(F.max("pos").alias("_last"))
    c = electrodes.select("line_id", F.col("pos").alias("c"))
    return c.join(last, "line_id").filter(F.col("c") + 3 <= F.col("_last")).withColumn("m", F.explode(F.sequence(F.col("c") + 2, F.least(F.col("c") + most + 1, F.col("_last") - 1)))).select("line_id", "c", "m")


def loops(stations: DataFrame, factor: float = 1.5, corners: int = 16) -> DataFrame:
    """(tx_id, seq, x, y): a loop of ``corners`` vertices around each half (west, east) of the survey."""
    middle = stations.agg(F.avg("x").alias("_mx"))
    halves = stations.crossJoin(F.broadcast(middle)).withColumn("tx_id", F.when(F.col("x") < F.col("_mx"), 0).otherwise(1))
    box = halves.groupBy("tx_id").agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"))
    turn = F.col("seq") * (2 * math.pi / corners)
    around = box.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(corners - 1))))
    return around.select("tx_id", "seq", ((F.col("_a") + F.col("_b")) / 2 + F.cos(turn) * (F.col("_b") - F.col("_a")) / 2 * factor).alias("x"), ((F.col("_c") + F.col("_d")) / 2 + F.sin(turn) * (F.col("_d") - F.col("_c")) / 2 * factor).alias("y"))


def short_segments(stations: DataFrame, longest: float = 200.0) -> DataFrame:
    """(id, next): steps along each line that are no longer than the limit; transmitters of an airborne system."""
    w = Window.partitionBy("line_id").orderBy("pos")
    rows = stations.withColumn("next", F.lead("id").over(w)).withColumn("_d", F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")))
    return rows.filter(F.col("_d") <= longest).select("id", "next")


#: Frequencies (Hz) and coil offsets (m) of a towed system.
COILS = [(900.0, 7.86), (7200.0, 7.86), (56000.0, 6.3)]


def coils(stations: DataFrame) -> DataFrame:
    """(id, frequency, offset, tx_x, y, z): a transmitter behind each receiver for each frequency."""
    table = F.explode(F.array(*[F.struct(F.lit(f).alias("frequency"), F.lit(o).alias("offset")) for f, o in COILS])).alias("s")
    return stations.select("id", "x", "y", "z", table).select("id", "s.frequency", "s.offset", (F.col("x") - F.col("s.offset")).alias("tx_x"), "y", "z")


def channels(stations: DataFrame, frequencies: list[float], components: list[str]) -> DataFrame:
    """(id, frequency, component) of a natural-source survey."""
    each = lambda v, n: F.explode(F.array(*[F.lit(x) for x in v])).alias(n)
    return stations.select("id", each(frequencies, "frequency")).select("id", "frequency", each(components, "component"))


def layered_model(cells: DataFrame, top: float, bottom: float, inside: float, outside: float, active: Column) -> DataFrame:
    """(cell_id, value): a slab between two heights, NaN in inactive cells."""
    within = (F.col("zc") < top) & (F.col("zc") > bottom)
    return cells.select("cell_id", F.when(~active, F.lit(float("nan"))).when(within, F.lit(inside)).otherwise(F.lit(outside)).alias("value"))
