"""Aggregates of survey and model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.filters import number
from lodestrata.operators.joins import nearest


def station_spacing(stations: DataFrame, axes: tuple[str, ...] = ("x", "y"), width: float | None = None) -> DataFrame:
    """One row: median, mean, least and largest distance of a station to its nearest neighbour."""
    d = nearest(stations, stations, 1, axes, width, other_than_self=True)
    return d.agg(F.median("d").alias("median"), F.avg("d").alias("mean"), F.min("d").alias("least"), F.max("d").alias("largest"))


def window_of(stations: DataFrame) -> DataFrame:
    """Centre and size of the bounding box in plan; a side of no length is given the mean of the two."""
    ends = stations.agg(*[f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("l", F.min), ("h", F.max))])
    dx, dy = F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly")
    side = lambda s: F.when(s == 0, (dx + dy) / 2).otherwise(s)
    return ends.select(((F.col("lx") + F.col("hx")) / 2).alias("x"), ((F.col("ly") + F.col("hy")) / 2).alias("y"), side(dx).alias("width"), side(dy).alias("height"))


def padding_distance(stations: DataFrame, factor: float = 2.0) -> DataFrame:
    """The longer side of the bounding box over a factor, to the nearest 100."""
    longer = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return stations.agg((F.bround(longer / factor / 100.0) * 100.0).alias("padding"))


def depth_core(stations: DataFrame, depth: float, cell: float) -> DataFrame:
    """The core's depth below the lowest station: the depth less the stations' relief plus a cell, if it is deep enough."""
    relief = F.max("z") - F.min("z")
    return stations.agg(F.when(F.lit(depth) >= relief, F.lit(depth) - relief + cell).otherwise(F.lit(depth)).alias("depth"))


def trend(points: DataFrame, order: int = 1, value: str = "value") -> DataFrame:
    """Coefficients (c0, cx, cy) of a constant or plane fitted by least squares about the abs(value)-weighted centre
    (x0, y0); sums for the normal equations, solved in closed form.  Order 0 or 1."""
    v = F.col(value)
    rows = points.filter(number(v))
    centre = rows.agg((F.sum(F.abs(v) * F.col("x")) / F.sum(F.abs(v))).alias("x0"), (F.sum(F.abs(v) * F.col("y")) / F.sum(F.abs(v))).alias("y0"))
    x, y = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    sums = rows.crossJoin(F.broadcast(centre)).groupBy("x0", "y0").agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), F.sum(v).alias("sv"), F.sum(x * v).alias("sxv"), F.sum(y * v).alias("syv")
    )
    if order == 0:
        return sums.select("x0", "y0", (F.col("sv") / F.col("n")).alias("c0"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    if order != 1:
        raise ValueError("only orders 0 and 1")
    e = lambda t: F.expr(t)
    det = "(n * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy))"
    c0 = f"try_divide(sv * (sxx * syy - sxy * sxy) - sx * (sxv * syy - sxy * syv) + sy * (sxv * sxy - sxx * syv), {det})"
    cx = f"try_divide(n * (sxv * syy - sxy * syv) - sv * (sx * syy - sxy * sy) + sy * (sx * syv - sxv * sy), {det})"
    cy = f"try_divide(n * (sxx * syv - sxv * sxy) - sx * (sx * syv - sxv * sy) + sv * (sx * sxy - sxx * sy), {det})"
    return sums.select("x0", "y0", e(c0).alias("c0"), e(cx).alias("cx"), e(cy).alias("cy"))


def unit_means(units: DataFrame) -> DataFrame:
    return units.groupBy("unit").agg(F.avg("property").alias("mean"))


def unit_weights(units: DataFrame) -> DataFrame:
    """(unit, weight): each unit's share of all volume; units are aggregated before the total is taken over them."""
    return units.groupBy("unit").agg(F.sum("volume").alias("v")).select("unit", (F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1)))).alias("weight"))


def misfit(predicted: DataFrame, observed: DataFrame, keys: list[str], group: Column | None = None) -> DataFrame:
    """Sum of ((predicted - observed) / deviation)^2, by a group if given; missing data and infinite deviations add 0."""
    residual = (F.col("p.value") - F.col("o.value")) / F.col("o.uncertainty")
    term = F.when(number(F.col("o.value")) & (F.col("o.uncertainty") < float("inf")), residual * residual).otherwise(F.lit(0.0))
    on = [F.col(f"p.{k}") == F.col(f"o.{k}") for k in keys]
    joined = predicted.alias("p").join(observed.alias("o"), on)
    return (joined.groupBy(group.alias("tile")) if group is not None else joined).agg(F.sum(term).alias("phi"))


def weighted_misfit(parts: DataFrame, multipliers: DataFrame, squared: bool = False) -> DataFrame:
    """One row phi: parts (tile, phi) times their multipliers (tile, multiplier), squared where groups are joined."""
    m = F.col("multiplier")
    return parts.join(multipliers, "tile").agg(F.sum((m * m if squared else m) * F.col("phi")).alias("phi"))


def in_every(names: DataFrame, name: str, group: str) -> DataFrame:
    """Names that stand in every group."""
    n = names.agg(F.countDistinct(group).alias("_groups"))
    return names.groupBy(name).agg(F.countDistinct(group).alias("_n")).crossJoin(F.broadcast(n)).filter("_n = _groups").select(name)


def last_by(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    return df.groupBy(group).agg(F.max_by(value, order).alias(value))


def median_tile(tiles: DataFrame) -> DataFrame:
    """The tile in the middle of all by size (the upper of two), ties by number."""
    w = Window.orderBy("size", "tile")
    return tiles.withColumn("_r", F.row_number().over(w)).crossJoin(F.broadcast(tiles.agg(F.count("*").alias("_n")))).filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select("tile", "size")


def sensitivity_norm(jacobian: DataFrame, volumes: DataFrame) -> DataFrame:
    """(cell_id, value) on all cells: sqrt of the sum of squared sensitivities over the cell's volume; null where none."""
    rows = jacobian.groupBy("cell_id").agg(F.sqrt(F.sum(F.col("j") * F.col("j"))).alias("norm"))
    return volumes.join(rows, "cell_id", "left").select("cell_id", (F.col("norm") / F.col("volume")).alias("value"))


def sensitivity_weights(jacobian: DataFrame, floor: float) -> DataFrame:
    """(cell_id, weight): fourth root of the sum of squared sensitivities and a floor."""
    return jacobian.groupBy("cell_id").agg(F.pow(F.sum(F.col("j") * F.col("j")) + floor, 0.25).alias("weight"))
