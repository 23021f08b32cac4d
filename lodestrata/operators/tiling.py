"""Dealing stations out to tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.windows import numbered


def tiles_by_label(stations: DataFrame, n_tiles: int, label: str = "line_id") -> DataFrame:
    """(id, tile): with at least as many labels as tiles, whole labels are dealt out evenly in their order."""
    labels = stations.select(label).distinct().withColumn("tile", (F.ntile(n_tiles).over(Window.orderBy(label)) - 1).cast("int"))
    return stations.join(labels, label).select("id", "tile")


def tiles_by_halving(stations: DataFrame, depth: int) -> DataFrame:
    """(id, tile): 2^depth tiles whose sizes differ by one at most, by halving each tile along its longer side; ties by
    id.  Each halving is a window over the tiles, so only the first sees all stations together."""
    now = stations.select("id", "x", "y", F.lit(0).alias("tile"))
    for _ in range(depth):
        own = Window.partitionBy("tile")
        wide = (F.max("x").over(own) - F.min("x").over(own)) >= (F.max("y").over(own) - F.min("y").over(own))
        keyed = now.withColumn("_key", F.when(wide, F.col("x")).otherwise(F.col("y")))
        half = F.ntile(2).over(Window.partitionBy("tile").orderBy("_key", "id")) - 1
        now = keyed.withColumn("tile", (F.col("tile") * 2 + half).cast("int")).drop("_key")
    return now.select("id", "tile")


def tiles_by_kmeans(stations: DataFrame, n_tiles: int, seed: int = 0) -> DataFrame:
    """(id, tile) by k-means on plan coordinates scaled by their largest span."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ends = stations.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("s")).first()
    scaled = stations.select("id", ((F.col("x") - ends["x"]) / (ends["s"] or 1.0)).alias("u"), ((F.col("y") - ends["y"]) / (ends["s"] or 1.0)).alias("v"))
    points = VectorAssembler(inputCols=["u", "v"], outputCol="features").transform(scaled)
    return KMeans(k=n_tiles, seed=seed, predictionCol="tile").fit(points).transform(points).select("id", "tile")


def tiles_for(stations: DataFrame, method: str, n_tiles: int) -> DataFrame:
    """(id, tile): one tile for a 2-D survey, one per station for a 1-D one, else by label where there are enough."""
    if "2d" in method:
        return stations.select("id", F.lit(0).alias("tile"))
    if "1d" in method:
        return numbered(stations.select("id"), ["id"], "tile").select("id", F.col("tile").cast("int").alias("tile"))
    return tiles_by_label(stations, n_tiles)


def fibonacci(upto: int) -> list[int]:
    out = [1, 2]
    while out[-1] + out[-2] <= upto:
        out.append(out[-1] + out[-2])
    return [n for n in out if n <= upto]


def estimated_gigabytes(n_data: int, n_cells: int, n_tiles: int) -> float:
    """Dense float64 sensitivities of all tiles."""
    return n_data * n_cells * n_tiles * 8e-9
