"""Cells, their neighbours, rotated gradients and graphs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("i", "j", "k")


def face_neighbours(cells: DataFrame) -> DataFrame:
    """(axis, a, b): cells of a regular block that share a face; b follows a along the axis."""
    own = cells.select(F.col("cell_id").alias("a"), *AXES)
    other = cells.select(F.col("cell_id").alias("b"), *AXES)
    parts = [own.join(other.withColumn(x, F.col(x) - 1), list(AXES)).select(F.lit(x).alias("axis"), "a", "b") for x in AXES]
    return reduce(DataFrame.unionByName, parts)


def all_neighbours(cells: DataFrame) -> DataFrame:
    """Ordered pairs (a, b) of cells that share a face, an edge or a corner: each cell probes the 26 places around it."""
    shift = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if x or y or z])
    probes = cells.select(F.col("cell_id").alias("a"), *AXES, F.explode(shift).alias("s")).select("a", *[(F.col(x) + F.col(f"s.{y}")).cast("int").alias(x) for x, y in zip(AXES, "xyz", strict=True)])
    return probes.join(cells.select(F.col("cell_id").alias("b"), *AXES), list(AXES)).select("a", "b")


def next_cell(faces: DataFrame, axis: str, cells: DataFrame) -> DataFrame:
    """(cell_id, next): the cell that follows along an axis, -1 without one."""
    return cells.select("cell_id").join(faces.filter(F.col("axis") == axis).select(F.col("a").alias("cell_id"), "b"), "cell_id", "left").select("cell_id", F.coalesce("b", F.lit(-1)).alias("next"))


def sides(faces: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cell_id, axis, low, high): the neighbours before and after each wanted cell along each axis."""
    low = faces.select("axis", F.col("b").alias("cell_id"), F.col("a").alias("low"), F.lit(None).cast("long").alias("high"))
    high = faces.select("axis", F.col("a").alias("cell_id"), F.lit(None).cast("long").alias("low"), F.col("b").alias("high"))
    return low.unionByName(high).join(wanted, "cell_id", "left_semi").groupBy("cell_id", "axis").agg(F.max("low").alias("low"), F.max("high").alias("high"))


def expanded_active(cells: DataFrame, faces: DataFrame, active: str, receiver_cells: DataFrame) -> DataFrame:
    """(cell_id, active): also the cells that hold receivers, their neighbours in plan, and those below what that added."""
    wanted = receiver_cells.select("cell_id").distinct()
    plan = faces.filter(F.col("axis").isin("i", "j"))
    around = plan.join(wanted, plan["a"] == wanted["cell_id"]).select(plan["b"].alias("cell_id")).unionByName(plan.join(wanted, plan["b"] == wanted["cell_id"]).select(plan["a"].alias("cell_id")))
    added = wanted.unionByName(around).distinct().join(cells.filter(active), "cell_id", "left_anti")
    below = faces.filter("axis = 'k'").join(added, F.col("b") == F.col("cell_id")).select(F.col("a").alias("cell_id"))
    more = added.unionByName(below).distinct().withColumn("_more", F.lit(True))
    return cells.join(more, "cell_id", "left").select("cell_id", (F.col(active) | F.coalesce("_more", F.lit(False))).alias("active"))


def below_surface(cells: DataFrame, surface: DataFrame, size: float, reference: str = "center", width: float | None = None) -> DataFrame:
    """(cell_id, active): whether a cell's centre, top or bottom is strictly below the nearest surface point in plan."""
    from lodestrata.operators.joins import nearest

    shift = {"center": 0.0, "top": size / 2, "bottom": -size / 2}[reference]
    columns = cells.select("xc", "yc").distinct().select(F.struct("xc", "yc").alias("id"), F.col("xc").alias("x"), F.col("yc").alias("y"))
    heights = nearest(columns, surface, 1, ("x", "y"), width).join(surface.select(F.col("id").alias("nn_id"), "z"), "nn_id").select(F.col("id.xc").alias("xc"), F.col("id.yc").alias("yc"), "z")
    return cells.join(heights, ["xc", "yc"]).select("cell_id", (F.col("zc") + shift < F.col("z")).alias("active"))


def overlap_volume(boxes: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Volume that two boxes share, from (low, high, low, high) of each axis."""
    return reduce(lambda v, s: v * s, [F.greatest(F.lit(0.0), F.least(h1, h2) - F.greatest(l1, l2)) for l1, h1, l2, h2 in boxes])


def partial_volumes(cells: DataFrame, pairs: DataFrame, normal: tuple[float, float, float], size: float) -> DataFrame:
    """(a, b, volume): what each neighbour b holds of cell a moved by a cell's width along a direction."""
    own = cells.select(F.col("cell_id").alias("a"), *[F.col(c).alias(f"_a{c}") for c in ("xc", "yc", "zc")])
    other = cells.select(F.col("cell_id").alias("b"), *[F.col(c).alias(f"_b{c}") for c in ("xc", "yc", "zc")])
    half = size / 2
    boxes = []
    for c, n in zip(("xc", "yc", "zc"), normal, strict=True):
        at = F.col(f"_a{c}") + n * size
        boxes.append((at - half, at + half, F.col(f"_b{c}") - half, F.col(f"_b{c}") + half))
    return pairs.join(own, "a").join(other, "b").select("a", "b", overlap_volume(boxes).alias("volume")).filter("volume > 0 and a <> b")


def gradient_operator(volumes: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b, w): minus each neighbour's share of the moved cell, plus 1 on the diagonal; cells without shares have 0."""
    merged = volumes.groupBy("a", "b").agg(F.sum("volume").alias("v"))
    total = merged.groupBy("a").agg(F.sum("v").alias("_t"))
    shares = merged.join(total, "a").select("a", "b", (-F.col("v") / F.col("_t")).alias("w"))
    diagonal = cells.select(F.col("cell_id").alias("a")).join(total, "a", "left").select("a", F.col("a").alias("b"), F.when(F.col("_t").isNull(), 0.0).otherwise(1.0).alias("w"))
    return shares.unionByName(diagonal)


def direction(dip: float, azimuth: float) -> tuple[float, float, float]:
    """Unit vector that dips (degrees down) towards an azimuth (degrees from north)."""
    d, a = math.radians(dip), math.radians(azimuth)
    return math.cos(d) * math.sin(a), math.cos(d) * math.cos(a), -math.sin(d)


def rotated_gradient(cells: DataFrame, normal: tuple[float, float, float], size: float) -> DataFrame:
    """The gradient operator (a, b, w) along any direction of a regular block."""
    return gradient_operator(partial_volumes(cells, all_neighbours(cells), normal, size), cells)


def within_active(operator: DataFrame, active: DataFrame, size: float) -> DataFrame:
    """An operator on active cells only, over the cell size; rows that no longer sum to 0 (they lost a share) go."""
    on = active.filter("active").select("cell_id")
    kept = operator.join(on, operator["a"] == on["cell_id"], "left_semi").join(on, operator["b"] == on["cell_id"], "left_semi")
    whole = kept.groupBy("a").agg(F.sum("w").alias("_s"), F.max(F.abs("w")).alias("_m")).filter("abs(_s) < 1e-8 and _m > 0").select("a")
    return kept.join(whole, "a", "left_semi").select("a", "b", (F.col("w") / size).alias("w"))


def applied(operator: DataFrame, model: DataFrame) -> DataFrame:
    """(cell_id, value): a sparse operator (a, b, w) on a model; the products are summed map-side."""
    return operator.join(model.select(F.col("cell_id").alias("b"), "value"), "b").groupBy("a").agg(F.sum(F.col("w") * F.col("value")).alias("value")).withColumnRenamed("a", "cell_id")


def corners(cells: DataFrame, size: float) -> DataFrame:
    """Low (bottom, south, west) and high corners of cells."""
    return cells.select("cell_id", *[(F.col(f"{a}c") + s * size / 2).alias(f"{a}{n}") for a in "xyz" for n, s in (("l", -1), ("h", 1))])


def coarsened(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Distinct coarse cells (i, j, k, level): each fine cell is dropped to its level by shifting its coordinates."""
    shift = lambda x: (F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("level"))) * F.pow(F.lit(2.0), F.col("level"))).cast("int").alias(x)
    return cells.join(levels, "cell_id").select(*[shift(x) for x in AXES], "level").distinct()


def tree_level(ncells: Column, finest: int) -> Column:
    return (F.lit(finest) - F.log2(ncells)).cast("int")


def flipped(cells: DataFrame, size: tuple[float, float, float], count: tuple[int, int, int]) -> DataFrame:
    """Cells in the convention of positive sizes: along an axis of negative size, indices count from the other end."""
    return cells.select("cell_id", *[((n - 1 - F.col(x)) if s < 0 else F.col(x)).cast("int").alias(x) for x, s, n in zip(AXES, size, count, strict=True)])


def padded_column(core: int, padding: int, height: float, expansion: float, spark) -> DataFrame:
    """(k, h, bottom): a column of equal core layers and growing ones below."""
    k = F.col("id")
    h = F.when(k < core, F.lit(height)).otherwise(F.lit(height) * F.pow(F.lit(expansion), (k - core + 1).cast("double")))
    return spark.range(core + padding).select(k.cast("int").alias("k"), h.alias("h")).withColumn("bottom", -F.sum("h").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))


def connected_parts(edges: DataFrame, a: str = "v0", b: str = "v1", max_rounds: int = 60) -> DataFrame:
    """(node, part): the smallest node that each node is connected with.

    Each round every node takes the smallest label around it, then that label's own label (pointer jumping), so the
    rounds grow with the logarithm of the longest path rather than its length.  Minima are aggregated map-side; rounds
    are cut by reliable checkpoints, as executors may be lost."""
    from lodestrata.plans.checkpoints import cut

    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = cut(both.distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")))
    for _ in range(max_rounds):
        around = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("_m"))
        lower = label.join(around, "u").select("u", "l", F.least("l", "_m").alias("_n"))
        jump = lower.select(F.col("u").alias("_n"), F.col("_n").alias("_j"))
        new = cut(lower.join(jump, "_n").select("u", F.least("_n", "_j").alias("n"), "l"))
        label = new.select("u", F.col("n").alias("l"))
        if new.filter("n <> l").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("l").alias("part"))
    raise RuntimeError("parts did not settle")


def inside_mesh(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(id, inside) for a closed surface of triangles (a, b, c corners with x, y, z): by the solid angles that they take
    up, which sum to 4 pi inside and 0 outside.  Triangles of a body are few; every point meets all of them."""
    c = F.col
    v = {t: [c(f"{t}{a}") - c(a) for a in "xyz"] for t in "abc"}
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    a, b, d = v["a"], v["b"], v["c"]
    na, nb, nd = (F.sqrt(dot(p, p)) for p in (a, b, d))
    det = a[0] * (b[1] * d[2] - b[2] * d[1]) - a[1] * (b[0] * d[2] - b[2] * d[0]) + a[2] * (b[0] * d[1] - b[1] * d[0])
    angle = F.atan2(det, na * nb * nd + dot(a, b) * nd + dot(b, d) * na + dot(d, a) * nb) * 2
    return points.crossJoin(F.broadcast(triangles)).groupBy("id").agg((F.abs(F.sum(angle)) > 2 * math.pi).alias("inside"))


def normals(cells: DataFrame, axis: str, outward: bool = True) -> DataFrame:
    """(cell_id, nx, ny, nz): a unit vector along an axis for every cell."""
    sign = 1.0 if outward else -1.0
    return cells.select("cell_id", *[F.lit(sign if a == axis else 0.0).alias(f"n{t}") for a, t in zip(AXES, "xyz", strict=True)])


def centroids(cells: DataFrame, origin: tuple[float, float, float], size: tuple[float, float, float]) -> DataFrame:
    """(cell_id, x, y, z) of cells (i, j, k, ncells) that are ncells finest cells wide."""
    return cells.select("cell_id", *[((F.col(a) + F.col("ncells") / 2) * s + o).alias(t) for a, t, o, s in zip(AXES, "xyz", origin, size, strict=True)])


def same_places(a: DataFrame, b: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """One row: whether two tables (cell_id, x, y, z) hold the same cells at the same places."""
    other = b.select("cell_id", *[F.col(t).alias(f"_{t}") for t in "xyz"])
    apart = F.greatest(*[F.coalesce(F.abs(F.col(t) - F.col(f"_{t}")), F.lit(float("inf"))) for t in "xyz"])
    return a.join(other, "cell_id", "full").agg((F.coalesce(F.max(apart), F.lit(0.0)) <= tolerance).alias("same"))


def draped_prisms(stations: DataFrame, spacing: float, heights: DataFrame) -> DataFrame:
    """(line_id, column, along, top, k, bottom): columns of equal spacing along each line, topped by the mean height of
    the stations within, with layers (k, h) below; columns without a station take no part."""
    from lodestrata.operators.windows import along_line

    placed = along_line(stations).withColumn("column", F.floor(F.col("along") / spacing).cast("int"))
    tops = placed.groupBy("line_id", "column").agg(F.avg("z").alias("top"))
    depth = heights.withColumn("_d", F.sum("h").over(Window.partitionBy(F.lit(1)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).select("k", "_d")
    return tops.crossJoin(F.broadcast(depth)).select("line_id", "column", ((F.col("column") + 0.5) * spacing).alias("along"), "top", "k", (F.col("top") - F.col("_d")).alias("bottom"))
