"""Joins of survey tables: nearest neighbours, points in cells, segments through cells, ids and orders."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.windows import numbered
from lodestrata.plans.checkpoints import cut


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]))


def suggested_width(df: DataFrame, axes: tuple[str, ...], per_bucket: int = 4) -> float:
    """A bucket width that puts about ``per_bucket`` rows into each bucket of the bounding box."""
    found = df.agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    spans = [float(found[a] or 0) for a in axes]
    wide = [s for s in spans if s > 0]
    return math.prod(wide) ** (1 / len(wide)) * (per_bucket / max(1, found["n"])) ** (1 / len(wide)) if wide else 1.0


def _extent(df: DataFrame, axes: list[str]) -> list[tuple[float, float]]:
    found = df.agg(*[f(a).alias(f"{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [(found[f"lo{a}"], found[f"hi{a}"]) for a in axes]


def nearest(left: DataFrame, right: DataFrame, k: int = 1, axes: tuple[str, ...] = ("x", "y", "z"), width: float | None = None, left_id: str = "id", right_id: str = "id", other_than_self: bool = False) -> DataFrame:
    """(left id, right id as ``nn_id``, distance ``d``, ``rank``) of each left row's k nearest right rows; ties by id.

    Right rows are put into grid buckets; left rows probe the buckets around their own, an equi-join.  A left row is done
    when its k-th neighbour is no farther than the probed ring is wide; the others probe a grid of four times the width,
    until none is left or the grid's buckets hold everything.  Each step is cut by a checkpoint, so that none is done
    again.  Rows with a null or NaN coordinate have no neighbour and are nobody's; a right table of fewer than k rows gives
    all of them.
    """
    names = [f"_l{i}" for i in range(len(axes))], [f"_r{i}" for i in range(len(axes))]
    whole = lambda df: df.filter(" and ".join(f"{a} is not null and not isnan({a})" for a in axes))
    todo = whole(left).select(F.col(left_id).alias("_id"), *[F.col(a).cast("double").alias(n) for a, n in zip(axes, names[0], strict=True)])
    r = whole(right).select(F.col(right_id).alias("nn_id"), *[F.col(a).cast("double").alias(n) for a, n in zip(axes, names[1], strict=True)])
    ends = list(zip(_extent(todo, names[0]), _extent(r, names[1]), strict=True))
    own = [F.col(n) for n in names[0]]
    d = distance(tuple(own), tuple(F.col(n) for n in names[1])).alias("d")
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("d", "nn_id"))
    out = todo.crossJoin(r.limit(0)).select("_id", "nn_id", d).withColumn("rank", F.lit(0))
    if any(x is None for both in ends for end in both for x in end):
        return out.withColumnRenamed("_id", left_id)
    span = max(max(a[1], b[1]) - min(a[0], b[0]) for a, b in ends)
    width = width or suggested_width(whole(right), axes)
    while True:
        key = lambda c, w=width: F.floor(c / w)
        near = todo
        for i, c in enumerate(own):
            near = near.withColumn(f"_k{i}", F.explode(F.array(*[key(c) + s for s in (-1, 0, 1)])))
        there = r.select("*", *[key(F.col(n)).alias(f"_k{i}") for i, n in enumerate(names[1])])
        met = near.join(there, [f"_k{i}" for i in range(len(axes))]).select("_id", "nn_id", d)
        met = cut((met.filter(F.col("_id") != F.col("nn_id")) if other_than_self else met).withColumn("rank", rank).filter(F.col("rank") <= k))
        if width >= span:
            return out.unionByName(met).withColumn("rank", F.col("rank").cast("int")).withColumnRenamed("_id", left_id)
        sure = met.groupBy("_id").agg(F.count("*").alias("_n"), F.max("d").alias("_far")).filter((F.col("_n") == k) & (F.col("_far") <= width)).select("_id")
        out = out.unionByName(met.join(sure, "_id", "left_semi"))
        todo = cut(todo.join(sure, "_id", "left_anti"))
        if todo.isEmpty():
            return out.withColumn("rank", F.col("rank").cast("int")).withColumnRenamed("_id", left_id)
        width *= 4


def nearest_value(target: DataFrame, source: DataFrame, value: str, axes: tuple[str, ...] = ("x", "y", "z"), target_id: str = "id", source_id: str = "id", zero_is_missing: bool = False, width: float | None = None) -> DataFrame:
    """(target id, value) of the nearest source row; 0 as NaN for values that mean something only where they are set."""
    found = nearest(target, source, 1, axes, width, target_id, source_id)
    out = found.join(source.select(F.col(source_id).alias("nn_id"), F.col(value)), "nn_id").select(target_id, value)
    return out.withColumn(value, F.when(F.col(value) == 0, F.lit(float("nan"))).otherwise(F.col(value))) if zero_is_missing else out


def draped(locations: DataFrame, surface: DataFrame, k: int = 2, width: float | None = None) -> DataFrame:
    """(id, z) of each location: the surface's k nearest points (by x, y) weighted by 1 / (distance + 1e-8)."""
    found = nearest(locations, surface, k, ("x", "y"), width)
    heights = surface.select(F.col("id").alias("nn_id"), "z")
    w = F.lit(1.0) / (F.col("d") + 1e-8)
    return found.join(heights, "nn_id").groupBy("id").agg((F.sum(w * F.col("z")) / F.sum(w)).alias("z"))


def grid_key(value: Column, origin: float, size: float) -> Column:
    """Number of the regular cell that holds a coordinate; lower faces belong to the cell."""
    return F.floor((value - origin) / size).cast("int")


def containing_cells(points: DataFrame, cells: DataFrame, origin: tuple[float, float, float], size: tuple[float, float, float]) -> DataFrame:
    """(id, cell_id) of points inside a mesh of cells (i, j, k, ncells), where a cell is ncells finest cells wide: one
    equi-join on integer keys for each width there is (few, as widths are powers of two)."""
    at = [grid_key(F.col(a), o, s) for a, o, s in zip("xyz", origin, size, strict=True)]
    keyed = points.select("id", *[k.alias(f"_{a}") for a, k in zip("ijk", at, strict=True)])
    widths = F.broadcast(cells.select("ncells").distinct())
    probes = keyed.crossJoin(widths).select("id", "ncells", *[(F.floor(F.col(f"_{a}") / F.col("ncells")) * F.col("ncells")).cast("int").alias(a) for a in "ijk"])
    return probes.join(cells.select("cell_id", "i", "j", "k", "ncells"), ["i", "j", "k", "ncells"]).select("id", "cell_id")


def crossed_cells(segments: DataFrame, boxes: DataFrame, reach: float) -> DataFrame:
    """Distinct (segment id, cell_id) of boxes (low and high of x, y, z) that a segment (x0..z1) touches.

    Segments and boxes meet in plan buckets ``reach`` wide, then the slab test decides."""
    span = lambda low, high: F.sequence(F.floor(F.least(low, high) / reach), F.floor(F.greatest(low, high) / reach))
    c = F.col
    s = segments.withColumn("_bx", F.explode(span(c("x0"), c("x1")))).withColumn("_by", F.explode(span(c("y0"), c("y1"))))
    b = boxes.withColumn("_bx", F.explode(span(c("xl"), c("xh")))).withColumn("_by", F.explode(span(c("yl"), c("yh"))))
    enter, leave = [], []
    for a in "xyz":
        p, q, low, high = c(f"{a}0"), c(f"{a}1"), c(f"{a}l"), c(f"{a}h")
        t0, t1 = F.try_divide(low - p, q - p), F.try_divide(high - p, q - p)
        inside = (p >= low) & (p <= high)
        enter.append(F.coalesce(F.least(t0, t1), F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))))
        leave.append(F.coalesce(F.greatest(t0, t1), F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))))
    hit = F.greatest(F.lit(0.0), *enter) <= F.least(F.lit(1.0), *leave)
    return s.join(b, ["_bx", "_by"]).filter(hit).select("segment_id", "cell_id").distinct()


def refinement_levels(cells: DataFrame, stations: DataFrame, radii: list[float], width: float | None = None) -> DataFrame:
    """(cell_id, level): 0 for cells whose nearest station is within the first radius, 1 within the second, and so on."""
    found = nearest(cells.select(F.col("cell_id").alias("id"), F.col("xc").alias("x"), F.col("yc").alias("y"), F.col("zc").alias("z")), stations, 1, width=width)
    level = F.lit(len(radii))
    for n, radius in reversed(list(enumerate(radii))):
        level = F.when(F.col("d") < radius, n).otherwise(level)
    return found.select(F.col("id").alias("cell_id"), level.cast("int").alias("level"))


def by_transmitter(receivers: DataFrame, loops: DataFrame) -> DataFrame:
    """Receivers with the vertices of their transmitter loop, by tx_id."""
    return receivers.join(loops, "tx_id")


def sources_in_order(dipoles: DataFrame, source: str = "ab") -> DataFrame:
    """(source, place, receivers): sources in the order in which they first appear, with how many receivers they have."""
    first = dipoles.groupBy(source).agg(F.min("cell_id").alias("_first"), F.count("*").alias("receivers"))
    return numbered(first, ["_first"], "place").select(F.col(source), F.col("place").cast("int").alias("place"), "receivers")


def positions_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both tables, sorted, with the first place of each in the left table (column pos)."""
    return left.join(right, key, "left_semi").groupBy(key).agg(F.min("pos").alias("pos"))


def nth_of_frequency(receivers: DataFrame, transmitters: DataFrame) -> DataFrame:
    """Each receiver with the transmitter that has its frequency and its place among those."""
    numbered = transmitters.withColumn("n", (F.row_number().over(Window.partitionBy("frequency").orderBy("tx")) - 1).cast("int"))
    return receivers.crossJoin(F.broadcast(numbered.select("frequency").distinct())).join(numbered, ["frequency", "n"])


def reordered(model: DataFrame, mapping: DataFrame) -> DataFrame:
    """A model (cell_id, value) in another mesh's order: mapping has cell_id and new_id."""
    return model.join(mapping, "cell_id").select(F.col("new_id").alias("cell_id"), "value")


def scattered(full: DataFrame, part: DataFrame, key: str, value: str, missing: float | None = float("nan")) -> DataFrame:
    """Partial results on the full table; missing rows get ``missing``."""
    joined = full.join(part.select(key, value), key, "left")
    return joined if missing is None else joined.withColumn(value, F.coalesce(F.col(value), F.lit(missing)))


def projected(weights: DataFrame, model: DataFrame) -> DataFrame:
    """(cell_id, value) of a sparse projection (cell_id, local_id, w): weighted mean with 1e-8 added to the weights."""
    return weights.join(model, "local_id").groupBy("cell_id").agg((F.sum(F.col("w") * F.col("value")) / (F.sum("w") + 1e-8)).alias("value"))


def poles(dipoles: DataFrame) -> DataFrame:
    """One row: whether every dipole is a pole (M is N)."""
    return dipoles.agg(F.coalesce(F.bool_and(F.col("m") == F.col("n")), F.lit(False)).alias("pole"))


def potential_difference(dipoles: DataFrame, potential: DataFrame) -> DataFrame:
    """(cell_id, value): the potential at M less that at N, or at M alone where all dipoles are poles."""
    m = potential.select(F.col("id").alias("m"), F.col("value").alias("_vm"))
    n = potential.select(F.col("id").alias("n"), F.col("value").alias("_vn"))
    return dipoles.crossJoin(F.broadcast(poles(dipoles))).join(m, "m").join(n, "n").select("cell_id", F.when(F.col("pole"), F.col("_vm")).otherwise(F.col("_vm") - F.col("_vn")).alias("value"))


def midpoints(dipoles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cell_id, x, y, z) halfway between a dipole's electrodes."""
    m = vertices.select(F.col("id").alias("m"), *[F.col(a).alias(f"_m{a}") for a in "xyz"])
    n = vertices.select(F.col("id").alias("n"), *[F.col(a).alias(f"_n{a}") for a in "xyz"])
    return dipoles.join(m, "m").join(n, "n").select("cell_id", *[((F.col(f"_m{a}") + F.col(f"_n{a}")) / 2).alias(a) for a in "xyz"])


def stacked_transfer(targets: DataFrame, sources: DataFrame, missing: float = float("nan")) -> DataFrame:
    """(cell_id, value) for target cells: of source rows (cell_id, order, value) that fall into a cell the last by order
    holds; inactive or empty cells have no data."""
    last = sources.groupBy("cell_id").agg(F.max_by("value", "order").alias("value"))
    return targets.join(last, "cell_id", "left").select("cell_id", F.when(F.col("active"), F.coalesce("value", F.lit(missing))).otherwise(F.lit(missing)).alias("value"))
