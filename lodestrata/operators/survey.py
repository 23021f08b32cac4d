"""Operators on surveys, their data and models, as tables of stations, components and cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.joins import nearest
from lodestrata.operators.windows import numbered


def component_data(wide: DataFrame, component: str, uncertainty: str | float, id_col: str = "id") -> DataFrame:
    """(id, value, uncertainty) of one component; a number as uncertainty holds for every row, a name is a column."""
    u = F.col(uncertainty) if isinstance(uncertainty, str) else F.lit(float(uncertainty))
    return wide.select(id_col, F.col(component).alias("value"), u.alias("uncertainty"))


def all_data(wide: DataFrame, uncertainties: dict[str, str | float], id_col: str = "id") -> DataFrame:
    """(id, component, value, uncertainty) of all components; one scan, no shuffle."""
    one = lambda c, u: F.struct(F.lit(c).alias("component"), F.col(c).alias("value"), (F.col(u) if isinstance(u, str) else F.lit(float(u))).alias("uncertainty"))
    return wide.select(id_col, F.explode(F.array(*[one(c, u) for c, u in uncertainties.items()])).alias("_d")).select(id_col, "_d.*")


def survey_copy(vertices: DataFrame, dipoles: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """A survey's dipoles (m, n vertex ids) of a predicate with the vertices they use, both renumbered from 0 in the order
    of their ids, as a copy that stands by itself."""
    kept = dipoles.filter(mask)
    used = kept.select(F.explode(F.array("m", "n")).alias("id")).distinct()
    new = numbered(vertices.join(used, "id", "left_semi"), ["id"], "new_id")
    ids = new.select("id", "new_id")
    renamed = kept.join(ids.select(F.col("id").alias("m"), F.col("new_id").alias("new_m")), "m").join(ids.select(F.col("id").alias("n"), F.col("new_id").alias("new_n")), "n")
    return new, renamed


def model_in_order(model: DataFrame, order: DataFrame, resistivity: bool = False) -> DataFrame:
    """(place, name, value) of a model in mesh order; ``order`` maps cell_id to place.  Conductivities are saved as
    resistivities under that name where asked."""
    value = F.when(F.col("value") != 0, 1.0 / F.col("value")) if resistivity else F.col("value")
    return model.join(order, "cell_id").select("place", F.lit("resistivity_model" if resistivity else "model").alias("name"), value.alias("value"))


def scattered_predictions(flat: DataFrame, places: DataFrame, factor: Column) -> DataFrame:
    """(channel, component, receiver, value) of a flat vector (pos, value) by its ordering table, the normalisation taken
    out again."""
    return places.join(flat, "pos").select("channel", "component", "receiver", (F.col("value") / factor).alias("value"))


def electrical_outputs(predicted: DataFrame, observed: DataFrame, factors: DataFrame) -> DataFrame:
    """(cell_id, place, name, value): what an electrical run saves, the residual first, then the potential and the apparent
    resistivity (potential over geometric factor; null where that is 0)."""
    rows = predicted.join(observed.select("cell_id", F.col("value").alias("_o")), "cell_id").join(factors, "cell_id")
    out = [("residual", F.col("_o") - F.col("value")), ("potential", F.col("value")), ("apparent_resistivity", F.try_divide(F.col("value"), F.col("factor")))]
    return rows.select("cell_id", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in out])).alias("place", "_s")).select("cell_id", "place", "_s.*")


def joint_ranges(tiles: DataFrame, driver: str = "driver", count: str = "tiles") -> DataFrame:
    """(driver, first, last): the tiles of each driver within a joint run, one driver after another; ``last`` is exclusive.
    A row for each driver."""
    upto = F.sum(count).over(Window.orderBy(driver))
    return tiles.select(driver, (upto - F.col(count)).alias("first"), upto.alias("last"))


def proper_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, volume) of different cells that share a volume."""
    return pairs.filter("volume > 0 and a <> b")


def known_pairs(pairs: DataFrame, *columns: str) -> DataFrame:
    """Pairs without those where a column holds the sentinel -1 for a missing neighbour."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.col(c) != -1)
    return pairs.filter(keep)


def applied_to_models(models: DataFrame, kinds: list[str], operation: Callable[[Column], Column]) -> DataFrame:
    """(model_type, cell_id, value) with an operation done to the values of the named kinds that are not null."""
    value = F.col("value")
    return models.withColumn("value", F.when(F.col("model_type").isin(kinds) & value.isNotNull(), operation(value)).otherwise(value))


def model_of_kind(models: DataFrame, kind: str, active: DataFrame | None = None) -> DataFrame:
    """(cell_id, value) of one kind of model; without rows where there is none.  Angles are taken on all cells, others may
    be trimmed to the active ones."""
    own = models.filter(F.col("model_type") == kind).select("cell_id", "value")
    return own if active is None else own.join(active.filter("active").select("cell_id"), "cell_id", "left_semi")


def neighbour_corners(cells: DataFrame, pairs: DataFrame, size: float) -> DataFrame:
    """(a, b, xl, yl, zl, xh, yh, zh): low and high corners of each neighbour b of a."""
    own = cells.select(F.col("cell_id").alias("b"), *[(F.col(f"{c}c") + s * size / 2).alias(f"{c}{n}") for n, s in (("l", -1), ("h", 1)) for c in "xyz"])
    return pairs.select("a", "b").join(own, "b").select("a", "b", "xl", "yl", "zl", "xh", "yh", "zh")


def terms_of_drivers(terms: DataFrame, mappings: DataFrame) -> DataFrame:
    """(driver, term, weight): regularisation terms given back to the drivers whose mapping they use."""
    return terms.join(mappings, "mapping").select("driver", "term", "weight")


def kernel(stations: DataFrame, cells: DataFrame, terms: Column) -> DataFrame:
    """(id, cell_id, g): the dense kernel of an integral response, a row for each station and active cell.  Every pair is
    wanted by definition; cells go to the stations' tasks, and stations are not shuffled."""
    return stations.crossJoin(cells).select("id", "cell_id", terms.alias("g"))


def on_triangles(locations: DataFrame, vertices: DataFrame, triangles: DataFrame, width: float) -> DataFrame:
    """(id, z): height of a triangulated surface below or above locations by linear interpolation, places being rounded to
    whole numbers first; outside of all triangles that of the nearest vertex in space.

    Triangles (t, v0, v1, v2) meet locations by grid squares of ``width`` that their boxes touch, an equi-join; of several
    triangles with a point on their edge the first counts."""
    at = lambda n: vertices.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    tin = triangles.join(at("v0"), "v0").join(at("v1"), "v1").join(at("v2"), "v2")
    square = lambda c: F.floor(c / width).cast("long")
    spans = [F.sequence(square(F.least(*[F.col(f"v{k}{c}") for k in range(3)])), square(F.greatest(*[F.col(f"v{k}{c}") for k in range(3)]))) for c in "xy"]
    tin = tin.withColumn("_i", F.explode(spans[0])).withColumn("_j", F.explode(spans[1]))
    points = locations.select("id", F.round("x").alias("x"), F.round("y").alias("y"), "z")
    c = F.col
    area = (c("v1y") - c("v2y")) * (c("v0x") - c("v2x")) + (c("v2x") - c("v1x")) * (c("v0y") - c("v2y"))
    a = ((c("v1y") - c("v2y")) * (c("x") - c("v2x")) + (c("v2x") - c("v1x")) * (c("y") - c("v2y"))) / area
    b = ((c("v2y") - c("v0y")) * (c("x") - c("v2x")) + (c("v0x") - c("v2x")) * (c("y") - c("v2y"))) / area
    met = points.withColumn("_i", square(c("x"))).withColumn("_j", square(c("y"))).join(tin, ["_i", "_j"]).filter(area != 0)
    inside = met.select("id", "t", a.alias("_a"), b.alias("_b"), "v0z", "v1z", "v2z").filter("_a >= -1e-12 and _b >= -1e-12 and _a + _b <= 1 + 1e-12")
    height = F.col("_a") * F.col("v0z") + F.col("_b") * F.col("v1z") + (1 - F.col("_a") - F.col("_b")) * F.col("v2z")
    linear = inside.groupBy("id").agg(F.min_by(height, "t").alias("z"))
    outside = points.join(linear, "id", "left_anti")
    near = nearest(outside, vertices.select("id", "x", "y", "z"), 1, ("x", "y", "z")).join(vertices.select(F.col("id").alias("nn_id"), "z"), "nn_id").select("id", "z")
    return linear.unionByName(near)


def in_first_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first, place): distinct values in the order of their first appearance."""
    first = df.groupBy(value).agg(F.min(order).alias("first"))
    return numbered(first, ["first"], "place")


def reversed_layers(layers: DataFrame, group: str, order: str) -> DataFrame:
    """The layers of each group with ``place`` counted from the last one."""
    return layers.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order))) - 1)


def in_all_groups(df: DataFrame, value: str, group: str) -> DataFrame:
    """Values that every group has; distinct counts, no window over the table."""
    groups = df.agg(F.count_distinct(group).alias("_n"))
    return df.select(value, group).distinct().groupBy(value).agg(F.count("*").alias("_k")).crossJoin(F.broadcast(groups)).filter("_k = _n").select(value)


def sweep_parameters(stations: DataFrame, line: str = "line_id") -> DataFrame:
    """One row: the least and the largest line and how many there are, which make up a sweep over lines."""
    return stations.agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count_distinct(line).alias("n"))


def job_stem(name: Column) -> Column:
    """A job file's name without its extensions."""
    return F.regexp_replace(F.regexp_replace(name, r"\.json$", ""), r"\.ui$", "")


def line_jobs(stations: DataFrame, lookup: DataFrame, form: dict[str, Column], line: str = "line_id") -> DataFrame:
    """(line, file, status, job): a job form as JSON for each line that is pending in the lookup, which becomes written;
    other lines keep their status and have no job.  ``form`` gives a form's entries as aggregates of a line's stations."""
    own = stations.groupBy(line).agg(*[c.alias(k) for k, c in form.items()])
    job = F.to_json(F.struct(F.col(line), *[F.col(k) for k in form]))
    pending = F.col("status") == "pending"
    return lookup.join(own, line, "left").select(line, "file", F.when(pending, "written").otherwise(F.col("status")).alias("status"), F.when(pending, job).alias("job"))


def split_evenly(counts: list[int], workers: int) -> list[int]:
    """Into how many parts each item is split, one more in turn until the parts divide among the workers; items of a
    single row are not split further."""
    parts = [1] * len(counts)
    room = [max(1, c) for c in counts]
    while sum(parts) % workers and any(p < r for p, r in zip(parts, room, strict=True)):
        for i in range(len(parts)):
            if sum(parts) % workers == 0:
                break
            if parts[i] < room[i]:
                parts[i] += 1
    return parts
