"""Order-dependent work along lines, prisms and tables of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.plans.checkpoints import cut


def along_line(df: DataFrame, line: str = "line_id", order: str = "pos") -> DataFrame:
    """Adds ``along``: the distance walked in plan from the line's first station."""
    w = Window.partitionBy(line).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("along", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def smoothed(df: DataFrame, columns: list[str], width: int = 2, line: str = "line_id", order: str = "pos") -> DataFrame:
    """Centred means of up to 2 * width + 1 neighbours along a line; its first and last station stay as they are."""
    w = Window.partitionBy(line).orderBy(order)
    near, end = w.rowsBetween(-width, width), F.lag(order).over(w).isNull() | F.lead(order).over(w).isNull()
    return df.withColumns({c: F.when(end, F.col(c)).otherwise(F.avg(c).over(near)) for c in columns})


def cell_widths(df: DataFrame, group: str, order: str, centre: str, tie: str = "id") -> DataFrame:
    """Widths of columns from their centres: half the way to both neighbours, the nearest one twice at the ends.  Columns
    at one place follow each other by ``tie``, so that the widths do not depend on how the rows are dealt."""
    w = Window.partitionBy(group).orderBy(order, tie)
    before, after = F.col(centre) - F.lag(centre).over(w), F.lead(centre).over(w) - F.col(centre)
    return df.withColumn("width", (F.coalesce(before, after) + F.coalesce(after, before)) / 2)


def layer_heights(layers: DataFrame, prism: str = "prism_id", order: str = "k") -> DataFrame:
    """Thickness of each layer of a prism: the bottom above (or the prism's top) less its own bottom."""
    return layers.withColumn("height", F.coalesce(F.lag("bottom").over(Window.partitionBy(prism).orderBy(order)), F.col("top")) - F.col("bottom"))


def draped_columns(columns: DataFrame, heights: DataFrame) -> DataFrame:
    """Every column (prism_id, top) with every layer (k, h): bottoms from the summed heights; layers are few."""
    depth = heights.withColumn("_depth", F.sum("h").over(Window.partitionBy(F.lit(1)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return columns.crossJoin(F.broadcast(depth.select("k", "_depth"))).select("prism_id", "top", "k", (F.col("top") - F.col("_depth")).alias("bottom"))


def time_steps(times: DataFrame, unit: float = 1.0) -> DataFrame:
    """(t, dt): steps between distinct times, rounded (ties to even) to 6 places before the unit."""
    t = times.select("t").distinct()
    return t.withColumn("dt", F.bround(F.lead("t").over(Window.orderBy("t")) - F.col("t"), 6) * unit).filter(F.col("dt").isNotNull())


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Rows with their place (from 0) in an order without ties.  Rows are dealt by ranges of the order and counted within
    them; the ranges' sizes, a row for each partition, are added up.  So no task holds the table.  Cut by a checkpoint, as
    the ranges are found by sampling and must stay the same."""
    rows = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_within")).drop("_p", "_within", "_before")


def even_split(df: DataFrame, n: int, order: list[str], name: str = "part") -> DataFrame:
    """Parts of equal size in an order without ties; the first ones are one longer where it does not divide."""
    size = df.agg(F.floor(F.count("*") / n).alias("_s"), (F.count("*") % n).alias("_l"))
    place, short, longer = F.col("_at"), F.col("_s"), F.col("_l")
    edge = longer * (short + 1)
    part = F.when(place < edge, F.floor(place / (short + 1))).otherwise(longer + F.floor((place - edge) / F.greatest(short, F.lit(1))))
    return numbered(df, order, "_at").crossJoin(F.broadcast(size)).withColumn(name, part.cast("int")).drop("_at", "_s", "_l")


def coded(df: DataFrame, columns: list[Column], name: str = "code") -> DataFrame:
    """Numbers from 0 for distinct combinations, in their order.  Distinct values are numbered, then joined back, so all
    rows of the table never meet in one task."""
    keyed = df.withColumns({f"_c{i}": c for i, c in enumerate(columns)})
    names = [f"_c{i}" for i in range(len(columns))]
    codes = numbered(keyed.select(*names).distinct(), names, name).withColumn(name, F.col(name).cast("int"))
    return keyed.join(codes, names).drop(*names)


def renumbered(vertices: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that cells (m, n) use with new ids from 0, and the cells with them."""
    used = cells.select(F.explode(F.array("m", "n")).alias("id")).distinct()
    codes = numbered(used, ["id"], "new_id").withColumn("new_id", F.col("new_id").cast("int"))
    m, n = (codes.select(F.col("id").alias(a), F.col("new_id").alias(f"new_{a}")) for a in "mn")
    return vertices.join(codes, "id"), cells.join(m, "m").join(n, "n")


def ordering(channels: DataFrame, components: DataFrame, receivers: DataFrame) -> DataFrame:
    """(pos, channel, component, receiver) of a flat data vector: receivers run fastest, channels slowest."""
    n_c, n_r = (d.agg(F.count("*").alias(n)) for d, n in ((components, "_nc"), (receivers, "_nr")))
    grid = channels.crossJoin(F.broadcast(components)).crossJoin(receivers).crossJoin(F.broadcast(n_c)).crossJoin(F.broadcast(n_r))
    return grid.select(((F.col("channel") * F.col("_nc") + F.col("component")) * F.col("_nr") + F.col("receiver")).alias("pos"), "channel", "component", "receiver")


def circumradius(df: DataFrame, order: str, x: str, y: str) -> DataFrame:
    """Radius of the circle through each point and its two neighbours in an order; infinite at the ends and on lines."""
    w = Window.partitionBy(F.lit(1)).orderBy(order)
    ax, ay, bx, by, cx, cy = F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y), F.lead(x).over(w), F.lead(y).over(w)
    area = F.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
    sides = F.hypot(bx - ax, by - ay) * F.hypot(cx - bx, cy - by) * F.hypot(cx - ax, cy - ay)
    return df.withColumn("radius", F.coalesce(F.try_divide(sides, area * 2), F.lit(float("inf"))))


def every_nth(model: DataFrame, n: int, part: int) -> DataFrame:
    """A strided slice of a model from the bottom up: (place, value)."""
    rows = model.filter(F.col("cell_id") % n == part)
    return numbered(rows, [F.desc("cell_id")], "place").select(F.col("place").cast("int").alias("place"), "value")


def counter_clockwise(loop: DataFrame, group: str = "tx_id", order: str = "seq") -> DataFrame:
    """Segments (x0, y0, x1, y1) of closed loops in counter-clockwise order: where the mean cross product about the
    loop's centre is negative, the order and the ends of all segments are turned."""
    centre = loop.groupBy(group).agg(F.avg("x0").alias("_cx"), F.avg("y0").alias("_cy"))
    cross = (F.col("x0") - F.col("_cx")) * (F.col("y1") - F.col("_cy")) - (F.col("x1") - F.col("_cx")) * (F.col("y0") - F.col("_cy"))
    turn = loop.join(centre, group).groupBy(group).agg((F.avg(cross) < 0).alias("_turn"))
    swap = lambda a, b: F.when(F.col("_turn"), F.col(b)).otherwise(F.col(a))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.when(F.col("_turn"), -F.col(order)).otherwise(F.col(order)))) - 1
    turned = loop.join(turn, group)
    return turned.select(group, place.cast("int").alias("place"), *[swap(a, b).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))])


def closed(segments: DataFrame, group: str = "tx_id", order: str = "seq") -> DataFrame:
    """Open chains of segments (v0, v1) with a closing one from the last to the first vertex, where they are open."""
    ends = segments.groupBy(group).agg(F.max_by("v1", order).alias("v0"), F.min_by("v0", order).alias("v1"), (F.max(order) + 1).alias(order))
    return segments.select(group, order, "v0", "v1").unionByName(ends.filter("v0 <> v1").select(group, order, "v0", "v1"))


def rank_by(df: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """Places from 0 by falling value; for small tables of totals."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(F.desc(value), tie)) - 1).cast("int"))


def greedy_order(stations: DataFrame, line: str = "line_id") -> DataFrame:
    """(line, id, place) along each line: always on to the nearest station not yet met, from the one with the smallest
    x, then y, then id.  A line is one group, so lines must fit a task."""
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "id"]).reset_index(drop=True)
        xy, left, at, out = pdf[["x", "y"]].to_numpy(), list(range(1, len(pdf))), 0, [0]
        while left:
            d = ((xy[left] - xy[at]) ** 2).sum(1)
            at = left.pop(int(d.argmin()))
            out.append(at)
        return pd.DataFrame({line: pdf[line].iloc[out].to_numpy(), "id": pdf["id"].iloc[out].to_numpy(), "place": range(len(out))})

    kinds = {f.name: f.dataType.simpleString() for f in stations.schema}
    return stations.select(line, "id", "x", "y").groupBy(line).applyInPandas(walk, f"{line} {kinds[line]}, id {kinds['id']}, place int")
