"""Queries over survey tables: masks, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import aggregates, filters, joins, mesh, tiling, windows
from lodestrata.plans.registry import query
from lodestrata.sources import io

R = 6  # places to which results of floating arithmetic are rounded


def rounded(df, *names):
    return df.withColumns({n: F.round(n, R) for n in names})


# ------------------------------------------------------------------------------------------------ sources and sinks


@query("s03_locations", "SELECT a.id AS cell_id, round((v.x + w.x) / 2, 6) AS x, round((v.y + w.y) / 2, 6) AS y, round((v.z + w.z) / 2, 6) AS z FROM (SELECT cell_id AS id, m, n FROM dipoles) a JOIN stations v ON v.id = a.m JOIN stations w ON w.id = a.n")
def _(v):
    return rounded(joins.midpoints(v.dipoles, v.stations), "x", "y", "z")


@query("s04_topography_override", "SELECT s.id, s.x, s.y, CASE WHEN s.id % 3 = 0 THEN 12.5e0 ELSE s.z END AS z FROM stations s")
def _(v):
    elevation = F.when(F.col("id") % 3 == 0, F.lit(12.5))
    return v.stations.select("id", "x", "y", F.coalesce(elevation, F.col("z")).alias("z"))


@query("s05_property_group", "SELECT vec_id AS id, c.channel, CAST(embedding[c.k] AS DOUBLE) AS value FROM embeddings CROSS JOIN (VALUES (10.0e0, 11), (100.0e0, 12), (1000.0e0, 13)) c(channel, k)")
def _(v):
    wide = v.table("embeddings").select(F.col("vec_id").alias("id"), *[F.element_at("embedding", 11 + i).cast("double").alias(f"ch{i}") for i in range(3)])
    return io.long_channels(wide, "id", {"ch0": 10.0, "ch1": 100.0, "ch2": 1000.0})


@query("s08_save_data", "SELECT id, round(max(CASE WHEN component = 'gx' THEN value END), 6) AS gx, round(max(CASE WHEN component = 'gx' THEN uncertainty END), 6) AS gx_uncertainty, round(max(CASE WHEN component = 'gz' THEN -value END), 6) AS gz, round(max(CASE WHEN component = 'gz' THEN uncertainty END), 6) AS gz_uncertainty FROM observed WHERE component IN ('gx', 'gz') GROUP BY id")
def _(v):
    two = v.observed.filter(F.col("component").isin("gx", "gz"))
    return rounded(io.saved_data(two, scalars.sign(F.col("component"), "gravity")), "gx", "gx_uncertainty", "gz", "gz_uncertainty")


@query("s11_no_data_model", "SELECT cell_id, CASE WHEN active THEN value ELSE -9999.0e0 END AS value FROM model")
def _(v):
    return v.model.select("cell_id", scalars.no_data(F.col("value"), F.col("active"), -9999.0).alias("value"))


@query("s12_model_transforms", "SELECT cell_id, CASE WHEN active THEN round(1.0e0 / exp(value), 6) END AS value FROM model")
def _(v):
    saved = io.saved_model(v.model.select("cell_id", "value").filter(v.model["active"]), v.model.select("cell_id", "active"), [F.exp, scalars.inverse_property])
    return saved.select("cell_id", F.when(~F.isnan("value"), F.round("value", R)).alias("value"))


@query("s13_sensitivities", "SELECT c.cell_id, round(s.norm / 1000.0e0, 6) AS value FROM cells c LEFT JOIN (SELECT l_partkey % 300 AS cell_id, sqrt(sum(l_quantity * l_quantity)) AS norm FROM lineitem GROUP BY 1) s ON s.cell_id = c.cell_id")
def _(v):
    j = v.table("lineitem").select((F.col("l_partkey") % 300).alias("cell_id"), F.col("l_quantity").alias("j"))
    return rounded(aggregates.sensitivity_norm(j, v.cells.select("cell_id", F.lit(1000.0).alias("volume"))), "value")


@query("s15_residual", "SELECT o.id, o.component, round(o.value - p.value, 6) AS residual FROM observed o JOIN predicted p ON p.id = o.id AND p.component = o.component")
def _(v):
    return rounded(io.residual(v.observed, v.predicted, ["id", "component"]), "residual")


@query("s20_line_lookup", "SELECT CAST(k AS INTEGER) AS line_id, 'f' || k AS file, 'pending' AS status FROM (SELECT range AS k FROM range(5))")
def _(v):
    text = v.spark.range(1).select(F.to_json(F.create_map(*[x for k in range(5) for x in (F.lit(f"f{k}"), F.struct(F.lit(k).alias("line_id"), F.lit("pending").alias("status")))])).alias("value"))
    return io.line_files(text)


@query("s30_unit_lookup", "SELECT c.cell_id, coalesce(u.code, 0) AS code FROM cells c LEFT JOIN (SELECT m.cell_id, d.code FROM model m JOIN (VALUES (1, 10), (2, 20), (3, 30)) d(unit, code) ON d.unit = m.unit WHERE m.active) u ON u.cell_id = c.cell_id")
def _(v):
    codes = F.create_map(*[F.lit(x) for p in ((1, 10), (2, 20), (3, 30)) for x in p])
    known = v.model.filter("active").select("cell_id", F.try_element_at(codes, F.col("unit")).alias("code"))
    return v.cells.select("cell_id").join(known, "cell_id", "left").select("cell_id", F.coalesce("code", F.lit(0)).alias("code"))


# ------------------------------------------------------------------------------------------------------------ masks


@query("f01_checked_mask", "SELECT id, line_id % 2 = 1 AS mask FROM stations")
def _(v):
    return filters.checked_mask(v.stations.select("id", (F.col("line_id") % 2).alias("mask")), "mask")


@query("f02_mask_filter", "SELECT id, component, value FROM observed WHERE id % 3 = 1")
def _(v):
    return filters.masked(v.observed, F.col("id") % 3 == 1).select("id", "component", "value")


@query("f03_line_filter", "SELECT id, x, y, z FROM stations WHERE line_id = 3")
def _(v):
    return filters.on_line(v.stations, 3).select("id", "x", "y", "z")


@query("f04_sub_survey", "SELECT s.id, s.x, s.y FROM stations s WHERE s.id IN (SELECT m FROM dipoles WHERE line_id < 4 UNION SELECT n FROM dipoles WHERE line_id < 4)")
def _(v):
    return filters.sub_survey(v.stations, v.dipoles, F.col("line_id") < 4)[0].select("id", "x", "y")


@query("f05_active_below_topography", "WITH n AS (SELECT c.cell_id, c.zc, t.z, row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt((c.xc - t.x) * (c.xc - t.x) + (c.yc - t.y) * (c.yc - t.y)), t.id) AS r FROM cells c CROSS JOIN topo t) SELECT cell_id, zc + 50.0e0 < z AS active FROM n WHERE r = 1")
def _(v):
    return mesh.below_surface(v.cells, v.topo, 100.0, "top")


@query("f08_remove_air", "SELECT cell_id, value FROM model WHERE active")
def _(v):
    return filters.trimmed(v.model.select("cell_id", "value"), v.model.select("cell_id", "active"))


@query("f09_percentile_mask", "WITH q AS (SELECT quantile_cont(value, 0.1) AS l FROM gappy WHERE component = 'gx' AND NOT isnan(value)) SELECT id, NOT isnan(value) AND value > l AS keep FROM gappy, q WHERE component = 'gx'")
def _(v):
    return filters.sensitivity_mask(v.gappy.filter("component = 'gx'").select("id", "value"), "value", 10.0, "percentile").select("id", "keep")


@query("f10_percent_mask", "WITH q AS (SELECT max(value) AS m FROM gappy WHERE component = 'gx' AND NOT isnan(value)) SELECT id, NOT isnan(value) AND value * 100.0e0 / m > 10.0e0 AS keep FROM gappy, q WHERE component = 'gx'")
def _(v):
    return filters.sensitivity_mask(v.gappy.filter("component = 'gx'").select("id", "value"), "value", 10.0, "percent").select("id", "keep")


@query("f11_log_percent_mask", "WITH g AS (SELECT id, CASE WHEN NOT isnan(value) AND value > 0 THEN log10(value) END AS v FROM gappy WHERE component = 'gx'), q AS (SELECT min(v) AS a, max(v) AS b FROM g) SELECT id, coalesce((v - a) * 100.0e0 / (b - a) > 50.0e0, false) AS keep FROM g, q")
def _(v):
    return filters.sensitivity_mask(v.gappy.filter("component = 'gx'").select("id", "value"), "value", 50.0, "log_percent").select("id", "keep")


@query("f14_floating_active", "SELECT bool_or(b.active AND NOT a.active) AS floating FROM (SELECT c.*, m.active FROM cells c JOIN model m ON m.cell_id = c.cell_id) a JOIN (SELECT c.*, m.active FROM cells c JOIN model m ON m.cell_id = c.cell_id) b ON b.i = a.i AND b.j = a.j AND b.k = a.k + 1")
def _(v):
    return filters.floating_active(v.cells.join(v.model, "cell_id"))


@query("f15_dummy_data", "SELECT id, component, CASE WHEN isnan(value) THEN -999.0e0 ELSE value END AS value, CASE WHEN isnan(value) THEN CAST('Infinity' AS DOUBLE) ELSE uncertainty END AS deviation FROM gappy")
def _(v):
    return v.gappy.select("id", "component", scalars.dummy_value(F.col("value")).alias("value"), scalars.dummy_deviation(F.col("value"), F.col("uncertainty")).alias("deviation"))


@query("f17_clamped_depth", "SELECT id, x, y, greatest(z, (SELECT max(z) FROM stations) - 20.0e0) AS z FROM stations")
def _(v):
    return filters.clamped_depth(v.stations, 20.0).select("id", "x", "y", "z")


@query("f18_waveform_fits", "SELECT (SELECT max(value) FROM readings WHERE event_type = 'click') <= (SELECT max(value) FROM readings) - 2.0e0 AS fits")
def _(v):
    r = v.readings.withColumn("t", F.col("value"))
    return filters.waveform_fits(r.filter("event_type = 'click'"), r, 2.0)


@query("f19_on_time", "SELECT id, value FROM observed WHERE component = 'gy' AND value <= 0")
def _(v):
    return filters.on_time(v.observed.filter("component = 'gy'").withColumn("t", F.col("value"))).select("id", "value")


@query("f21_observed_normalized", "SELECT id, component, value * f AS value, abs(uncertainty * f) AS uncertainty FROM (SELECT *, CASE WHEN component IN ('gz', 'gxz', 'gyz') THEN -1.0e0 ELSE 1.0e0 END AS f FROM observed) WHERE id % 2 = 0")
def _(v):
    f = scalars.sign(F.col("component"), "gravity")
    return filters.masked(v.observed, F.col("id") % 2 == 0).select("id", "component", scalars.normalized(F.col("value"), f).alias("value"), scalars.normalized(F.col("uncertainty"), f, True).alias("uncertainty"))


# ------------------------------------------------------------------------------------------------------------ joins

NEAREST = "row_number() OVER (PARTITION BY {a}.{i} ORDER BY sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y)), {b}.id)"


@query("j01_receivers_by_loop", "SELECT s.id, s.tx_id, l.seq, l.x FROM loops s JOIN loops l ON l.tx_id = s.tx_id")
def _(v):
    return joins.by_transmitter(v.loops.select("id", "tx_id"), v.loops.select("tx_id", "seq", "x"))


@query("j02_source_order", "SELECT ab, CAST(row_number() OVER (ORDER BY min(cell_id)) - 1 AS INTEGER) AS place, count(*) AS receivers FROM dipoles GROUP BY ab")
def _(v):
    return joins.sources_in_order(v.dipoles)


@query("j03_tile_subset", "SELECT o.id, o.component, o.value FROM observed o WHERE o.component = 'gz' AND o.id IN (SELECT id FROM stations WHERE line_id = 2)")
def _(v):
    return v.observed.filter("component = 'gz'").join(filters.on_line(v.stations, 2), "id", "left_semi").select("id", "component", "value")


@query("j04_common_positions", "SELECT e.line_id, min(e.pos) AS pos FROM electrodes e WHERE e.line_id IN (SELECT line_id FROM readings) GROUP BY e.line_id")
def _(v):
    return joins.positions_in(v.electrodes.withColumn("line_id", F.col("line_id").cast("long")), v.readings, "line_id").withColumn("line_id", F.col("line_id").cast("int"))


@query("j05_frequency_pairs", "WITH tx AS (SELECT id AS tx, line_id AS frequency, CAST(row_number() OVER (PARTITION BY line_id ORDER BY id) - 1 AS INTEGER) AS n FROM stations) SELECT r.id, t.frequency, t.tx FROM (SELECT id, pos - 1 AS n FROM electrodes) r JOIN tx t ON t.n = r.n")
def _(v):
    rx = v.electrodes.select("id", (F.col("pos") - 1).alias("n"))
    return joins.nth_of_frequency(rx, v.stations.select(F.col("id").alias("tx"), F.col("line_id").alias("frequency"))).select("id", "frequency", "tx")


@query("j06_nearest_value", f"WITH n AS (SELECT c.cell_id, t.z, row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt((c.xc - t.x) * (c.xc - t.x) + (c.yc - t.y) * (c.yc - t.y) + (c.zc - t.z) * (c.zc - t.z)), t.id) AS r FROM cells c CROSS JOIN stations t) SELECT cell_id, z FROM n WHERE r = 1")
def _(v):
    target = v.cells.select("cell_id", F.col("xc").alias("x"), F.col("yc").alias("y"), F.col("zc").alias("z"))
    return joins.nearest_value(target, v.stations.withColumn("v", F.col("z")), "v", target_id="cell_id").withColumnRenamed("v", "z")


@query("j07_draped_locations", "WITH n AS (SELECT s.id, t.z, sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) AS d, " + NEAREST.format(a="s", b="t", i="id") + " AS r FROM stations s CROSS JOIN topo t) SELECT id, round(sum(z / (d + 1e-8)) / sum(1.0e0 / (d + 1e-8)), 6) AS z FROM n WHERE r <= 2 GROUP BY id")
def _(v):
    return rounded(joins.draped(v.stations, v.topo), "z")


@query("j08_containing_cells", "SELECT s.id, c.cell_id FROM stations s JOIN cells c ON s.x >= c.xc - 50 AND s.x < c.xc + 50 AND s.y >= c.yc - 50 AND s.y < c.yc + 50 AND s.z >= c.zc - 50 AND s.z < c.zc + 50")
def _(v):
    return joins.containing_cells(v.stations, v.cells, (-400.0, -400.0, -400.0), (100.0, 100.0, 100.0))


@query("j09_crossed_cells", "WITH s AS (SELECT a.id AS segment_id, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1 FROM electrodes a JOIN electrodes b ON a.line_id = b.line_id AND b.pos = a.pos + 1), t AS (SELECT s.segment_id, c.cell_id, (c.xc - 50 - x0) / (x1 - x0) AS xa, (c.xc + 50 - x0) / (x1 - x0) AS xb, (c.yc - 50 - y0) / (y1 - y0) AS ya, (c.yc + 50 - y0) / (y1 - y0) AS yb, (c.zc - 50 - z0) / (z1 - z0) AS za, (c.zc + 50 - z0) / (z1 - z0) AS zb FROM s CROSS JOIN cells c) SELECT DISTINCT segment_id, cell_id FROM t WHERE greatest(0.0e0, least(xa, xb), least(ya, yb), least(za, zb)) <= least(1.0e0, greatest(xa, xb), greatest(ya, yb), greatest(za, zb))")
def _(v):
    a = v.electrodes.select("line_id", "pos", F.col("id").alias("segment_id"), *[F.col(t).alias(f"{t}0") for t in "xyz"])
    b = v.electrodes.select("line_id", (F.col("pos") - 1).alias("pos"), *[F.col(t).alias(f"{t}1") for t in "xyz"])
    boxes = mesh.corners(v.cells.withColumnsRenamed({"xc": "xc", "yc": "yc", "zc": "zc"}), 100.0)
    return joins.crossed_cells(a.join(b, ["line_id", "pos"]), boxes, 200.0)


@query("j10_refinement_levels", "WITH d AS (SELECT c.cell_id, min(sqrt((c.xc - s.x) * (c.xc - s.x) + (c.yc - s.y) * (c.yc - s.y) + (c.zc - s.z) * (c.zc - s.z))) AS d FROM cells c CROSS JOIN stations s GROUP BY c.cell_id) SELECT cell_id, CASE WHEN d < 60 THEN 0 WHEN d < 120 THEN 1 ELSE 2 END AS level FROM d")
def _(v):
    return joins.refinement_levels(v.cells, v.stations, [60.0, 120.0])


@query("j11_local_active", "SELECT c.cell_id, coalesce(m.active, false) AS active FROM cells c LEFT JOIN (SELECT * FROM model WHERE cell_id < 100) m ON m.cell_id = c.cell_id")
def _(v):
    local = v.model.filter("cell_id < 100").select("cell_id", "active")
    return v.cells.select("cell_id").join(local, "cell_id", "left").select("cell_id", F.coalesce("active", F.lit(False)).alias("active"))


@query("j12_stacked_transfer", "SELECT m.cell_id, CASE WHEN m.active THEN s.value END AS value FROM model m LEFT JOIN (SELECT l_partkey % 256 AS cell_id, max_by(l_quantity, l_orderkey * 100 + l_linenumber) AS value FROM lineitem GROUP BY 1) s ON s.cell_id = m.cell_id")
def _(v):
    source = v.table("lineitem").select((F.col("l_partkey") % 256).alias("cell_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("order"), F.col("l_quantity").alias("value"))
    out = joins.stacked_transfer(v.model.select("cell_id", "active"), source)
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query("j13_reordered_model", "SELECT (cell_id * 37) % 256 AS cell_id, value FROM model")
def _(v):
    return joins.reordered(v.model.select("cell_id", "value"), v.cells.select("cell_id", (F.col("cell_id") * 37 % 256).alias("new_id")))


@query("j15_potential_difference", "SELECT d.cell_id, round(a.z - b.z, 6) AS value FROM dipoles d JOIN stations a ON a.id = d.m JOIN stations b ON b.id = d.n")
def _(v):
    return rounded(joins.potential_difference(v.dipoles, v.stations.select("id", F.col("z").alias("value"))), "value")


@query("j17_value_map", "SELECT m.cell_id, d.name FROM model m JOIN (VALUES (0, 'air'), (1, 'till'), (2, 'rock'), (3, 'ore')) d(unit, name) ON d.unit = m.unit")
def _(v):
    names = F.create_map(*[F.lit(x) for p in ((0, "air"), (1, "till"), (2, "rock"), (3, "ore")) for x in p])
    return v.model.select("cell_id", F.element_at(names, F.col("unit")).alias("name"))


@query("j18_geological_units", "SELECT DISTINCT unit FROM model WHERE unit <> 0")
def _(v):
    return v.model.select("unit").distinct().filter("unit <> 0")


@query("j19_scattered_results", "SELECT s.id, CASE WHEN s.line_id = 3 THEN s.z ELSE -1.0e0 END AS value FROM stations s")
def _(v):
    part = filters.on_line(v.stations, 3).select("id", F.col("z").alias("value"))
    return joins.scattered(v.stations.select("id"), part, "id", "value", -1.0)


@query("j20_projected_model", "SELECT l.l_partkey % 256 AS cell_id, round(sum(l.l_discount * m.value) / (sum(l.l_discount) + 1e-8), 6) AS value FROM lineitem l JOIN model m ON m.cell_id = l.l_suppkey % 256 GROUP BY 1")
def _(v):
    w = v.table("lineitem").select((F.col("l_partkey") % 256).alias("cell_id"), (F.col("l_suppkey") % 256).alias("local_id"), F.col("l_discount").alias("w"))
    return rounded(joins.projected(w, v.model.select(F.col("cell_id").alias("local_id"), "value")), "value")


@query("j22_ground_elevation", "WITH n AS (SELECT s.id, s.z + t.z AS z, " + NEAREST.format(a="s", b="t", i="id") + " AS r FROM stations s CROSS JOIN topo t) SELECT id, round(z, 6) AS z FROM n WHERE r = 1")
def _(v):
    ground = joins.nearest_value(v.stations, v.topo.withColumn("ground", F.col("z")), "ground", ("x", "y"))
    return v.stations.join(ground, "id").select("id", F.round(F.col("z") + F.col("ground"), R).alias("z"))


@query("j23_vector_blocks", "SELECT CAST(cell_id // 100 AS INTEGER) AS component, cell_id % 100 AS cell, value FROM model")
def _(v):
    return v.model.select(F.floor(F.col("cell_id") / 100).cast("int").alias("component"), (F.col("cell_id") % 100).alias("cell"), "value")


# ------------------------------------------------------------------------------------------------------- aggregates


@query("a01_station_spacing", "WITH n AS (SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM stations a JOIN stations b ON a.id <> b.id GROUP BY a.id) SELECT round(median(d), 6) AS median, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS largest FROM n")
def _(v):
    return rounded(aggregates.station_spacing(v.stations), "median", "mean", "least", "largest")


@query("a02_window", "SELECT round((min(x) + max(x)) / 2, 6) AS x, round((min(y) + max(y)) / 2, 6) AS y, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height FROM stations")
def _(v):
    return rounded(aggregates.window_of(v.stations), "x", "y", "width", "height")


@query("a03_padding_distance", "SELECT round_even(greatest(max(x) - min(x), max(y) - min(y)) / 2.0e0 / 100.0e0, 0) * 100.0e0 AS padding FROM stations")
def _(v):
    return aggregates.padding_distance(v.stations)


@query("a04_depth_core", "SELECT round(CASE WHEN 500.0e0 >= max(z) - min(z) THEN 500.0e0 - (max(z) - min(z)) + 10.0e0 ELSE 500.0e0 END, 6) AS depth FROM stations")
def _(v):
    return rounded(aggregates.depth_core(v.stations, 500.0, 10.0), "depth")


@query("a05_data_count", "SELECT component, count(*) AS n FROM gappy GROUP BY component")
def _(v):
    return v.gappy.groupBy("component").agg(F.count("*").alias("n"))


@query("a06_active_count", "SELECT count(*) FILTER (WHERE active) AS n_active, count(*) AS n_cells FROM model")
def _(v):
    return v.model.agg(F.count_if("active").alias("n_active"), F.count("*").alias("n_cells"))


@query("a07_trend", "WITH p AS (SELECT s.x, s.y, o.value AS v FROM stations s JOIN gappy o ON o.id = s.id WHERE o.component = 'gz' AND NOT isnan(o.value)), c AS (SELECT sum(abs(v) * x) / sum(abs(v)) AS x0, sum(abs(v) * y) / sum(abs(v)) AS y0 FROM p), s AS (SELECT x0, y0, count(*)::DOUBLE AS n, sum(x - x0) AS sx, sum(y - y0) AS sy, sum((x - x0) * (x - x0)) AS sxx, sum((x - x0) * (y - y0)) AS sxy, sum((y - y0) * (y - y0)) AS syy, sum(v) AS sv, sum((x - x0) * v) AS sxv, sum((y - y0) * v) AS syv FROM p, c GROUP BY x0, y0), d AS (SELECT *, n * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy) AS det FROM s) SELECT round(x0, 4) AS x0, round(y0, 4) AS y0, round((sv * (sxx * syy - sxy * sxy) - sx * (sxv * syy - sxy * syv) + sy * (sxv * sxy - sxx * syv)) / det, 6) AS c0, round((n * (sxv * syy - sxy * syv) - sv * (sx * syy - sxy * sy) + sy * (sx * syv - sxv * sy)) / det, 6) AS cx, round((n * (sxx * syv - sxv * sxy) - sx * (sx * syv - sxv * sy) + sv * (sx * sxy - sxx * sy)) / det, 6) AS cy FROM d")
def _(v):
    points = v.stations.select("id", "x", "y").join(v.gappy.filter("component = 'gz'"), "id")
    out = aggregates.trend(points)
    return out.select(F.round("x0", 4).alias("x0"), F.round("y0", 4).alias("y0"), *[F.round(c, R).alias(c) for c in ("c0", "cx", "cy")])


@query("a08_unit_means", "SELECT unit, round(avg(property), 6) AS mean FROM units GROUP BY unit")
def _(v):
    return rounded(aggregates.unit_means(v.units), "mean")


@query("a09_unit_weights", "SELECT unit, round(sum(volume) / sum(sum(volume)) OVER (), 6) AS weight FROM units GROUP BY unit")
def _(v):
    return rounded(aggregates.unit_weights(v.units), "weight")


@query("a10_covariances", "SELECT u.unit, p.property, 1.0e0 AS covariance FROM (SELECT DISTINCT unit FROM units) u CROSS JOIN (VALUES ('density'), ('susceptibility')) p(property)")
def _(v):
    names = F.explode(F.array(F.lit("density"), F.lit("susceptibility"))).alias("property")
    return v.units.select("unit").distinct().select("unit", names).withColumn("covariance", F.lit(1.0))


@query("a12_common_names", "SELECT event_type FROM readings GROUP BY event_type HAVING count(DISTINCT line_id) = (SELECT count(DISTINCT line_id) FROM readings)")
def _(v):
    return aggregates.in_every(v.readings, "event_type", "line_id")


@query("a13_last_iteration", "SELECT line_id, max_by(value, id) AS value FROM readings GROUP BY line_id")
def _(v):
    return aggregates.last_by(v.readings, "line_id", "value", "id")


MISFIT = "SELECT o.id % 4 AS tile, sum(CASE WHEN isnan(o.value) THEN 0.0e0 ELSE ((p.value - o.value) / o.uncertainty) * ((p.value - o.value) / o.uncertainty) END) AS phi FROM gappy o JOIN predicted p ON p.id = o.id AND p.component = o.component GROUP BY 1"


@query("a14_tile_misfit", f"SELECT tile, round(phi, 6) AS phi FROM ({MISFIT})")
def _(v):
    return rounded(aggregates.misfit(v.predicted, v.gappy, ["id", "component"], F.col("o.id") % 4), "phi")


@query("a15_global_misfit", f"SELECT round(sum(phi * (1.0e0 + tile)), 5) AS phi FROM ({MISFIT})")
def _(v):
    parts = aggregates.misfit(v.predicted, v.gappy, ["id", "component"], F.col("o.id") % 4)
    weights = v.range(4, "tile").withColumn("multiplier", F.col("tile") + 1.0)
    return aggregates.weighted_misfit(parts, weights).select(F.round("phi", 5).alias("phi"))


@query("a16_joint_misfit", f"SELECT round(sum(phi * (1.0e0 + tile) * (1.0e0 + tile)), 5) AS phi FROM ({MISFIT})")
def _(v):
    parts = aggregates.misfit(v.predicted, v.gappy, ["id", "component"], F.col("o.id") % 4)
    weights = v.range(4, "tile").withColumn("multiplier", F.col("tile") + 1.0)
    return aggregates.weighted_misfit(parts, weights, squared=True).select(F.round("phi", 5).alias("phi"))


@query("a17_target_misfit", "SELECT count(*) * 1.5e0 AS target FROM observed")
def _(v):
    return v.observed.agg((F.count("*") * 1.5).alias("target"))


@query("a18_median_tile", "WITH t AS (SELECT line_id AS tile, count(*) AS size FROM stations GROUP BY line_id), r AS (SELECT *, row_number() OVER (ORDER BY size, tile) AS r, count(*) OVER () AS n FROM t) SELECT tile, size FROM r WHERE r = n // 2 + 1")
def _(v):
    return aggregates.median_tile(v.stations.groupBy(F.col("line_id").alias("tile")).agg(F.count("*").alias("size")))


@query("a20_reference_statistics", "SELECT round(avg(z), 6) AS mean, min(z) AS least, max(z) AS most FROM topo")
def _(v):
    return rounded(v.topo.agg(F.avg("z").alias("mean"), F.min("z").alias("least"), F.max("z").alias("most")), "mean")


@query("a21_tree_levels", "SELECT cell_id, CAST(6 - log2(w) AS INTEGER) AS level FROM (SELECT cell_id, CASE cell_id % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 2.0e0 ELSE 4.0e0 END AS w FROM cells)")
def _(v):
    width = F.when(F.col("cell_id") % 3 == 0, 1.0).when(F.col("cell_id") % 3 == 1, 2.0).otherwise(4.0)
    return v.cells.select("cell_id", mesh.tree_level(width, 6).alias("level"))


@query("a22_unique_locations", "SELECT x, y, z FROM (SELECT s.x, s.y, s.z FROM dipoles d JOIN stations s ON s.id = d.m UNION SELECT s.x, s.y, s.z FROM dipoles d JOIN stations s ON s.id = d.n)")
def _(v):
    at = lambda k: v.dipoles.select(F.col(k).alias("id")).join(v.stations, "id").select("x", "y", "z")
    return at("m").unionByName(at("n")).distinct()


# ------------------------------------------------------------------------------------------------- windows and sorts


@query("w01_along_line", "WITH s AS (SELECT id, line_id, pos, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0e0) AS step FROM electrodes WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT id, round(sum(step) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 6) AS along FROM s")
def _(v):
    return rounded(windows.along_line(v.electrodes).select("id", "along"), "along")


@query("w02_smoothed_line", "SELECT id, round(CASE WHEN lag(pos) OVER w IS NULL OR lead(pos) OVER w IS NULL THEN z ELSE avg(z) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS z FROM electrodes WINDOW w AS (PARTITION BY line_id ORDER BY pos)")
def _(v):
    return rounded(windows.smoothed(v.electrodes, ["z"]).select("id", "z"), "z")


@query("w03_cell_widths", "SELECT id, round((coalesce(x - lag(x) OVER w, lead(x) OVER w - x) + coalesce(lead(x) OVER w - x, x - lag(x) OVER w)) / 2, 6) AS width FROM stations WINDOW w AS (PARTITION BY line_id ORDER BY x)")
def _(v):
    return rounded(windows.cell_widths(v.stations, "line_id", "x", "x").select("id", "width"), "width")


@query("w04_layer_heights", "WITH l AS (SELECT s.id AS prism_id, k.k, s.z AS top, s.z - 10.0e0 * (k.k + 1) AS bottom FROM stations s CROSS JOIN (SELECT range AS k FROM range(4)) k) SELECT prism_id, k, round(coalesce(lag(bottom) OVER (PARTITION BY prism_id ORDER BY k), top) - bottom, 6) AS height FROM l")
def _(v):
    layers = v.stations.crossJoin(v.range(4, "k")).select(F.col("id").alias("prism_id"), "k", F.col("z").alias("top"), (F.col("z") - (F.col("k") + 1) * 10.0).alias("bottom"))
    return rounded(windows.layer_heights(layers).select("prism_id", "k", "height"), "height")


@query("w05_draped_columns", "WITH h AS (SELECT range AS k, 10.0e0 * power(1.1e0, range) AS h FROM range(6)), d AS (SELECT k, sum(h) OVER (ORDER BY k) AS depth FROM h) SELECT s.id AS prism_id, d.k, round(s.z - d.depth, 6) AS bottom FROM stations s CROSS JOIN d")
def _(v):
    heights = v.range(6, "k").withColumn("h", F.pow(F.lit(1.1), F.col("k").cast("double")) * 10.0)
    columns = v.stations.select(F.col("id").alias("prism_id"), F.col("z").alias("top"))
    return rounded(windows.draped_columns(columns, heights).select("prism_id", "k", "bottom"), "bottom")


@query("w06_time_steps", "WITH t AS (SELECT DISTINCT round(value, 2) AS t FROM readings) SELECT t, dt FROM (SELECT t, round_even(lead(t) OVER (ORDER BY t) - t, 6) * 0.001e0 AS dt FROM t) WHERE dt IS NOT NULL")
def _(v):
    return windows.time_steps(v.readings.select(F.round("value", 2).alias("t")), 0.001)


@query("w07_even_split", "SELECT id, CAST(ntile(7) OVER (ORDER BY id) - 1 AS INTEGER) AS part FROM stations")
def _(v):
    return windows.even_split(v.stations.select("id"), 7, ["id"])


@query("w08_codes", "SELECT id, CAST(dense_rank() OVER (ORDER BY round_even(x, -2), round_even(y, -2)) - 1 AS INTEGER) AS code FROM stations")
def _(v):
    return windows.coded(v.stations, [scalars.round_nearest(F.col("x"), 100.0), scalars.round_nearest(F.col("y"), 100.0)]).select("id", "code")


@query("w09_renumbered", "WITH c AS (SELECT * FROM dipoles WHERE line_id = 2), u AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS k FROM (SELECT m AS id FROM c UNION SELECT n FROM c)) SELECT c.cell_id, a.k AS new_m, b.k AS new_n FROM c JOIN u a ON a.id = c.m JOIN u b ON b.id = c.n")
def _(v):
    return windows.renumbered(v.stations, filters.on_line(v.dipoles, 2))[1].select("cell_id", "new_m", "new_n")


@query("w10_ordering", "SELECT (c.r * 3 + p.r) * 50 + x.r AS pos, c.r AS channel, p.r AS component, x.r AS receiver FROM (SELECT range AS r FROM range(4)) c, (SELECT range AS r FROM range(3)) p, (SELECT range AS r FROM range(50)) x")
def _(v):
    return windows.ordering(v.range(4, "channel"), v.range(3, "component"), v.range(50, "receiver"))


@query("w11_circumradius", "WITH t AS (SELECT CAST(line_id AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM stations GROUP BY line_id), n AS (SELECT x, y, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS cx, lead(y) OVER w AS cy FROM t WINDOW w AS (ORDER BY x)), r AS (SELECT x, abs((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) AS a, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) * sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) * sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) AS s FROM n) SELECT x, CASE WHEN a > 0 THEN round(s / (2 * a), 6) ELSE -1.0e0 END AS radius FROM r")
def _(v):
    t = v.stations.groupBy(F.col("line_id").cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))
    out = windows.circumradius(t, "x", "x", "y")
    return out.select("x", F.when(F.col("radius") < float("inf"), F.round("radius", R)).otherwise(-1.0).alias("radius"))


@query("w13_every_nth", "SELECT CAST(row_number() OVER (ORDER BY cell_id DESC) - 1 AS INTEGER) AS place, value FROM model WHERE cell_id % 8 = 3")
def _(v):
    return windows.every_nth(v.model, 8, 3)


LOOP = "SELECT a.tx_id, a.seq, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM loops a JOIN loops b ON a.tx_id = b.tx_id AND b.seq = a.seq + 1"


def _loop(v):
    a = v.loops.select("tx_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = v.loops.select("tx_id", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return a.join(b, ["tx_id", "seq"])


@query("o01_counter_clockwise", f"WITH l AS ({LOOP}), c AS (SELECT tx_id, avg(x0) AS cx, avg(y0) AS cy FROM l GROUP BY tx_id), t AS (SELECT l.tx_id, avg((x0 - cx) * (y1 - cy) - (x1 - cx) * (y0 - cy)) < 0 AS turn FROM l JOIN c ON c.tx_id = l.tx_id GROUP BY l.tx_id) SELECT l.tx_id, CAST(row_number() OVER (PARTITION BY l.tx_id ORDER BY CASE WHEN turn THEN -seq ELSE seq END) - 1 AS INTEGER) AS place, CASE WHEN turn THEN x1 ELSE x0 END AS x0, CASE WHEN turn THEN y1 ELSE y0 END AS y0, CASE WHEN turn THEN x0 ELSE x1 END AS x1, CASE WHEN turn THEN y0 ELSE y1 END AS y1 FROM l JOIN t ON t.tx_id = l.tx_id")
def _(v):
    return windows.counter_clockwise(_loop(v))


@query("o02_closed_loops", "WITH s AS (SELECT a.tx_id, a.seq, a.id AS v0, b.id AS v1 FROM loops a JOIN loops b ON a.tx_id = b.tx_id AND b.seq = a.seq + 1) SELECT tx_id, seq, v0, v1 FROM s UNION ALL SELECT tx_id, max(seq) + 1, max_by(v1, seq), min_by(v0, seq) FROM s GROUP BY tx_id HAVING max_by(v1, seq) <> min_by(v0, seq)")
def _(v):
    a = v.loops.select("tx_id", "seq", F.col("id").alias("v0"))
    b = v.loops.select("tx_id", (F.col("seq") - 1).alias("seq"), F.col("id").alias("v1"))
    return windows.closed(a.join(b, ["tx_id", "seq"]))


@query("o03_greedy_order")
def _(v):
    return windows.greedy_order(v.stations)


@query("o04_cell_convention", "SELECT cell_id, 7 - i AS i, j, 3 - k AS k FROM cells")
def _(v):
    return mesh.flipped(v.cells, (-100.0, 100.0, -100.0), (8, 8, 4))


@query("o06_class_order", "SELECT unit, CAST(row_number() OVER (ORDER BY sum(volume) DESC, unit) - 1 AS INTEGER) AS rank FROM units GROUP BY unit")
def _(v):
    return windows.rank_by(v.units.groupBy("unit").agg(F.sum("volume").alias("v")), "v", "unit").select("unit", "rank")


@query("o08_two_nearest", "WITH n AS (SELECT a.id, b.id AS nn_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS d, CAST(row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.id) AS INTEGER) AS rank FROM stations a JOIN stations b ON a.id <> b.id) SELECT * FROM n WHERE rank <= 2")
def _(v):
    return rounded(joins.nearest(v.stations, v.stations, 2, other_than_self=True), "d")


@query("o09_least_radius", "SELECT min_by(id, z) AS id FROM stations")
def _(v):
    return v.stations.agg(F.min_by("id", "z").alias("id"))


# ---------------------------------------------------------------------------------------------------- sets and tiles


@query("u01_stacked", "SELECT id, x, y, z FROM stations UNION ALL SELECT id, x, y, z FROM topo")
def _(v):
    return v.stations.select("id", "x", "y", "z").unionByName(v.topo)


@query("u02_union", "SELECT m AS id FROM dipoles UNION SELECT n FROM dipoles")
def _(v):
    return v.dipoles.select(F.col("m").alias("id")).union(v.dipoles.select("n")).distinct()


@query("u04_intersection", "SELECT event_type FROM readings WHERE line_id = 1 INTERSECT SELECT event_type FROM readings WHERE line_id = 2")
def _(v):
    names = lambda k: filters.on_line(v.readings, k).select("event_type")
    return names(1).intersect(names(2))


@query("u05_any_active", "SELECT cell_id, bool_or(active) AS active FROM (SELECT cell_id, active FROM model UNION ALL SELECT cell_id, cell_id % 3 = 0 FROM model) GROUP BY cell_id")
def _(v):
    return v.model.select("cell_id", "active").union(v.model.select("cell_id", F.col("cell_id") % 3 == 0)).groupBy("cell_id").agg(F.bool_or("active").alias("active"))


@query("u06_merged_parts", "WITH n AS (SELECT line_id, count(*) AS n FROM stations GROUP BY line_id), o AS (SELECT line_id, coalesce(sum(n) OVER (ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM n) SELECT e.id, o.o + e.pos - 1 AS merged FROM electrodes e JOIN o ON o.line_id = e.line_id")
def _(v):
    from pyspark.sql import Window

    w = Window.orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = v.stations.groupBy("line_id").agg(F.count("*").alias("n")).select("line_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("o"))
    return v.electrodes.join(offsets, "line_id").select("id", (F.col("o") + F.col("pos") - 1).alias("merged"))


@query("t01_tiles_by_label", "WITH l AS (SELECT line_id, CAST(ntile(5) OVER (ORDER BY line_id) - 1 AS INTEGER) AS tile FROM (SELECT DISTINCT line_id FROM stations)) SELECT s.id, l.tile FROM stations s JOIN l ON l.line_id = s.line_id")
def _(v):
    return tiling.tiles_by_label(v.stations, 5)


@query("t01_tiles_by_halving")
def _(v):
    return tiling.tiles_by_halving(v.stations, 3)


@query("t01_tiles_by_kmeans")
def _(v):
    return tiling.tiles_by_kmeans(v.stations, 4)


@query("t02_one_tile_per_station", "SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS tile FROM stations")
def _(v):
    return tiling.tiles_for(v.stations, "tdem 1d", 1)


@query("t03_tile_sizes", "SELECT n AS n_tiles, round(500.0e0 * 256.0e0 * n * 8e-9, 6) AS gigabytes FROM (VALUES (1), (2), (3), (5), (8), (13)) f(n)")
def _(v):
    return v.spark.createDataFrame([(n, round(tiling.estimated_gigabytes(500, 256, n), 6)) for n in tiling.fibonacci(13)], "n_tiles int, gigabytes double")


@query("t09_padding_cells", "SELECT line_id AS n_tiles, CASE WHEN line_id = 1 THEN 100 WHEN component = 'fdem' THEN 4 ELSE 6 END AS padding FROM (SELECT DISTINCT line_id FROM stations) CROSS JOIN (VALUES ('fdem'), ('gravity')) m(component)")
def _(v):
    methods = F.explode(F.array(F.lit("fdem"), F.lit("gravity"))).alias("method")
    return v.stations.select("line_id").distinct().select("line_id", methods).select(F.col("line_id").alias("n_tiles"), scalars.padding_cells(F.col("line_id"), F.col("method")).alias("padding"))


