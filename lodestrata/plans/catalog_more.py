"""Further queries: names and forms, meshes along lines, per-line jobs, and single events."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import aggregates, filters, joins, mesh
from lodestrata.plans import objective, plates, synthetics
from lodestrata.plans.registry import query

R = 6


def rounded(df, *names):
    return df.withColumns({n: F.round(n, R) for n in names})


@query("f22_trimmed_models", "SELECT k.kind, m.cell_id, m.value * k.f AS value FROM model m CROSS JOIN (VALUES ('starting', 1.0e0), ('reference', 2.0e0)) k(kind, f) WHERE m.active")
def _(v):
    kinds = F.explode(F.array(F.struct(F.lit("starting").alias("kind"), F.lit(1.0).alias("f")), F.struct(F.lit("reference").alias("kind"), F.lit(2.0).alias("f")))).alias("k")
    models = v.model.select("cell_id", "value", kinds).select("k.kind", "cell_id", (F.col("value") * F.col("k.f")).alias("value"))
    return filters.trimmed(models, v.model.select("cell_id", "active")).select("kind", "cell_id", "value")


@query("j21_same_row_pairs", "SELECT r.id, t.x AS tx_x FROM stations r JOIN stations t ON t.id = r.id")
def _(v):
    return v.stations.select("id").join(v.stations.select("id", F.col("x").alias("tx_x")), "id")


@query("j25_block_counts", "SELECT count(*) FILTER (WHERE active) AS scalar, 3 * count(*) FILTER (WHERE active) AS vector FROM model")
def _(v):
    return v.model.agg(F.count_if("active").alias("scalar"), (F.count_if("active") * 3).alias("vector"))


@query("o05_first_appearance", "SELECT event_type, min(id) AS first FROM readings GROUP BY event_type")
def _(v):
    return v.readings.groupBy("event_type").agg(F.min("id").alias("first"))


@query("o07_face_pairs", "SELECT least(a.cell_id, b.cell_id) AS a, greatest(a.cell_id, b.cell_id) AS b FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j AND b.k = a.k + 1")
def _(v):
    return mesh.face_neighbours(v.cells).filter("axis = 'k'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query("o10_reversed_layers", "SELECT line_id, max_by(id, pos) AS first FROM electrodes GROUP BY line_id")
def _(v):
    return v.electrodes.groupBy("line_id").agg(F.max_by("id", "pos").alias("first"))


@query("x15_conductivity", "SELECT cell_id, round(CASE WHEN volume > 0 THEN ln(1.0e0 / volume) END, 6) AS sigma, round(1.0e0 / nullif(volume, 0), 6) AS linear FROM units")
def _(v):
    p = F.col("volume")
    return v.units.select("cell_id", F.round(scalars.conductivity(p, True, True), R).alias("sigma"), F.round(scalars.conductivity(p, True, False), R).alias("linear"))


@query("x20_orientations", "SELECT id, round(CASE WHEN x < 0 THEN x + 360.0e0 * ceil(-x / 360.0e0) ELSE x - 360.0e0 * floor(x / 360.0e0) END, 6) AS direction, round(CASE WHEN x + 90 < 0 THEN x + 90 + 360.0e0 * ceil(-(x + 90) / 360.0e0) ELSE x + 90 - 360.0e0 * floor((x + 90) / 360.0e0) END, 6) AS from_strike FROM stations")
def _(v):
    return rounded(v.stations.select("id", F.pmod("x", F.lit(360.0)).alias("direction"), scalars.strike_to_direction(F.col("x")).alias("from_strike")), "direction", "from_strike")


C30, S30 = math.cos(math.radians(30.0)), math.sin(math.radians(30.0))


@query("x22_rotations", f"SELECT id, round(x * {C30!r} - y * {S30!r}, 6) AS u, round(x * {S30!r} + y * {C30!r}, 6) AS w FROM stations")
def _(v):
    a, b = scalars.rotated(F.col("x"), F.col("y"), 30.0)
    return rounded(v.stations.select("id", a.alias("u"), b.alias("w")), "u", "w")


@query("x30_forms", "SELECT id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"id\":' || id || ',\"kind\":\"' || event_type || '\"}' AS form FROM readings")
def _(v):
    return v.readings.select("id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct("id", F.col("event_type").alias("kind"))).alias("form"))


@query("x31_value_map", "SELECT unit, count(*) AS n FROM (SELECT CASE unit WHEN 0 THEN 'unknown' WHEN 1 THEN 'till' ELSE 'rock' END AS unit FROM model) GROUP BY unit")
def _(v):
    labels = F.create_map(F.lit(0), F.lit("unknown"), F.lit(1), F.lit("till"))
    return v.model.select(F.coalesce(F.try_element_at(labels, F.col("unit")), F.lit("rock")).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


@query("x33_reciprocal", "SELECT cell_id, round(1.0e0 / nullif(property, 0), 6) AS value FROM units")
def _(v):
    return v.units.select("cell_id", F.round(scalars.inverse_property(F.col("property")), R).alias("value"))


@query("x34_reference_angles", "SELECT cell_id, CASE WHEN cell_id % 2 = 0 THEN value ELSE 60.0e0 END AS inclination FROM model WHERE active")
def _(v):
    stored = F.when(F.col("cell_id") % 2 == 0, F.col("value"))
    return v.model.filter("active").select("cell_id", scalars.angle_or_default(stored, 60.0).alias("inclination"))


@query("x37_current_names", "SELECT * FROM (VALUES ('fem', 'fdem'), ('fdem', 'fdem'), ('gravity', 'gravity'), ('fem 1d', 'fdem 1d')) t(old, name)")
def _(v):
    return v.spark.createDataFrame([("fem",), ("fdem",), ("gravity",), ("fem 1d",)], "old string").select("old", scalars.current_name(F.col("old")).alias("name"))


BELOW = "WITH n AS (SELECT c.cell_id, c.zc, t.z, row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt((c.xc - t.x) * (c.xc - t.x) + (c.yc - t.y) * (c.yc - t.y)), t.id) AS r FROM cells c CROSS JOIN topo t)"


@query("g06_active_model", f"{BELOW}, h AS (SELECT DISTINCT c.cell_id FROM stations s JOIN cells c ON s.x >= c.xc - 50 AND s.x < c.xc + 50 AND s.y >= c.yc - 50 AND s.y < c.yc + 50 AND s.z >= c.zc - 50 AND s.z < c.zc + 50) SELECT n.cell_id, n.zc - 50.0e0 < n.z OR n.cell_id IN (SELECT cell_id FROM h) AS active FROM n WHERE r = 1")
def _(v):
    below = mesh.below_surface(v.cells, v.topo, 100.0, "bottom")
    held = joins.containing_cells(v.stations, v.cells, (-400.0, -400.0, -400.0), (100.0, 100.0, 100.0)).select("cell_id").distinct().withColumn("_held", F.lit(True))
    return below.join(held, "cell_id", "left").select("cell_id", (F.col("active") | F.coalesce("_held", F.lit(False))).alias("active"))


@query("g07_cell_normals", "SELECT cell_id, 0.0e0 AS nx, -1.0e0 AS ny, 0.0e0 AS nz FROM cells")
def _(v):
    return mesh.normals(v.cells, "j", outward=False).withColumns({"nx": F.col("nx") + 0.0, "nz": F.col("nz") + 0.0})


@query("g14_drape_mesh", "WITH s AS (SELECT line_id, pos, z, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0e0) AS step FROM electrodes WINDOW w AS (PARTITION BY line_id ORDER BY pos)), a AS (SELECT line_id, z, CAST(floor(sum(step) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) / 500.0e0) AS INTEGER) AS col FROM s), t AS (SELECT line_id, col, avg(z) AS top FROM a GROUP BY line_id, col) SELECT line_id, col AS \"column\", (col + 0.5e0) * 500.0e0 AS along, round(top, 6) AS top, k.k, round(top - 20.0e0 * (k.k + 1), 6) AS bottom FROM t CROSS JOIN (SELECT range AS k FROM range(3)) k")
def _(v):
    return rounded(mesh.draped_prisms(v.electrodes, 500.0, v.range(3, "k").withColumn("h", F.lit(20.0))), "top", "bottom")


@query("g16_centroids", "SELECT cell_id, xc AS x, yc AS y, zc AS z FROM cells")
def _(v):
    return mesh.centroids(v.cells, (-400.0, -400.0, -400.0), (100.0, 100.0, 100.0))


@query("g23_same_places", "SELECT true AS same")
def _(v):
    there = v.cells.select("cell_id", F.col("xc").alias("x"), F.col("yc").alias("y"), F.col("zc").alias("z"))
    return mesh.same_places(mesh.centroids(v.cells, (-400.0, -400.0, -400.0), (100.0, 100.0, 100.0)), there)


@query("p14_receiver_places", "SELECT d.cell_id, d.m <> d.n AS dipole, a.x AS mx, CASE WHEN d.m <> d.n THEN b.x END AS nx FROM dipoles d JOIN stations a ON a.id = d.m JOIN stations b ON b.id = d.n")
def _(v):
    at = lambda k: v.stations.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"))
    pair = F.col("m") != F.col("n")
    return v.dipoles.join(at("m"), "m").join(at("n"), "n").select("cell_id", pair.alias("dipole"), "mx", F.when(pair, F.col("nx")).alias("nx"))


@query("p15_survey_shape", "SELECT count(DISTINCT component) AS n_components, count(DISTINCT id) AS n_receivers FROM observed")
def _(v):
    return v.observed.agg(F.countDistinct("component").alias("n_components"), F.countDistinct("id").alias("n_receivers"))


@query("k05_missing_models", "SELECT c.cell_id, coalesce(m.value, 0.5e0) AS value FROM cells c LEFT JOIN (SELECT * FROM model WHERE cell_id < 128) m ON m.cell_id = c.cell_id")
def _(v):
    first = v.cells.select("cell_id", F.lit(0.5).alias("_first"))
    return first.join(v.model.filter("cell_id < 128").select("cell_id", "value"), "cell_id", "left").select("cell_id", F.coalesce("value", "_first").alias("value"))


@query("k10_regularization_terms", "SELECT 'smallness' AS term, 0.0e0 AS phi UNION ALL SELECT 'petrophysics', round(sum((property - 100.0e0) * (property - 100.0e0)) / 1e6, 4) FROM units")
def _(v):
    model = v.units.select("cell_id", F.col("property").alias("value"))
    reference = v.units.select("cell_id", F.lit(100.0).alias("value"))
    small = objective.smallness(model, reference, 0.0).select(F.lit("smallness").alias("term"), F.round("phi", 4).alias("phi"))
    return small.unionByName(objective.smallness(model, reference, 1e-6).select(F.lit("petrophysics").alias("term"), F.round("phi", 4).alias("phi")))


def _single(v, event):
    return plates.realized(v.cells, [event], ("background", 1.0)).select("cell_id", "unit")


@query("e01_deposition", "SELECT cell_id, CASE WHEN zc < -150.0e0 THEN 2 ELSE 1 END AS unit FROM cells")
def _(v):
    return _single(v, plates.deposition("a", 1.0, F.col("zc"), F.lit(-150.0)))


@query("e02_overburden", "SELECT cell_id, CASE WHEN NOT (zc < 0.0e0 - 60.0e0) THEN 2 ELSE 1 END AS unit FROM cells")
def _(v):
    return _single(v, plates.overburden("a", 1.0, F.col("zc"), F.lit(0.0), 60.0))


@query("e03_erosion", "SELECT cell_id, CASE WHEN NOT (zc < -100.0e0) THEN 2 ELSE 1 END AS unit FROM cells")
def _(v):
    return _single(v, plates.erosion(F.col("zc"), F.lit(-100.0)))


@query("e04_anomaly", "SELECT cell_id, CASE WHEN abs(xc) <= 100 AND abs(yc) <= 200 THEN 2 ELSE 1 END AS unit FROM cells")
def _(v):
    return _single(v, plates.anomaly("a", 1.0, (F.abs("xc") <= 100) & (F.abs("yc") <= 200)))


@query("e06_coeval_dikes", "SELECT cell_id, CASE WHEN NOT (zc < 0) THEN 3 WHEN abs(xc) <= 100 OR abs(yc) <= 100 THEN 2 ELSE 1 END AS unit FROM cells")
def _(v):
    events = plates.checked([plates.anomaly("a", 1.0, F.abs("xc") <= 100), plates.anomaly("b", 1.0, F.abs("yc") <= 100), plates.erosion(F.col("zc"), F.lit(0.0))])
    return plates.realized(v.cells, events, ("background", 1.0), coeval=True).select("cell_id", "unit")


@query("y08_tipper_survey", "SELECT s.id, c.component, b.base FROM stations s CROSS JOIN (VALUES ('txz_real'), ('txz_imag'), ('tyz_real'), ('tyz_imag')) c(component) CROSS JOIN (SELECT min(id) AS base FROM stations) b")
def _(v):
    rows = synthetics.channels(v.stations, [10.0], ["txz_real", "txz_imag", "tyz_real", "tyz_imag"]).select("id", "component")
    return rows.crossJoin(F.broadcast(v.stations.agg(F.min("id").alias("base"))))


@query("y12_regular_mesh", "SELECT count(*) AS n, min(xc) AS low, max(xc) AS high FROM cells")
def _(v):
    return v.cells.agg(F.count("*").alias("n"), F.min("xc").alias("low"), F.max("xc").alias("high"))


@query("y15_line_mesh", "SELECT id, x, y, z FROM stations WHERE line_id = 4 AND id IN (SELECT m FROM dipoles UNION SELECT n FROM dipoles)")
def _(v):
    used = v.dipoles.select(F.explode(F.array("m", "n")).alias("id")).distinct()
    return filters.on_line(v.stations, 4).join(used, "id", "left_semi").select("id", "x", "y", "z")


@query("b02_line_sweep")
def _(v):
    import numpy as np
    import pandas as pd

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        """A line's trend of height against place, the smallest of jobs that run on one line at a time."""
        pdf = pdf.sort_values("pos")
        slope, height = np.polyfit(pdf["pos"], pdf["z"], 1) if len(pdf) > 1 else (0.0, float(pdf["z"].iloc[0]))
        return pd.DataFrame({"line_id": [pdf["line_id"].iloc[0]], "slope": [round(float(slope), R)], "height": [round(float(height), R)]})

    return v.electrodes.groupBy("line_id").applyInPandas(job, "line_id int, slope double, height double")


@query("b04_line_jobs", "SELECT line_id, count(*) AS stations, 'written' AS status FROM stations GROUP BY line_id")
def _(v):
    return v.stations.groupBy("line_id").agg(F.count("*").alias("stations"), F.lit("written").alias("status"))


@query("b07_misfit_per_station", "SELECT o.id AS tile, round(sum(((p.value - o.value) / o.uncertainty) * ((p.value - o.value) / o.uncertainty)), 6) AS phi FROM observed o JOIN predicted p ON p.id = o.id AND p.component = o.component GROUP BY o.id")
def _(v):
    return rounded(aggregates.misfit(v.predicted, v.observed, ["id", "component"], F.col("o.id")), "phi")
