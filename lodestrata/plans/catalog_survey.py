"""Queries of the operators on surveys, their files and their jobs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import joins, mesh, survey, windows
from lodestrata.plans import methods, plates, synthetics
from lodestrata.plans.checkpoints import shared_dir
from lodestrata.plans.registry import query
from lodestrata.sources import io
from lodestrata.sources.views import COMPONENTS

R = 6


def rounded(df, *names):
    return df.withColumns({n: F.round(n, R) for n in names})


def _folder(v, name):
    """A new folder for files that a query writes and reads back."""
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def _wide(v):
    e = lambda i: F.element_at("embedding", i).cast("double")
    return v.table("embeddings").select(F.col("vec_id").alias("id"), *[e(4 + i).alias(c) for i, c in enumerate(COMPONENTS)], F.abs(e(1)).alias("u"))


# ---------------------------------------------------------------------------------------------------- data and files


@query("s06_component_data", "SELECT vec_id AS id, CAST(embedding[4] AS DOUBLE) AS value, 0.05e0 AS uncertainty FROM embeddings")
def _(v):
    return survey.component_data(_wide(v), "gx", 0.05)


@query("s07_all_data", "SELECT o.id, o.component, o.value, CASE WHEN o.component = 'gz' THEN abs(CAST(e.embedding[1] AS DOUBLE)) ELSE 0.05e0 END AS uncertainty FROM observed o JOIN embeddings e ON e.vec_id = o.id")
def _(v):
    return survey.all_data(_wide(v), {c: "u" if c == "gz" else 0.05 for c in COMPONENTS})


@query("s09_survey_copy", "WITH k AS (SELECT m, n FROM dipoles WHERE line_id % 2 = 0), u AS (SELECT m AS id FROM k UNION SELECT n FROM k) SELECT s.id, row_number() OVER (ORDER BY s.id) - 1 AS new_id, s.x FROM stations s JOIN u ON u.id = s.id")
def _(v):
    return survey.survey_copy(v.stations, v.dipoles, F.col("line_id") % 2 == 0)[0].select("id", "new_id", "x")


@query("s09_copied_dipoles", "WITH k AS (SELECT * FROM dipoles WHERE line_id % 2 = 0), u AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM (SELECT m AS id FROM k UNION SELECT n FROM k)) SELECT k.cell_id, a.p AS new_m, b.p AS new_n FROM k JOIN u a ON a.id = k.m JOIN u b ON b.id = k.n")
def _(v):
    return survey.survey_copy(v.stations, v.dipoles, F.col("line_id") % 2 == 0)[1].select("cell_id", "new_m", "new_n")


@query("s10_saved_model", "SELECT 255 - cell_id AS place, 'resistivity_model' AS name, round(1 / value, 6) AS value FROM (SELECT cell_id, nullif(value, 0) AS value FROM model)")
def _(v):
    order = v.cells.select("cell_id", (255 - F.col("cell_id")).alias("place"))
    return rounded(survey.model_in_order(v.model, order, resistivity=True), "value")


@query("s14_saved_predictions", "WITH s AS (SELECT id AS receiver, x FROM stations) SELECT c.channel, k.component, s.receiver, round((s.receiver + c.channel * 10 + k.component) / CASE k.component WHEN 0 THEN 1.0e0 ELSE -2.0e0 END, 6) AS value FROM s CROSS JOIN (VALUES (0), (1)) c(channel) CROSS JOIN (VALUES (0), (1)) k(component)")
def _(v):
    places = windows.ordering(v.range(2, "channel").withColumn("channel", F.col("channel").cast("int")), v.range(2, "component").withColumn("component", F.col("component").cast("int")), v.stations.select(F.col("id").alias("receiver")))
    flat = places.select("pos", (F.col("receiver") + F.col("channel") * 10 + F.col("component")).cast("double").alias("value"))
    return rounded(survey.scattered_predictions(flat, places, F.when(F.col("component") == 0, 1.0).otherwise(-2.0)), "value")


@query("s16_electrical_outputs", "WITH d AS (SELECT d.cell_id, o.value AS o, p.value AS p, (d.cell_id % 5 + 1) * 0.5e0 AS f FROM dipoles d JOIN observed o ON o.id = d.cell_id AND o.component = 'gz' JOIN predicted p ON p.id = o.id AND p.component = 'gz') SELECT cell_id, CAST(0 AS INTEGER) AS place, 'residual' AS name, round(o - p, 6) AS value FROM d UNION ALL SELECT cell_id, 1, 'potential', round(p, 6) FROM d UNION ALL SELECT cell_id, 2, 'apparent_resistivity', round(p / f, 6) FROM d")
def _(v):
    of = lambda t: t.filter("component = 'gz'").select(F.col("id").alias("cell_id"), "value").join(v.dipoles.select("cell_id"), "cell_id", "left_semi")
    factors = v.dipoles.select("cell_id", ((F.col("cell_id") % 5 + 1) * 0.5).alias("factor"))
    return rounded(survey.electrical_outputs(of(v.predicted), of(v.observed), factors), "value")


@query("s19_iteration_log", "SELECT CAST(line_id AS INTEGER) AS iteration, round(avg(value), 4) AS beta, count(*) AS phi_d FROM readings GROUP BY line_id")
def _(v):
    path = _folder(v, "log")
    log = v.readings.groupBy(F.col("line_id").cast("int").alias("iteration")).agg(F.round(F.avg("value"), 4).alias("beta"), F.count("*").alias("phi_d"))
    log.write.option("sep", " ").option("header", True).csv(path)
    return io.read_log(v.spark, path).select(F.col("iteration").cast("int").alias("iteration"), F.col("beta").cast("double").alias("beta"), F.col("phi_d").cast("long").alias("phi_d"))


@query("s20_line_lookup_file", "SELECT line_id, 'job' || line_id AS file, CASE WHEN line_id % 2 = 0 THEN 'pending' ELSE 'written' END AS status FROM (SELECT DISTINCT line_id FROM stations)")
def _(v):
    path = _folder(v, "lookup")
    lines = v.stations.select("line_id").distinct()
    entry = F.struct(F.concat(F.lit("job"), F.col("line_id")).alias("k"), F.struct("line_id", F.when(F.col("line_id") % 2 == 0, "pending").otherwise("written").alias("status")).alias("v"))
    lines.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)
    return io.read_lookup(v.spark, path)


@query("s23_station_csv", "SELECT id, line_id, x, y, z FROM stations")
def _(v):
    path = _folder(v, "points")
    v.stations.write.option("header", True).csv(path)
    return io.read_points(v.spark, path, "id bigint, line_id int, x double, y double, z double")


@query("s24_text_assets", "SELECT 'waveform' AS asset, id * 0.001e0 AS a, x AS b FROM stations UNION ALL SELECT 'color', CAST(id % 256 AS DOUBLE), CAST(line_id AS DOUBLE) FROM stations")
def _(v):
    wave, colors = _folder(v, "waveform"), _folder(v, "colors")
    note = v.spark.range(1).select(F.lit("// a note").alias("value"))
    v.stations.select(F.concat_ws(" ", (F.col("id") * 0.001).cast("string"), F.col("x").cast("string")).alias("value")).unionByName(note).write.text(wave)
    v.stations.select(F.concat_ws(", ", F.col("line_id").cast("string"), F.lit("unit"), (F.col("id") % 256).cast("string"), F.lit("0"), F.lit("255")).alias("value")).unionByName(note).write.text(colors)
    a = io.read_waveform(v.spark, wave).select(F.lit("waveform").alias("asset"), F.col("t").alias("a"), F.col("current").alias("b"))
    return a.unionByName(io.read_colors(v.spark, colors).select(F.lit("color").alias("asset"), F.col("r").cast("double").alias("a"), F.col("id").cast("double").alias("b")))


@query("s29_joint_ranges", "WITH t AS (SELECT line_id AS driver, count(*) AS n FROM stations GROUP BY line_id) SELECT driver, CAST(sum(n) OVER w - n AS BIGINT) AS first, CAST(sum(n) OVER w AS BIGINT) AS last FROM t WINDOW w AS (ORDER BY driver)")
def _(v):
    return survey.joint_ranges(v.stations.groupBy(F.col("line_id").alias("driver")).agg(F.count("*").alias("tiles")))


# -------------------------------------------------------------------------------------------------- models and meshes


def _partial(v):
    """Pairs of cells with the volume that they share, which is none for some, and each cell with itself."""
    faces = mesh.face_neighbours(v.cells).select("a", "b", ((F.col("a") % 3) * 1.5).alias("volume"))
    return faces.unionByName(v.cells.select(F.col("cell_id").alias("a"), F.col("cell_id").alias("b"), F.lit(2.0).alias("volume")))


FACES = "(SELECT a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON (b.i = a.i + 1 AND b.j = a.j AND b.k = a.k) OR (b.i = a.i AND b.j = a.j + 1 AND b.k = a.k) OR (b.i = a.i AND b.j = a.j AND b.k = a.k + 1))"


@query("f12_proper_pairs", f"SELECT a, b, (a % 3) * 1.5e0 AS volume FROM {FACES} WHERE a % 3 > 0")
def _(v):
    return survey.proper_pairs(_partial(v))


@query("f13_known_pairs", "SELECT a.cell_id, b.cell_id AS next FROM cells a JOIN cells b ON b.i = a.i + 1 AND b.j = a.j AND b.k = a.k")
def _(v):
    return survey.known_pairs(mesh.next_cell(mesh.face_neighbours(v.cells), "i", v.cells), "next")


def _models(v):
    kinds = F.explode(F.array(F.lit("starting"), F.lit("reference"), F.lit("gradient_dip"))).alias("model_type")
    gap = (F.col("cell_id") % 9 == 0) & (F.col("model_type") == "reference")
    return v.model.select("cell_id", "value", kinds).withColumn("value", F.when(gap, F.lit(None)).otherwise(F.col("value"))).select("model_type", "cell_id", "value")


@query("f23_applied_to_models", "SELECT k.model_type, cell_id, CASE WHEN k.model_type = 'reference' AND cell_id % 9 = 0 THEN NULL WHEN k.model_type IN ('starting', 'reference') THEN round(ln(value + 1), 6) ELSE round(value, 6) END AS value FROM model CROSS JOIN (VALUES ('starting'), ('reference'), ('gradient_dip')) k(model_type)")
def _(v):
    return rounded(survey.applied_to_models(_models(v), ["starting", "reference"], lambda c: F.log(c + 1)), "value")


@query("x35_model_of_kind", "SELECT cell_id, value FROM model")
def _(v):
    return survey.model_of_kind(_models(v), "gradient_dip")


@query("x35_trimmed_model", "SELECT cell_id, CASE WHEN cell_id % 9 = 0 THEN NULL ELSE value END AS value FROM model WHERE active")
def _(v):
    return survey.model_of_kind(_models(v), "reference", v.model.select("cell_id", "active"))


@query("x10_normalized", "SELECT id, component, abs(value * CASE WHEN component IN ('gz', 'gxz', 'gyz') THEN -1.0e0 ELSE 1.0e0 END) AS value FROM observed")
def _(v):
    return v.observed.select("id", "component", scalars.normalized(F.col("value"), scalars.sign(F.col("component"), "gravity"), True).alias("value"))


@query("g09_neighbour_corners", f"SELECT f.a, f.b, xc - 50.0e0 AS xl, yc - 50.0e0 AS yl, zc - 50.0e0 AS zl, xc + 50.0e0 AS xh, yc + 50.0e0 AS yh, zc + 50.0e0 AS zh FROM {FACES} f JOIN cells c ON c.cell_id = f.b")
def _(v):
    return survey.neighbour_corners(v.cells, mesh.face_neighbours(v.cells), 100.0)


@query("u03_neighbours_by_kind", "SELECT abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) AS kind, count(*) AS n FROM cells a JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.cell_id <> b.cell_id GROUP BY 1")
def _(v):
    place = lambda n: v.cells.select(F.col("cell_id").alias(n), *[F.col(x).alias(f"{n}{x}") for x in "ijk"])
    pairs = mesh.all_neighbours(v.cells).join(place("a"), "a").join(place("b"), "b")
    kind = sum((F.abs(F.col(f"a{x}") - F.col(f"b{x}")) for x in "ijk"), F.lit(0))
    return pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("a11_gradient_operator", f"WITH p AS (SELECT a, b, (a % 3) * 1.5e0 AS v FROM {FACES} WHERE a % 3 > 0), t AS (SELECT a, sum(v) AS t FROM p GROUP BY a) SELECT p.a, p.b, round(-v / t, 6) AS w FROM p JOIN t ON t.a = p.a UNION ALL SELECT cell_id, cell_id, CASE WHEN t IS NULL THEN 0.0e0 ELSE 1.0e0 END FROM cells LEFT JOIN t ON t.a = cell_id")
def _(v):
    return rounded(mesh.gradient_operator(survey.proper_pairs(_partial(v)), v.cells), "w")


@query("y10_active_by_top", "WITH n AS (SELECT c.cell_id, c.zc, t.z, row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt((c.xc - t.x) * (c.xc - t.x) + (c.yc - t.y) * (c.yc - t.y)), t.id) AS r FROM cells c CROSS JOIN topo t) SELECT cell_id, zc + 50.0e0 < z AS active FROM n WHERE r = 1")
def _(v):
    return mesh.below_surface(v.cells, v.topo, 100.0, "top")


_A, _D = math.radians(120.0), math.radians(60.0)
_PLATE = plates.Plate(10.0, -20.0, -100.0, 200.0, 100.0, 20.0, 60.0, 120.0)


@query(
    "g21_plate_vertices",
    f"SELECT CAST(4 * a.i + 2 * b.i + c.i AS INTEGER) AS corner, round(10.0e0 - {math.cos(_A)!r} * 100.0e0 * a.s + {math.sin(_A) * math.cos(_D)!r} * 50.0e0 * b.s + {math.sin(_A) * math.sin(_D)!r} * 10.0e0 * c.s, 6) AS x, "
    f"round(-20.0e0 + {math.sin(_A)!r} * 100.0e0 * a.s + {math.cos(_A) * math.cos(_D)!r} * 50.0e0 * b.s + {math.cos(_A) * math.sin(_D)!r} * 10.0e0 * c.s, 6) AS y, "
    f"round(-100.0e0 - {math.sin(_D)!r} * 50.0e0 * b.s + {math.cos(_D)!r} * 10.0e0 * c.s, 6) AS z FROM (VALUES (0, -1), (1, 1)) a(i, s), (VALUES (0, -1), (1, 1)) b(i, s), (VALUES (0, -1), (1, 1)) c(i, s)",
)
def _(v):
    rows = [(i, *map(float, p)) for i, p in enumerate(_PLATE.corners())]
    return rounded(v.spark.createDataFrame(rows, "corner int, x double, y double, z double"), "x", "y", "z")


# ------------------------------------------------------------------------------------------------ joins and responses


@query("a19_midpoints", "SELECT d.cell_id, round((m.x + n.x) / 2, 6) AS x, round((m.y + n.y) / 2, 6) AS y, round((m.z + n.z) / 2, 6) AS z FROM dipoles d JOIN stations m ON m.id = d.m JOIN stations n ON n.id = d.n")
def _(v):
    return rounded(joins.midpoints(v.dipoles, v.stations), "x", "y", "z")


@query("j16_dense_kernel", "SELECT s.id, c.cell_id, round((c.zc - s.z) / power((c.xc - s.x) * (c.xc - s.x) + (c.yc - s.y) * (c.yc - s.y) + (c.zc - s.z) * (c.zc - s.z), 1.5e0) * 1e6, 6) AS g FROM stations s CROSS JOIN cells c JOIN model m ON m.cell_id = c.cell_id WHERE m.active")
def _(v):
    cells = v.cells.join(v.model.filter("active").select("cell_id"), "cell_id", "left_semi").select("cell_id", "xc", "yc", "zc")
    dx, dy, dz = F.col("xc") - F.col("x"), F.col("yc") - F.col("y"), F.col("zc") - F.col("z")
    return rounded(survey.kernel(v.stations, cells, dz / F.pow(dx * dx + dy * dy + dz * dz, F.lit(1.5)) * 1e6), "g")


@query(
    "x28_linear_elevation",
    """WITH q AS (SELECT range AS q, (range // 16) * 17 + range % 16 AS a FROM range(256)), tri AS (SELECT q * 2 AS t, a AS v0, a + 1 AS v1, a + 18 AS v2 FROM q UNION ALL SELECT q * 2 + 1, a, a + 18, a + 17 FROM q),
s AS (SELECT id, round(x) AS x, round(y) AS y, z FROM stations),
c AS (SELECT tri.t, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, d.x AS x2, d.y AS y2, d.z AS z2 FROM tri JOIN topo a ON a.id = v0 JOIN topo b ON b.id = v1 JOIN topo d ON d.id = v2),
w AS (SELECT s.id, c.*, ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / ((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)) AS u, ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / ((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)) AS v FROM s JOIN c ON x BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND y BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2)),
l AS (SELECT id, min_by(u * z0 + v * z1 + (1 - u - v) * z2, t) AS z FROM w WHERE u >= -1e-12 AND v >= -1e-12 AND u + v <= 1 + 1e-12 GROUP BY id),
n AS (SELECT s.id, t.z, row_number() OVER (PARTITION BY s.id ORDER BY sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z)), t.id) AS r FROM s CROSS JOIN topo t WHERE s.id NOT IN (SELECT id FROM l))
SELECT id, round(z, 6) AS z FROM l UNION ALL SELECT id, round(z, 6) FROM n WHERE r = 1""",
)
def _(v):
    return rounded(survey.on_triangles(v.stations, v.topo, synthetics.grid_triangles(v.spark, 17, 17), 100.0), "z")


@query("k09_terms_of_drivers", "SELECT CAST(line_id AS INTEGER) AS driver, t.term, t.weight FROM (SELECT DISTINCT line_id FROM stations) JOIN (VALUES (0, 'small', 1.0e0), (1, 'smooth_x', 2.0e0), (1, 'smooth_y', 3.0e0)) t(mapping, term, weight) ON t.mapping = line_id % 2")
def _(v):
    terms = v.spark.createDataFrame([(0, "small", 1.0), (1, "smooth_x", 2.0), (1, "smooth_y", 3.0)], "mapping int, term string, weight double")
    return survey.terms_of_drivers(terms, v.stations.select(F.col("line_id").alias("driver")).distinct().withColumn("mapping", (F.col("driver") % 2).cast("int")))


# ------------------------------------------------------------------------------------------------ orders, sets and jobs


@query("o05_order_of_appearance", "SELECT event_type, first, row_number() OVER (ORDER BY first) - 1 AS place FROM (SELECT event_type, min(id) AS first FROM readings GROUP BY event_type)")
def _(v):
    return survey.in_first_order(v.readings, "event_type", "id")


@query("o10_layers_from_below", "SELECT id, line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY pos DESC) - 1 AS INTEGER) AS place FROM electrodes")
def _(v):
    return survey.reversed_layers(v.electrodes, "line_id", "pos").select("id", "line_id", "place")


@query("u04_in_all_lines", "SELECT event_type FROM readings GROUP BY event_type HAVING count(DISTINCT line_id) = (SELECT count(DISTINCT line_id) FROM readings)")
def _(v):
    return survey.in_all_groups(v.readings, "event_type", "line_id")


@query("b01_sweep", "SELECT min(line_id) AS first, max(line_id) AS last, count(DISTINCT line_id) AS n FROM stations")
def _(v):
    return survey.sweep_parameters(v.stations)


@query("b04_written_jobs", "WITH s AS (SELECT line_id, count(*) AS n, min(id) AS first FROM stations GROUP BY line_id) SELECT line_id, 'job' || line_id AS file, 'written' AS status, CASE WHEN line_id % 2 = 0 THEN '{\"line_id\":' || line_id || ',\"n\":' || n || ',\"first\":' || first || '}' END AS job FROM s")
def _(v):
    lookup = v.stations.select("line_id").distinct().select("line_id", F.concat(F.lit("job"), F.col("line_id")).alias("file"), F.when(F.col("line_id") % 2 == 0, "pending").otherwise("written").alias("status"))
    return survey.line_jobs(v.stations, lookup, {"n": F.count("*"), "first": F.min("id")})


@query("x06_job_stems", "SELECT id, 'line' || line_id AS stem FROM stations")
def _(v):
    return v.stations.select("id", survey.job_stem(F.concat(F.lit("line"), F.col("line_id"), F.lit(".ui.json"))).alias("stem"))


@query("w12_split_counts", "SELECT CAST(line_id AS INTEGER) AS line_id, CAST(1 + CASE WHEN p < (4 - n % 4) % 4 THEN 1 ELSE 0 END AS INTEGER) AS parts FROM (SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT line_id FROM stations))")
def _(v):
    """Lines are few and their counts a driver's matter, like the workers that they are split for."""
    lines = sorted((r.line_id, r["count"]) for r in v.stations.groupBy("line_id").count().collect())
    parts = survey.split_evenly([n for _, n in lines], 4)
    return v.spark.createDataFrame([(line, p) for (line, _), p in zip(lines, parts, strict=True)], "line_id int, parts int")


@query("methods_all", "SELECT * FROM (VALUES ('gravity', 'density', '3d', 10), ('magnetic scalar', 'susceptibility', '3d', 10), ('magnetic vector', 'susceptibility', '3d', 10), ('direct current 3d', 'conductivity', '3d', 1), ('direct current 2d', 'conductivity', '2d', 1), ('direct current pseudo 3d', 'conductivity', 'pseudo 3d', 1), ('induced polarization 3d', 'chargeability', '3d', 1), ('induced polarization 2d', 'chargeability', '2d', 1), ('induced polarization pseudo 3d', 'chargeability', 'pseudo 3d', 1), ('fdem', 'conductivity', '3d', 2), ('fem', 'conductivity', '3d', 2), ('fdem 1d', 'conductivity', '1d', 2), ('tdem', 'conductivity', '3d', 3), ('tdem 1d', 'conductivity', '1d', 1), ('magnetotellurics', 'conductivity', '3d', 8), ('tipper', 'conductivity', '3d', 4), ('joint surveys', 'shared', '3d', 0), ('joint cross gradient', 'several', '3d', 0), ('joint petrophysics', 'several', '3d', 0)) t(method, property, dimensions, n_components)")
def _(v):
    rows = [(name, m.physical_property, m.dimensions, len(m.components)) for name in [*methods.METHODS, *methods.ALIASES] for m in [methods.method(name)]]
    return v.spark.createDataFrame(rows, "method string, property string, dimensions string, n_components int")
