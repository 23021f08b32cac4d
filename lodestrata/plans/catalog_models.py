"""Queries over models and meshes: expressions, neighbours, responses, objectives, histories and generated surveys."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import aggregates, filters, joins, mesh, windows
from lodestrata.plans import forward, methods, objective, plates, synthetics
from lodestrata.plans.flagship import all_cells, gravity_of
from lodestrata.plans.registry import query
from lodestrata.sources import io

R = 6


def rounded(df, *names):
    return df.withColumns({n: F.round(n, R) for n in names})


def values(v, rows, schema):
    return v.spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------------------------------------------ expressions

NAMES = "(VALUES ('gz_channel_bool'), ('zxx_real'), ('tzx_imag'), ('gxy_channel'), ('tmi')) n(name)"


def _names(v):
    return values(v, [("gz_channel_bool",), ("zxx_real",), ("tzx_imag",), ("gxy_channel",), ("tmi",)], "name string")


@query("x01_tensor_names", f"SELECT name, regexp_matches(name, '(xx|xy|xz|yx|yy|yz|zx|zy|zz)') AS tensor FROM {NAMES}")
def _(v):
    return _names(v).select("name", scalars.tensor_component(F.col("name")).alias("tensor"))


@query("x02_component_names", f"SELECT name, array_to_string(list_filter(string_split(name, '_'), lambda p: p NOT IN ('channel', 'bool')), '_') AS component FROM {NAMES}")
def _(v):
    return _names(v).select("name", scalars.component_name(F.col("name")).alias("component"))


@query("x03_receiver_parts", f"SELECT name, reverse(substr(string_split(name, '_')[1], 2, 2)) AS orientation, string_split(name, '_')[2] AS part FROM {NAMES} WHERE name LIKE '%real' OR name LIKE '%imag'")
def _(v):
    axes, part = scalars.receiver_parts(F.col("name"), reverse=True)
    return _names(v).filter("name like '%real' or name like '%imag'").select("name", axes.alias("orientation"), part.alias("part"))


@query("x04_impedance_names", "SELECT c, CASE c WHEN 'zxx' THEN 'zyy' WHEN 'zxy' THEN 'zyx' WHEN 'zyx' THEN 'zxy' WHEN 'zyy' THEN 'zxx' ELSE c END AS translated FROM (VALUES ('zxx'), ('zxy'), ('zyx'), ('zyy'), ('other')) t(c)")
def _(v):
    table = F.create_map(*[F.lit(x) for p in scalars.IMPEDANCE.items() for x in p])
    return values(v, [("zxx",), ("zxy",), ("zyx",), ("zyy",), ("other",)], "c string").select("c", F.coalesce(F.try_element_at(table, F.col("c")), F.col("c")).alias("translated"))


@query("x05_iteration_names", "SELECT name, CAST(nullif(regexp_extract(name, '(\\d+)', 1), '') AS INTEGER) AS iteration, CASE WHEN regexp_extract(name, '(\\d+)', 1) = '' THEN name ELSE replace(name, regexp_extract(name, '(\\d+)', 1), 'final') END AS final FROM (VALUES ('Iteration_12_gz'), ('Iteration_3_3'), ('model')) t(name)")
def _(v):
    n = F.col("name")
    return values(v, [("Iteration_12_gz",), ("Iteration_3_3",), ("model",)], "name string").select("name", scalars.iteration_number(n).alias("iteration"), scalars.final_name(n).alias("final"))


@query("x07_versions", "SELECT * FROM (VALUES ('0.3.0-rc.2', '0.3.0'), ('0.2.1.post1', '0.2.1'), ('1.0.0a1', '1.0.0a1'), ('2.1+local', '2.1')) t(version, comparable)")
def _(v):
    return values(v, [("0.3.0-rc.2",), ("0.2.1.post1",), ("1.0.0a1",), ("2.1+local",)], "version string").select("version", scalars.comparable_version(F.col("version")).alias("comparable"))


@query("x08_next_event_id", "SELECT max(unit) + 1 AS next FROM model")
def _(v):
    return v.model.agg((F.max("unit") + 1).alias("next"))


@query("x09_normalizations", "SELECT component, CASE WHEN component IN ('gz', 'gxz', 'gyz') THEN -1.0e0 ELSE 1.0e0 END AS gravity, -1.0e0 AS mt, 1.0e0 AS dc FROM (SELECT DISTINCT component FROM observed)")
def _(v):
    c = F.col("component")
    return v.observed.select("component").distinct().select("component", scalars.sign(c, "gravity").alias("gravity"), scalars.sign(c, "magnetotellurics").alias("mt"), scalars.sign(c, "potential").alias("dc"))


@query("x11_time_units", "SELECT * FROM (VALUES ('Seconds (s)', 1.0e0), ('Milliseconds (ms)', 0.001e0), ('Microseconds (us)', 0.000001e0)) t(unit, seconds)")
def _(v):
    table = F.create_map(*[F.lit(x) for p in scalars.TIME_UNITS.items() for x in p])
    return values(v, [(u,) for u in scalars.TIME_UNITS], "unit string").select("unit", F.element_at(table, F.col("unit")).alias("seconds"))


@query("x12_log_models", "SELECT cell_id, round(CASE WHEN volume > 0 THEN ln(volume) END, 6) AS conductivity, round(CASE WHEN volume > 0 THEN ln(1.0e0 / volume) END, 6) AS resistivity FROM units")
def _(v):
    p = F.col("volume")
    return v.units.select("cell_id", F.round(scalars.log_property(p), R).alias("conductivity"), F.round(scalars.log_property(p, True), R).alias("resistivity"))


@query("x13_reference_weight", "SELECT unit, CASE WHEN bool_and(property = 0) THEN 0.0e0 ELSE 1.0e0 END AS alpha_s FROM units GROUP BY unit")
def _(v):
    return v.units.groupBy("unit").agg(F.when(F.bool_and(F.col("property") == 0), 0.0).otherwise(1.0).alias("alpha_s"))


@query("x14_bounds", "SELECT cell_id, round(ln(1.0e0 / (value + 2.0e0)), 6) AS low, CASE WHEN value = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(ln(1.0e0 / value), 6) END AS high FROM model")
def _(v):
    low, high = scalars.bounds(F.when(F.col("value") != 0, F.col("value")), F.col("value") + 2.0, True, True)
    inf = F.lit(float("inf"))
    return v.model.select("cell_id", F.round(low, R).alias("low"), F.when(high == inf, inf).otherwise(F.round(F.when(high < inf, high), R)).alias("high"))


@query("x16_tiled_vector", "SELECT k.component * 256 + m.cell_id AS pos, m.value FROM model m CROSS JOIN (SELECT range AS component FROM range(3)) k")
def _(v):
    return v.model.crossJoin(v.range(3, "component")).select((F.col("component") * 256 + F.col("cell_id")).alias("pos"), "value")


@query("x17_field_angles", "SELECT id, component, CASE WHEN isnan(value) THEN 0.0e0 WHEN id % 2 = 0 THEN value ELSE 60.0e0 END AS angle FROM gappy")
def _(v):
    stored = F.when((F.col("id") % 2 == 0) | F.isnan("value"), F.col("value"))
    return v.gappy.select("id", "component", scalars.angle_or_default(stored, 60.0).alias("angle"))


@query("x18_polar", "SELECT id, round(sqrt(x * x + y * y + z * z), 6) AS amplitude, round(degrees(atan2(-z, sqrt(x * x + y * y))), 6) AS dip, round((degrees(atan2(x, y)) + 360.0e0) - 360.0e0 * floor((degrees(atan2(x, y)) + 360.0e0) / 360.0e0), 6) AS azimuth FROM stations")
def _(v):
    a, d, z = scalars.from_cartesian(F.col("x"), F.col("y"), F.col("z"))
    return rounded(v.stations.select("id", a.alias("amplitude"), d.alias("dip"), z.alias("azimuth")), "amplitude", "dip", "azimuth")


@query("x18_cartesian", "SELECT id, round(z * cos(radians(30.0e0)) * sin(radians(y)), 6) AS east, round(z * cos(radians(30.0e0)) * cos(radians(y)), 6) AS north, round(-z * sin(radians(30.0e0)), 6) AS up FROM stations")
def _(v):
    e, n, u = scalars.to_cartesian(F.col("z"), F.lit(30.0), F.col("y"))
    return rounded(v.stations.select("id", e.alias("east"), n.alias("north"), u.alias("up")), "east", "north", "up")


@query("x19_dip_directions", "WITH t AS (SELECT id, CASE WHEN z < 0 THEN -1 ELSE 1 END AS s, x, y, z FROM stations), a AS (SELECT id, degrees(atan2(x * s, y * s)) AS d, degrees(acos(least(1.0e0, abs(z) / sqrt(x * x + y * y + z * z)))) AS dip FROM t) SELECT id, round(CASE WHEN d < 0 THEN d + 360.0e0 ELSE d END, 6) AS direction, round(dip, 6) AS dip FROM a")
def _(v):
    direction, dip = scalars.dip_direction(F.col("x"), F.col("y"), F.col("z"))
    return rounded(v.stations.select("id", direction.alias("direction"), dip.alias("dip")), "direction", "dip")


@query("x21_aspect_rotation", "SELECT id, round(-atan2(sin(radians(y)) / 25.0e0, cos(radians(y)) / 50.0e0), 6) AS phi FROM stations")
def _(v):
    return v.stations.select("id", F.round(scalars.aspect_rotation(F.radians("y"), F.lit(50.0), F.lit(25.0)), R).alias("phi"))


@query("x23_round_nearest", "SELECT id, round_even(x / 5.0e0, 0) * 5.0e0 AS x FROM stations")
def _(v):
    return v.stations.select("id", scalars.round_nearest(F.col("x"), 5.0).alias("x"))


@query("x24_vertical_padding", "SELECT m, NOT regexp_matches(m, '(direct current|induced polarization|gravity|magnetic)') AS padded FROM (VALUES ('gravity'), ('tipper'), ('direct current 3d'), ('fdem'), ('magnetic vector')) t(m)")
def _(v):
    return values(v, [("gravity",), ("tipper",), ("direct current 3d",), ("fdem",), ("magnetic vector",)], "m string").select("m", scalars.vertical_padding(F.col("m")).alias("padded"))


@query("x25_offsets", "SELECT id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM readings")
def _(v):
    return v.readings.select("id", F.element_at(F.from_json("props", "map<string,int>"), "k").alias("k"))


@query("x26_fdem_factor", f"SELECT offset_m, round(1e12 * (4e-7 * {math.pi!r} * (-1.0e0 / (offset_m * offset_m * offset_m) / 4.0e0 / {math.pi!r}) / 1e6), 6) AS factor FROM (VALUES (7.86e0), (6.3e0)) t(offset_m)")
def _(v):
    return values(v, [(7.86,), (6.3,)], "offset_m double").select("offset_m", F.round(scalars.fdem_factor(F.col("offset_m")) * 1e12, R).alias("factor"))


@query("x27_interpolated_waveform", "WITH w AS (SELECT pos AS t, z AS current, lead(pos) OVER (ORDER BY pos) AS t1, lead(z) OVER (ORDER BY pos) AS c1 FROM electrodes WHERE line_id = 0) SELECT q.t AS t, round(w.current + (q.t - w.t) * (w.c1 - w.current) / (w.t1 - w.t), 6) AS current FROM (SELECT range * 0.7e0 + 1.0e0 AS t FROM range(30)) q JOIN w ON q.t >= w.t AND q.t < w.t1")
def _(v):
    w = Window.orderBy("t")
    wave = filters.on_line(v.electrodes, 0).select(F.col("pos").alias("t"), F.col("z").alias("c")).withColumn("t1", F.lead("t").over(w)).withColumn("c1", F.lead("c").over(w)).filter("t1 is not null")
    times = v.range(30, "k").select((F.col("k") * 0.7 + 1.0).alias("q"))
    # samples are a unit apart, so the bracketing one is an equi-join on the floor
    return times.join(wave, F.floor("q") == F.col("t")).select(F.col("q").alias("t"), F.round(F.col("c") + (F.col("q") - F.col("t")) * (F.col("c1") - F.col("c")) / (F.col("t1") - F.col("t")), R).alias("current"))


@query("x28_draped_elevation", "WITH p AS (SELECT DISTINCT round_even(x, 0) AS x, round_even(y, 0) AS y FROM stations), n AS (SELECT p.x, p.y, t.z, row_number() OVER (PARTITION BY p.x, p.y ORDER BY sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)), t.id) AS r FROM p CROSS JOIN topo t) SELECT s.id, n.z FROM stations s JOIN n ON n.x = round_even(s.x, 0) AND n.y = round_even(s.y, 0) WHERE n.r = 1")
def _(v):
    at = v.stations.select("id", F.bround("x").alias("x"), F.bround("y").alias("y"))
    places = at.select("x", "y").distinct().select(F.struct("x", "y").alias("id"), "x", "y")
    z = joins.nearest_value(places, v.topo.withColumn("h", F.col("z")), "h", ("x", "y"))
    return at.join(z.select(F.col("id.x").alias("x"), F.col("id.y").alias("y"), F.col("h").alias("z")), ["x", "y"]).select("id", "z")


@query("x29_durations", "SELECT s, (s // 86400) || ' days, ' || ((s // 3600) % 24) || ' hours, ' || ((s // 60) % 60) || ' minutes, ' || (s % 60) || ' seconds' AS text FROM (SELECT range * 12345 AS s FROM range(20))")
def _(v):
    return v.range(20, "k").select((F.col("k") * 12345).alias("s")).select("s", scalars.duration(F.col("s")).alias("text"))


@query("x32_apparent_factor", f"SELECT line_id AS id, round(1.0e0 / ((1.0e0 / (line_id + 1) - 1.0e0 / (line_id + 3)) / {2 * math.pi!r} + 1e-10), 5) AS factor FROM (SELECT DISTINCT line_id FROM stations)")
def _(v):
    am, bm = (F.col("line_id") + 1).cast("double"), (F.col("line_id") + 3).cast("double")
    none = F.lit(None).cast("double")
    g = scalars.geometric_factor(am, bm, none, none)
    return v.stations.select("line_id").distinct().select(F.col("line_id").alias("id"), F.round(scalars.apparent_factor(g), 5).alias("factor"))


@query("x36_gradient_angles", "SELECT id, round(radians(x), 6) AS direction, round(radians(y), 6) AS dip FROM stations")
def _(v):
    return v.stations.select("id", F.round(F.radians("x"), R).alias("direction"), F.round(F.radians("y"), R).alias("dip"))


@query("x38_channel_times", "SELECT id, k.k AS place, (k.k + 1) * 0.001e0 AS t FROM stations CROSS JOIN (SELECT range AS k FROM range(3)) k")
def _(v):
    times = F.transform(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), lambda t: t * 1e-3)
    return v.stations.select("id", F.posexplode(times).alias("place", "t")).withColumn("place", F.col("place").cast("long"))


@query("method_catalogue", "SELECT * FROM (VALUES ('gravity', 10), ('magnetic scalar', 10), ('tipper', 4)) t(method, n_components)")
def _(v):
    wanted = ["gravity", "magnetic scalar", "tipper"]
    return methods.catalogue(v.spark).filter(F.col("method").isin(wanted)).groupBy("method").agg(F.countDistinct("component").alias("n_components"))


# ------------------------------------------------------------------------------------------------ meshes and graphs

FACES = "(SELECT 'i' AS axis, a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON b.i = a.i + 1 AND b.j = a.j AND b.k = a.k UNION ALL SELECT 'j', a.cell_id, b.cell_id FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j + 1 AND b.k = a.k UNION ALL SELECT 'k', a.cell_id, b.cell_id FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j AND b.k = a.k + 1)"


@query("g01_connected_parts", "WITH RECURSIVE b AS MATERIALIZED (SELECT v0 AS u, v1 AS v FROM edges UNION SELECT v1, v0 FROM edges), r(u, l) USING KEY (u) AS (SELECT u, min(u) FROM b GROUP BY u UNION SELECT b.v, min(r.l) FROM r JOIN b ON b.u = r.u JOIN recurring.r AS k ON k.u = b.v WHERE r.l < k.l GROUP BY b.v) SELECT u AS node, l AS part FROM r")
def _(v):
    return mesh.connected_parts(v.edges)


@query("g02_all_neighbours", "SELECT a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.cell_id <> b.cell_id")
def _(v):
    return mesh.all_neighbours(v.cells)


@query("g03_next_cell", "SELECT a.cell_id, coalesce(b.cell_id, -1) AS next FROM cells a LEFT JOIN cells b ON b.i = a.i + 1 AND b.j = a.j AND b.k = a.k")
def _(v):
    return mesh.next_cell(mesh.face_neighbours(v.cells), "i", v.cells)


@query("g04_neighbouring_cells", f"SELECT cell_id, axis, max(low) AS low, max(high) AS high FROM (SELECT b AS cell_id, axis, a AS low, NULL AS high FROM {FACES} UNION ALL SELECT a, axis, NULL, b FROM {FACES}) WHERE cell_id % 10 = 3 GROUP BY cell_id, axis")
def _(v):
    return mesh.sides(mesh.face_neighbours(v.cells), v.cells.filter("cell_id % 10 = 3").select("cell_id"))


@query("g05_expanded_active", f"WITH f AS (SELECT * FROM {FACES}), w AS (SELECT cell_id FROM cells WHERE cell_id % 25 = 0), near AS (SELECT cell_id FROM w UNION SELECT f.b FROM f JOIN w ON f.a = w.cell_id WHERE axis <> 'k' UNION SELECT f.a FROM f JOIN w ON f.b = w.cell_id WHERE axis <> 'k'), added AS (SELECT n.cell_id FROM near n JOIN model m ON m.cell_id = n.cell_id WHERE NOT m.active), more AS (SELECT cell_id FROM added UNION SELECT f.a FROM f JOIN added d ON f.b = d.cell_id WHERE axis = 'k') SELECT m.cell_id, m.active OR m.cell_id IN (SELECT cell_id FROM more) AS active FROM model m")
def _(v):
    wanted = v.cells.filter("cell_id % 25 = 0").select("cell_id")
    return mesh.expanded_active(v.model.select("cell_id", "active"), mesh.face_neighbours(v.cells), "active", wanted)


@query("g08_cell_corners", "SELECT cell_id, xc - 50.0e0 AS xl, xc + 50.0e0 AS xh, yc - 50.0e0 AS yl, yc + 50.0e0 AS yh, zc - 50.0e0 AS zl, zc + 50.0e0 AS zh FROM cells")
def _(v):
    return mesh.corners(v.cells, 100.0)


N = mesh.direction(30.0, 60.0)
MOVED = f"SELECT a.cell_id AS a, b.cell_id AS b, " + " * ".join(f"greatest(0.0e0, least(a.{c} + {n * 100.0!r} + 50.0e0, b.{c} + 50.0e0) - greatest(a.{c} + {n * 100.0!r} - 50.0e0, b.{c} - 50.0e0))" for c, n in zip(("xc", "yc", "zc"), N, strict=True)) + " AS volume FROM cells a JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.cell_id <> b.cell_id"


@query("g10_partial_volumes", f"SELECT a, b, round(volume, 3) AS volume FROM ({MOVED}) WHERE volume > 0")
def _(v):
    out = mesh.partial_volumes(v.cells, mesh.all_neighbours(v.cells), N, 100.0)
    return out.select("a", "b", F.round("volume", 3).alias("volume"))


GRADIENT = f"SELECT a, b, -volume / sum(volume) OVER (PARTITION BY a) AS w FROM ({MOVED}) WHERE volume > 0 UNION ALL SELECT c.cell_id, c.cell_id, CASE WHEN c.cell_id IN (SELECT a FROM ({MOVED}) WHERE volume > 0) THEN 1.0e0 ELSE 0.0e0 END FROM cells c"


@query("g11_rotated_gradient", f"SELECT a, b, round(w, 6) AS w FROM ({GRADIENT})")
def _(v):
    return rounded(mesh.rotated_gradient(v.cells, N, 100.0), "w")


@query("g11_applied_gradient", f"SELECT g.a AS cell_id, round(sum(g.w * m.value), 6) AS value FROM ({GRADIENT}) g JOIN model m ON m.cell_id = g.b GROUP BY g.a")
def _(v):
    return rounded(mesh.applied(mesh.rotated_gradient(v.cells, N, 100.0), v.model), "value")


@query("g12_gradient_in_active", f"WITH k AS (SELECT g.* FROM ({GRADIENT}) g JOIN model p ON p.cell_id = g.a AND p.active JOIN model q ON q.cell_id = g.b AND q.active), s AS (SELECT a FROM k GROUP BY a HAVING abs(sum(w)) < 1e-8 AND max(abs(w)) > 0) SELECT k.a, k.b, round(k.w / 100.0e0, 8) AS w FROM k JOIN s ON s.a = k.a")
def _(v):
    out = mesh.within_active(mesh.rotated_gradient(v.cells, N, 100.0), v.model.select("cell_id", "active"), 100.0)
    return out.select("a", "b", F.round("w", 8).alias("w"))


@query("g13_coarsened_mesh", "SELECT DISTINCT CAST((i >> l) << l AS INTEGER) AS i, CAST((j >> l) << l AS INTEGER) AS j, CAST((k >> l) << l AS INTEGER) AS k, l AS level FROM (SELECT *, CAST(CASE WHEN i < 4 THEN 0 ELSE 1 END AS INTEGER) AS l FROM cells)")
def _(v):
    levels = v.cells.select("cell_id", F.when(F.col("i") < 4, 0).otherwise(1).alias("level"))
    return mesh.coarsened(v.cells, levels)


@query("g15_auto_mesh", "WITH n AS (SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM stations a JOIN stations b ON a.id <> b.id GROUP BY a.id) SELECT round_even((SELECT median(d) FROM n) / 2.0e0 / 5.0e0, 0) * 5.0e0 AS cell, round_even(greatest(max(x) - min(x), max(y) - min(y)) / 2.0e0 / 100.0e0, 0) * 100.0e0 AS padding FROM stations")
def _(v):
    spacing = aggregates.station_spacing(v.stations)
    return spacing.select(scalars.round_nearest(F.col("median") / 2, 5.0).alias("cell")).crossJoin(aggregates.padding_distance(v.stations))


@query("g17_padded_column", "WITH h AS (SELECT range AS k, CASE WHEN range < 10 THEN 5.0e0 ELSE 5.0e0 * power(1.2e0, range - 9) END AS h FROM range(16)) SELECT CAST(k AS INTEGER) AS k, round(h, 6) AS h, round(-sum(h) OVER (ORDER BY k), 6) AS bottom FROM h")
def _(v):
    return rounded(mesh.padded_column(10, 6, 5.0, 1.2, v.spark), "h", "bottom")


PLATE = plates.Plate(20.0, -30.0, -150.0, 400.0, 300.0, 120.0, 60.0, 45.0)
INSIDE = " AND ".join(f"abs((xc - {PLATE.x!r}) * {a[0]!r} + (yc - {PLATE.y!r}) * {a[1]!r} + (zc - {PLATE.z!r}) * {a[2]!r}) <= {length / 2 + 1e-9!r}" for a, length in zip(PLATE.axes(), (400.0, 300.0, 120.0), strict=True))


@query("g18_inside_plate", f"SELECT cell_id, {INSIDE} AS inside FROM cells")
def _(v):
    return v.cells.select("cell_id", PLATE.inside(F.col("xc"), F.col("yc"), F.col("zc")).alias("inside"))


@query("g19_inside_body", f"SELECT cell_id AS id, {INSIDE} AS inside FROM cells")
def _(v):
    corners = PLATE.corners()
    rows = [tuple(x for k in face for x in corners[k]) for face in plates.FACES]
    triangles = values(v, rows, ", ".join(f"{t}{a} double" for t in "abc" for a in "xyz"))
    return mesh.inside_mesh(v.cells.select(F.col("cell_id").alias("id"), F.col("xc").alias("x"), F.col("yc").alias("y"), F.col("zc").alias("z")), triangles)


@query("g20_below_shifted_surface", "WITH n AS (SELECT c.cell_id, c.zc, t.z, row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt((c.xc - t.x) * (c.xc - t.x) + (c.yc - t.y) * (c.yc - t.y)), t.id) AS r FROM cells c CROSS JOIN topo t) SELECT cell_id, zc < z - 120.0e0 AS active FROM n WHERE r = 1")
def _(v):
    return mesh.below_surface(v.cells, v.topo.withColumn("z", F.col("z") - 120.0), 100.0)


@query("g21_plate_corners", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {round(p[0], 6)!r}e0, {round(p[1], 6)!r}e0, {round(p[2], 6)!r}e0)" for i, p in enumerate(plates.Plate(0.0, 0.0, -100.0, 200.0, 100.0, 20.0).corners())) + ") t(corner, x, y, z)")
def _(v):
    return rounded(values(v, [(i, *map(float, p)) for i, p in enumerate(plates.Plate(0.0, 0.0, -100.0, 200.0, 100.0, 20.0).corners())], "corner int, x double, y double, z double"), "x", "y", "z")


# -------------------------------------------------------------------------------------------------------- responses

CORNERS = "(SELECT 50.0e0 * a.s AS sx, 50.0e0 * b.s AS sy, 50.0e0 * c.s AS sz, CAST(a.s * b.s * c.s AS DOUBLE) AS mu FROM (VALUES (-1), (1)) a(s), (VALUES (-1), (1)) b(s), (VALUES (-1), (1)) c(s))"
DENSE = "(SELECT xc, yc, zc, (cell_id % 7) * 0.1e0 + 0.1e0 AS density FROM cells)"
PRISM = f"(SELECT s.id, c.density * k.mu AS f, c.xc + k.sx - s.x AS dx, c.yc + k.sy - s.y AS dy, c.zc + k.sz - s.z AS dz FROM stations s, {DENSE} c, {CORNERS} k)"
WITH_R = f"(SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM {PRISM})"


@query("p01_gravity", f"SELECT id, round(sum(f * (dx * ln(dy + r) + dy * ln(dx + r) - dz * atan(coalesce(dx * dy / nullif(dz * r, 0), 0)))) * 6.6743e-3, 6) AS gz FROM {WITH_R} GROUP BY id")
def _(v):
    return gravity_of(v, all_cells(v))


@query("p01_gravity_tensor", f"SELECT id, round(sum(-f * atan(dx * dy / (dz * r))) * 6.6743e-3, 6) AS gzz, round(sum(f * ln(dz + r)) * 6.6743e-3, 6) AS gxy, round(sum(f * ln(dy + r)) * 6.6743e-3, 6) AS gxz FROM {WITH_R} GROUP BY id")
def _(v):
    return rounded(forward.gravity(v.stations, all_cells(v), 100.0, ("gzz", "gxy", "gxz")), "gzz", "gxy", "gxz")


FIELD = (50000.0, 60.0, 10.0)
U = (math.cos(math.radians(60.0)) * math.sin(math.radians(10.0)), math.cos(math.radians(60.0)) * math.cos(math.radians(10.0)), -math.sin(math.radians(60.0)))
DIPOLE = f"(SELECT s.id, c.density * 0.01e0 * 50000.0e0 * 1000000.0e0 / {4 * math.pi!r} AS m, s.x - c.xc AS dx, s.y - c.yc AS dy, s.z - c.zc AS dz FROM stations s, {DENSE} c)"
ALONG = f"(SELECT *, dx * dx + dy * dy + dz * dz AS r2, dx * {U[0]!r} + dy * {U[1]!r} + dz * {U[2]!r} AS al FROM {DIPOLE})"
B = [f"sum(m * ({d} * al * 3.0e0 / power(r2, 2.5) - {u!r} / power(r2, 1.5)))" for d, u in zip(("dx", "dy", "dz"), U, strict=True)]


@query("p02_magnetic", f"SELECT id, round({B[0]}, 4) AS bx, round({B[0]} * {U[0]!r} + {B[1]} * {U[1]!r} + {B[2]} * {U[2]!r}, 4) AS tmi FROM {ALONG} GROUP BY id")
def _(v):
    cells = all_cells(v).select("xc", "yc", "zc", (F.col("density") * 0.01).alias("susceptibility"))
    return forward.magnetic(v.stations, cells, 100.0, FIELD).select("id", F.round("bx", 4).alias("bx"), F.round("tmi", 4).alias("tmi"))


@query("p02_magnetic_vector", f"SELECT id, round({B[0]} * {U[0]!r} + {B[1]} * {U[1]!r} + {B[2]} * {U[2]!r}, 4) AS tmi FROM {ALONG} GROUP BY id")
def _(v):
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(u).alias("u")) for k, u in enumerate(U)])).alias("p")
    cells = all_cells(v).select("xc", "yc", "zc", "density", parts).select("xc", "yc", "zc", F.col("p.k").alias("component"), (F.col("density") * 0.01 * F.col("p.u")).alias("value"))
    return forward.magnetic_vector(v.stations, cells, 100.0, 50000.0, U).select("id", F.round("tmi", 4).alias("tmi"))


@query("p03_half_space", f"WITH q AS (SELECT a.line_id, a.id AS a, b.id AS b, m.id AS m, n.id AS n, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, m.x AS mx, m.y AS my, m.z AS mz, n.x AS nx, n.y AS ny, n.z AS nz FROM electrodes a JOIN electrodes b ON b.line_id = a.line_id AND b.pos = a.pos + 1 JOIN electrodes m ON m.line_id = a.line_id AND m.pos = a.pos + 2 JOIN electrodes n ON n.line_id = a.line_id AND n.pos = a.pos + 3), g AS (SELECT a AS cell_id, (1 / sqrt((ax - mx) ** 2 + (ay - my) ** 2 + (az - mz) ** 2) - 1 / sqrt((bx - mx) ** 2 + (by_ - my) ** 2 + (bz - mz) ** 2) - 1 / sqrt((ax - nx) ** 2 + (ay - ny) ** 2 + (az - nz) ** 2) + 1 / sqrt((bx - nx) ** 2 + (by_ - ny) ** 2 + (bz - nz) ** 2)) / {2 * math.pi!r} AS f FROM q) SELECT cell_id, round(f * 100.0e0, 6) AS potential, round(f * 100.0e0 / (f + 1e-10), 4) AS apparent FROM g")
def _(v):
    e = v.electrodes.select("line_id", "pos", "id")
    rows = e.select("line_id", "pos", F.col("id").alias("a"))
    for k, n in enumerate("bmn", 1):
        rows = rows.join(e.select("line_id", (F.col("pos") - k).alias("pos"), F.col("id").alias(n)), ["line_id", "pos"])
    out = forward.half_space_potential(rows.withColumn("cell_id", F.col("a")), v.stations, 100.0)
    return out.select("cell_id", F.round("potential", R).alias("potential"), F.round("apparent", 4).alias("apparent"))


@query("p09_full_model", "SELECT c.cell_id, round(coalesce(exp(m.value), 1e-8), 8) AS value FROM cells c LEFT JOIN model m ON m.cell_id = c.cell_id AND m.active")
def _(v):
    return forward.full_model(v.model.filter("active").select("cell_id", "value"), v.cells).select("cell_id", F.round("value", 8).alias("value"))


@query("p11_pole_flag", "SELECT line_id, bool_and(m = n) AS pole FROM dipoles GROUP BY line_id")
def _(v):
    return v.dipoles.groupBy("line_id").agg(F.bool_and(F.col("m") == F.col("n")).alias("pole"))


@query("p12_base_station", "SELECT s.id, b.base FROM stations s CROSS JOIN (SELECT min_by(z, id) AS base FROM stations) b")
def _(v):
    return v.stations.select("id").crossJoin(F.broadcast(v.stations.agg(F.min_by("z", "id").alias("base"))))


@query("p13_colocated", "SELECT max(abs(s.x - t.x)) <= 1e-8 + 1e-5 * max(abs(t.x)) AS colocated FROM stations s JOIN stations t ON t.id = s.id")
def _(v):
    t = v.stations.select("id", F.col("x").alias("tx"))
    return v.stations.join(t, "id").agg((F.max(F.abs(F.col("x") - F.col("tx"))) <= F.max(F.abs("tx")) * 1e-5 + 1e-8).alias("colocated"))


# -------------------------------------------------------------------------------------------------------- objective


@query("r01_smallness", "SELECT round(sum((value - 0.02e0) * (value - 0.02e0)) * 2.0e0, 8) AS phi FROM model")
def _(v):
    reference = v.cells.select("cell_id", F.lit(0.02).alias("value"))
    return objective.smallness(v.model.select("cell_id", "value"), reference, 2.0).select(F.round("phi", 8).alias("phi"))


@query("r01_smoothness", f"SELECT f.axis, round(sum(((b.value - a.value) / 100.0e0) * ((b.value - a.value) / 100.0e0)) * CASE f.axis WHEN 'i' THEN 1.0e0 WHEN 'j' THEN 2.0e0 ELSE 0.0e0 END, 10) AS phi FROM {FACES} f JOIN model a ON a.cell_id = f.a JOIN model b ON b.cell_id = f.b GROUP BY f.axis")
def _(v):
    out = objective.smoothness(v.model.select("cell_id", "value"), mesh.face_neighbours(v.cells), 100.0, {"i": 1.0, "j": 2.0})
    return out.select("axis", F.round("phi", 10).alias("phi"))


@query("r02_sparse_norm", "SELECT component, round(sum(value * value / power(value * value + 0.0001e0, 0.5e0)), 6) AS phi FROM observed GROUP BY component")
def _(v):
    return v.observed.groupBy("component").agg(F.round(F.sum(objective.sparse_norm(F.col("value"), 1.0, 0.01)), R).alias("phi"))


@query("r03_sensitivity_weights", "SELECT l_partkey % 100 AS cell_id, round(power(sum(l_quantity * l_quantity) + 0.5e0, 0.25e0), 6) AS weight FROM lineitem GROUP BY 1")
def _(v):
    j = v.table("lineitem").select((F.col("l_partkey") % 100).alias("cell_id"), F.col("l_quantity").alias("j"))
    return rounded(aggregates.sensitivity_weights(j, 0.5), "weight")


def _all_columns(v):
    return v.table("embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("cell_id", "g")).withColumn("g", F.col("g").cast("double"))


KERNEL = "(SELECT vec_id AS id, CAST(k AS INTEGER) AS cell_id, CAST(embedding[k + 1] AS DOUBLE) AS g FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings))"


@query("r05_initial_beta", f"SELECT round(sum(v * v) / (SELECT max(len(embedding)) FROM embeddings) * 10.0e0, 6) AS beta FROM (SELECT id, sum(g) AS v FROM {KERNEL} GROUP BY id)")
def _(v):
    ones = _all_columns(v).select("cell_id").distinct().withColumn("value", F.lit(1.0))
    return rounded(objective.initial_beta(_all_columns(v), ones, 10.0), "beta")


@query("r06_preconditioner", f"SELECT cell_id, round(1.0e0 / (sum(g * g) + 0.1e0), 6) AS value FROM {KERNEL} GROUP BY cell_id")
def _(v):
    return rounded(objective.preconditioner(_all_columns(v), 0.1), "value")


@query("r08_misfit_scales", "WITH p AS (SELECT line_id AS tile, CAST(count(*) AS DOUBLE) AS phi FROM stations GROUP BY line_id) SELECT tile, round((SELECT max(phi) FROM p) / phi, 6) AS multiplier FROM p")
def _(v):
    parts = v.stations.groupBy(F.col("line_id").alias("tile")).agg(F.count("*").cast("double").alias("phi"))
    return rounded(objective.misfit_scales(parts), "multiplier")


@query("r09_conjugate_gradients")
def _(v):
    data = v.stations.select("id", (F.col("z") / 100).alias("value"))
    model, _ = objective.conjugate_gradients(_all_columns(v), data, 0.1, steps=8)
    return rounded(model, "value")


@query("k01_joint_multipliers", "SELECT line_id AS tile, CAST(max(count(*)) OVER () AS DOUBLE) / count(*) AS multiplier FROM stations GROUP BY line_id")
def _(v):
    n = v.stations.groupBy(F.col("line_id").alias("tile")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select("tile", (F.col("most").cast("double") / F.col("n")).alias("multiplier"))


@query("k02_block_offsets", "WITH n AS (SELECT unit, count(*) AS n FROM model WHERE active GROUP BY unit) SELECT unit, n, CAST(sum(n) OVER (ORDER BY unit ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first FROM n")
def _(v):
    n = v.model.filter("active").groupBy("unit").agg(F.count("*").alias("n"))
    return n.withColumn("first", F.sum("n").over(Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


CELL_GRADIENTS = "(SELECT c.cell_id, coalesce((bi.v - m.v) / 100.0e0, 0) AS gx, coalesce((bj.v - m.v) / 100.0e0, 0) AS gy, coalesce((bk.v - m.v) / 100.0e0, 0) AS gz FROM cells c JOIN (SELECT cell_id, {e} AS v FROM model) m ON m.cell_id = c.cell_id LEFT JOIN cells ci ON ci.i = c.i + 1 AND ci.j = c.j AND ci.k = c.k LEFT JOIN (SELECT cell_id, {e} AS v FROM model) bi ON bi.cell_id = ci.cell_id LEFT JOIN cells cj ON cj.i = c.i AND cj.j = c.j + 1 AND cj.k = c.k LEFT JOIN (SELECT cell_id, {e} AS v FROM model) bj ON bj.cell_id = cj.cell_id LEFT JOIN cells ck ON ck.i = c.i AND ck.j = c.j AND ck.k = c.k + 1 LEFT JOIN (SELECT cell_id, {e} AS v FROM model) bk ON bk.cell_id = ck.cell_id)"


@query("k04_cross_gradient", f"SELECT round(sum((a.gy * b.gz - a.gz * b.gy) ** 2 + (a.gz * b.gx - a.gx * b.gz) ** 2 + (a.gx * b.gy - a.gy * b.gx) ** 2) * 1e8, 6) AS phi FROM {CELL_GRADIENTS.format(e='value')} a JOIN {CELL_GRADIENTS.format(e='CAST(unit AS DOUBLE)')} b ON b.cell_id = a.cell_id")
def _(v):
    faces = mesh.face_neighbours(v.cells)
    a = objective.cell_gradients(v.model.select("cell_id", "value"), faces, 100.0)
    b = objective.cell_gradients(v.model.select("cell_id", F.col("unit").cast("double").alias("value")), faces, 100.0)
    return rounded(objective.cross_gradient(a, b, 1e8), "phi")


@query("k06_same_property", "SELECT count(DISTINCT event_type) = 1 AS same FROM readings")
def _(v):
    return v.readings.agg((F.countDistinct("event_type") == 1).alias("same"))


@query("k07_membership", "SELECT m.cell_id, CAST(dense_rank() OVER (ORDER BY m.unit) - 1 AS INTEGER) AS class FROM model m WHERE m.unit <> 0")
def _(v):
    return windows.coded(v.model.filter("unit <> 0"), [F.col("unit")], "class").select("cell_id", "class")


CLASSES = [(0, 0.5, 0.0, 1e6), (1, 0.3, 5000.0, 4e6), (2, 0.2, 9000.0, 1e6)]


@query("k08_gaussian_class", "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}e0, {c}e0, {float(d):.1f}e0)" for a, b, c, d in CLASSES) + ") c(label, weight, mean, var)), s AS (SELECT u.cell_id, c.label, ln(c.weight) - 0.5e0 * (ln(c.var) + (u.property - c.mean) * (u.property - c.mean) / c.var) AS p FROM units u CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY p DESC, label) AS r FROM s) SELECT cell_id, label FROM r WHERE r = 1")
def _(v):
    classes = values(v, CLASSES, "label int, weight double, mean_property double, var_property double")
    return objective.gaussian_class(v.units.select("cell_id", "property"), classes, ["property"])


# ----------------------------------------------------------------------------------------- histories and synthetics

SURFACE = "(50.0e0 * exp(-(xc * xc + yc * yc) / 80000.0e0))"


def _history():
    top = synthetics.hill(F.col("xc"), F.col("yc"), 50.0, 200.0)
    z = F.col("zc")
    return plates.checked([
        plates.deposition("basement", 0.5, z, F.lit(-200.0)),
        plates.anomaly("plate", 2.0, PLATE.inside(F.col("xc"), F.col("yc"), z)),
        plates.overburden("overburden", 0.1, z, top, 80.0),
        plates.erosion(z, top),
    ])


EVENTS = f"CASE WHEN NOT (zc < {SURFACE}) THEN 5 WHEN NOT (zc < {SURFACE} - 80.0e0) THEN 4 WHEN {INSIDE} THEN 3 WHEN zc < -200.0e0 THEN 2 ELSE 1 END"


@query("e05_event_fold", f"SELECT cell_id, {EVENTS} AS unit FROM cells")
def _(v):
    return plates.realized(v.cells, _history(), ("background", 1.0)).select("cell_id", "unit")


@query("e07_plate_model", f"SELECT cell_id, name, value FROM (SELECT cell_id, {EVENTS} AS u FROM cells) JOIN (VALUES (1, 'background', 1.0e0), (2, 'basement', 0.5e0), (3, 'plate', 2.0e0), (4, 'overburden', 0.1e0), (5, 'air', NULL)) t(unit, name, value) ON t.unit = u")
def _(v):
    return plates.realized(v.cells, _history(), ("background", 1.0)).select("cell_id", "name", "value")


@query("e08_replicated_plates", f"SELECT s.id, k.k AS copy, round(s.x + (k.k * 50.0e0 - 50.0e0) * {math.sin(math.radians(30.0))!r}, 6) AS x, round(s.y + (k.k * 50.0e0 - 50.0e0) * {math.cos(math.radians(30.0))!r}, 6) AS y FROM stations s CROSS JOIN (VALUES (0), (1), (2)) k(k)")
def _(v):
    out = plates.replicated(v.stations.select("id", "x", "y"), 3, 50.0, 30.0)
    return rounded(out.select("id", "copy", "x", "y"), "x", "y")


@query("e09_plate_centre", f"SELECT round(avg(x) + 10.0e0, 6) AS x, round(avg(y) - 20.0e0, 6) AS y, round((SELECT min(z) FROM topo) - 100.0e0 - {0.5 * 400.0 * math.sin(math.radians(60.0))!r}, 6) AS z FROM stations")
def _(v):
    return rounded(plates.plate_centre(v.stations, v.topo, 10.0, -20.0, -100.0, 60.0, 400.0, reference="min"), "x", "y", "z")


@query("e12_single_plate", "SELECT line_id AS number, CASE WHEN line_id = 1 THEN 0.0e0 ELSE 10.0e0 END AS spacing FROM (SELECT DISTINCT line_id FROM stations)")
def _(v):
    return v.stations.select(F.col("line_id").alias("number")).distinct().withColumn("spacing", F.when(F.col("number") == 1, 0.0).otherwise(10.0))


@query("y01_grid_survey", "SELECT range AS id, CAST(range // 20 AS INTEGER) AS line_id, round(-100.0e0 + (range % 20) * (200.0e0 / 19), 6) AS x, round(-100.0e0 + (range // 20) * 50.0e0, 6) AS y FROM range(100)")
def _(v):
    out = synthetics.grid(v.spark, 20, 5, (-100.0, 100.0, -100.0, 100.0), synthetics.hill(F.col("x"), F.col("y")))
    return rounded(out.select("id", "line_id", "x", "y"), "x", "y")


@query("y03_dipole_survey", "SELECT a.line_id, a.pos AS c, m.pos AS m FROM electrodes a JOIN electrodes m ON m.line_id = a.line_id AND m.pos BETWEEN a.pos + 2 AND a.pos + 10 JOIN electrodes n ON n.line_id = m.line_id AND n.pos = m.pos + 1")
def _(v):
    return synthetics.dipole_survey(v.electrodes)


@query("y04_loops", f"WITH h AS (SELECT CASE WHEN x < (SELECT avg(x) FROM stations) THEN 0 ELSE 1 END AS tx_id, x, y FROM stations), b AS (SELECT tx_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM h GROUP BY tx_id) SELECT tx_id, CAST(s.s AS INTEGER) AS seq, round((a + b) / 2 + cos(s.s * {2 * math.pi / 16!r}) * (b - a) / 2 * 1.5e0, 6) AS x, round((c + d) / 2 + sin(s.s * {2 * math.pi / 16!r}) * (d - c) / 2 * 1.5e0, 6) AS y FROM b CROSS JOIN (SELECT range AS s FROM range(16)) s")
def _(v):
    return rounded(synthetics.loops(v.stations), "x", "y")


@query("y05_short_segments", "SELECT a.id, b.id AS next FROM electrodes a JOIN electrodes b ON b.line_id = a.line_id AND b.pos = a.pos + 1 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 200.0e0")
def _(v):
    return synthetics.short_segments(v.electrodes)


@query("y06_coils", "SELECT s.id, f.frequency, f.o AS \"offset\", round(s.x - f.o, 6) AS tx_x FROM stations s CROSS JOIN (VALUES (900.0e0, 7.86e0), (7200.0e0, 7.86e0), (56000.0e0, 6.3e0)) f(frequency, o)")
def _(v):
    return rounded(synthetics.coils(v.stations).select("id", "frequency", "offset", "tx_x"), "tx_x")


@query("y07_natural_channels", "SELECT s.id, f.frequency, c.component FROM stations s CROSS JOIN (VALUES (10.0e0), (100.0e0), (1000.0e0)) f(frequency) CROSS JOIN (VALUES ('zxx_real'), ('zxx_imag'), ('zxy_real'), ('zxy_imag')) c(component)")
def _(v):
    return synthetics.channels(v.stations, [10.0, 100.0, 1000.0], ["zxx_real", "zxx_imag", "zxy_real", "zxy_imag"])


@query("y09_grid_triangles", "WITH q AS (SELECT range AS q, (range // 16) * 17 + range % 16 AS a FROM range(256)) SELECT q * 2 AS t, a AS v0, a + 1 AS v1, a + 18 AS v2 FROM q UNION ALL SELECT q * 2 + 1, a, a + 18, a + 17 FROM q")
def _(v):
    return synthetics.grid_triangles(v.spark, 17, 17)


@query("y11_layered_model", "SELECT c.cell_id, CASE WHEN NOT m.active THEN -1.0e0 WHEN zc < -100 AND zc > -300 THEN 0.1e0 ELSE 0.01e0 END AS value FROM cells c JOIN model m ON m.cell_id = c.cell_id")
def _(v):
    out = synthetics.layered_model(v.cells.join(v.model.select("cell_id", "active"), "cell_id"), -100.0, -300.0, 0.1, 0.01, F.col("active"))
    return out.select("cell_id", F.when(F.isnan("value"), -1.0).otherwise(F.col("value")).alias("value"))


@query("y17_survey_limits", "SELECT 100.0e0 - 200.0e0 / 2 AS x0, 100.0e0 + 200.0e0 / 2 AS x1, 50.0e0 - 100.0e0 / 2 AS y0, 50.0e0 + 100.0e0 / 2 AS y1")
def _(v):
    return v.spark.range(1).select(F.lit(0.0).alias("x0"), F.lit(200.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("y1"))


@query("b01_sweep_parameters", "SELECT min(line_id) AS first, max(line_id) AS last, count(DISTINCT line_id) AS n FROM stations")
def _(v):
    return v.stations.agg(F.min("line_id").alias("first"), F.max("line_id").alias("last"), F.countDistinct("line_id").alias("n"))


@query("b03_collected_results", "SELECT s.id, s.line_id, CASE WHEN r.k IS NULL THEN -1.0e0 ELSE round(s.z * 2.0e0, 6) END AS value FROM stations s LEFT JOIN (VALUES (1), (3), (5)) r(k) ON r.k = s.line_id")
def _(v):
    done = v.stations.filter(F.col("line_id").isin(1, 3, 5)).select("id", F.round(F.col("z") * 2.0, R).alias("value"))
    return joins.scattered(v.stations.select("id", "line_id"), done, "id", "value", -1.0)


@query("b05_transferred_models", "WITH n AS (SELECT c.cell_id, m.value, row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt((c.xc - s.x) * (c.xc - s.x) + (c.yc - s.y) * (c.yc - s.y)), s.id) AS r FROM cells c CROSS JOIN stations s JOIN model m ON m.cell_id = s.id % 256) SELECT cell_id, value FROM n WHERE r = 1")
def _(v):
    source = v.stations.join(v.model.select(F.col("cell_id").alias("k"), "value"), F.col("id") % 256 == F.col("k"))
    target = v.cells.select("cell_id", F.col("xc").alias("x"), F.col("yc").alias("y"))
    return joins.nearest_value(target, source, "value", ("x", "y"), target_id="cell_id")


@query("v05_custom_transforms", "SELECT cell_id, CASE WHEN active THEN round(sqrt(value) + 1.0e0, 6) END AS value FROM model")
def _(v):
    out = io.saved_model(v.model.filter("active").select("cell_id", "value"), v.model.select("cell_id", "active"), [F.sqrt, lambda c: c + 1.0])
    return out.select("cell_id", F.when(~F.isnan("value"), F.round("value", R)).alias("value"))
