"""Known results, far-field checks, round trips, error paths and odd rows of the survey operators."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import aggregates, filters, joins, mesh, tiling, windows
from lodestrata.plans import forward, methods, objective, plates
from lodestrata.sources import io


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double, z double")


def block(spark, n=3, size=10.0):
    cells = spark.range(n**3).select(F.col("id").alias("cell_id"), (F.col("id") % n).cast("int").alias("i"), (F.floor(F.col("id") / n) % n).cast("int").alias("j"), F.floor(F.col("id") / n**2).cast("int").alias("k"))
    return cells.select("*", F.lit(1).alias("ncells"), *[(F.col(a) * size + size / 2).alias(c) for a, c in zip("ijk", ("xc", "yc", "zc"), strict=True)])


def test_percentile_mask(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") > 100, float("nan")).otherwise(F.col("id").cast("double")).alias("v"))
    assert filters.sensitivity_mask(rows, "v", 10.0).filter("keep").count() == 90
    kept = filters.sensitivity_mask(rows, "v", 10.0, "percent").filter("keep")
    assert kept.agg(F.min("v")).first()[0] > 10
    with pytest.raises(ValueError, match="unknown"):
        filters.sensitivity_mask(rows, "v", 10.0, "other")
    assert filters.sensitivity_mask(rows.limit(0), "v", 10.0).count() == 0


def test_masks(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 0)], "v int, mask int")
    assert [r.v for r in filters.masked(filters.checked_mask(rows, "mask"), F.col("mask")).orderBy("v").collect()] == [2, 3, 4]
    for bad in (3, None):
        with pytest.raises(PySparkException, match="Badly formed"):
            filters.checked_mask(spark.createDataFrame([(bad,)], "mask int"), "mask").collect()


def test_round_nearest_is_half_even(spark):
    got = [r[0] for r in spark.range(11).orderBy("id").select(scalars.round_nearest(F.col("id").cast("double"), 5.0)).collect()]
    assert got == [0, 0, 0, 5, 5, 5, 5, 5, 10, 10, 10]


def test_padding_distance(spark):
    assert aggregates.padding_distance(points(spark, [(0, 0, 0), (975, 500, 0)])).first()[0] == 500


def test_neighbours_of_a_block(spark):
    found = mesh.all_neighbours(block(spark)).filter("a = 13").collect()
    assert len(found) == 26 and all(r.b != 13 for r in found)
    assert mesh.face_neighbours(block(spark)).count() == 3 * 18


def test_dip_convention(spark):
    normals = [(1, 0, 1), (0, 1, 1), (-1, 0, 1), (0, -1, 1)]
    d, dip = scalars.dip_direction(F.col("x"), F.col("y"), F.col("z"))
    got = points(spark, normals).orderBy("id").select(d.alias("d"), dip.alias("p")).collect()
    assert [round(r.d) % 360 for r in got] == [90, 0, 270, 180] and all(abs(r.p - 45) < 1e-9 for r in got)


def test_station_spacing(spark):
    rows = [(10 * i, 50 * j, 0) for i in range(10) for j in range(3)]
    r = aggregates.station_spacing(points(spark, rows)).first()
    assert (r["median"], r["mean"], r["least"], r["largest"]) == (10, 10, 10, 10)


def test_nearest_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    left = [(rng.gauss(0, 1), rng.gauss(0, 1), 0) for _ in range(60)] + [(50, 50, 0)]
    right = [(rng.choice([0, 0.5, 30]) + rng.random() * 0.1, rng.random(), 0) for _ in range(80)]
    for k in (1, 3):
        got = {(r.id, r["rank"]): (r.nn_id, round(r.d, 9)) for r in joins.nearest(points(spark, left), points(spark, right), k, width=0.2).collect()}
        for i, p in enumerate(left):
            order = sorted((math.dist(p, q), j) for j, q in enumerate(right))[:k]
            assert [got[i, n + 1] for n in range(k)] == [(j, round(d, 9)) for d, j in order]
    assert joins.nearest(points(spark, left).limit(0), points(spark, right), 1, width=1.0).count() == 0


def test_ccw_and_closing(spark):
    ring = [(math.cos(-t), math.sin(-t)) for t in (k * math.pi / 3 for k in range(6))]
    rows = [(0, k, *ring[k], *ring[(k + 1) % 6]) for k in range(6)]
    got = windows.counter_clockwise(spark.createDataFrame(rows, "tx_id int, seq int, x0 double, y0 double, x1 double, y1 double")).orderBy("place").collect()
    assert all(a.x0 * a.y1 - a.x1 * a.y0 > 0 for a in got) and (got[0].x0, got[0].y0) == ring[0]
    chain = spark.createDataFrame([(0, 0, 5, 6), (0, 1, 6, 7)], "tx_id int, seq int, v0 int, v1 int")
    assert {(r.seq, r.v0, r.v1) for r in windows.closed(chain).collect()} == {(0, 5, 6), (1, 6, 7), (2, 7, 5)}


def test_connected_parts(spark):
    edges = [(line * 100 + i, line * 100 + i + 1) for line in range(8) for i in range(10)]
    got = mesh.connected_parts(spark.createDataFrame(edges, "v0 long, v1 long")).collect()
    assert len({r.part for r in got}) == 8 and all(r.part == r.node // 100 * 100 for r in got)


def test_tiles(spark):
    stations = points(spark, [(i % 40, i // 40, 0) for i in range(1000)]).withColumn("line_id", (F.col("id") % 10).cast("int"))
    assert tiling.tiles_by_label(stations, 10).join(stations, "id").groupBy("tile").agg(F.countDistinct("line_id").alias("n")).filter("n <> 1").count() == 0
    assert {r.n for r in tiling.tiles_by_label(stations, 5).join(stations, "id").groupBy("tile").agg(F.countDistinct("line_id").alias("n")).collect()} == {2}
    sizes = [r["count"] for r in tiling.tiles_by_halving(stations, 3).groupBy("tile").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert tiling.fibonacci(13) == [1, 2, 3, 5, 8, 13]


def test_gravity_far_field(spark):
    cell = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "xc double, yc double, zc double, density double")
    r = forward.gravity(points(spark, [(0, 0, 1000), (1000, 0, 0), (300, 400, 500)]), cell, 100.0, ("gx", "gy", "gz", "gzz")).orderBy("id").collect()
    mass = 100.0**3 * forward.G_MGAL
    assert abs(r[0].gz / (mass / 1000**2) - 1) < 1e-3 and abs(r[0].gx) < 1e-6 * mass
    assert abs(abs(r[1].gx) / (mass / 1000**2) - 1) < 1e-3
    d = math.sqrt(300**2 + 400**2 + 500**2)
    assert abs(r[2].gz / (mass * 500 / d**3) - 1) < 1e-2 and abs(abs(r[2].gy) / (mass * 400 / d**3) - 1) < 1e-2
    assert r[2].gx < 0 and r[2].gy < 0  # towards the mass, which is in the south-west
    assert abs(r[0].gzz / (2 * mass / 1000**3) - 1) < 1e-2


def test_gravity_of_an_edge_station_is_finite(spark):
    cell = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "xc double, yc double, zc double, density double")
    r = forward.gravity(points(spark, [(50, 50, 50), (50, 0, 50), (0, 0, 0)]), cell, 100.0).collect()
    assert all(math.isfinite(x.gz) for x in r) and abs(r[2].gz) < 1e-6


def test_magnetic_dipole_on_axis(spark):
    cell = spark.createDataFrame([(0.0, 0.0, 0.0, 0.1)], "xc double, yc double, zc double, susceptibility double")
    r = forward.magnetic(points(spark, [(0, 0, 500)]), cell, 10.0, (50000.0, 90.0, 0.0)).first()
    assert abs(r.bz - -2 * 0.1 * 50000 * 10**3 / (4 * math.pi * 500**3)) < 1e-9 and abs(r.tmi + r.bz) < 1e-9


def test_half_space_reads_its_resistivity(spark):
    e = points(spark, [(10 * i, 0, 0) for i in range(4)])
    d = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 0, 0, 2, 2)], "cell_id int, a int, b int, m int, n int")
    r = forward.half_space_potential(d, e, 100.0).orderBy("cell_id").collect()
    assert all(abs(x.apparent - 100) < 1e-3 for x in r)
    assert abs(r[1].factor - 1 / (2 * math.pi * 20)) < 1e-12


def test_residual_of_observed_is_zero(spark):
    obs = spark.createDataFrame([(1, "gz", 2.0, 0.1), (2, "gz", 3.0, 0.1)], "id int, component string, value double, uncertainty double")
    assert all(r.residual == 0 for r in io.residual(obs, obs, ["id", "component"]).collect())
    assert aggregates.misfit(obs, obs, ["id", "component"]).first().phi == 0


def test_misfit_of_missing_data(spark):
    obs = spark.createDataFrame([(1, float("nan"), 0.1), (2, 3.0, float("inf")), (3, 1.0, 0.5), (4, None, 0.5)], "id int, value double, uncertainty double")
    pred = spark.createDataFrame([(i, 2.0) for i in (1, 2, 3, 4)], "id int, value double")
    assert aggregates.misfit(pred, obs, ["id"]).first().phi == 4


def test_plate_history(spark):
    z = F.col("zc")
    cells = block(spark, 4)
    events = plates.checked([plates.overburden("cover", 2.0, z, F.lit(40.0), 5.0), plates.erosion(z, F.lit(40.0))])
    got = {r.zc: r.unit for r in plates.realized(cells, events, ("rock", 1.0)).collect()}
    assert got == {5.0: 1, 15.0: 1, 25.0: 1, 35.0: 2}
    with pytest.raises(ValueError, match="erosion"):
        plates.checked(events[:1])
    with pytest.raises(ValueError, match="overburden"):
        plates.checked([events[0], plates.anomaly("a", 1.0, z > 0), events[1]])


def test_plate_centre_and_copies(spark):
    survey, topo = points(spark, [(-20, -20, 0), (0, 0, 0)]), points(spark, [(0, 0, 0)])
    r = plates.plate_centre(survey, topo, 10.0, 10.0, -100.0, 90.0, 400.0).first()
    assert (r.x, r.y, r.z) == (0, 0, -300)
    one = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    assert [round(r.x) for r in plates.replicated(one, 2, 10.0, 90.0).orderBy("copy").collect()] == [-5, 5]
    assert [round(r.y) for r in plates.replicated(one, 3, 5.0, 0.0).orderBy("copy").collect()] == [-5, 0, 5]


@pytest.mark.parametrize("dip", [20.0, 90.0])
@pytest.mark.parametrize("direction", [0.0, 45.0, 200.0])
def test_plate_faces_point_outwards(spark, dip, direction):
    p = plates.Plate(5.0, -3.0, 2.0, 20.0, 10.0, 4.0, dip, direction)
    rows = [tuple(x for k in f for x in p.corners()[k]) for f in plates.FACES]
    triangles = spark.createDataFrame(rows, ", ".join(f"{t}{a} double" for t in "abc" for a in "xyz"))
    probe = points(spark, [(5, -3, 2), (5, -3, 50), *[tuple(c + 0.9 * (k - c) for c, k in zip((5, -3, 2), q, strict=True)) for q in p.corners()]])
    got = [r.inside for r in mesh.inside_mesh(probe, triangles).orderBy("id").collect()]
    assert got == [True, False] + [True] * 8
    assert [r[0] for r in probe.orderBy("id").select(p.inside(F.col("x"), F.col("y"), F.col("z"))).collect()] == got


def test_conjugate_gradients_fit(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    g, d = rng.normal(size=(30, 5)), rng.normal(size=30)
    kernel = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(30) for j in range(5)], "id int, cell_id int, g double")
    data = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "id int, value double")
    model, history = objective.conjugate_gradients(kernel, data, 0.5, steps=5)
    want = np.linalg.solve(g.T @ g + 0.5 * np.eye(5), g.T @ d)
    assert np.allclose([r.value for r in model.orderBy("cell_id").collect()], want, atol=1e-6) and history[-1] < 1e-10
    clipped, _ = objective.conjugate_gradients(kernel, data, 0.5, steps=2, lower=0.0, upper=0.01)
    assert all(0 <= r.value <= 0.01 for r in clipped.collect())


def test_fdem_and_signs(spark):
    one = spark.range(1)
    f = one.select(scalars.fdem_factor(F.lit(7.86))).first()[0]
    assert abs(f - 4e-7 * math.pi * (-1 / 7.86**3 / 4 / math.pi) / 1e6) < 1e-24
    s = one.select(scalars.sign(F.lit("z"), "tdem", "dB/dt (T/s)"), scalars.sign(F.lit("z"), "tdem", "B (T)"), scalars.sign(F.lit("txz_imag"), "tipper"), scalars.sign(F.lit("zxx_real"), "magnetotellurics")).first()
    assert list(s) == [-1, 1, -1, -1]


def test_forms_logs_and_methods(spark, tmp_path):
    (tmp_path / "job.json").write_text('{"title": "t", "a": {"value": 3, "isValue": true}, "b": {"value": 1, "isValue": false, "property": "p"}, "c": {"value": 2, "enabled": false}}')
    assert io.read_form(spark, f"file://{tmp_path}/job.json") == {"title": "t", "a": 3, "b": "p", "c": None}
    (tmp_path / "log.out").write_text("iteration beta phi_d\n0 1.5 20.0\n1 0.75 10.5\n")
    log = io.read_log(spark, f"file://{tmp_path}/log.out")
    assert log.columns == ["iteration", "beta", "phi_d"] and log.agg(F.min("phi_d")).first()[0] == 10.5
    assert methods.method("fem").name == "fdem" and len(methods.METHODS) == 18
    with pytest.raises(NotImplementedError):
        methods.method("seismic")
    io.write_iterations(spark.createDataFrame([(1, 2.0), (2, 3.0)], "iteration int, value double"), f"file://{tmp_path}/it")
    assert spark.read.parquet(f"file://{tmp_path}/it").filter("iteration = 2").first().value == 3.0


def test_empty_and_repeated_rows(spark):
    none = points(spark, [(0, 0, 0)]).limit(0)
    assert aggregates.window_of(none).count() == 1 and filters.clamped_depth(none, 1.0).count() == 0
    twice = points(spark, [(0, 0, 0), (1, 0, 0)]).union(points(spark, [(0, 0, 0)]))
    assert filters.clamped_depth(twice, 1.0).count() == 3


def test_nearest_without_places_and_far_away(spark):
    """Null and NaN coordinates have no neighbour; few right rows are all found; far rows still find theirs."""
    from lodestrata.operators import joins

    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1e7, -1e7)], "id long, x double, y double")
    right = spark.createDataFrame([(10, 0.0, 1.0), (11, 5.0, 5.0), (12, None, 0.0)], "id long, x double, y double")
    got = {(r.id, r["rank"]): r.nn_id for r in joins.nearest(left, right, 3, ("x", "y")).collect()}
    assert got == {(1, 1): 10, (1, 2): 11, (4, 1): 11, (4, 2): 10}
    assert joins.nearest(left, right.limit(0), 1, ("x", "y")).count() == 0


def test_numbered_and_even_split(spark):
    from lodestrata.operators import windows

    rows = spark.createDataFrame([(i * 37 % 1009, str(i)) for i in range(1009)], "id long, name string").repartition(7)
    assert all(r.at == r.id for r in windows.numbered(rows, ["id"], "at").collect())
    sizes = sorted(r["count"] for r in windows.even_split(rows, 10, ["id"]).groupBy("part").count().collect())
    assert sizes == [100] + [101] * 9
    assert sorted(r.part for r in windows.even_split(rows.limit(3), 5, ["id"]).collect()) == [0, 1, 2]
    assert windows.numbered(rows.limit(0), ["id"], "at").count() == 0


def test_split_evenly():
    from lodestrata.operators import survey

    assert survey.split_evenly([5, 5, 5], 4) == [2, 1, 1] and survey.split_evenly([1, 1], 4) == [1, 1] and survey.split_evenly([], 3) == []


def test_cell_widths_of_columns_at_one_place(spark):
    """Ties go by id, whatever the order of the rows; with that order written out, the SQL gives the same."""
    import duckdb

    from lodestrata.plans.catalog import ORACLE_SQL

    places = [(i, i % 2, float(7 * i % 40 // 4)) for i in range(80)]
    tables = [spark.createDataFrame(rows, "id long, line_id int, x double").coalesce(1) for rows in (places, places[::-1])]
    got = [{r.id: round(r.width, 6) for r in windows.cell_widths(t, "line_id", "x", "x").collect()} for t in tables]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, label int, embedding double[])")
    con.executemany("insert into embeddings values (?, ?, ?)", [(i, line, [x / 1000, 0.0, 0.0]) for i, line, x in places])
    assert got[0] == got[1] == dict(con.execute(ORACLE_SQL["w03_cell_widths"].replace("ORDER BY x)", "ORDER BY x, id)")).fetchall())
