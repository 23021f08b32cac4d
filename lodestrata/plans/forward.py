"""Closed-form responses: prisms' gravity, cells' magnetic dipoles, electrodes on a half-space.

Every station meets every active cell by definition of the integral.  Cells are joined without shuffling the stations
(Spark broadcasts them where they are small enough), corners and cells are summed map-side per station.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gravitational constant in mGal m^2 per kg of density in g/cc, and the magnetic constant over 4 pi in nT.
G_MGAL = 6.6743e-3
NT = 100.0


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(0.0))


def corner_terms(dx: Column, dy: Column, dz: Column) -> dict[str, Column]:
    """What one corner adds to each component of a prism's attraction (x east, y north, z up; z positive for masses
    below), before sign and density.  Limits on edges and faces are taken as 0, which is exact for gz."""
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    angle = lambda a, b, c: F.atan(F.coalesce(F.try_divide(a * b, c * r), F.lit(0.0)))
    return {
        "gz": dx * _log(dy + r) + dy * _log(dx + r) - dz * angle(dx, dy, dz),
        "gx": -(dy * _log(dz + r) + dz * _log(dy + r) - dx * angle(dy, dz, dx)),
        "gy": -(dx * _log(dz + r) + dz * _log(dx + r) - dy * angle(dx, dz, dy)),
        "gxx": -angle(dy, dz, dx),
        "gyy": -angle(dx, dz, dy),
        "gzz": -angle(dx, dy, dz),
        "gxy": _log(dz + r),
        "gxz": _log(dy + r),
        "gyz": _log(dx + r),
    }


def gravity(stations: DataFrame, cells: DataFrame, size: float, components: tuple[str, ...] = ("gz",)) -> DataFrame:
    """(id, components): attraction of prisms (xc, yc, zc, density) of equal size at stations (id, x, y, z)."""
    half = size / 2
    bit = lambda k: (F.floor(F.col("_c") / 2**k) % 2 * 2 - 1).cast("double")
    corners = stations.sparkSession.range(8).withColumnRenamed("id", "_c").select(*[(bit(k) * half).alias(f"_s{a}") for k, a in enumerate("xyz")], (bit(0) * bit(1) * bit(2)).alias("_mu"))
    pairs = stations.select("id", "x", "y", "z").crossJoin(cells.filter("density <> 0").select("xc", "yc", "zc", "density")).crossJoin(F.broadcast(corners))
    terms = corner_terms(*[F.col(f"{a}c") + F.col(f"_s{a}") - F.col(a) for a in "xyz"])
    return pairs.groupBy("id").agg(*[F.sum(terms[c] * F.col("_mu") * F.col("density") * G_MGAL).alias(c) for c in components])


def magnetic(stations: DataFrame, cells: DataFrame, size: float, field: tuple[float, float, float]) -> DataFrame:
    """(id, bx, by, bz, tmi) in nT of cells (xc, yc, zc, susceptibility) as dipoles in an inducing field given by its
    strength (nT), inclination and declination (degrees)."""
    strength, inclination, declination = field
    i, d = math.radians(inclination), math.radians(declination)
    u = (math.cos(i) * math.sin(d), math.cos(i) * math.cos(d), -math.sin(i))
    moment = F.col("susceptibility") * strength * size**3 / (4 * math.pi)
    dx, dy, dz = F.col("x") - F.col("xc"), F.col("y") - F.col("yc"), F.col("z") - F.col("zc")
    r2 = dx * dx + dy * dy + dz * dz
    along = dx * u[0] + dy * u[1] + dz * u[2]
    part = lambda a, n: moment * (a * along * 3.0 / F.pow(r2, 2.5) - F.lit(n) / F.pow(r2, 1.5))
    pairs = stations.select("id", "x", "y", "z").crossJoin(cells.filter("susceptibility <> 0").select("xc", "yc", "zc", "susceptibility"))
    sums = pairs.groupBy("id").agg(F.sum(part(dx, u[0])).alias("bx"), F.sum(part(dy, u[1])).alias("by"), F.sum(part(dz, u[2])).alias("bz"))
    return sums.withColumn("tmi", F.col("bx") * u[0] + F.col("by") * u[1] + F.col("bz") * u[2])


def magnetic_vector(stations: DataFrame, cells: DataFrame, size: float, strength: float, projection: tuple[float, float, float]) -> DataFrame:
    """(id, tmi) of cells with a magnetisation vector (three rows a cell: component 0 to 2 and value)."""
    dx, dy, dz = F.col("x") - F.col("xc"), F.col("y") - F.col("yc"), F.col("z") - F.col("zc")
    r2 = dx * dx + dy * dy + dz * dz
    u = projection
    along_u = dx * u[0] + dy * u[1] + dz * u[2]
    own = F.when(F.col("component") == 0, dx).when(F.col("component") == 1, dy).otherwise(dz)
    unit = F.when(F.col("component") == 0, u[0]).when(F.col("component") == 1, u[1]).otherwise(u[2])
    term = F.col("value") * strength * size**3 / (4 * math.pi) * (own * along_u * 3.0 / F.pow(r2, 2.5) - unit / F.pow(r2, 1.5))
    return stations.select("id", "x", "y", "z").crossJoin(cells).groupBy("id").agg(F.sum(term).alias("tmi"))


def half_space_potential(dipoles: DataFrame, electrodes: DataFrame, resistivity: float, current: float = 1.0) -> DataFrame:
    """(cell_id, potential, factor, apparent): a four-electrode array (a, b, m, n electrode ids; b or n null or equal to
    a or m for a pole) on a half-space; factor is geometric, apparent the resistivity read from the potential."""
    place = lambda n: electrodes.select(F.col("id").alias(n), *[F.col(t).alias(f"_{n}{t}") for t in "xyz"])
    rows = dipoles
    for n in "abmn":
        rows = rows.join(place(n), n, "left" if n in "bn" else "inner")
    far = {("a", "m"): F.lit(False), ("b", "m"): F.col("b").isNull() | (F.col("b") == F.col("a")), ("a", "n"): F.col("n").isNull() | (F.col("n") == F.col("m"))}
    far["b", "n"] = far["b", "m"] | far["a", "n"]

    def inverse(s: str, r: str) -> Column:
        d = F.sqrt(sum(((F.col(f"_{s}{t}") - F.col(f"_{r}{t}")) ** 2 for t in "xyz"), F.lit(0.0)))
        return F.when(far[s, r], 0.0).otherwise(F.coalesce(F.try_divide(F.lit(1.0), d), F.lit(0.0)))

    factor = (inverse("a", "m") - inverse("b", "m") - inverse("a", "n") + inverse("b", "n")) / (2 * math.pi)
    out = rows.select("cell_id", factor.alias("factor"))
    return out.select("cell_id", (F.col("factor") * resistivity * current).alias("potential"), "factor", F.try_divide(F.col("factor") * resistivity * current, F.col("factor") + 1e-10).alias("apparent"))


def full_model(active: DataFrame, mesh: DataFrame, missing: float = 1e-8, exponential: bool = True) -> DataFrame:
    """(cell_id, value) on the whole mesh from active cells: exponentials of logarithms, a floor elsewhere."""
    value = F.exp("value") if exponential else F.col("value")
    return mesh.select("cell_id").join(active, "cell_id", "left").select("cell_id", F.coalesce(value, F.lit(missing)).alias("value"))
