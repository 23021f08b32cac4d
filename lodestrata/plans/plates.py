"""Geological models from ordered events, and plates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Event:
    """A step of a geological history: where its condition holds, the cells take its id."""

    kind: str
    name: str
    value: float | None
    where: Column


def deposition(name: str, value: float, z: Column, surface: Column) -> Event:
    return Event("deposition", name, value, z < surface)


def overburden(name: str, value: float, z: Column, topography: Column, thickness: float) -> Event:
    """Whatever is not below the topography less the thickness."""
    return Event("overburden", name, value, ~(z < topography - thickness))


def erosion(z: Column, surface: Column) -> Event:
    """Air above a surface."""
    return Event("erosion", "air", None, ~(z < surface))


def anomaly(name: str, value: float, inside: Column) -> Event:
    return Event("anomaly", name, value, inside)


def checked(events: list[Event]) -> list[Event]:
    """A history ends with erosion, and an overburden comes right before it."""
    if not events or events[-1].kind != "erosion":
        raise ValueError("the last event must be an erosion")
    if any(e.kind == "overburden" for e in events[:-2]):
        raise ValueError("an overburden must be the last event but one")
    return events


def event_ids(events: list[Event], coeval: bool = False) -> list[tuple[int, Event]]:
    """Ids from 2 on (1 is the background); of coeval anomalies in a row all share one."""
    out: list[tuple[int, Event]] = []
    for e in events:
        shares = coeval and out and e.kind == "anomaly" == out[-1][1].kind
        out.append((out[-1][0] if shares else (out[-1][0] if out else 1) + 1, e))
    return out


def realized(cells: DataFrame, events: list[Event], background: tuple[str, float], coeval: bool = False) -> DataFrame:
    """The cells with unit (id), name and value after all events: later ones overwrite earlier ones.

    The history is folded into one expression, so it is a single projection."""
    numbered = event_ids(events, coeval)
    unit = reduce(lambda now, e: F.when(e[1].where, F.lit(e[0])).otherwise(now), numbered, F.lit(1))
    names = F.create_map(*[x for i, n in {1: background[0], **{i: e.name for i, e in numbered}}.items() for x in (F.lit(i), F.lit(n))])
    values = F.create_map(*[x for i, v in {1: background[1], **{i: e.value for i, e in numbered}}.items() for x in (F.lit(i), F.lit(v).cast("double"))])
    return cells.withColumn("unit", unit).withColumn("name", F.element_at(names, F.col("unit"))).withColumn("value", F.element_at(values, F.col("unit")))


@dataclass(frozen=True)
class Plate:
    """A box by its centre, lengths along strike and dip, width, dip and dip direction (degrees)."""

    x: float
    y: float
    z: float
    strike_length: float
    dip_length: float
    width: float
    dip: float = 90.0
    dip_direction: float = 90.0

    def axes(self) -> list[tuple[float, float, float]]:
        """Unit vectors along strike, down dip and across the plate."""
        a, d = math.radians(self.dip_direction), math.radians(self.dip)
        across = (math.sin(a), math.cos(a), 0.0)
        strike = (-across[1], across[0], 0.0)
        down = (across[0] * math.cos(d), across[1] * math.cos(d), -math.sin(d))
        normal = (across[0] * math.sin(d), across[1] * math.sin(d), math.cos(d))
        return [strike, down, normal]

    def inside(self, x: Column, y: Column, z: Column) -> Column:
        """Whether points are in the plate, its faces included."""
        delta = (x - self.x, y - self.y, z - self.z)
        near = [F.abs(sum((c * n for c, n in zip(delta, axis, strict=True)), F.lit(0.0))) <= length / 2 + 1e-9 for axis, length in zip(self.axes(), (self.strike_length, self.dip_length, self.width), strict=True)]
        return near[0] & near[1] & near[2]

    def corners(self) -> list[tuple[float, float, float]]:
        out = []
        for s in (-1, 1):
            for d in (-1, 1):
                for w in (-1, 1):
                    parts = zip(self.axes(), (s * self.strike_length / 2, d * self.dip_length / 2, w * self.width / 2), strict=True)
                    shift = [sum(v) for v in zip(*[[a * h for a in axis] for axis, h in parts], strict=True)]
                    out.append((self.x + shift[0], self.y + shift[1], self.z + shift[2]))
        return out


#: The faces of a box over Plate.corners(), two triangles each, seen anticlockwise from outside.
FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def replicated(plates: DataFrame, number: int, spacing: float, azimuth: float) -> DataFrame:
    """Copies of plates (x, y) in a row along an azimuth, centred on the plate; one plate stays where it is."""
    a = math.radians(azimuth)
    copies = F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    at = F.col("copy") * spacing - (number - 1) * spacing / 2
    return plates.withColumn("copy", copies).withColumn("x", F.col("x") + at * math.sin(a)).withColumn("y", F.col("y") + at * math.cos(a))


def plate_centre(stations: DataFrame, topography: DataFrame, easting: float, northing: float, elevation: float, dip: float, dip_length: float, relative: bool = True, reference: str = "mean") -> DataFrame:
    """One row (x, y, z): offsets from the survey's mean and a statistic of the topography, and half the plate's depth."""
    f = {"mean": F.avg, "min": F.min, "max": F.max}[reference]
    half = 0.5 * dip_length * math.sin(math.radians(dip))
    base = stations.agg(F.avg("x").alias("_x"), F.avg("y").alias("_y")).crossJoin(topography.agg(f("z").alias("_z")))
    on = 1.0 if relative else 0.0
    return base.select((F.col("_x") * on + easting).alias("x"), (F.col("_y") * on + northing).alias("y"), (F.col("_z") * on + elevation - half).alias("z"))
