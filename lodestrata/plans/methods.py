"""The catalogue of job types, and the registry of what runs them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Method:
    """A kind of survey: the property that it recovers, its components, and how many dimensions it has."""

    name: str
    physical_property: str
    components: tuple[str, ...]
    dimensions: str = "3d"
    lower_bound: float | None = None


#: Components of tensors, and of complex impedances and tippers.
_GRAVITY = ("gx", "gy", "gz", "guv", "gxx", "gxy", "gxz", "gyy", "gyz", "gzz")
_MAGNETIC = ("tmi", "bx", "by", "bz", "bxx", "bxy", "bxz", "byy", "byz", "bzz")
_IMPEDANCE = tuple(f"{c}_{p}" for c in ("zxx", "zxy", "zyx", "zyy") for p in ("real", "imag"))
_TIPPER = tuple(f"{c}_{p}" for c in ("txz", "tyz") for p in ("real", "imag"))

METHODS = {
    m.name: m
    for m in (
        Method("gravity", "density", _GRAVITY),
        Method("magnetic scalar", "susceptibility", _MAGNETIC, lower_bound=0.0),
        Method("magnetic vector", "susceptibility", _MAGNETIC),
        Method("direct current 3d", "conductivity", ("potential",)),
        Method("direct current 2d", "conductivity", ("potential",), "2d"),
        Method("direct current pseudo 3d", "conductivity", ("potential",), "pseudo 3d"),
        Method("induced polarization 3d", "chargeability", ("chargeability",), lower_bound=0.0),
        Method("induced polarization 2d", "chargeability", ("chargeability",), "2d", 0.0),
        Method("induced polarization pseudo 3d", "chargeability", ("chargeability",), "pseudo 3d", 0.0),
        Method("fdem", "conductivity", ("z_real", "z_imag")),
        Method("fdem 1d", "conductivity", ("z_real", "z_imag"), "1d"),
        Method("tdem", "conductivity", ("x", "y", "z")),
        Method("tdem 1d", "conductivity", ("z",), "1d"),
        Method("magnetotellurics", "conductivity", _IMPEDANCE),
        Method("tipper", "conductivity", _TIPPER),
        Method("joint surveys", "shared", ()),
        Method("joint cross gradient", "several", ()),
        Method("joint petrophysics", "several", ()),
    )
}
ALIASES = {"fem": "fdem"}


def method(name: str) -> Method:
    """A job type by name; raises for one that is not known."""
    name = ALIASES.get(name, name)
    if name not in METHODS:
        raise NotImplementedError(f"no method {name}")
    return METHODS[name]


def catalogue(spark: SparkSession) -> DataFrame:
    """(method, property, dimensions, component)."""
    rows = [(m.name, m.physical_property, m.dimensions, c) for m in METHODS.values() for c in m.components]
    return spark.createDataFrame(rows, "method string, property string, dimensions string, component string")


@dataclass
class Registry:
    """Names of jobs and the functions (SparkSession, options) -> DataFrame that run them."""

    jobs: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str) -> Callable:
        def add(run: Callable) -> Callable:
            self.jobs[name] = run
            return run

        return add

    def run(self, name: str, spark: SparkSession, options: dict) -> DataFrame:
        if name not in self.jobs:
            raise NotImplementedError(f"no job {name}")
        return self.jobs[name](spark, options)
