"""Column expressions of survey data: signs and units, model transforms, orientations, names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components whose sign turns between the z-up tables and the z-down numerics, by kind of survey.
Z_COMPONENTS = ["gz", "bz", "gxz", "gyz", "bxz", "byz"]
TIME_COMPONENTS = ["x", "y", "z"]
#: Seconds in a unit of time, and hertz in a unit of frequency.
TIME_UNITS = {"Seconds (s)": 1.0, "Milliseconds (ms)": 1e-3, "Microseconds (us)": 1e-6}
#: Impedance components as the numerics name them (x and y change places).
IMPEDANCE = {"zxx": "zyy", "zxy": "zyx", "zyx": "zxy", "zyy": "zxx"}
MU_0 = 4e-7 * math.pi


def sign(component: Column, method: str, units: str = "") -> Column:
    """The factor of a component's values for a kind of survey; 1 where none applies."""
    one, minus = F.lit(1.0), F.lit(-1.0)
    if method == "magnetotellurics":
        return F.when(component.isNotNull(), minus).otherwise(one)
    if method == "tipper":
        return F.when(component.contains("imag"), minus).otherwise(one)
    if method.startswith("tdem"):
        return F.when(component.isin(TIME_COMPONENTS), minus).otherwise(one) if "dB/dt" in units else one
    if method in ("potential", "chargeability"):
        return one
    return F.when(component.isin(Z_COMPONENTS), minus).otherwise(one)


def fdem_factor(offset: Column) -> Column:
    """Parts per million of the primary field of a coplanar pair at an offset."""
    return F.lit(MU_0) * (F.lit(-1.0) / F.pow(offset, 3) / F.lit(4.0) / F.lit(math.pi)) / F.lit(1e6)


def normalized(value: Column, factor: Column, absolute: bool = False) -> Column:
    return F.abs(value * factor) if absolute else value * factor


def dummy_value(value: Column, dummy: float = -999.0) -> Column:
    """Missing data as the dummy value."""
    return F.when(value.isNull() | F.isnan(value), F.lit(dummy)).otherwise(value)


def dummy_deviation(value: Column, deviation: Column) -> Column:
    """Infinite where the datum is missing, so that it adds nothing to a misfit."""
    return F.when(value.isNull() | F.isnan(value), F.lit(float("inf"))).otherwise(deviation)


def saved_uncertainty(deviation: Column, factor: Column) -> Column:
    """As written back: positive in the data's own sign and unit, NaN for infinite."""
    out = F.abs(deviation / factor)
    return F.when(out == F.lit(float("inf")), F.lit(float("nan"))).otherwise(out)


def log_property(value: Column, resistivity: bool = False) -> Column:
    """Natural logarithm of a conductivity, or of a resistivity's reciprocal; null for values of 0 or below."""
    v = F.try_divide(F.lit(1.0), value) if resistivity else value
    return F.when(v > 0, F.log(v))


def bounds(lower: Column, upper: Column, resistivity: bool = False, log: bool = False) -> tuple[Column, Column]:
    """Bounds as the numerics take them: a resistivity's swap and invert, none is infinite, logarithms of finite ones."""
    low, high = (F.try_divide(F.lit(1.0), upper), F.try_divide(F.lit(1.0), lower)) if resistivity else (lower, upper)
    low, high = F.coalesce(low, F.lit(float("-inf"))), F.coalesce(high, F.lit(float("inf")))
    if log:
        finite = lambda v: F.when((F.abs(v) < F.lit(float("inf"))) & (v > 0), F.log(v)).otherwise(v)
        low, high = finite(low), finite(high)
    return low, high


def no_data(value: Column, active: Column, missing: float = float("nan")) -> Column:
    return F.when(active, value).otherwise(F.lit(missing))


def inverse_property(value: Column) -> Column:
    return F.try_divide(F.lit(1.0), value)


def angle_or_default(value: Column, default: float) -> Column:
    """A stored angle, else that of the inducing field; NaN becomes 0."""
    return F.nanvl(F.coalesce(value, F.lit(default)), F.lit(0.0))


def to_cartesian(amplitude: Column, dip: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a vector that dips (degrees down) towards an azimuth (degrees from north)."""
    d, a = F.radians(dip), F.radians(azimuth)
    return amplitude * F.cos(d) * F.sin(a), amplitude * F.cos(d) * F.cos(a), -amplitude * F.sin(d)


def from_cartesian(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Amplitude, dip (degrees down) and azimuth (degrees from north, 0 to 360) of a vector."""
    return F.sqrt(x * x + y * y + z * z), F.degrees(F.atan2(-z, F.hypot(x, y))), F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def dip_direction(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Dip direction and dip (degrees) of the plane with this normal; the normal is turned upwards first."""
    turn = F.when(z < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    length = F.sqrt(x * x + y * y + z * z)
    return F.pmod(F.degrees(F.atan2(x * turn, y * turn)), F.lit(360.0)), F.degrees(F.acos(F.least(F.lit(1.0), F.try_divide(F.abs(z), length))))


def strike_to_direction(strike: Column) -> Column:
    return F.pmod(strike + 90.0, F.lit(360.0))


def aspect_rotation(angle: Column, width: Column, height: Column) -> Column:
    """An angle (radians) as it appears in cells of width by height: minus the angle of (sin/height, cos/width)."""
    return -F.atan2(F.sin(angle) / height, F.cos(angle) / width)


def round_nearest(value: Column, step: float) -> Column:
    """To the nearest multiple, ties to even."""
    return F.bround(value / step) * step


def tensor_component(name: Column) -> Column:
    """Whether a channel's name ends in a pair of axes."""
    return name.rlike("(xx|xy|xz|yx|yy|yz|zx|zy|zz)")


def component_name(channel: Column) -> Column:
    """gz of gz_channel_bool."""
    return F.array_join(F.filter(F.split(channel, "_"), lambda p: ~p.isin("channel", "bool")), "_")


def receiver_parts(component: Column, reverse: bool = False) -> tuple[Column, Column]:
    """Orientation and real/imag part of names like zxx_real; a tipper's orientation is read backwards."""
    axes = F.substring(F.split_part(component, F.lit("_"), F.lit(1)), 2, 2)
    return F.reverse(axes) if reverse else axes, F.split_part(component, F.lit("_"), F.lit(2))


def iteration_number(name: Column) -> Column:
    """The first number in a name, null without one."""
    found = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def final_name(name: Column) -> Column:
    """The name with its first number replaced by "final" wherever it stands."""
    found = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(found == "", name).otherwise(F.replace(name, found, F.lit("final")))


def comparable_version(version: Column) -> Column:
    """A version without release candidate, post and local parts; alphas and betas stay."""
    return F.regexp_replace(F.regexp_replace(version, r"\+.*$", ""), r"[.\-_]?(rc|post|dev)\.?\d*$", "")


def duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds as text."""
    s = F.floor(seconds).cast("long")
    part = lambda n, m=None: (F.floor(s / n) % m if m else F.floor(s / n)).cast("string")
    return F.concat(part(86400), F.lit(" days, "), part(3600, 24), F.lit(" hours, "), part(60, 60), F.lit(" minutes, "), part(1, 60), F.lit(" seconds"))


def padding_cells(n_tiles: Column, method: Column) -> Column:
    """Cells around a tile: 100 for a single tile, 4 for electromagnetic surveys, else 6."""
    return F.when(n_tiles == 1, 100).when(method.isin("fdem", "tdem"), 4).otherwise(6)


def vertical_padding(method: Column) -> Column:
    """Whether a mesh is padded above and below: not for galvanic and potential-field surveys."""
    return ~method.rlike("(direct current|induced polarization|gravity|magnetic)")


def geometric_factor(am: Column, bm: Column, an: Column, bn: Column) -> Column:
    """Of a four-electrode array on a half-space; a pole's distances are infinite, given as null."""
    inverse = lambda d: F.coalesce(F.try_divide(F.lit(1.0), d), F.lit(0.0))
    return (inverse(am) - inverse(bm) - inverse(an) + inverse(bn)) / F.lit(2.0 * math.pi)


def apparent_factor(factor: Column) -> Column:
    """What turns a potential into an apparent resistivity."""
    return F.lit(1.0) / (factor + F.lit(1e-10))


def conductivity(value: Column, resistivity: bool, log: bool) -> Column:
    """A model as conductivity, its logarithm where the problem is solved for conductivity."""
    v = F.try_divide(F.lit(1.0), value) if resistivity else value
    return F.when(v > 0, F.log(v)) if log else v


def rotated(a: Column, b: Column, degrees: float) -> tuple[Column, Column]:
    """Two coordinates turned anticlockwise in their plane."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return a * c - b * s, a * s + b * c


def current_name(method: Column) -> Column:
    """The present name of a job type."""
    return F.when(method == "fem", "fdem").when(method == "fem 1d", "fdem 1d").otherwise(method)
