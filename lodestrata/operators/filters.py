"""Masks and predicates over station, channel and cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """Whether a value is neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def checked_mask(df: DataFrame, mask: str) -> DataFrame:
    """The table with its 0/1 mask column as a boolean; any other value, null included, raises when it is read."""
    ok = F.coalesce(F.col(mask).isin(0, 1), F.lit(False))
    return df.withColumn(mask, F.when(ok, F.col(mask) == 1).otherwise(F.raise_error(F.lit("Badly formed mask")).cast("boolean")))


def masked(df: DataFrame, mask: Column) -> DataFrame:
    """The rows of a mask; a null mask value drops its row."""
    return df.filter(mask)


def on_line(df: DataFrame, line: int, line_col: str = "line_id") -> DataFrame:
    """One survey line; a filter that reaches the scan, and prunes where the table is partitioned by line."""
    return df.filter(F.col(line_col) == F.lit(line))


def sub_survey(vertices: DataFrame, cells: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The cells (m, n vertex ids) of a predicate, and the vertices that they use."""
    kept = cells.filter(keep)
    used = kept.select(F.explode(F.array("m", "n")).alias("id")).distinct()
    return vertices.join(used, "id", "left_semi"), kept


def percentile_mask(df: DataFrame, value: str, cutoff: float, name: str = "keep") -> DataFrame:
    """True above a percentile (0 to 100, linear between ranks) of the numbers; false for NaN and null.

    The percentile is one aggregate row, joined as a scalar."""
    v = F.col(value)
    limit = df.filter(number(v)).agg(F.percentile(v, F.lit(cutoff / 100.0)).alias("_limit"))
    return df.crossJoin(F.broadcast(limit)).withColumn(name, F.coalesce(number(v) & (v > F.col("_limit")), F.lit(False))).drop("_limit")


def percent_mask(df: DataFrame, value: str, cutoff: float, log: bool = False, name: str = "keep") -> DataFrame:
    """True where a value exceeds a percentage of the largest one; on a log scale, of the range of log10 (0 counts as
    missing)."""
    v = F.col(value)
    scaled = F.when(number(v) & (v > 0), F.log10(v)) if log else F.when(number(v), v)
    rows = df.withColumn("_v", scaled)
    ends = rows.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    base = F.col("_low") if log else F.lit(0.0)
    share = F.try_divide((F.col("_v") - base) * 100.0, F.col("_high") - base)
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, F.coalesce(share > cutoff, F.lit(False))).drop("_v", "_low", "_high")


def sensitivity_mask(df: DataFrame, value: str, cutoff: float, method: str = "percentile", name: str = "keep") -> DataFrame:
    """Cells that the data can see, by one of three measures."""
    if method == "percentile":
        return percentile_mask(df, value, cutoff, name)
    if method in ("percent", "log_percent"):
        return percent_mask(df, value, cutoff, method == "log_percent", name)
    raise ValueError(f"unknown method {method}")


def floating_active(cells: DataFrame, active: str = "active") -> DataFrame:
    """One row: whether any active cell of a regular mesh (i, j, k) stands on an inactive one."""
    above = cells.select("i", "j", (F.col("k") - 1).alias("k"), F.col(active).alias("_above"))
    return cells.join(above, ["i", "j", "k"]).agg(F.coalesce(F.bool_or(F.col("_above") & ~F.col(active)), F.lit(False)).alias("floating"))


def clamped_depth(df: DataFrame, depth: float, z: str = "z") -> DataFrame:
    """Heights no lower than a depth below the highest."""
    top = df.agg(F.max(z).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(z, F.greatest(F.col(z), F.col("_top") - depth)).drop("_top")


def waveform_fits(channels: DataFrame, waveform: DataFrame, timing_mark: float) -> DataFrame:
    """One row: whether the last channel ends before the waveform does."""
    return channels.agg(F.max("t").alias("last")).crossJoin(waveform.agg((F.max("t") - timing_mark).alias("end"))).select((F.col("last") <= F.col("end")).alias("fits"))


def on_time(waveform: DataFrame) -> DataFrame:
    """The samples of a waveform up to time 0."""
    return waveform.filter(F.col("t") <= 0)


def trimmed(models: DataFrame, active: DataFrame, key: str = "cell_id") -> DataFrame:
    """Every model's rows in active cells; ``active`` has the key and a boolean column active."""
    return models.join(active.filter("active").select(key), key, "left_semi")
