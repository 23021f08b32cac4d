"""Scans and sinks: job forms, logs, tables, and what is written back of data, models and sensitivities."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalars import no_data, saved_uncertainty


def read_form(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON job form as a flat dict of what is enabled: a form's value, or its property where it is no value."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    return form_values(json.loads(text))


def form_values(form: dict[str, Any]) -> dict[str, Any]:
    out = {}
    for key, entry in form.items():
        if not isinstance(entry, dict) or "value" not in entry:
            out[key] = entry
        elif entry.get("enabled", True):
            out[key] = entry["value"] if entry.get("isValue", True) else entry.get("property")
        else:
            out[key] = None
    return out


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A blank-separated iteration log with a header line; columns are numbers."""
    return spark.read.option("sep", " ").option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).csv(path)


def read_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of stations by a given schema."""
    return spark.read.option("header", True).option("comment", "/").schema(schema).csv(path)


def long_channels(wide: DataFrame, id_col: str, columns: dict[str, float]) -> DataFrame:
    """(id, channel, value) of columns given with the channel (time or frequency) that they hold."""
    names = F.create_map(*[x for c, v in columns.items() for x in (F.lit(c), F.lit(float(v)))])
    return wide.unpivot(id_col, list(columns), "_c", "value").select(id_col, F.element_at(names, F.col("_c")).alias("channel"), "value")


def saved_data(observed: DataFrame, factor) -> DataFrame:
    """Wide (id, <component>, <component>_uncertainty) as written back: divided by the normalisation, infinite
    uncertainties as NaN.  ``factor`` is a Column of the component."""
    components = sorted(r[0] for r in observed.select("component").distinct().collect())
    rows = observed.select("id", "component", (F.col("value") / factor).alias("v"), saved_uncertainty(F.col("uncertainty"), factor).alias("u"))
    wide = rows.groupBy("id").pivot("component", components).agg(F.first("v").alias("v"), F.first("u").alias("u"))
    return wide.select("id", *[x for c in components for x in (F.col(f"{c}_v").alias(c), F.col(f"{c}_u").alias(f"{c}_uncertainty"))])


def saved_model(model: DataFrame, mesh: DataFrame, transforms: list | None = None) -> DataFrame:
    """(cell_id, value) on the whole mesh: transforms (Column to Column) in their order, NaN in inactive cells."""
    value = reduce(lambda v, f: f(v), transforms or [], F.col("value"))
    return mesh.select("cell_id", "active").join(model.select("cell_id", value.alias("value")), "cell_id", "left").select("cell_id", no_data(F.col("value"), F.col("active")).alias("value"))


def residual(observed: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, residual): observed less predicted."""
    p = predicted.select(*keys, F.col("value").alias("_p"))
    return observed.join(p, keys).select(*keys, (F.col("value") - F.col("_p")).alias("residual"))


def write_iterations(df: DataFrame, path: str) -> None:
    """A table partitioned by its iteration column, so that one iteration can be read or replaced alone."""
    df.write.mode("overwrite").partitionBy("iteration").parquet(path)


def line_files(lookup: DataFrame, column: str = "value") -> DataFrame:
    """(line_id, file, status) of a sweep's lookup JSON, an object of line ids with their status."""
    entries = F.explode(F.map_entries(F.from_json(column, "map<string,struct<line_id:int,status:string>>"))).alias("e")
    return lookup.select(entries).select(F.col("e.value.line_id").alias("line_id"), F.col("e.key").alias("file"), F.col("e.value.status").alias("status"))


def read_lines(spark: SparkSession, path: str, comment: str = "//") -> DataFrame:
    """(value) of a text file's lines, without blank ones and those that begin with the comment mark."""
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith(F.col("value"), F.lit(comment)))


def read_waveform(spark: SparkSession, path: str) -> DataFrame:
    """(t, current) of a text asset of two columns separated by blanks or commas."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    return read_lines(spark, path).select(F.get(parts, 0).cast("double").alias("t"), F.get(parts, 1).cast("double").alias("current"))


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """(t, width) of time channels, in the same form."""
    return read_waveform(spark, path).withColumnRenamed("current", "width")


def read_colors(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, r, g, b) of a colour table."""
    schema = "id int, name string, r int, g int, b int"
    row = F.from_csv("value", schema, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("_c")
    return read_lines(spark, path).select(row).select("_c.*").filter("id is not null")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, file, status) of a sweep's lookup file."""
    return line_files(spark.read.option("wholetext", True).text(path))
