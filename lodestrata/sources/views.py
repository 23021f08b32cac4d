"""Survey tables over generic Parquet tables, in Spark and as SQL for another engine.

The tables carry no geometry: positions come from vectors, meshes from ranges.  The mapping is for queries and tests.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = ["gx", "gy", "gz", "gxz", "gyz", "gzz"]


class Views:
    """The survey tables below one folder of Parquet tables, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def range(self, n: int, name: str = "id") -> DataFrame:
        return self.spark.range(n).withColumnRenamed("id", name)

    @cached_property
    def stations(self) -> DataFrame:
        e = lambda i: F.element_at("embedding", i).cast("double")
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("line_id"), (e(1) * 1000.0).alias("x"), (e(2) * 1000.0).alias("y"), (e(3) * 100.0).alias("z"))

    @cached_property
    def observed(self) -> DataFrame:
        """Long: id, component, value, uncertainty."""
        wide = self.table("embeddings").select(F.col("vec_id").alias("id"), *[F.element_at("embedding", 4 + i).cast("double").alias(c) for i, c in enumerate(COMPONENTS)])
        return wide.unpivot("id", COMPONENTS, "component", "value").withColumn("uncertainty", F.abs("value") * 0.02 + 0.001)

    @cached_property
    def gappy(self) -> DataFrame:
        """observed with NaN where id + 1 is a multiple of 7."""
        return self.observed.withColumn("value", F.when((F.col("id") + 1) % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))

    @cached_property
    def cells(self) -> DataFrame:
        """A block of 8 x 8 x 4 cells of 100 m from (-400, -400, -400)."""
        i, j, k = F.col("cell_id") % 8, F.floor(F.col("cell_id") / 8) % 8, F.floor(F.col("cell_id") / 64)
        at = lambda c: c.cast("double") * 100.0 - 350.0
        return self.range(256, "cell_id").select("cell_id", i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), F.lit(1).alias("ncells"), at(i).alias("xc"), at(j).alias("yc"), at(k).alias("zc"))

    @cached_property
    def model(self) -> DataFrame:
        """A property of each cell, its unit, and whether the cell is active."""
        return self.cells.select("cell_id", (F.col("cell_id") % 7 * 0.01).alias("value"), (F.col("cell_id") % 4).cast("int").alias("unit"), (F.col("cell_id") % 5 != 0).alias("active"))

    @cached_property
    def topo(self) -> DataFrame:
        """A Gaussian hill on a grid of 17 x 17 points 50 m apart."""
        x, y = F.col("id") % 17 * 50.0 - 400.0, F.floor(F.col("id") / 17) * 50.0 - 400.0
        return self.range(289).select("id", x.alias("x"), y.alias("y"), F.round(F.exp(-(x * x + y * y) / 80000.0) * 50.0, 6).alias("z"))

    @cached_property
    def electrodes(self) -> DataFrame:
        """Stations with their place along the line, by id."""
        from pyspark.sql import Window

        return self.stations.withColumn("pos", F.row_number().over(Window.partitionBy("line_id").orderBy("id")).cast("int"))

    @cached_property
    def loops(self) -> DataFrame:
        """Every electrode as a vertex of a loop: six after one another on a line make one."""
        loop = (F.col("line_id").cast("long") * 1000000 + F.floor((F.col("pos") - 1) / 6)).alias("tx_id")
        return self.electrodes.select(loop, ((F.col("pos") - 1) % 6 + 1).cast("int").alias("seq"), "id", "x", "y")

    @cached_property
    def dipoles(self) -> DataFrame:
        """M-N dipoles of neighbouring electrodes of a line; every fifth is a pole (M is N)."""
        a = self.electrodes
        b = a.select("line_id", (F.col("pos") - 1).alias("pos"), F.col("id").alias("next"))
        return a.join(b, ["line_id", "pos"]).select(F.col("id").alias("cell_id"), F.col("id").alias("m"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(F.col("next")).alias("n"), (F.col("id") % 9).alias("ab"), "line_id")

    @cached_property
    def edges(self) -> DataFrame:
        """A bipartite graph with cycles."""
        return self.table("lineitem").select(F.col("l_partkey").alias("v0"), (F.col("l_suppkey") + 1000000).alias("v1"))

    @cached_property
    def units(self) -> DataFrame:
        c = F.col("c_mktsegment")
        return self.table("customer").select(F.col("c_custkey").alias("cell_id"), c.alias("unit"), F.abs("c_acctbal").alias("volume"), F.col("c_acctbal").alias("property"))

    @cached_property
    def readings(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("line_id"), F.col("ts").alias("t"), "value", "event_type", "props")

    @cached_property
    def predicted(self) -> DataFrame:
        """What a model predicts: the observed values, a little off."""
        return self.observed.select("id", "component", (F.col("value") * 1.01 + 0.002).alias("value"))


SQL = {
    "stations": "SELECT vec_id AS id, label AS line_id, CAST(embedding[1] AS DOUBLE) * 1000.0e0 AS x, CAST(embedding[2] AS DOUBLE) * 1000.0e0 AS y, CAST(embedding[3] AS DOUBLE) * 100.0e0 AS z FROM embeddings",
    "observed": "SELECT id, component, value, abs(value) * 0.02e0 + 0.001e0 AS uncertainty FROM (SELECT vec_id AS id, c.component, CAST(embedding[c.k] AS DOUBLE) AS value FROM embeddings CROSS JOIN (VALUES ('gx', 4), ('gy', 5), ('gz', 6), ('gxz', 7), ('gyz', 8), ('gzz', 9)) c(component, k))",
    "gappy": "SELECT id, component, CASE WHEN (id + 1) % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value, uncertainty FROM observed",
    "cells": "SELECT cell_id, CAST(cell_id % 8 AS INTEGER) AS i, CAST((cell_id // 8) % 8 AS INTEGER) AS j, CAST(cell_id // 64 AS INTEGER) AS k, 1 AS ncells, (cell_id % 8) * 100.0e0 - 350.0e0 AS xc, ((cell_id // 8) % 8) * 100.0e0 - 350.0e0 AS yc, (cell_id // 64) * 100.0e0 - 350.0e0 AS zc FROM (SELECT range AS cell_id FROM range(256))",
    "model": "SELECT cell_id, (cell_id % 7) * 0.01e0 AS value, CAST(cell_id % 4 AS INTEGER) AS unit, cell_id % 5 <> 0 AS active FROM cells",
    "topo": "SELECT id, x, y, round(exp(-(x * x + y * y) / 80000.0e0) * 50.0e0, 6) AS z FROM (SELECT range AS id, (range % 17) * 50.0e0 - 400.0e0 AS x, (range // 17) * 50.0e0 - 400.0e0 AS y FROM range(289))",
    "electrodes": "SELECT *, CAST(row_number() OVER (PARTITION BY line_id ORDER BY id) AS INTEGER) AS pos FROM stations",
    "loops": "SELECT CAST(line_id AS BIGINT) * 1000000 + (pos - 1) // 6 AS tx_id, CAST((pos - 1) % 6 + 1 AS INTEGER) AS seq, id, x, y FROM electrodes",
    "dipoles": "SELECT a.id AS cell_id, a.id AS m, CASE WHEN a.id % 5 = 0 THEN a.id ELSE b.id END AS n, a.id % 9 AS ab, a.line_id FROM electrodes a JOIN electrodes b ON a.line_id = b.line_id AND b.pos = a.pos + 1",
    "edges": "SELECT l_partkey AS v0, l_suppkey + 1000000 AS v1 FROM lineitem",
    "units": "SELECT c_custkey AS cell_id, c_mktsegment AS unit, abs(c_acctbal) AS volume, c_acctbal AS property FROM customer",
    "readings": "SELECT event_id AS id, user_id AS line_id, ts AS t, value, event_type, props FROM events",
    "predicted": "SELECT id, component, value * 1.01e0 + 0.002e0 AS value FROM observed",
}


def with_views(sql: str) -> str:
    """The query with the views that it uses, and those they use, put before it."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(SQL[name])
    parts = [f"{name} AS ({SQL[name]})" for name in SQL if name in used]
    if not parts:
        return sql
    recursive = bool(re.match(r"\s*WITH RECURSIVE\b", sql))
    rest = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql, count=1) if re.match(r"\s*WITH\b", sql) else " " + sql
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)}{rest}"
