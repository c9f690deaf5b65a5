"""Degrees over a stream of edges: a running aggregate, and one over time windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ends(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id"), *more)


def running_degrees(edges: DataFrame) -> DataFrame:
    """id, degree over all edges seen so far; use output mode 'update' or 'complete'."""
    return _ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def windowed_degrees(edges: DataFrame, time: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """start, end, id, degree for tumbling (or sliding) windows of event time; edges later than ``late`` are left out."""
    known = _ends(edges.withWatermark(time, late), time)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return known.groupBy(window.alias("w"), "id").agg(F.count("*").alias("degree")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "id", "degree")


def edges_to_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A stream's edges both of whose ends are among a table's nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
