"""A page with the clusters drawn in the plane, for a bounded number of points."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v

# Size of the plot and its margin.
WIDTH, HEIGHT, PAD = 1100, 760, 70


def plot_rows(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """id columns with px, py, color and a short title; extents are one broadcast row."""
    e = points.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    j = points.join(F.broadcast(e))
    out = j.withColumn("px", v.scale(F.col(x), F.col("_x0"), F.col("_x1"), WIDTH, PAD)).withColumn("py", v.scale(F.col(y), F.col("_y0"), F.col("_y1"), HEIGHT, PAD, True))
    return out.withColumn("color", v.cluster_color(F.col("cluster"))).withColumn("title", t.truncate_title(F.col("title"))).drop("_x0", "_x1", "_y0", "_y1")


def metric(value: float | int | None) -> str:
    return "N/A" if value is None else str(value) if isinstance(value, int) else f"{value:.4f}"


def page(points: DataFrame, metrics: dict, max_points: int = 20_000) -> str:
    """An SVG page; more than ``max_points`` points are an error, not a sample."""
    rows = plot_rows(points).select("px", "py", "color", "title", "cluster").limit(max_points + 1).collect()
    if len(rows) > max_points:
        raise ValueError(f"more than {max_points} points")
    dots = "\n".join(f'<circle cx="{r.px:.1f}" cy="{r.py:.1f}" r="4" fill="{r.color}"><title>{html.escape(r.title or "")} (cluster {r.cluster})</title></circle>' for r in rows)
    table = "".join(f"<tr><th>{html.escape(k)}</th><td>{metric(x)}</td></tr>" for k, x in metrics.items())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Clusters</title></head><body><table>{table}</table><svg viewBox="0 0 {WIDTH} {HEIGHT}">{dots}</svg></body></html>'
