"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (with partial sums on the map side) and a join,
so a hub vertex is never gathered in one task; each round is written to the
shared checkpoint folder, which keeps the plan short and outlives executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def _min_of_neighbours(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and all its v."""
    low = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return edges.join(low, "u")


def components(edges: DataFrame, max_rounds: int = 60, space: list[str] | None = None) -> DataFrame:
    """Columns a, b (linked ids) -> node, component (smallest id reachable).

    Only ids that occur in a link are returned; self links and nulls are ignored.
    The result is a written table (see materialize for ``space``).
    """
    with scratch(edges.sparkSession) as own:
        e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        e = materialize(e, "links", own)
        before = None
        for _ in range(max_rounds):
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _min_of_neighbours(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            star = _min_of_neighbours(down)
            small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            e = materialize(small, "links", own)
            now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
        stars = e.groupBy("u").agg(F.min("v").alias("v"))
        out = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct().toDF("node", "component"))
        return materialize(out, "components", space)
