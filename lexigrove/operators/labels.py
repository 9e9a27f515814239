"""Cluster members, summaries, labels and the dashboard's rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from . import vectorize
from .cluster import NOISE


def members(points: DataFrame, texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(cluster, id, text) of the points with a text, without noise."""
    rows = points.where(F.col("cluster") != NOISE).join(texts, id_col)
    return rows.where(t.strip(F.col("text")) != "").select("cluster", id_col, "text")


def summary(points: DataFrame, id_col: str = "doc_id", domain: str = "domain", first: int = 5) -> DataFrame:
    """cluster, num_docs, dominant_domain, domain_breakdown, sample_docs.

    Equal counts go to the domain met first by id; the sample is the first ids.
    """
    rows = points.where(F.col("cluster") != NOISE)
    by = rows.groupBy("cluster", domain).agg(F.count("*").alias("n"), F.min(id_col).alias("first"))
    top = by.groupBy("cluster").agg(
        F.sum("n").alias("num_docs"),
        F.max(F.struct("n", (-F.col("first")).alias("o"), F.col(domain).alias("d"))).alias("_top"),
        F.array_sort(F.collect_list(F.struct(F.col(domain).alias("domain"), "n"))).alias("domain_breakdown"),
    )
    w = Window.partitionBy("cluster").orderBy(id_col)
    sample = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first).groupBy("cluster").agg(F.array_sort(F.collect_list(id_col)).alias("sample_docs"))
    return top.join(sample, "cluster").select("cluster", "num_docs", F.col("_top.d").alias("dominant_domain"), "domain_breakdown", "sample_docs")


def tfidf_terms(rows: DataFrame, top_n: int = 10, max_features: int = 5000, limit: int = t.LABEL_TEXT_LIMIT, id_col: str = "doc_id") -> DataFrame:
    """(cluster, rank, term, weight): the strongest terms of each cluster's joined text.

    The joined text is cut at ``limit`` characters.  Each member fills one at least, so
    the first ``limit`` ids of a cluster (found with partial limits before the shuffle)
    hold all that it can reach, and a running length finds those.
    """
    order = Window.partitionBy("cluster").orderBy(id_col)
    w = order.rowsBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
    near = first.withColumn("_at", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))).where(F.col("_at") < limit)
    joined = near.groupBy("cluster").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), "text"))), lambda x: x["text"]), " "), 1, limit).alias("text"))
    counts = vectorize.term_counts(joined, id_col="cluster")
    n = joined.count()
    weights = vectorize.tfidf(counts, vectorize.vocabulary(counts, n, max_features=max_features), n, "cluster").withColumn("weight", F.round("weight", 12))
    r = Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return weights.where(F.col("weight") > 0).withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= top_n).select("cluster", "rank", "term", "weight")


def label(terms: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, label: the first three terms joined and capitalised, else 'Cluster k'."""
    first = terms.where(F.col("rank") <= 3).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " · ").alias("_l"))
    return clusters.select("cluster").distinct().join(first, "cluster", "left").select("cluster", F.coalesce(F.initcap("_l"), F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("label"))


def merge_summary(labels: DataFrame, summaries: DataFrame) -> DataFrame:
    """Labels with their summary; on shared names the summary wins."""
    shared = [c for c in summaries.columns if c in labels.columns and c != "cluster"]
    s = summaries.withColumnsRenamed({c: f"_s_{c}" for c in shared})
    j = labels.join(s, "cluster", "left")
    for c in shared:
        j = j.withColumn(c, F.coalesce(f"_s_{c}", c)).drop(f"_s_{c}")
    return j


def dashboard_clusters(labels: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each label; clusters without points are grey."""
    have = points.groupBy("cluster").agg(F.count("*").alias("points"))
    j = labels.join(have, "cluster", "left")
    color = F.when(F.col("points").isNull(), F.lit(v.NO_POINTS_COLOR)).otherwise(v.cluster_color(F.col("cluster")))
    return j.select("cluster", "label", F.coalesce("num_docs", "points", F.lit(0)).alias("num_docs"), F.coalesce("dominant_domain", F.lit("unknown")).alias("dominant_domain"), color.alias("color"))


def dashboard_rows(labels: DataFrame, terms: DataFrame, points: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One whole row for each label: keywords, terms, members, domains, a sample and a colour.

    ``labels``: cluster, label, and keywords (array) where there are any; ``terms``: see
    tfidf_terms.  Without points the counts are 0, the lists empty and the colour grey.
    """
    by = terms.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("tfidf_terms"))
    keywords = F.col("keywords") if "keywords" in labels.columns else F.array().cast("array<string>")
    j = labels.select("cluster", "label", keywords.alias("keywords")).join(by, "cluster", "left").join(summary(points, id_col), "cluster", "left")
    color = F.when(F.col("num_docs").isNull(), F.lit(v.NO_POINTS_COLOR)).otherwise(v.cluster_color(F.col("cluster")))
    empty = F.array().cast("array<string>")
    return j.select(
        "cluster", "label", F.coalesce("keywords", empty).alias("keywords"), F.coalesce("tfidf_terms", empty).alias("tfidf_terms"), F.coalesce("num_docs", F.lit(0)).alias("num_docs"),
        F.coalesce("dominant_domain", F.lit("unknown")).alias("dominant_domain"), "domain_breakdown", "sample_docs", color.alias("color"),
    )


# The files of assignments by method.
ASSIGNMENT_FILES = {
    "baseline": "baseline_cluster_assignments.json",
    "sota": "sota_cluster_assignments.json",
    "umap_hdbscan": "umap_hdbscan_assignments.json",
}


def assignments_path(folder: str, method: str, chosen: str = "") -> str:
    """Where a method's assignments are: the file that is named, else the method's own in ``folder``."""
    return chosen or f"{folder.rstrip('/')}/{ASSIGNMENT_FILES.get(method, method + '_cluster_assignments.json')}"
