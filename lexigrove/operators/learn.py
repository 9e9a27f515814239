"""K-Means, PCA and SVD on Spark's own learning library."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_vectors(points: DataFrame, vec_col: str = "embedding", out: str = "features") -> DataFrame:
    return points.withColumn(out, array_to_vector(F.col(vec_col).cast("array<double>")))


def kmeans(points: DataFrame, k: int = 5, restarts: int = 20, seed: int = 42, features: str = "features") -> DataFrame:
    """Adds cluster: the best of ``restarts`` seeds by training cost."""
    points = points.persist()
    best = None
    for r in range(restarts):
        model = KMeans(k=k, seed=seed + r, featuresCol=features, predictionCol="cluster").fit(points)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(points)


def pca(points: DataFrame, k: int, features: str = "features", out: str = "projected") -> tuple[DataFrame, float]:
    """Centred scores on the first k components, and the share of variance they explain."""
    model = PCA(k=k, inputCol=features, outputCol="_pca").fit(points)
    rows = model.transform(points).withColumn("_a", vector_to_array("_pca"))
    means = rows.agg(*(F.avg(F.get("_a", F.lit(i))).alias(f"_m{i}") for i in range(k)))
    centred = rows.join(F.broadcast(means)).withColumn(out, F.array(*(F.get("_a", F.lit(i)) - F.col(f"_m{i}") for i in range(k))))
    return centred.drop("_pca", "_a", *(f"_m{i}" for i in range(k))), float(sum(model.explainedVariance))


def project_2d(points: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, x, y: the first two principal components (stands in for a neighbour embedding)."""
    rows, _ = pca(to_vectors(points.where(F.col(vec_col).isNotNull()), vec_col), 2)
    return rows.select(id_col, F.get("projected", F.lit(0)).alias("x"), F.get("projected", F.lit(1)).alias("y"))


def sparse_vectors(weights: DataFrame, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Long-form weights -> one sparse vector for each id, columns in order of term.

    The vocabulary has at most max_features terms, so it fits a single sort.
    """
    from pyspark.sql import Window

    terms = vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("col"))
    width = terms.count()
    rows = weights.join(F.broadcast(terms), "term").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("col", "weight"))).alias("cells"))
    make = F.udf(lambda c: Vectors.sparse(width, [x["col"] for x in c], [x["weight"] for x in c]), VectorUDT())
    return rows.select(id_col, make("cells").alias("features"))


def truncated_svd(points: DataFrame, k: int, id_col: str = "doc_id", features: str = "features") -> tuple[DataFrame, list[float]]:
    """Scores on the top k right singular vectors, and the singular values."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    # The solver goes over all rows in each of its steps: they are converted once, within the JVM.
    rows = MLUtils.convertVectorColumnsFromML(points.select(features), features).persist()
    svd = RowMatrix(rows).computeSVD(k)
    rows.unpersist()
    v = svd.V.toArray()
    score = F.udf(lambda x: [float(y) for y in x.dot(v)] if hasattr(x, "dot") else None, "array<double>")
    return points.select(id_col, score(features).alias("projected")), list(svd.s.toArray())


def reduce_dimensions(points: DataFrame, k: int, n_cells_dense: int = 20_000_000, features: str = "features", id_col: str = "doc_id") -> DataFrame:
    """PCA while rows x columns fit a dense matrix of ``n_cells_dense`` cells, else SVD."""
    n = points.count()
    width = points.select(features).first()[0].size if n else 0
    k = min(k, max(n - 1, 0), width)
    if k < 2:
        return points
    if n * width <= n_cells_dense:
        return pca(points, k, features)[0]
    return truncated_svd(points, k, id_col, features)[0]
