"""Cluster assignment, evaluation and noise handling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v

NOISE = -1


def centroids(points: DataFrame, group: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """cluster, centroid: the mean vector, L2-normalised; noise has none."""
    cells = points.where(F.col(group) != NOISE).select(group, F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "x"))
    mean = cells.groupBy(group, "pos").agg(F.avg("x").alias("x"))
    arr = mean.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return arr.select(F.col(group).alias("cluster"), v.l2_normalize(F.col("c.x")).alias("centroid"))


def best_centroid(points: DataFrame, cents: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Adds best (similarity to 12 places) and best_cluster; ties go to the smallest cluster.

    The centroids travel as one row: clusters x dimensions, whatever the number of points.
    """
    table = cents.agg(F.collect_list(F.struct("cluster", "centroid")).alias("_cents"))
    sims = F.transform("_cents", lambda c: F.struct(F.round(v.dot(F.col(vec_col), c["centroid"]), 12).alias("s"), (-c["cluster"]).alias("o")))
    out = points.join(F.broadcast(table)).withColumn("_m", F.array_max(sims))
    return out.withColumn("best", F.col("_m.s")).withColumn("best_cluster", -F.col("_m.o")).drop("_cents", "_m")


def assign(points: DataFrame, group: str = "label", least: float | None = None, vec_col: str = "embedding") -> DataFrame:
    """Nearest centroid of the given groups; noise under the ``least`` similarity."""
    out = best_centroid(points, centroids(points, group, vec_col), vec_col)
    c = F.col("best_cluster") if least is None else F.when(F.col("best") < least, F.lit(NOISE)).otherwise(F.col("best_cluster"))
    return out.withColumn("cluster", c).drop("best_cluster")


def assign_noise(points: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Noise goes to the nearest cluster centroid; without clusters nothing changes."""
    out = best_centroid(points.withColumnRenamed("cluster", "raw_cluster"), centroids(points, "cluster", vec_col), vec_col)
    final = F.when((F.col("raw_cluster") == NOISE) & F.col("best_cluster").isNotNull(), F.col("best_cluster")).otherwise(F.col("raw_cluster"))
    out = out.withColumn("cluster", final).withColumn("was_noise", (F.col("raw_cluster") == NOISE) & (F.col("cluster") != NOISE))
    return out.drop("best", "best_cluster")


def contingency(points: DataFrame, true: str = "label", pred: str = "cluster") -> DataFrame:
    return points.groupBy(true, pred).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def _marginals(points: DataFrame, true: str, pred: str) -> tuple[DataFrame, ...]:
    table = contingency(points, true, pred)
    rows = table.groupBy(true).agg(F.sum("n").alias("n"))
    cols = table.groupBy(pred).agg(F.sum("n").alias("n"))
    return table, rows, cols


def ari(points: DataFrame, true: str = "label", pred: str = "cluster") -> DataFrame:
    """Adjusted Rand index; 1 when degenerate."""
    table, rows, cols = _marginals(points, true, pred)
    one = table.agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    a = rows.agg(F.sum(_pairs(F.col("n"))).alias("a"))
    b = cols.agg(F.sum(_pairs(F.col("n"))).alias("b"))
    j = one.join(F.broadcast(a)).join(F.broadcast(b))
    e = F.col("a") * F.col("b") / _pairs(F.col("n"))
    top, low = F.col("s") - e, (F.col("a") + F.col("b")) / 2 - e
    return j.select(F.when(F.coalesce(low, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(top / low).alias("ari"))


def information(points: DataFrame, true: str = "label", pred: str = "cluster") -> DataFrame:
    """mi, h_true, h_pred in natural units."""
    table, rows, cols = _marginals(points, true, pred)
    n = table.agg(F.sum("n").cast("double").alias("total"))
    j = table.join(F.broadcast(rows.withColumnRenamed("n", "a")), true).join(F.broadcast(cols.withColumnRenamed("n", "b")), pred).join(F.broadcast(n))
    mi = j.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))
    entropy = lambda t, name: t.join(F.broadcast(n)).agg((-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))).alias(name))
    return mi.join(F.broadcast(entropy(rows, "h_true"))).join(F.broadcast(entropy(cols, "h_pred")))


def nmi(points: DataFrame, true: str = "label", pred: str = "cluster") -> DataFrame:
    i = information(points, true, pred)
    mean = (F.col("h_true") + F.col("h_pred")) / 2
    return i.select(F.when(mean == 0, F.lit(1.0)).otherwise(F.col("mi") / mean).alias("nmi"))


def homogeneity(points: DataFrame, true: str = "label", pred: str = "cluster") -> DataFrame:
    return information(points, true, pred).select(F.when(F.col("h_true") == 0, F.lit(1.0)).otherwise(F.col("mi") / F.col("h_true")).alias("homogeneity"))


def purity(points: DataFrame, true: str = "label", pred: str = "cluster", without_noise: bool = False) -> DataFrame:
    rows = points.where(F.col(pred) != NOISE) if without_noise else points
    best = contingency(rows, true, pred).groupBy(pred).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.agg(F.coalesce(F.sum("m") / F.greatest(F.sum("n"), F.lit(1)), F.lit(0.0)).alias("purity"))


def counts(points: DataFrame, pred: str = "cluster") -> DataFrame:
    c = F.col(pred)
    return points.agg(F.count("*").alias("n_points"), F.countDistinct(F.when(c != NOISE, c)).alias("n_clusters"), F.count_if(c == NOISE).alias("n_noise"))


#: Points whose tree one task spans by itself, from a full matrix of distances.
LOCAL_POINTS = 2000


def hdbscan(points: DataFrame, min_cluster_size: int = 4, min_samples: int = 1, method: str = "leaf", max_points: int = 200_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster: density clusters.

    Core distances, mutual reachability, minimum spanning tree, condensed tree and leaf
    or excess-of-mass selection follow Campello, Moulavi and Sander (2013).  Beyond
    ``LOCAL_POINTS`` the spanning tree is found by Boruvka's rounds, each an exact search
    by blocks (see knn); its edges, one fewer than points, come to the driver, which
    builds the condensed tree: some 1 KB a point, hence ``max_points`` (else an error).
    """
    if method not in ("leaf", "eom"):
        raise ValueError(f"unknown method {method!r}")
    rows = points.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    n = rows.count()
    if n > max_points:
        raise ValueError(f"{n} points; at most {max_points} can be clustered")
    if n > LOCAL_POINTS:
        ids = np.sort(rows.select("id").toArrow().column(0).to_numpy())
        edges = spanning_tree(rows, ids, min_samples)
        found = pa.table({"id": ids, "cluster": pa.array(tree_clusters(len(ids), edges, min_cluster_size, method), pa.int32())})
        return points.sparkSession.createDataFrame(found, "id long, cluster int").withColumnRenamed("id", id_col)

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = np.array(t.column("vec").to_pylist(), "f8")
        return pa.table({"id": t.column("id"), "cluster": pa.array(density_clusters(x, min_cluster_size, min_samples, method), pa.int32())})

    return rows.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(fit, "id long, cluster int").withColumnRenamed("id", id_col)


def spanning_tree(rows: DataFrame, ids: np.ndarray, min_samples: int) -> list[tuple[float, int, int]]:
    """Edges (mutual reachability, place, place) of the minimum spanning tree over (id, vec); places are those in ``ids``.

    In each round every component takes its nearest edge to another one; edges of equal
    length go by their places, so that no round closes a circle.
    """
    from . import knn

    spark = rows.sparkSession
    core = knn.core_distance(rows, min_samples, False, "id", "vec").withColumnRenamed("core", "c").persist()
    whole = rows.join(core, "id", "left").select("id", F.concat("vec", F.array(F.coalesce("c", F.lit(0.0)))).alias("vec")).persist()
    component = np.arange(len(ids))

    rows = knn.once(lambda m: (knn.Rows(m[:, :-1]), m[None, :, -1] ** 2))

    def step(q, x, others, tags, m):
        # The last component of a vector is its core distance; tags are components of the tree, in order.
        own = shared.value
        mine = own[np.searchsorted(shared_ids.value, q)]
        # Squared distances by one product; the core distance of the row's own point is put in at the end.
        near, cores = rows(m)
        d = near.product(x[:, :-1])
        d += (x[:, :-1] ** 2).sum(1)[:, None]
        np.maximum(d, cores, out=d)
        for r, (lo, hi) in enumerate(zip(np.searchsorted(tags, mine).tolist(), np.searchsorted(tags, mine, "right").tolist())):
            d[r, lo:hi] = np.inf
        least = np.maximum(d.min(axis=1), x[:, -1] ** 2)
        ok = np.isfinite(least)
        if not ok.any():
            return None
        # Of equally near ones the first edge in order of its ends.
        i, j = np.divmod(np.flatnonzero(d <= np.where(ok, least, -np.inf)[:, None]), d.shape[1])
        low, high = np.minimum(q[i], others[j]), np.maximum(q[i], others[j])
        order = np.lexsort((high, low, i))
        i, low, high = i[order], low[order], high[order]
        one = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        # One edge for each component of these queries.
        w, first, high, comp = np.sqrt(least[i[one]]), low[one], high[one], mine[i[one]]
        order = np.lexsort((high, first, w, comp))
        order = order[np.r_[True, comp[order][1:] != comp[order][:-1]]]
        return pa.RecordBatch.from_arrays([pa.array(z[order]) for z in (comp, w, first, high)], names=["own", "w", "a", "b"])

    edges: list[tuple[float, int, int]] = []
    shared_ids = spark.sparkContext.broadcast(ids)
    while len(edges) < len(ids) - 1:
        shared = spark.sparkContext.broadcast(component)
        names = spark.createDataFrame(pa.table({"id": ids, "tag": component}), "id long, tag long")
        tagged = whole.join(names, "id")
        near = knn.block_pairs(whole, tagged, step, "own long, w double, a long, b long", "id", "vec", "tag")
        best = near.groupBy("own").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct().toArrow()
        taken = sorted(zip(best.column("w").to_pylist(), np.searchsorted(ids, best.column("a").to_numpy()).tolist(), np.searchsorted(ids, best.column("b").to_numpy()).tolist()))
        parent = {int(c): int(c) for c in np.unique(component)}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        before = len(edges)
        for w, a, b in taken:
            x, y = find(int(component[a])), find(int(component[b]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((w, a, b))
        shared.unpersist()
        if len(edges) == before:
            raise RuntimeError("the spanning tree did not grow: vectors with null or non-finite components")
        component = np.array([find(c) for c in component.tolist()])
    core.unpersist()
    whole.unpersist()
    return edges


def density_clusters(x: np.ndarray, min_cluster_size: int, min_samples: int, method: str) -> list[int]:
    n = len(x)
    if n < 2:
        return [NOISE] * n
    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # Prim's tree over the mutual reachability.
    inside, near, frm, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    now = 0
    for _ in range(n - 1):
        inside[now] = True
        closer = ~inside & (reach[now] < near)
        near[closer], frm[closer] = reach[now][closer], now
        now = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((near[now], frm[now], now))
    return tree_clusters(n, edges, min_cluster_size, method)


def tree_clusters(n: int, edges: list[tuple[float, int, int]], min_cluster_size: int, method: str) -> list[int]:
    """The cluster of each of n points, by the condensed tree of a spanning tree's edges."""
    if n < 2:
        return [NOISE] * n
    # Single-linkage tree: node n + i merges two nodes at a height.
    parent, left, right, height, size = list(range(n)), {}, {}, {}, {i: 1 for i in range(n)}
    top = {i: i for i in range(n)}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, (w, a, b) in enumerate(sorted(edges)):
        a, b = find(a), find(b)
        node = n + i
        left[node], right[node], height[node], size[node] = top[a], top[b], w, size[top[a]] + size[top[b]]
        parent[b] = a
        top[a] = node
    # Condensed tree: a split counts if both sides are large enough.
    births, children, stability, member = {0: 0.0}, {0: []}, {0: 0.0}, np.zeros(n, int)
    todo, fresh = [(n + len(edges) - 1, 0)], 1
    while todo:
        node, c = todo.pop()
        if node < n:
            member[node] = c
            continue
        lam = 1 / height[node] if height[node] > 0 else np.finfo(float).max
        sides = [left[node], right[node]]
        big = [s for s in sides if size[s] >= min_cluster_size]
        if len(big) == 2:
            for s in sides:
                births[fresh], children[fresh], stability[fresh] = lam, [], 0.0
                children[c].append(fresh)
                stability[c] += (lam - births[c]) * size[s]
                todo.append((s, fresh))
                fresh += 1
            continue
        for s in sides:
            if s in big:
                todo.append((s, c))
            else:
                stability[c] += (lam - births[c]) * size[s]
                stack = [s]
                while stack:
                    k = stack.pop()
                    if k < n:
                        member[k] = c
                    else:
                        stack += [left[k], right[k]]
    if method == "leaf":
        chosen = {c for c in children if not children[c] and c}
    else:
        chosen, best = set(), {}
        for c in sorted(children, reverse=True):
            below = sum(best[k] for k in children[c])
            if c and (not children[c] or stability[c] >= below):
                best[c] = stability[c]
                under = list(children[c])
                while under:
                    k = under.pop()
                    chosen.discard(k)
                    under += children[k]
                chosen.add(c)
            else:
                best[c] = below
    up = {k: c for c in children for k in children[c]}
    number = {c: i for i, c in enumerate(sorted(chosen))}
    out = []
    for m in member:
        c = int(m)
        while c not in chosen and c in up:
            c = up[c]
        out.append(number.get(c, NOISE))
    return out


def assignment_rows(points: DataFrame, places: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Points (see assign_noise, and further columns) with their place in the plane (id, x, y) and their colour."""
    return points.join(places.select(id_col, "x", "y"), id_col, "left").withColumn("color", v.cluster_color(F.col("cluster")))
