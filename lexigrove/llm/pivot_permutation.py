"""Embedding near-dedup by a pivot-permutation index.

Each vector is described by its ``prefix`` nearest reference points (pivots) in
order of nearness.  One inverted list for each pivot holds the vectors that have it
in their prefix, with the whole prefix and a code of one byte for each component.
Within a list the shared pivots of two vectors are counted (a pivot that is the
nearest of one and the last of the other's prefix doesn't count); pairs that share
``least`` or more are candidates, and the list of their smallest shared pivot
answers for them.  A candidate is verified by bounds on its cosine from the codes;
where these leave it open (about 0.01 around the threshold), by a join of the pair's
ids with the vectors, in double precision.  Links are handed on as counts and as one
edge for each vector, never as all pairs of a list.

A list of over ``chunk`` vectors is split by a second shared pivot, and what is
still longer into chunks that are compared chunk with chunk in tasks of their own.
Equal vectors are one class from the start, so copies are never paired.

The pivots are fitted on a bounded sample (``sample_rows``, or twice their number if
that is more); every vector is indexed.  Their number is 1.2 times the root of the
number of vectors, so that a list's length grows as the root; the prefix grows from
6 by two for each eightfold number of pivots beyond 256, which keeps the share of
pairs at cosine 0.905 that meet at 96 % or more (random vectors of 64 components).

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing; neither do vectors of different length, nor rows
with a null id.  Repeated rows are one vector; rows that share an id but not a
vector are one node with the links of each.  Equally near pivots go by number.  An
empty table gives no rows; other columns are never read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch
from .graph import components

#: Rows of two vectors' blocks that are compared at once, and cells of a block of distances to pivots.
TILE, CELLS = 1024, 1 << 22
#: Room for the roundings of single precision in the bounds.
ROUNDING = 1e-4


def fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` spread-out unit vectors of the sample: farthest-first from the first one."""
    x = unit(sample)
    n = min(n, len(x))
    chosen, near = [0], x @ x[0]
    for _ in range(n - 1):
        k = int(np.argmin(near))
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    return x[chosen]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, so that no square overflows."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in double precision."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def n_pivots_for(n: int) -> int:
    return max(32, round(1.2 * math.sqrt(n)))


def prefix_for(n_pivots: int) -> int:
    return 6 + max(0, round(2 / 3 * math.log2(max(n_pivots, 1) / 256)))


def permutation_prefix(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row of unit vectors, in order; equally near ones by number."""
    prefix = min(prefix, len(pivots))
    out = np.empty((len(x), prefix), np.int32)
    step = max(1, CELLS // len(pivots))
    for lo in range(0, len(x), step):
        far = -(x[lo : lo + step] @ pivots.T)
        near = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1)
        out[lo : lo + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)
    return out


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as bytes: codes, the scale of each row, and the length of what is left out."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j in ``root``, where every row points to a smaller one or itself."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


class Block:
    """Entries of one list: prefixes, codes, scales, errors, multiplicities."""

    def __init__(self, t: pa.Table):
        self.rep, self.m = t.column("rep").to_numpy(), t.column("m").to_numpy()
        self.pre = np.frombuffer(b"".join(t.column("pre").to_pylist()), np.int32).reshape(t.num_rows, -1)
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.int8).reshape(t.num_rows, -1)
        self.x = codes.astype(np.float32) * t.column("scale").to_numpy()[:, None].astype(np.float32)
        self.err = t.column("err").to_numpy()


def candidates(b: Block, rows: slice, cols: slice, threshold: float, least: int, answered: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of two tiles, counted from their starts, that this list answers for, and which of them are links for sure.

    ``answered``: the smallest shared pivot of the pairs, or the two smallest.
    """
    pi, pj = b.pre[rows], b.pre[cols]
    some = np.unique(np.concatenate([pi.ravel(), pj.ravel()]))

    def marked(p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), len(some)), np.float32)
        np.put_along_axis(out, np.searchsorted(some, p), 1, axis=1)
        return out

    shared = marked(pi) @ marked(pj).T
    if pi.shape[1] > least:  # the ends of the two orders don't count as shared
        shared -= pi[:, :1] == pj[:, -1]
        shared -= pi[:, -1:] == pj[:, 0]
    about = b.x[rows] @ b.x[cols].T
    open_ = b.err[rows][:, None] + (1 + b.err[rows][:, None]) * b.err[cols][None, :] + ROUNDING
    i, j = np.nonzero((shared > least - 0.5) & (about + open_ >= threshold))
    # The smallest pivots that both have, whatever their places.
    both = (pi[i][:, :, None] == pj[j][:, None, :]).any(axis=2)
    own = np.sort(np.where(both, pi[i], np.iinfo(np.int32).max), axis=1)[:, : len(answered)]
    here = (own == np.array(answered, np.int32)).all(axis=1)
    i, j = i[here], j[here]
    return i, j, about[i, j] - open_[i, j] >= threshold


def compare(b: Block, cell: tuple[int, ...], threshold: float, least: int, split: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """links and root of every entry, and the pairs left open.  ``split`` > 0: only between the first ``split`` rows and the rest."""
    n = len(b.rep)
    links, root, doubt = np.zeros(n, np.int64), np.arange(n), []
    for lo in range(0, split or n, TILE):
        rows = slice(lo, min(lo + TILE, split or n))
        for at in range(split or lo, n, TILE):
            i, j, sure = candidates(b, rows, slice(at, min(at + TILE, n)), threshold, least, cell)
            i, j = i + lo, j + at
            once = i < j
            i, j, sure = i[once], j[once], sure[once]
            doubt.append(np.stack([b.rep[i[~sure]], b.rep[j[~sure]]]))
            i, j = i[sure], j[sure]
            np.add.at(links, i, b.m[j])
            np.add.at(links, j, b.m[i])
            unite(root, i, j)
    return links, root, doubt


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of sorted input, a group at a time, across batch borders."""
    pending: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(i).to_numpy() for i in range(keys)])
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for a, z in zip(edges, edges[1:]):
            own = tuple(k[a].tolist())
            if own != key and pending:
                yield key, pa.Table.from_batches(pending)
                pending = []
            key = own
            pending.append(b.slice(a, z - a))
    if pending:
        yield key, pa.Table.from_batches(pending)


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype("f8")


def fit(classes: DataFrame, n_pivots: int | None, sample_rows: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector, from a sample by hash of each length's vectors."""
    sizes = {r["size"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).collect()}
    want = {d: n_pivots or n_pivots_for(n) for d, n in sizes.items()}
    room = {d: max(sample_rows, 2 * k) for d, k in want.items()}
    share = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, int(min(1.0, room[d] / n) * (1 << 20)) + 1))) if sizes else F.lit(None)
    size = F.size("embedding")
    sample: dict[int, list] = {}
    if sizes:
        for r in classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share[size]).select("rep", "embedding").toLocalIterator():
            sample.setdefault(len(r["embedding"]), []).append((r["rep"], r["embedding"]))
    # A length whose few vectors the hash left out has none to be near to: its first vector stands in.
    for d in sizes.keys() - sample.keys():
        r = classes.where(size == d).orderBy("rep").first()
        sample[d] = [(r["rep"], r["embedding"])]
    return {d: fit_pivots(np.array([v for _, v in sorted(rows)[: 2 * room[d]]], "f8"), want[d]) for d, rows in sample.items()}


ENTRY = "size int, p int, rep long, m long, pre binary, code binary, scale double, err double"


def _link(classes: DataFrame, threshold: float, least: int, prefix: int | None, n_pivots: int | None, chunk: int, sample_rows: int) -> DataFrame:
    """rep, m, embedding -> rows (a, b, links): link counts (b null), edges (links 0), pairs left open (links null)."""
    shared = classes.sparkSession.sparkContext.broadcast(fit(classes, n_pivots, sample_rows))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy()
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                x, pivots = unit(_flat(part.column(3), d)), shared.value[d]
                pre = permutation_prefix(x, pivots, prefix or prefix_for(len(pivots)))
                codes, scale, err = encode(x)
                at = pa.array(np.repeat(np.arange(len(x)), pre.shape[1]))
                own = [part.column(0), part.column(1), pa.array([r.tobytes() for r in pre], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(scale), pa.array(err)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pre.size, d, np.int32)), pa.array(pre.ravel()), *(c.take(at) for c in own)], names=[c.split()[0] for c in ENTRY.split(", ")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, p, q, lo, hi), t in _groups(batches, 5):
            if t.num_rows < 2:
                continue
            side = t.column("c").to_numpy()
            t, split = t.take(pa.array(np.argsort(side, kind="stable"))), int((side == lo).sum()) if lo != hi else 0
            if lo != hi and split in (0, t.num_rows):
                continue
            b = Block(t)
            own = min(least, b.pre.shape[1])
            links, root, doubt = compare(b, (p,) if q < 0 else (p, q), threshold, own, split)
            some, away = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
            doubt = np.concatenate([np.zeros((2, 0), np.int64), *doubt], axis=1)
            n, k, u = len(some), len(away), doubt.shape[1]
            if n + u:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([b.rep[some], b.rep[away], doubt[0]])), pa.array(np.concatenate([np.zeros(n, np.int64), b.rep[root[away]], doubt[1]]), mask=np.arange(n + k + u) < n), pa.array(np.concatenate([links[some], np.zeros(k + u, np.int64)]), mask=np.arange(n + k + u) >= n + k)],
                    names=["a", "b", "links"],
                )

    index = classes.select("rep", "m", F.size("embedding").alias("size"), "embedding").mapInArrow(describe, ENTRY)
    long = index.groupBy("size", "p").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("size", "p")
    hot = [(r["size"], r["p"]) for r in long.collect()]  # lists of over chunk vectors each: fewer than vectors / chunk * prefix
    if hot:
        found = classes.sparkSession.createDataFrame(hot, "size int, p int").withColumn("hot", F.lit(True))
        rows = index.join(F.broadcast(found), ["size", "p"], "left")
        second = second_pivots(rows)
        rows = second.select("size", "p", "q", *[c.split()[0] for c in ENTRY.split(", ")[2:]])
        parts = rows.groupBy("size", "p", "q").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("size", "p", "q", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
        rows = rows.join(F.broadcast(classes.sparkSession.createDataFrame(parts.collect(), parts.schema)), ["size", "p", "q"], "left")
        rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        rows = rows.withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
        rows = rows.withColumns({"lo": F.least("c", "j"), "hi": F.greatest("c", "j")})
    else:
        rows = index.withColumns({"q": F.lit(-1), "lo": F.lit(0), "hi": F.lit(0), "c": F.lit(0)})
    key = ["size", "p", "q", "lo", "hi"]
    rows = rows.select(*key, "c", *[c.split()[0] for c in ENTRY.split(", ")[2:]])
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "a long, b long, links long")


def second_pivots(rows: DataFrame) -> DataFrame:
    """Entries of hot lists once for each larger pivot q of their prefix; q is -1 for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, hot = b.column(1).to_numpy(), b.column(b.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False)
            at, q = [], []
            for i, pre in enumerate(b.column(4).to_pylist()):
                own = [x for x in np.frombuffer(pre, np.int32).tolist() if x > p[i]] if hot[i] and len(pre) > 4 else [-1]
                at += [i] * len(own)
                q += own
            t = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns[:-1], pa.array(q, pa.int32())], names=[*t.schema.names[:-1], "q"])

    names = [c.split()[0] for c in ENTRY.split(", ")]
    return rows.select(*names, "hot").mapInArrow(run, ENTRY + ", q int")


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) left open by the codes -> the links among them, as in _link, by the vectors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            size = t.column(4).to_numpy()
            for d in np.unique(size).tolist():
                part = t.filter(pa.array(size == d))
                hit = cosines(_flat(part.column(5), d), _flat(part.column(6), d)) >= threshold
                a, b, ma, mb = (part.column(k).to_numpy()[hit] for k in range(4))
                n = len(a)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b, a])), pa.array(np.concatenate([a, b, b]), mask=np.arange(3 * n) < 2 * n), pa.array(np.concatenate([mb, ma, np.zeros(n, np.int64)]))], names=["a", "b", "links"])

    one = classes.select(F.col("rep").alias("a"), F.col("m").alias("ma"), F.col("embedding").alias("va"))
    two = classes.select(F.col("rep").alias("b"), F.col("m").alias("mb"), F.col("embedding").alias("vb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ma", "mb", F.size("va").alias("size"), "va", "vb").mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, least: int = 2, prefix: int | None = None, n_pivots: int | None = None, chunk: int = 1 << 15, sample_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).dropDuplicates(["vec_id", "embedding"])
    if not isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    big = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != big))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    with scratch(vectors.sparkSession) as space:
        classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
        classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes", space)
        met = materialize(_link(classes, threshold, least, prefix, n_pivots, chunk, sample_rows), "vector-links", space)
        found = met.where("links is not null").union(materialize(verified(met.where("links is null").select("a", "b"), classes, threshold), "verified-links", space))
        links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        # A node of several vectors joins their classes.
        members = materialize(good.join(classes, "embedding").select("vec_id", "rep", "m"), "members", space)
        several = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("vec_id", "a")
        several = members.join(materialize(several, "shared-ids", space), "vec_id").where("a <> rep").select("a", F.col("rep").alias("b"))
        comp = components(found.where("b is not null").select("a", "b").union(several), space=space)
        # The smallest id of a component: a minimum, with partial results.
        named = classes.select("rep", "first").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        named = materialize(named, "named", space)
        smallest = materialize(named.groupBy("component").agg(F.min("first").alias("smallest")), "smallest", space)
        named = materialize(named.join(smallest, "component").select("rep", "smallest"), "named-classes", space)
        out = members.join(links, "rep", "left").join(named, "rep")
        out = out.groupBy("vec_id").agg(F.sum(F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.min("smallest").alias("component_id"))
        alone = rows.where(~usable).select("vec_id").distinct().join(out.select(F.col("vec_id").alias("v")), F.col("vec_id") == F.col("v"), "left_anti")
        out = out.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
        return materialize(out.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept")), "vector-duplicates")


#: Exact links; the index finds those that meet (all of them on the test tables).
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
), link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id) AS n_links, r.c AS component_id, v.vec_id = r.c AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = v.vec_id
"""
