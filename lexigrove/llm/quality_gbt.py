"""Quality rules: gradient-boosted trees over document statistics.

The statistics of every whole text are computed once, in one scan.  A boosted
ensemble is fitted on labelled rows (at most about ``max_train_rows`` of them, a
bound on the driver's memory), flattened into numpy node arrays, and scored for
whole batches at a time.  Chosen features are held monotonic: more symbols,
more repeated lines or more repeated words never raise a document's score.

Defined results: a null or empty text has all counts 0 and fails the base rule; texts
of any length are counted whole; repeated rows and rows with a null id are scored
alike, each on its own; rows with a null id are not trained on, several labels of one
id are averaged, and of equal splits the first feature and threshold is taken; without
labels of both kinds the model keeps all that the base rule keeps; an empty table
gives no rows; other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, map_arrow, materialize, slices

FEATURES = ("log_words", "mean_word_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "punct_rate", "pipe_rate", "line_words", "distinct_rate", "long_word_rate")
#: Sign of the allowed change of P(good) as the feature rises.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1}

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOLS = list(b"#*$%&|<>")
_PUNCT = list(b"!?;:,.-_=+~^/\\")


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside an n-word window that occurs twice or more in the text."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    code = ids[:m].copy()
    for k in range(1, n):
        # Re-numbering after each step keeps the codes exact and small.
        code = np.unique(code * len(index) + ids[k : k + m], return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    marked = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(marked, at, 1)
    np.add.at(marked, at + n, -1)
    return int((np.cumsum(marked[:-1]) > 0).sum())


def statistics(text: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, *FEATURES)."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, sum(text.count(bytes([c])) for c in _SYMBOLS), 0, 0, *[0.0] * len(FEATURES))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(count[:0x80].sum() + count[0xC0:].sum() - count[_WHITE].sum())
    symbols = int(count[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    return (
        n, chars, symbols, dup, rep,
        float(np.log1p(n)), chars / n, symbols / chars, dup / len(lines), rep / n,
        float(count[65:91].sum() / letters), float(count[48:58].sum() / chars), float(count[_PUNCT].sum() / chars), float(count[0x7C] / n),
        n / len(lines), len(set(words)) / n, sum(len(w) > 20 for w in words) / n,
    )


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(docs: DataFrame) -> DataFrame:
    def step(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        rows = [statistics(t) for t in texts]
        cols = list(zip(*rows))
        arrays = [part.column(0)] + [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.float64()) for c in cols[5:]]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_BASE, *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES)
    return map_arrow(ids_and_text(docs), step, schema)


@dataclass
class Forest:
    """All trees in flat node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """P(good) for each row of x."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 3.0) -> Forest:
    """Second-order boosting on the logistic loss with histogram splits.

    A split on a monotonic feature is allowed only if its leaves keep the order,
    and its children inherit bounds at the midpoint, so the order holds below too.
    """
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    both = len(y) and 0 < y.sum() < len(y)
    base = float(np.log(y.sum() / (len(y) - y.sum()))) if both else 10.0
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if both else []
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if both else None
    score = np.full(len(y), base)

    def node(f: int = 0, t: float = np.inf, v: float = 0.0) -> int:
        k = len(feature)
        feature.append(f), threshold.append(t), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(trees if both else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def leaf(gs: float, hs: float, lo: float, hi: float) -> float:
            return float(np.clip(gs / (hs + l2), lo, hi))

        def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts if level < depth else ()):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                vl, vr = np.clip(gl / (hl + l2), lo, hi), np.clip((gs - gl) / (hs - hl + l2), lo, hi)
                gain = gl * vl - 0.5 * (hl + l2) * vl**2 + (gs - gl) * vr - 0.5 * (hs - hl + l2) * vr**2
                v = leaf(gs, hs, lo, hi)
                gain -= gs * v - 0.5 * (hs + l2) * v**2
                ok = (hl > least) & (hs - hl > least) & (sign[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] < 0:
                v = leaf(gs, hs, lo, hi) * rate
                score[rows] += v
                return node(v=v)
            _, j, k = best
            go = binned[rows, j] <= k
            me = node(j, float(cuts[j][k]))
            vl, vr = leaf(g[rows[go]].sum(), h[rows[go]].sum(), lo, hi), leaf(g[rows[~go]].sum(), h[rows[~go]].sum(), lo, hi)
            mid = (vl + vr) / 2
            a, b = ((lo, mid), (mid, hi)) if sign[j] > 0 else ((mid, hi), (lo, mid)) if sign[j] < 0 else ((lo, hi), (lo, hi))
            left[me] = grow(rows[go], level + 1, *a)
            right[me] = grow(rows[~go], level + 1, *b)
            return me

        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), depth, base)


def quality_rules(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, keep_at: float = 0.5, trees: int = 40, depth: int = 3) -> DataFrame:
    """Base statistics, base rule and the ensemble's verdict for every row of ``docs``.

    ``max_train_rows`` bounds the labelled rows that the driver fits on; beyond
    it, rows are taken by a hash of doc_id with equal chance.
    """
    stats = materialize(document_statistics(docs), "quality")
    truth = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    have = max(1, truth.count())
    share = int(min(1.0, max_train_rows / have) * (1 << 20))
    picked = truth.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    train = stats.join(picked, "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), *[F.min(f).alias(f) for f in FEATURES])
    rows = train.select("quality", *FEATURES).limit(2 * max_train_rows).toPandas().sort_values(list(("quality", *FEATURES))).to_numpy(dtype="f8")
    x, y = (rows[:, 1:], (rows[:, 0] > 0.5).astype("f8")) if len(rows) else (np.zeros((0, len(FEATURES))), np.zeros(0))
    forest = fit(x, y, trees, depth)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rep = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("n_words", "n_repeat_words"))
            m = np.column_stack([b.column(b.schema.get_field_index(f)).to_numpy() for f in FEATURES])
            p = forest.predict(m)
            failed = (n < 50) | (100 * rep > 50 * n)
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", *_BASE)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p)], names=["doc_id", *_BASE, "base_failed", "kept", "quality_score"])

    return stats.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", base_failed boolean, kept boolean, quality_score double")
