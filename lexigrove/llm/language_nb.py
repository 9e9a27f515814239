"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts come from every labelled training row; the matrix of log probabilities
(languages x buckets, a fixed size for each language) is broadcast, and batches
are scored as sparse rows in numpy.

Defined results: a null, empty or letterless text, or a corpus without
training rows, gives ``und`` with score 0 (a letter is a character of Unicode
category L); equal posteriors go to the first language in order of name; repeated
rows and rows with a null id are scored alike; texts of any length are read whole, a
piece at a time; other columns are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, small_batches, sum_blocks

ORDERS = (1, 2, 3)
BITS = 15
#: Cells of the matrix that are gathered at once, and bytes of it at most.
CELLS, MATRIX_BYTES = 1 << 21, 1 << 30
#: Bytes of text whose n-grams are gathered at once.
SLICE = 1 << 19
_WORD_LIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L occurs; \\w also takes numbers such as Ⅷ and ½."""
    return any(m[0].isalpha() for m in _WORD_LIKE.finditer(text))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, one after another, and where each text's begin."""
    grams, starts, at = [], [], 0
    for t in texts:
        # Texts are padded with blanks so that word edges count at both ends too.
        c = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        starts.append(at)
        h = np.zeros(len(c), np.uint32)
        for k in range(max(ORDERS)):
            m = len(c) - k
            if m <= 0:
                break
            h = (h[:m] ^ c[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                grams.append((h >> np.uint32(32 - BITS)).astype(np.int32))
                at += m
    return np.concatenate(grams), np.array(starts, np.int64)


def count_ngrams(rows: DataFrame, dtype: str = "float64") -> DataFrame:
    """Columns lang, text (binary) -> summed count vectors: key = lang, block 0, data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}
        for b in batches:
            for part, texts in slices(b, limit=SLICE):
                by: dict[str, list] = {}
                for lang, t in zip(part.column(0).to_pylist(), texts):
                    by.setdefault(lang, []).append((t or b"").decode("utf-8", "replace"))
                for lang, own in by.items():
                    found = np.bincount(features(own)[0], minlength=1 << BITS)
                    acc[lang] = acc.get(lang, 0) + found
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(acc, pa.string()), pa.array([0] * len(acc), pa.int32()), pa.array([v.astype(dtype).tobytes() for v in acc.values()], pa.binary())], names=["key", "block", "data"])

    return sum_blocks(rows.mapInArrow(count, "key string, block int, data binary"), dtype)


def log_probabilities(counts: np.ndarray, alpha: float = 0.5) -> tuple[np.ndarray, float]:
    """Smoothed log probabilities of one language's n-grams, and their mean under it (its entropy, negative)."""
    p = (counts + alpha) / (counts.sum() + alpha * len(counts))
    return np.log(p).astype(np.float32), float((p * np.log(p)).sum())


class Model:
    def __init__(self, langs: list[str], log_p: np.ndarray, usual: np.ndarray):
        """``log_p``: languages x buckets; ``usual``: mean log probability of each language's own n-grams."""
        self.langs, self.usual = langs, usual
        self.log_p = np.ascontiguousarray(log_p.T, np.float32)

    def log_likelihood(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages, and the number of n-grams of each text."""
        grams, starts = features(texts)
        step = max(256, CELLS // len(self.langs))
        log = np.zeros((len(texts), len(self.langs)))
        ends = np.append(starts[1:], len(grams))
        for i, (a, b) in enumerate(zip(starts, ends)):
            for k in range(a, b, step):
                log[i] += self.log_p[grams[k : min(b, k + step)]].sum(axis=0, dtype=np.float64)
        return log, ends - starts

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, its posterior, and how far the mean log probability of the text lies from the language's own."""
        if not texts:
            return [], [], []
        log, n = self.log_likelihood(texts)
        best = np.argmax(log, axis=1)
        top = log[np.arange(len(texts)), best]
        posterior = 1 / np.exp(log - top[:, None]).sum(axis=1)
        return [self.langs[i] for i in best], posterior.tolist(), (top / np.maximum(n, 1) - self.usual[best]).tolist()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on all rows with a text and a language; None if there are none.

    The matrix holds 128 KB for each language; beyond MATRIX_BYTES (8,192 languages) an error is raised.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                log_p, usual = log_probabilities(np.frombuffer(data))
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([usual]), pa.array([log_p.tobytes()], pa.binary())], names=["lang", "usual", "data"])

    most = MATRIX_BYTES // (4 << BITS)
    got = sorted(map(tuple, count_ngrams(rows).mapInArrow(finish, "lang string, usual double, data binary").limit(most + 1).collect()))
    if len(got) > most:
        raise ValueError(f"more than {most} languages")
    return Model([k for k, _, _ in got], np.stack([np.frombuffer(d, np.float32) for _, _, d in got]), np.array([u for _, u, _ in got])) if got else None


def identify(docs: DataFrame, model: Model | None, keep: tuple[Column, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the posterior of the predicted language) for every row."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def step(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        model = shared.value
        text = [None if t is None else t.decode("utf-8", "replace") for t in texts]
        known = [i for i, t in enumerate(text) if model and t and has_letter(t)]
        langs, scores = ["und"] * len(text), [0.0] * len(text)
        if known:
            for i, lang, s, _ in zip(known, *model.predict([text[i] for i in known])):
                langs[i], scores[i] = lang, s
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_arrow(rows, step, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5, unlike: float = 4.0, languages: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a language of the model (of ``languages``, if given).

    Rejected: texts without a letter; texts whose best language has a posterior under
    ``least``; texts whose n-grams are on the mean e^``unlike`` times less likely than
    that language's own (numbers, keys, other scripts, other languages).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.lit(0).alias("__"), F.col(text_col).cast("string").cast("binary").alias("__text"), *docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for part, texts in slices(b, limit=SLICE):
                keep = np.zeros(len(texts), bool)
                text = [None if t is None else t.decode("utf-8", "replace") for t in texts]
                known = [i for i, t in enumerate(text) if model and t and has_letter(t)]
                if known:
                    found, posterior, gap = model.predict([text[i] for i in known])
                    keep[known] = (np.array(posterior) >= least) & (np.array(gap) >= -unlike) & np.array([not languages or x in languages for x in found])
                    kept = part.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(kept.columns[2:], names=names)

    names = docs.columns
    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
