"""LM scoring: hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(subclass | class, history) * share.
Histories are described by hashed n-gram and skip features (previous word, previous
two, the one before the last).  Words are sorted by count: the most frequent fill
``HEAD_CLASSES`` classes of ``WIDTH`` words, each a subclass of its own; the rest of
the vocabulary forms classes of equal mass, each cut into ``WIDTH`` subclasses of
equal mass, in which a word has its share of the counts; all other words, unseen ones
included, are one last class.  Both softmaxes have features; every level sums to 1.

Training is by distributed gradient updates.  The texts are turned into word numbers
once.  One pass over all training rows sums the observed counts of (feature, outcome);
every further pass (``STEPS``) sums the expected counts at the broadcast weights, and
the driver takes a step along the log of observed to expected, which has the sign of
the gradient and vanishes with it.  Sums are in double precision and meet by blocks of
rows.  Every training row counts in every pass.

Sizes: counts of words cover all training rows; the vocabulary that is broadcast has at
most ``MAX_VOCABULARY`` words, and the counts of all others come from a join.  The
hashed tables grow with the training tokens, up to 2^``MAX_BITS`` rows (25 MB), which
bounds what is broadcast and what each task sends.

Defined results: a null or empty text has only its end token; texts of any length are
read whole; rows with a null id are training rows; repeated rows count and are scored
each on its own; words of equal count go by their bytes; without training rows every
probability is 1; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, materialize, scratch, shuffles_freed, slices, sum_blocks

#: White space is no word, so it can stand for the end of a text.
END = b"\n"
MAX_VOCABULARY = 1 << 17
CLASSES, HEAD_CLASSES, WIDTH = 64, 32, 32
#: Bits of the hashed feature tables at least and at most, training tokens for each row, rows of a block of sums.
MIN_BITS, MAX_BITS, TOKENS_A_ROW, BLOCK = 12, 16, 64, 256
#: Step at weights of zero (classes only, from the observed counts), and for each pass of expected counts those of both levels.
FIRST_STEP, STEPS = 0.45, ((0.55, 0.75),)
#: What shrinks a step where counts are small: outcomes as expected, and of each kind.
AS_EXPECTED, OF_EACH = 6.0, 2.0
#: Tokens handled at once in numpy (what they make stays in a core's cache), tokens summed in single precision
#: before the sums are added up in double, and distinct words counted before they are sent.
CHUNK, FLUSH, COUNTED = 1 << 12, 1 << 20, 200_000
FEATURES = 3


def word_counts(docs: DataFrame) -> DataFrame:
    """(token binary, c): counts over all rows, end tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["token", "c"])
            held.clear()
            return out

        for b in batches:
            for _, texts in slices(b):
                for t in texts:
                    held.update((t or b"").lower().split())
                held[END] += len(texts)
                if len(held) > COUNTED:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def add_rows(total: np.ndarray, row: np.ndarray, p: np.ndarray) -> None:
    """total[row[i]] += p[i] for all i; rows met once are added at a stroke, others summed first."""
    order = np.argsort(row, kind="stable")
    at = row[order]
    new = np.concatenate([[True], at[1:] != at[:-1], [True]])
    once = new[:-1] & new[1:]
    total[at[once]] += p.take(order[once], axis=0)
    several = ~once
    if several.any():
        at, order, first = at[several], order[several], np.flatnonzero(new[:-1][several])
        total[at[first]] += np.add.reduceat(p.take(order, axis=0), first, axis=0)


class Model:
    def __init__(self, tokens: list[bytes], counts: np.ndarray, total: int, distinct: int):
        """tokens by falling count; total and distinct are those of the training rows."""
        self.tokens, self.counts, self.total, self.distinct = tokens, counts.astype("f8"), total, distinct
        self.bits = min(MAX_BITS, max(MIN_BITS, round(math.log2(max(1, total) / TOKENS_A_ROW))))
        k = len(tokens)
        head = min(k, HEAD_CLASSES * WIDTH)
        self.cls, self.slot = np.full(k + 1, CLASSES - 1, np.int16), np.zeros(k + 1, np.int16)
        self.cls[:head], self.slot[:head] = np.arange(head) // WIDTH, np.arange(head) % WIDTH
        mid = self.counts[head:]
        if len(mid):
            at = (np.cumsum(mid) - mid) / mid.sum() * (CLASSES - 1 - HEAD_CLASSES)
            own = np.minimum(at.astype(int), CLASSES - 2 - HEAD_CLASSES)
            self.cls[head:k] = HEAD_CLASSES + own
            self.slot[head:k] = np.minimum(((at - own) * WIDTH).astype(int), WIDTH - 1)
        # One more than counted for the last class: room for words never seen.
        self.rest = max(0.0, total - self.counts.sum()) + max(0, distinct - k) + 1.0
        inner = np.zeros((CLASSES, WIDTH))
        np.add.at(inner, (self.cls[:k], self.slot[:k]), self.counts)
        size = inner.sum(axis=1)
        size[CLASSES - 1] += self.rest
        self.prior = size / size.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bias = np.maximum(np.log(self.prior), -1e4).astype("f4")
            self.inner_bias = np.maximum(np.log(inner / np.maximum(inner.sum(axis=1, keepdims=True), 1)), -1e4).astype("f4")
            self.word_log = np.append(np.log(self.counts / inner[self.cls[:k], self.slot[:k]]), -np.log(self.rest))
        self.base_log10 = np.append(np.log10(self.counts + 1), 0.0)
        self.w = [np.zeros((1 << self.bits, CLASSES), "f4"), np.zeros((1 << self.bits, WIDTH), "f4")]
        self._index: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    @property
    def index(self) -> dict[bytes, int]:
        if self._index is None:
            self._index = {t: i for i, t in enumerate(self.tokens)}
        return self._index

    def read(self, text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
        """The text's word numbers, the end's included, and its words outside the vocabulary."""
        get, k = self.index.get, len(self.tokens)
        words = (text or b"").lower().split()
        own = np.empty(len(words) + 1, np.int32)
        own[:-1] = np.fromiter(map(get, words, repeat(k)), np.int32, len(words))
        own[-1] = get(END, k)
        return own, [words[i] for i in np.flatnonzero(own[:-1] == k)]

    def features(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hashes of the history's features (features x tokens, 32 bits)."""
        start = len(self.tokens) + 1
        before = []
        for k in (1, 2):
            u = np.full(len(ids), start, np.uint32)
            u[k:] = np.where(place[k:] >= k, ids[:-k] if k < len(ids) else ids[:0], start)
            before.append(u)
        u1, u2 = before
        h = np.stack([u1 * np.uint32(0x9E3779B1) + np.uint32(1), (u1 * np.uint32(0x85EBCA6B)) ^ (u2 * np.uint32(0xC2B2AE35)), u2 * np.uint32(0x27D4EB2F) + np.uint32(3)])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        return h

    def rows(self, ids: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of both levels: rows of the features, right outcome, tokens that take part."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        shift = np.uint32(32 - self.bits)
        yield (h >> shift).astype(kind), self.cls[ids], np.arange(len(ids))
        known = np.flatnonzero(ids < len(self.tokens))
        c = self.cls[ids[known]].astype(np.uint32)
        yield ((h[:, known] ^ (c * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B) >> shift).astype(kind), self.slot[ids[known]], known

    def logits(self, level: int, f: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Steps are bounded, so logits stay far below overflow."""
        out = np.repeat(self.bias[None, :], len(ids), axis=0) if level == 0 else self.inner_bias[self.cls[ids]]
        for row in f:
            out += self.w[level].take(row, axis=0)
        return out

    def log_p(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural log probability of each token; in the last class without the word's own count."""
        out = self.word_log[ids]
        h = self.features(ids, place)
        for lo in range(0, len(ids), CHUNK):
            own = ids[lo : lo + CHUNK]
            part = out[lo : lo + CHUNK]
            for level, (f, right, which) in enumerate(self.rows(own, h[:, lo : lo + CHUNK])):
                x = self.logits(level, f, own[which])
                mine = x[np.arange(len(right)), right]
                np.exp(x, out=x)
                part[which] += mine - np.log(x @ np.ones(x.shape[1], "f4"))
        return out

    def observed(self, ids: np.ndarray, place: np.ndarray, sums: list[np.ndarray]) -> None:
        """Add how often each outcome met each row of features."""
        h = self.features(ids, place)
        for lo in range(0, len(ids), CHUNK):
            for level, (f, right, _) in enumerate(self.rows(ids[lo : lo + CHUNK], h[:, lo : lo + CHUNK])):
                np.add.at(sums[level].reshape(-1), (f.astype(np.int64) * sums[level].shape[1] + right).ravel(), np.float32(1))

    def expected(self, ids: np.ndarray, place: np.ndarray, sums: list[np.ndarray]) -> None:
        """Add how often each outcome is expected with each row of features."""
        h = self.features(ids, place)
        for lo in range(0, len(ids), CHUNK):
            own = ids[lo : lo + CHUNK]
            for level, (f, _, which) in enumerate(self.rows(own, h[:, lo : lo + CHUNK])):
                if not len(which):
                    continue
                x = self.logits(level, f, own[which])
                np.exp(x, out=x)
                x *= (np.float32(1) / (x @ np.ones(x.shape[1], "f4")))[:, None]
                for row in f:
                    add_rows(sums[level], row, x)

    def update(self, level: int, seen: np.ndarray, expected: np.ndarray, step: float) -> None:
        """Move each weight by the log of observed to expected counts, as far as there are counts."""
        visits = expected.sum(axis=1, keepdims=True)
        some = AS_EXPECTED * np.divide(expected, visits, out=np.zeros_like(expected), where=visits > 0) + OF_EACH
        # Rounded, so that the order of sums between runs leaves no trace.
        self.w[level] += np.round(step * np.log((seen + some) / (expected + some)), 3).astype("f4")

    def tables(self, kind: str = "f8") -> list[np.ndarray]:
        return [np.zeros(w.shape, kind) for w in self.w]


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, row, and the text's word numbers (two bytes each, larger ones apart) and its words outside the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for part, texts in slices(b):
                small, large, rest = [], [], []
                for t in texts:
                    ids, others = model.read(t)
                    big = ids >= 0xFFFF
                    small.append(np.where(big, 0xFFFF, ids).astype("<u2").tobytes())
                    large.append(ids[big].astype("<i4").tobytes())
                    rest.append(others)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(small, pa.binary()), pa.array(large, pa.binary()), pa.array(rest, pa.list_(pa.binary()))], names=["doc_id", "held_out", "row", "small", "large", "rest"])

    rows = docs.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, row long, small binary, large binary, rest array<binary>")


def numbers(small: pa.Array, large: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to), their word numbers, and the places of these in their texts."""
    small, large = small.to_pylist(), large.to_pylist()
    lo = 0
    while lo < len(small):
        hi, size = lo, 0
        while hi < len(small) and (hi == lo or size + len(small[hi]) <= 128 * CHUNK):
            size += len(small[hi])
            hi += 1
        ids = np.frombuffer(b"".join(small[lo:hi]), "<u2").astype(np.int64)
        ids[ids == 0xFFFF] = np.frombuffer(b"".join(large[lo:hi]), "<i4")
        n = np.array([len(x) // 2 for x in small[lo:hi]])
        yield lo, hi, ids, np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def sums_over(rows: DataFrame, model: Model, what: str) -> list[np.ndarray]:
    """Sum Model.observed or Model.expected over all rows (small, large)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums, part, held, some = model.tables(), model.tables("f4"), 0, False

        def flush() -> None:
            for total, own in zip(sums, part):
                total += own
                own[:] = 0

        for b in batches:
            for _, _, ids, place in numbers(b.column(0), b.column(1)):
                some = True
                getattr(model, what)(ids, place, part)
                held += len(ids)
                if held > FLUSH:
                    flush()
                    held = 0
        if some:
            flush()
            for level, table in enumerate(sums):
                for lo in range(0, len(table), 16 * BLOCK):
                    data = [table[i : i + BLOCK].astype("f4").tobytes() for i in range(lo, min(lo + 16 * BLOCK, len(table)), BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array([str(level)] * len(data)), pa.array(range(lo // BLOCK, lo // BLOCK + len(data)), pa.int32()), pa.array(data, pa.binary())], names=["key", "block", "data"])

    # A task sends tables of a bounded size, so it should read about as many bytes of word numbers.
    tasks = 1 + 2 * model.total // sum(w.nbytes for w in model.w)
    with shuffles_freed(spark):
        got = sum_blocks(rows.select("small", "large").coalesce(tasks).mapInArrow(run, "key string, block int, data binary"), "float64", "float32").toArrow()
    out = model.tables()
    for key, block, data in zip(*(c.to_pylist() for c in got.columns)):
        own = out[int(key)][block * BLOCK : (block + 1) * BLOCK]
        own += np.frombuffer(data).reshape(own.shape)
    shared.unpersist()
    return out


def train(rows: DataFrame, model: Model, steps: tuple[tuple[float, float], ...] = STEPS) -> Model:
    """``rows``: encoded training rows; each takes part in every pass."""
    seen = sums_over(rows, model, "observed")
    # At weights of zero every history expects the classes' shares.
    model.update(0, seen[0], seen[0].sum(axis=1, keepdims=True) * model.prior, FIRST_STEP)
    for pair in steps:
        for level, expected in enumerate(sums_over(rows, model, "expected")):
            model.update(level, seen[level], expected, pair[level])
    return model


def vocabulary(docs: DataFrame, space: list[str] | None = None) -> tuple[Model, DataFrame]:
    """An untrained model and the counts of all words of ``docs`` (doc_id, text)."""
    counts = materialize(word_counts(docs), "word-counts", space)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("c") * 32).cast("int")
    per = {r["k"]: r["n"] for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()}
    room, least = MAX_VOCABULARY, None
    for k in sorted(per, reverse=True):
        room -= per[k]
        if room < 0:
            break
        least = k
    # The end token is always known.
    known = counts.where((level >= least if least is not None else F.lit(False)) | (F.col("token") == F.lit(END))).toArrow()
    pairs = sorted(zip(known.column("c").to_pylist(), known.column("token").to_pylist()), key=lambda x: (-x[0], x[1]))
    return Model([t for _, t in pairs], np.array([c for c, _ in pairs], "f8"), total, distinct), counts


def score(encoded: DataFrame, model: Model, counts: DataFrame, space: list[str] | None = None) -> DataFrame:
    """Encoded rows -> the contract's columns, one row for each row."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.tokens)
        for b in batches:
            for lo, hi, ids, place in numbers(b.column(3), b.column(4)):
                first = np.flatnonzero(place == 0)
                known = np.add.reduceat((ids < k).astype(np.int64), first)
                base = np.add.reduceat(model.base_log10[ids], first)
                log = np.add.reduceat(model.log_p(ids, place), first) / np.log(10)
                n = np.diff([*first, len(ids)])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(n), pa.array(known), pa.array(base), pa.array(log)], names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "log"])

    rows = encoded.select("doc_id", "held_out", "row", "small", "large").mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, log double")
    # The exact way for words outside the broadcast vocabulary.
    rest = encoded.select("row", F.explode("rest").alias("token")).join(counts, "token")
    rest = rest.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("add"))
    out = rows.join(rest, "row", "left")
    add = F.coalesce("add", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * float(np.log10(model.total + model.distinct + 1))).alias("base_score"),
        (F.col("log") + add).alias("score"),
    )


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, steps: tuple[tuple[float, float], ...] = STEPS) -> DataFrame:
    """Score every row, with a model of the rows outside the held-out fold."""
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == held_fold, F.lit(False))
    docs = ids_and_text(documents, id_col, text_col, (held.alias("held_out"),))
    with scratch(docs.sparkSession) as space:
        model, counts = vocabulary(docs.where("not held_out").select("doc_id", "text"), space)
        encoded = materialize(encode(docs, model), "word-numbers", space)
        if model.total:
            train(encoded.where("not held_out"), model, steps)
        return materialize(score(encoded, model, counts, space), "lm-scores")
