"""Substring dedup: sliding sentence spans.

Texts are cut into sentences, and sentences of over ``LONG`` words (unmarked texts
too) into parts of at most ``ANCHOR`` words, at places that follow from the words
nearby alone; below, a part counts as a sentence.  Characters of scripts without
blanks between words (Han, kana, Thai, Lao, Khmer, Burmese) count as words.

Hashed (128 bits) are, from each sentence on and up to each sentence's end, the
shortest run of at least ``min_sentences`` sentences that has at least ``min_words``
words, and the shortest run of one sentence or more that has so many.  Equal hashes meet in one global join;
of each repeated run the first by (doc_id, text hash, sentence) stays, and every
sentence covered by another is removed.  A repeated stretch of over 50 words
(same sentence marks) holds a whole run, wherever its edges fall.

The join takes two scans.  The first sends a part of each run's hash, packed, and
finds those that occur more than once; a bit filter of them (sized by their number)
is broadcast, and the second scan sends only runs that it lets through, with their
places and whole hashes, to the exact join.  A slice of texts is cut and hashed in
numpy as one array of bytes.

Defined results: a null text stays null, an empty one empty, with no sentences; a
text of white space is one sentence without words; rows that repeat both id and text
are one document and are cut alike; null ids come first; a run repeated within a text
counts too; an empty table gives no rows; other columns are kept as they are, but for
n_sentences and n_removed, which give way where these are reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_filter, materialize, may_hold, scratch, slices, small_batches, text_bytes

#: A sentence of more words is cut at anchors: of any ANCHOR words in a row, the first with the least hash.
LONG, ANCHOR = 17, 16
#: Bytes of text that are cut at once, and whose words are hashed in one stroke.
SLICE, STROKE = 1 << 19, 1 << 18
#: Bytes of input for each bucket of packed hashes.
BUCKET_BYTES = 8 << 20

_SPACE, _MARK, _CLOSER = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", b".!?", b"\"')]"))
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
#: Odd numbers whose powers weigh the bytes of a word and the words of a run, and their inverses.
_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(x), -1, 1 << 64)) for x in _BASES)
_START = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sums(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of the weighted values, from 0 on."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * weights[: len(values)], out=out[1:])
    return out


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes begin and end."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if (data >= 0xE0).any():
        after = np.append(data[1:], 0).astype(np.uint8)
        three = (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F)) | (data >= 0xE3) & (data <= 0xE9)
        four = (data == 0xF0) & (after >= 0xA0) & (after <= 0xB3)
        begins |= three | four
        begins[3:] |= three[:-3] & inside[3:]
        begins[4:] |= four[:-4] & inside[4:]
    start = np.flatnonzero(begins)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:]
    return start, np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    power = inverse = np.zeros(0, np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + STROKE)))
        lo, hi = int(start[at]), int(end[to - 1])
        if len(power) <= hi - lo:
            power, inverse = (_powers(x, hi - lo) for x in (_BASES[0], _INVERSES[0]))
        sums = _sums(_BYTE[data[lo:hi]], power)
        a, b = start[at:to] - lo, end[at:to] - lo
        out[at:to] = _mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        at = to
    return out


@dataclass
class Parts:
    """The sentences of several texts, one after another."""

    #: For each text its first part, and their number at the end; texts without words have none.
    first: np.ndarray
    #: For each part where it begins in its text, its first word, and their number at the end.
    begin: np.ndarray
    word: np.ndarray
    hashes: np.ndarray

    def ranges(self, i: int, size: int) -> list[tuple[int, int]]:
        """Byte ranges that cover the whole text; each holds its trailing white space."""
        own = self.begin[self.first[i] : self.first[i + 1]].tolist() or [0]
        return list(zip(own, [*own[1:], size])) if size else []


def split(texts: list[bytes | None]) -> Parts:
    """A sentence ends after closing marks followed by white space, or with its line."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
    start, end = word_places(data)
    n = len(start)
    hashes = word_hashes(data, start, end)
    doc = np.searchsorted(edge, start, "right") - 1
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    plain = np.maximum.accumulate(np.where(_CLOSER[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
    close = plain[end - 1]
    marked = (close >= start) & _MARK[data[np.maximum(close, 0)]]
    opens = np.ones(n, bool)
    opens[1:] = (start[1:] > end[:-1]) & (marked[:-1] | (lines[start[1:]] > lines[end[:-1]]))
    # Long sentences are cut at their anchors.
    begin = np.flatnonzero(opens)
    size = np.diff(np.append(begin, n))
    if n >= ANCHOR and (size > LONG).any():
        sentence = np.cumsum(opens) - 1
        window = np.flatnonzero((sentence[: n - ANCHOR + 1] == sentence[ANCHOR - 1 :]) & (size[sentence[: n - ANCHOR + 1]] > LONG))
        view = np.lib.stride_tricks.sliding_window_view(hashes, ANCHOR)
        for lo in range(0, len(window), STROKE // ANCHOR):
            own = window[lo : lo + STROKE // ANCHOR]
            opens[own + view[own].argmin(axis=1)] = True
    word = np.flatnonzero(opens)
    first = np.searchsorted(doc[word], np.arange(len(texts) + 1))
    begin = start[word] - edge[doc[word]]
    begin[first[:-1][first[:-1] < first[1:]]] = 0
    return Parts(first, begin, np.append(word, n), hashes)


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of a text's sentences; together they cover it."""
    return split([text]).ranges(0, len(text))


def slice_runs(texts: list[bytes | None], min_sentences: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Of every run: text, first sentence, number of sentences, and the hash in two halves."""
    p = split(texts)
    k = len(p.begin)
    at = np.arange(k)
    text = np.searchsorted(p.first, at, "right") - 1
    # From each sentence on, and up to each sentence's end; the second rule of each asks for more sentences.
    ahead = np.searchsorted(p.word, p.word[:-1] + min_words)
    back = np.searchsorted(p.word, p.word[1:] - min_words, "right") - 1
    low = np.concatenate([at, at, *(np.minimum(back, at + 1 - m) for m in (1, min_sentences))])
    high = np.concatenate([*(np.maximum(ahead, at + m) for m in (1, min_sentences)), at + 1, at + 1])
    text = np.tile(text, 4)
    ok = (low >= p.first[text]) & (high <= p.first[text + 1])
    both = np.unique(low[ok] * (k + 1) + high[ok])
    at, to = both // (k + 1), both % (k + 1)
    text = np.searchsorted(p.first, at, "right") - 1
    a, b = p.word[at], p.word[to]
    own = p.hashes.copy()
    own[p.word[:-1]] ^= _START  # where sentences begin is part of the run
    own = _mix(own)
    halves = []
    for base, inverse in zip(_BASES, _INVERSES):
        sums = _sums(own, _powers(base, len(own)))
        halves.append(_mix((sums[b] - sums[a]) * _powers(inverse, len(own))[a] + (b - a).astype(np.uint64)).view(np.int64))
    return text, at - p.first[text], to - at, *halves


def runs(text: bytes, min_sentences: int, min_words: int) -> list[tuple[int, int, tuple[int, int]]]:
    """(first sentence, number of sentences, hash) of every run of one text."""
    _, first, n, h1, h2 = slice_runs([text], min_sentences, min_words)
    return list(zip(first.tolist(), n.tolist(), zip(h1.tolist(), h2.tolist())))


SPANS = "id long, tid long, first int, n int, h1 long, h2 long"


def bucket_bits(size: int) -> int:
    """Bits of a hash that name its bucket: a bucket holds a few MB, whatever the size of the input."""
    return min(24, max(10, math.ceil(math.log2(max(1, size) / BUCKET_BYTES))))


def repeated_hashes(rows: DataFrame, bits: int, min_sentences: int, min_words: int) -> DataFrame:
    """(h): the first ``bits`` + 40 bits of hashes that several runs have; they travel packed, five bytes each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in slices(b, limit=SLICE):
                h = np.sort(slice_runs(texts, min_sentences, min_words)[3].view(np.uint64)) >> np.uint64(24 - bits)
                if not len(h):
                    continue
                own = (h >> np.uint64(40)).astype(np.int32)
                edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(h)]
                low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                yield pa.RecordBatch.from_arrays([pa.array(own[edges[:-1]]), pa.array([low[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())], names=["bucket", "hashes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(k, []).append(x)
        for k in list(held):
            raw = np.frombuffer(b"".join(held.pop(k)), np.uint8).reshape(-1, 5)
            h = np.zeros((len(raw), 8), np.uint8)
            h[:, :5] = raw
            h, n = np.unique(h.view("<i8").ravel(), return_counts=True)
            if (n > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(k) << 40) | h[n > 1])], names=["h"])

    return rows.mapInArrow(pack, "bucket int, hashes binary").repartition("bucket").mapInArrow(meet, "h long")


def span_hashes(rows: DataFrame, table: np.ndarray, bits: int, min_sentences: int, min_words: int) -> DataFrame:
    """One row for each run that the filter lets through, with the hash in two halves; tid is a hash of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, limit=SLICE):
                which, first, n, h1, h2 = slice_runs(texts, min_sentences, min_words)
                again = may_hold(shared.value, (h1.view(np.uint64) >> np.uint64(24 - bits)).view(np.int64))
                which, first, n, h1, h2 = (x[again] for x in (which, first, n, h1, h2))
                if len(which):
                    own = pa.array(which)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(2).take(own), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2)], names=["id", "tid", "first", "n", "h1", "h2"])

    return rows.mapInArrow(run, SPANS)


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 16) -> DataFrame:
    """id, tid, cut: for each document with repeated runs, the runs to cut as (first, n)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("tid"))
    bits = bucket_bits(text_bytes(rows))
    with scratch(docs.sparkSession) as space:
        again = materialize(repeated_hashes(rows, bits, min_sentences, min_words), "hashes", space)
        spans = materialize(span_hashes(rows, bit_filter(again, "h"), bits, min_sentences, min_words), "spans", space)
        place = F.struct("id", "tid", "first")
        # Rows that repeat id and text give equal places, so distinct places tell a repeat.
        seen = spans.groupBy("h1", "h2").agg(F.min(place).alias("keep"), F.max(place).alias("last")).where("keep <> last").select("h1", "h2", "keep")
        # Written first: both sides of the join are then dealt anew, and a hot run's partition can be split.
        seen = materialize(seen, "repeats", space)
        cut = spans.join(seen, ["h1", "h2"]).where(~place.eqNullSafe(F.col("keep")))
        return materialize(cut.groupBy("id", "tid").agg(F.collect_set(F.struct("first", "n")).alias("cut")), "cuts")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 16, report: bool = False) -> DataFrame:
    """``docs`` without the repeated sentences; ``report`` adds n_sentences and n_removed."""
    cut = repeated_sentences(docs, id_col, text_col, min_sentences, min_words).withColumnsRenamed({"id": "__id", "tid": "__tid", "cut": "__cut"})
    added = ["n_sentences", "n_removed"] if report else []
    rest = [c for c in docs.columns if c != text_col and c not in added]
    joined = docs.join(cut, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__tid")), "left")
    rows = joined.select(F.col("__cut.first").alias("__first"), F.col(text_col).cast("string").cast("binary").alias(text_col), F.col("__cut.n").alias("__n"), *[docs[c] for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, limit=SLICE):
                out, gone = list(texts), [0] * len(texts)
                first, n = part.column(0).to_pylist(), part.column(2).to_pylist()
                cut = [i for i in range(len(texts)) if first[i]]
                some = list(range(len(texts))) if report else cut
                p = split([texts[i] for i in some])
                for k, i in enumerate(some):
                    if first[i]:
                        drop = {x for a, m in zip(first[i], n[i]) for x in range(a, a + m)}
                        out[i] = b"".join(texts[i][x:y] for s, (x, y) in enumerate(p.ranges(k, len(texts[i]))) if s not in drop)
                        gone[i] = len(drop)
                extra = []
                if report:
                    extra = [pa.array([max(k, int(bool(t))) for k, t in zip(np.diff(p.first).tolist(), texts)], pa.int64()), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *part.columns[3:], *extra], names=names)

    names = [text_col, *rest, *added]
    fields = [T.StructField(text_col, T.BinaryType()), *(rows.schema[c] for c in rest)]
    if report:
        fields += [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    small_batches(docs.sparkSession)
    done = rows.mapInArrow(run, T.StructType(fields)).withColumn(text_col, F.col(text_col).cast("string"))
    return done.select(*(c for c in docs.columns if c not in added), *added)
