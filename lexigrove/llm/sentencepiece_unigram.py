"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a SentencePiece model file (its path is a parameter; the driver
reads it and the arrays are broadcast, a fixed size).  A unigram file's scores are
log probabilities and used as they are.  A BPE file has merge ranks instead; they
become log probabilities by the Zipf-Mandelbrot law, log p = -log(rank + shift).
The best segmentation has the highest sum of log scores; characters without a
piece fall back to byte pieces.  Ties go to the longer last piece.

Defined results: a null text has null ids, an empty text no ids; very long texts
are encoded whole; repeated rows alike.  Decoding gives back the text, but for
the literal character U+2581, which stands for a blank, and invalid UTF-8.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Fixed value: how far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Shift of the Zipf-Mandelbrot law for files that hold ranks.
ZIPF_SHIFT = 2.7
#: Words whose segmentation a worker remembers; then it starts afresh.
CACHE_WORDS = 400_000
#: Words of at most so many characters are segmented together, so many at a time.
SHORT, TOGETHER = 48, 8192


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; nested messages as bytes."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value, at
            shift += 7

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


class DoubleArray:
    """Trie in two arrays: the child of s by byte c stands at base[s] + c + 1, and check holds s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 12
        base, check = array("i", [0]) * size, array("i", [-1]) * size
        value = array("i", [-1]) * size
        check[0] = 0
        free, sparse = 1, 1
        todo = [(0, 0, len(keys), 0)]  # node, range of keys, depth
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(keys[lo][0]) == depth:
                value[node] = keys[lo][1]
                lo += 1
            if lo == hi:
                continue
            children, i = [], lo
            while i < hi:
                c, j = keys[i][0][depth], i + 1
                while j < hi and keys[j][0][depth] == c:
                    j += 1
                children.append((c, i, j))
                i = j
            # A lone child takes the next free slot; families start where slots are sparse.
            first, at, full = children[0][0], free if len(children) == 1 else sparse, 0
            while True:
                if at + 600 > len(check):
                    more = len(check)
                    base.extend([0] * more), check.extend([-1] * more), value.extend([-1] * more)
                b = at - first - 1
                if check[at] >= 0:
                    full += 1
                elif b >= 0 and all(check[b + c + 1] < 0 for c, _, _ in children):
                    break
                at += 1
            if len(children) == 1:
                free = max(free, at)
            elif at > sparse + 300 and full >= 0.9 * (at - sparse):
                sparse = at
            base[node] = b
            for c, i, j in children:
                check[b + c + 1] = node
                todo.append((b + c + 1, i, j, depth + 1))
        pad = [0] * 257
        self.base = base
        self.check = check + array("i", [-1] * len(pad))
        self.value = value

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, id) of the keys that begin at ``at``."""
        node = 0
        for i in range(at, len(text)):
            nxt = self.base[node] + text[i] + 1
            if self.check[nxt] != node or nxt == 0:
                return
            node = nxt
            if self.value[node] >= 0:
                yield i + 1, self.value[node]


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, self.strip_extra, charsmap, bpe = True, True, b"", False
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x.get(1, b"").decode())
                self.scores.append(float(x.get(2, 0.0)))
                self.kinds.append(int(x.get(3, NORMAL)))
            elif field == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                x = dict(_fields(value))
                charsmap = x.get(2, b"")
                self.dummy_prefix, self.strip_extra = bool(x.get(3, 1)), bool(x.get(4, 1))
        if charsmap or USER in self.kinds:
            raise ValueError("models with a normalisation table or user-defined pieces aren't supported")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        own = [(p.encode(), i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL]
        if bpe:
            for _, i in own:
                self.scores[i] = -math.log(ZIPF_SHIFT - self.scores[i])
        self.trie = DoubleArray(own)
        self.unknown = min(self.scores[i] for _, i in own) - UNKNOWN_PENALTY
        words = [self.pieces[i] for _, i in own]
        # Where no piece crosses the start of a word, words can be segmented one by one.
        crosses = any(MARK in p.lstrip(MARK) for p in words)
        breaks = "" if any("\n" in p for p in words) else "\n"
        self.split = None if crosses else re.compile(f"{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+" + ("|\n" if breaks else ""))
        self.cache: dict[str, bytes] = {}
        self.surface = [p.replace(MARK, " ") if k == NORMAL else "" for p, k in zip(self.pieces, self.kinds)]
        #: Byte pieces that make a character only together with others.
        self.high = frozenset(i for b, i in self.byte_ids.items() if b >= 0x80)
        for b, i in self.byte_ids.items():
            if b < 0x80:
                self.surface[i] = chr(b)
        self.arrays = (*(np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores))

    def best(self, text: bytes) -> list[int]:
        """Viterbi: ids of the best path through one word (or a whole text)."""
        n = len(text)
        best, start, piece = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for i in range(n):
            here = best[i]
            if here == -np.inf:
                continue
            lead = text[i]
            one = i + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            single, node = False, 0
            for j in range(i, n):
                nxt = base[node] + text[j] + 1
                if check[nxt] != node or not nxt:
                    break
                node = nxt
                k = value[node]
                if k >= 0:
                    j += 1
                    if j == one:
                        single = True
                    s = here + scores[k]
                    if s > best[j]:
                        best[j], start[j], piece[j] = s, i, k
            if not single and here + self.unknown > best[one]:
                best[one], start[one], piece[one] = here + self.unknown, i, -1
        ids: list[int] = []
        at = n
        while at:
            i = start[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.byte_ids[c] for c in reversed(text[i:at]))
            at = i
        ids.reverse()
        return ids

    def best_many(self, words: list[bytes]) -> list[bytes]:
        """The same for many short words at once; ids as packed 32-bit numbers.

        The trie is walked from one start for all words together, and every walk
        goes on with those words that still match.
        """
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        text = np.zeros((n, width), np.int64)
        text[np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(words), np.uint8)
        base, check, value, score = self.arrays
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            rows = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            lead = text[rows, i]
            one = i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            here, single = best[rows, i], np.zeros(len(rows), bool)
            at, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for j in range(i, width):
                go = base[node] + text[rows[at], j] + 1
                ok = (check[go] == node) & (size[rows[at]] > j)
                at, node = at[ok], go[ok]
                if not len(at):
                    break
                k = value[node]
                hit = k >= 0
                if hit.any():
                    own, k = at[hit], k[hit]
                    single[own] |= one[own] == j + 1
                    s, r = here[own] + score[k], rows[own]
                    better = s > best[r, j + 1]
                    r = r[better]
                    best[r, j + 1], start[r, j + 1], piece[r, j + 1] = s[better], i, k[better]
            left = ~single
            if left.any():
                r, e, s = rows[left], one[left], here[left] + self.unknown
                better = s > best[r, e]
                r, e = r[better], e[better]
                best[r, e], start[r, e], piece[r, e] = s[better], i, -1
        at, word, steps = size.copy(), np.arange(n), []
        unknown = np.zeros(n, bool)
        while len(word):
            k = piece[word, at]
            unknown[word[k < 0]] = True
            steps.append((word, k))
            at = start[word, at].astype(np.int64)
            word, at = word[at > 0], at[at > 0]
        who, ids = np.concatenate([w for w, _ in steps[::-1]]), np.concatenate([k for _, k in steps[::-1]])
        order = np.argsort(who, kind="stable")
        flat, ends = ids[order].astype("<i4").tobytes(), 4 * np.cumsum(np.bincount(who, minlength=n))
        out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i in np.flatnonzero(unknown):
            out[i] = array("i", self.best(words[i])).tobytes()
        return out

    def words(self, text: str) -> list[str]:
        """The text's parts that can be segmented one by one."""
        if self.strip_extra:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.dummy_prefix:
            text = MARK + text
        return self.split.findall(text) if self.split else [text]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; new words of all texts are segmented together."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        parts = [self.words(t) if t else [] for t in texts]
        new = {w for own in parts for w in own if w not in cache}
        long = {w: array("i", self.best(w.encode())).tobytes() for w in new if len(w) > SHORT}
        fresh = sorted((w.encode() for w in new if len(w) <= SHORT), key=len)
        for lo in range(0, len(fresh), TOGETHER):
            part = fresh[lo : lo + TOGETHER]
            cache.update(zip((w.decode() for w in part), self.best_many(part)))
        if long:
            return [b"".join([cache[w] if w in cache else long[w] for w in own]) for own in parts]
        return [b"".join([cache[w] for w in own]) for own in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        surface, kinds, out, run = self.surface, self.kinds, [], bytearray()
        if not self.high.intersection(ids):
            text = "".join([surface[i] for i in ids])
        else:
            for i in ids:
                if kinds[i] == BYTE:
                    run.append(int(self.pieces[i][3:5], 16))
                else:
                    if run:
                        out.append(run.decode("utf-8", "replace"))
                        run = bytearray()
                    out.append(surface[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def load(path: str = DEFAULT_MODEL) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a further column of piece ids (replaced, if there was one of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    rows = docs.select(F.lit(0).alias("_"), F.col(text_col).cast("string"), *rest)
    names = [text_col, *rest, ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for part, texts in slices(b):
                packed = model.encode_many(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                at = pa.array(ends, mask=np.array([*(t is None for t in texts), False]))
                ids = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids], names=names)

    schema = T.StructType([*rows.drop("_").schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with a further column holding the text of the ids."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c not in (ids_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = [None if x is None else model.decode(x) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[ids_col, *rest, out_col])

    rows = rows.select(ids_col, *rest)
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def digest(ids_col: str = "ids"):
    """A number that changes with any id or its place."""
    return F.xxhash64(F.col(ids_col))
