"""The vector space of a corpus by arrays: vocabulary, TF-IDF and BM25 weights, ranking by blocks.

Same results as the plain plans of ``vectorize``, for n-grams of one and two words.  The JVM
takes texts apart into words; n-grams are numbers in arrays, so that no row is made for an
occurrence.  The vocabulary is exact and takes two passes: the first counts occurrences in
``BUCKETS`` counters by hash, which bound every term's count from above, the second counts
the terms of full counters one by one; more counters are opened until the rarest term taken
is at least as frequent as the bound.  Ranking multiplies a block of queries with a block of
rows by their common terms and hands on only the best k.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Counters of the first pass; bytes of text that are taken apart at a time (so that row and two words fit 63 bits).
BUCKETS, SLICE_BYTES = 1 << 21, 4 << 20
PART = 1 << 15
#: Bytes of a block of rows or of queries, 12 an entry.
BLOCK_BYTES, ENTRY = 32 << 20, 12
#: Similarities are rounded to so many places before they are ranked.
PLACES = 12
PACKED = "block int, ids binary, ptr binary, codes binary, weights binary"
#: The words that are kept at present (see Space).
_kept: list[DataFrame] = []


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, distinct words, and for each occurrence of a word its row, its text and its number among the distinct words)."""
    for b in batches:
        texts = b.column(1)
        size = np.zeros(b.num_rows, np.int64)
        np.add.at(size, np.repeat(np.arange(b.num_rows), texts.value_lengths().to_numpy()), pc.binary_length(texts.flatten()).to_numpy())
        ends, lo = np.cumsum(size), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            part = texts.slice(lo, hi - lo)
            words = pc.split_pattern(part.flatten(), " ")
            coded = words.flatten().dictionary_encode()
            text = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
            row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())[text]
            yield b.column(0).slice(lo, hi - lo), coded.dictionary, row, text, coded.indices.to_numpy().astype(np.int64)
            lo = hi


def _bucket(buckets: int, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15)
    if second is not None:
        x = (x ^ (x >> np.uint64(31))) + (second + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.diff(np.r_[start, len(keys)])


def _pairs(text: np.ndarray) -> np.ndarray:
    """Places whose word has a next one in the same text."""
    return np.flatnonzero(text[1:] == text[:-1])


def _ipc(a: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([a], names=["id"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _array(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


class Space:
    """Terms and weights of ``docs`` (id, text); ids that occur in several rows are one document.

    ``n`` is the number of rows, ``terms`` the vocabulary (term, df, cf) with the most frequent first:
    min_df <= df <= max_df * n, at most ``max_features``, ties by term.  It is held on the driver.
    """

    def __init__(self, docs: DataFrame, min_df: int = 1, max_df: float = 1.0, max_features: int = 16_000, longest: int = 2, stop: tuple[str, ...] = t.ENGLISH_STOP, id_col: str = "doc_id", text_col: str = "text"):
        if longest not in (1, 2):
            raise ValueError("n-grams of one or two words")
        self.longest, self.stop, self.id_col, self.spark = longest, stop, id_col, docs.sparkSession
        self.id_type = docs.schema[id_col].dataType.simpleString()
        # Words serve several passes.  One corpus is kept in a session: an older one is taken apart again if it is still asked for.
        while _kept:
            _kept.pop().unpersist()
        self.all = self._split(docs, id_col, text_col).persist()
        _kept.append(self.all)
        self.n, self.words = self._grouped(self.all)
        self.terms = self._vocabulary(min_df, max_df, max_features)

    def _split(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, words joined by blanks), dealt by id before texts are taken apart."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        words = F.array_join(t.word_tokens(F.col(text_col), self.stop), " ").alias("words")
        return docs.select(id_col, text_col).repartition(parts, id_col).select(F.col(id_col).alias("id"), words)

    @staticmethod
    def _grouped(split: DataFrame) -> tuple[int, DataFrame]:
        """Number of rows, and (id, texts): one row for each id that has words."""
        n, ids = split.agg(F.count("*"), F.count_distinct(F.struct("id"))).first()
        split = split.where("words <> ''")
        return n, split.select("id", F.array("words").alias("words")) if n == ids else split.groupBy("id").agg(F.collect_list("words").alias("words"))

    def _vocabulary(self, min_df: int, max_df: float, max_features: int) -> pa.Table:
        longest, buckets, part, most = self.longest, BUCKETS, min(PART, BUCKETS), SLICE_BYTES  # workers get them from here

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets, np.int64)
            for _, words, _, text, code in _slices(batches, most):
                h = _hashes(words)[code]
                total += np.bincount(_bucket(buckets, h), minlength=buckets)
                if longest > 1:
                    at = _pairs(text)
                    total += np.bincount(_bucket(buckets, h[at], h[at + 1]), minlength=buckets)
            for i in range(0, buckets, part):
                yield pa.RecordBatch.from_arrays([pa.array([i // part], pa.int32()), pa.array([total[i : i + part].tobytes()], pa.binary())], names=["part", "counts"])

        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(part, np.int64)
            for b in batches:
                for x in b.column("counts"):
                    total += np.frombuffer(x.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

        words = self.words
        filled = words.mapInArrow(fill, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").toArrow()
        total = np.zeros(buckets, np.int64)
        for i, counts in zip(filled.column("part").to_pylist(), filled.column("counts").to_pylist()):
            total[i * part : (i + 1) * part] = np.frombuffer(counts, np.int64)
        order, opened = np.sort(total)[::-1], 2 * max_features
        while True:
            least = max(1, int(order[opened])) if opened < buckets else 1
            found = self._exact(words, total >= least, min_df, max_df, max_features)
            # Every term that occurs ``least`` times or more was counted.
            if least == 1 or found.num_rows == max_features and found.column("cf")[-1].as_py() >= least:
                return found.combine_chunks()
            opened *= 4

    def _exact(self, words: DataFrame, full: np.ndarray, min_df: int, max_df: float, max_features: int) -> pa.Table:
        longest, buckets, most = self.longest, len(full), SLICE_BYTES
        mask = self.spark.sparkContext.broadcast(np.packbits(full))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            full = np.unpackbits(mask.value).astype(bool)
            for ids, words, row, text, code in _slices(batches, most):
                h, bits, far = _hashes(words), len(words).bit_length(), len(ids).bit_length()
                key = code << far | row
                kinds = [(key[full[_bucket(buckets, h)][code]], 0)]
                if longest > 1:
                    at = _pairs(text)
                    at = at[full[_bucket(buckets, h[code[at]], h[code[at + 1]])]]
                    kinds.append(((code[at] << bits | code[at + 1]) << far | row[at], bits))
                for keys, second in kinds:
                    keys, tf = _runs(keys)
                    gram, df = _runs(keys >> far)
                    if not len(gram):
                        continue
                    cf = np.add.reduceat(tf, np.cumsum(df) - df)
                    term = words.take(pa.array(gram)) if not second else pc.binary_join_element_wise(words.take(pa.array(gram >> second)), words.take(pa.array(gram & ((1 << second) - 1))), " ")
                    yield pa.RecordBatch.from_arrays([term, pa.array(df), pa.array(cf)], names=["term", "df", "cf"])

        v = words.mapInArrow(count, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        out = v.where((F.col("df") >= min_df) & (F.col("df") <= max_df * self.n)).orderBy(F.desc("cf"), "term").limit(max_features).toArrow()
        mask.unpersist()
        return out

    def vocabulary(self) -> DataFrame:
        return self.spark.createDataFrame(self.terms, "term string, df long, cf long")

    def _weighed(self, kind: str):
        """A function from batches of (id, texts) to (ids, row, term's number, weight), a slice at a time, in order of rows and terms."""
        terms, df = self.terms.column("term"), self.terms.column("df").to_numpy().astype("f8")
        spaced = pc.match_substring(terms, " ").to_numpy() if len(terms) else np.zeros(0, bool)
        one, two = np.flatnonzero(~spaced), np.flatnonzero(spaced)
        ends = pc.split_pattern(terms.take(pa.array(two)).combine_chunks(), " ").flatten()
        avg = float(pc.sum(self.terms.column("cf")).as_py() or 0) / max(self.n, 1) or 1.0
        idf = np.log((1.0 + self.n) / (1.0 + df)) + 1.0 if kind == "tfidf" else np.log(1.0 + (self.n - df + 0.5) / (df + 0.5))
        sent = self.spark.sparkContext.broadcast((terms.take(pa.array(one)).combine_chunks(), one, ends.take(pa.array(np.arange(0, len(ends), 2))), ends.take(pa.array(np.arange(1, len(ends), 2))), two, idf))

        most = SLICE_BYTES

        def run(batches: Iterator[pa.RecordBatch], k1: float = 1.5, b: float = 0.75):
            single, one, first, second, two, idf = sent.value
            far = max(1, len(idf).bit_length())
            place = lambda wanted, words: pc.fill_null(pc.index_in(wanted, value_set=words), -1).to_numpy().astype(np.int64)
            for ids, words, row, text, code in _slices(batches, most):
                number = np.full(len(words), -1, np.int64)
                at = place(single, words)
                number[at[at >= 0]] = one[at >= 0]
                found = number[code]
                keys = [(row << far | found)[found >= 0]]
                x, y = place(first, words), place(second, words)
                there = np.flatnonzero((x >= 0) & (y >= 0))
                if len(there):
                    bits = len(words).bit_length()
                    known = x[there] << bits | y[there]
                    order = np.argsort(known)
                    known, its = known[order], two[there][order]
                    at = _pairs(text)
                    pair = code[at] << bits | code[at + 1]
                    i = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                    ok = known[i] == pair
                    keys.append(row[at][ok] << far | its[i[ok]])
                key, tf = _runs(np.concatenate(keys))
                if not len(key):
                    continue
                r, c = key >> far, key & ((1 << far) - 1)
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                many = np.diff(np.r_[start, len(r)])
                if kind == "tfidf":
                    w = tf * idf[c]
                    w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, start)), many)
                else:
                    w = idf[c] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.repeat(np.add.reduceat(tf, start), many) / avg))
                yield ids, r, c, w

        return run

    def _long(self, kind: str) -> DataFrame:
        run = self._weighed(kind)
        terms = self.spark.sparkContext.broadcast(self.terms.column("term").combine_chunks())

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, r, c, w in run(batches):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), terms.value.take(pa.array(c)), pa.array(w)], names=[id_col, "term", "weight"])

        id_col = self.id_col
        return self.words.mapInArrow(rows, f"{id_col} {self.id_type}, term string, weight double")

    def tfidf(self) -> DataFrame:
        """(id, term, weight): tf * (ln((1+n)/(1+df)) + 1), each row of unit length."""
        return self._long("tfidf")

    def bm25(self) -> DataFrame:
        """(id, term, weight): Okapi weights; lengths and their mean are taken after pruning, over all documents."""
        return self._long("bm25")

    def blocks(self, words: DataFrame, parts: int) -> DataFrame:
        """TF-IDF rows of (id, texts) packed, a row for each part: ids in order, where each id's entries begin, term numbers and weights."""
        run = self._weighed("tfidf")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, sizes, codes, weights = [], [], [], []
            for i, r, c, w in run(batches):
                rows, many = _runs(r)
                ids.append(i.take(pa.array(rows)))
                sizes.append(many)
                codes.append(c.astype("i4"))
                weights.append(w)
            if ids:
                ptr = np.r_[0, np.cumsum(np.concatenate(sizes))]
                data = (_ipc(pa.concat_arrays(ids)), ptr.tobytes(), np.concatenate(codes).tobytes(), np.concatenate(weights).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["block", "ids", "ptr", "codes", "weights"])

        return words.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(pack, PACKED)

    def entries(self) -> int:
        """Weights of all rows together."""
        return int(pc.sum(self.terms.column("df")).as_py() or 0)

    def parts(self, entries: int, least: int) -> int:
        return max(1, least, -(-entries * ENTRY // BLOCK_BYTES))

    def rank(self, queries: DataFrame, top_k: int, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
        """query, id, similarity, rank: the top_k rows by cosine, ties by id; zero rows fill up.

        Work is in proportion to queries x rows x common terms; a task holds one block of each.
        """
        cores, name = self.spark.sparkContext.defaultParallelism, self.id_col
        n_q, words = self._grouped(self._split(queries, query_col, text_col))
        # A query's entries are not known before it is taken apart: some 50 are allowed for.
        n_asked, n_rows = self.parts(n_q * 50, 1), self.parts(self.entries(), min(3 * cores, -(-self.n // 256)))
        asked, rows = self.blocks(words, n_asked), self.blocks(self.words, n_rows)
        left = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns if c != "block"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("block"))
        n_terms = len(self.terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    q_ids, q_ptr, q_codes, q_weights, ids, ptr, codes, weights = (b.column(i)[k].as_buffer() for i in range(8))
                    q_ids, ids = _array(q_ids), _array(ids)
                    ptr, codes = np.frombuffer(ptr, np.int64), np.frombuffer(codes, "i4")
                    found = best(np.frombuffer(q_ptr, np.int64), np.frombuffer(q_codes, "i4"), np.frombuffer(q_weights), ptr, codes, np.frombuffer(weights), n_terms, top_k)
                    for q, j, s in found:
                        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), ids.take(pa.array(j)), pa.array(s)], names=[query_col, name, "similarity"])

        pairs = left.join(rows, "block").select(*(f"q_{c}" for c in ("ids", "ptr", "codes", "weights")), "ids", "ptr", "codes", "weights")
        hit = pairs.repartition(max(1, min(100 * cores, n_rows * n_asked))).mapInArrow(run, f"{query_col} {queries.schema[query_col].dataType.simpleString()}, {name} {self.id_type}, similarity double")
        first = self.all.select(F.col("id").alias(name)).distinct().orderBy(name).limit(2 * top_k)
        zero = queries.select(query_col).distinct().join(F.broadcast(first)).withColumn("similarity", F.lit(0.0))
        both = hit.union(zero.select(hit.columns)).groupBy(query_col, name).agg(F.max("similarity").alias("similarity"))
        w = Window.partitionBy(query_col).orderBy(F.desc("similarity"), name)
        return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def best(q_ptr: np.ndarray, q_codes: np.ndarray, q_weights: np.ndarray, ptr: np.ndarray, codes: np.ndarray, weights: np.ndarray, n_terms: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, similarity) of each query's k best rows with a common term, ties by row, for some queries at a time."""
    n, group = len(ptr) - 1, 64
    order = np.argsort(codes.astype(np.uint16) if n_terms < 1 << 16 else codes, kind="stable")
    rows = np.repeat(np.arange(n), np.diff(ptr))[order]
    by, edge = weights[order], np.r_[0, np.cumsum(np.bincount(codes, minlength=n_terms))]
    wide = -(-n // group) * group
    out: list[tuple] = []
    for q in range(len(q_ptr) - 1):
        lo, hi = q_ptr[q], q_ptr[q + 1]
        c = q_codes[lo:hi]
        spans = [slice(x, y) for x, y in zip(edge[c].tolist(), edge[c + 1].tolist())]
        at = np.concatenate([rows[s] for s in spans])
        if not len(at):
            continue
        score = np.bincount(at, np.concatenate([by[s] for s in spans]) * np.repeat(q_weights[lo:hi], edge[c + 1] - edge[c]), minlength=wide)
        # The k-th of the groups' greatest is at most the k-th of all.
        top = score.reshape(-1, group).max(axis=1)
        least = np.partition(top, -k)[-k] if len(top) > k else 0.0
        i = np.flatnonzero((score >= least - 2 * 10.0**-PLACES) & (score > 0))
        s = np.round(score[i], PLACES)
        take = np.lexsort((i, -s))[:k]
        out.append((np.full(len(take), q), i[take], s[take]))
        if len(out) == 10_000:
            yield tuple(map(np.concatenate, zip(*out)))
            out = []
    if out:
        yield tuple(map(np.concatenate, zip(*out)))
