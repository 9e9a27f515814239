"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct 5-word shingles as 64-bit hashes; documents
with equal sets are one class.  The join is exact:

1. Similar documents are partitioned into groups: classes that share one of a few
   minimum hashes are verified against the smallest class of that hash; the components
   of those links are groups, and so are the other classes that share a minimum hash,
   all cut into blocks.
2. The matrix keeps each group's token union, over prefix tokens: the first ones in
   one global order of tokens (tokens of few documents first).  Of two sets that link,
   the smaller has a token in the matrix that the larger looks up (see prefixes).
3. A query class and a group of another component that share s tokens can link only
   if s and what lies beyond the prefixes reach the intersection needed, and if the
   group's whole union holds enough of the query; only such groups are opened, and
   every size-compatible member is verified.

Pairs within a component are never compared again, so a group of many near copies
costs as many comparisons as it has members.  Tokens in ``HOT_DF`` documents or
more come last in the order, so common passages hardly ever meet in the matrix;
the set of those is bounded by ``MAX_HOT`` (a higher limit is used beyond it),
which changes the order alone and never the result.

Before groups are opened, bitmaps of four to eight bits a token bound each pair's
intersection from above; only what passes has its whole sets read, in a second scan.

Sets are compared by 64-bit hashes of shingles, so "exact" means: unless two different
shingles of the documents compared share a hash, or more than one pair of a document's
shingles shares 42 bits of it right at the limit.

Defined results: null or empty texts, or texts without words, have no shingles and
link with nothing; rows that repeat an id with another text are one node with the
links of each; null ids link with nothing; texts of any length are read whole; of
documents with equal sets the smallest id stands for all; an empty table gives no rows;
other columns are never read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, drop_tables, ids_and_text, materialize, may_hold, scratch, slices, text_bytes
from .graph import components

#: Similarity in percent, and words of a shingle.
PERCENT, WORDS = 75, 5
HOT_DF, MAX_HOT = 64, 1 << 20
#: Members of a block; members verified by one task.
BLOCK, STAR = 64, 128
#: Tokens beyond the least prefixes, in percent of the set.
SPARE = 6
#: Bits of a hash that stand for it in prefixes, and bytes of input for each bucket of packed tokens.
KEY_BITS, BUCKET_BYTES = 42, 8 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    m = len(w) - k + 1
    s = np.full(m, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i : i + m]) * np.uint64(0x9FB21C651E98DF25)
        s ^= s >> np.uint64(32)
    return np.unique(s)


def needed(n: int, percent: int = PERCENT) -> int:
    """Least intersection of a set of n tokens with any that it links with."""
    return -(-n * percent // 100)


def prefixes(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Tokens of a set of n that the matrix holds, and that a query of n tokens looks up.

    The smaller set of a link has at least 2t/(1+t) of its tokens in common, so the
    matrix can do with fewer.  SPARE tokens more on both sides make the counts tell more.
    """
    spare = n * SPARE // 100 + 1
    return min(n, n - -(-n * 2 * percent // (100 + percent)) + spare), min(n, n - needed(n, percent) + spare)


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def bucket_bits(size: int) -> int:
    """Bits of a token that name its bucket: a bucket holds a few MB, whatever the size of the input."""
    return min(KEY_BITS - 24, max(10, math.ceil(math.log2(max(1, size) / BUCKET_BYTES))))


def _packets(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Runs of equal (sorted) buckets: the buckets and their ranges."""
    edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    return bucket[edges[:-1]], list(zip(edges, edges[1:]))


def token_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(token, df): tokens in HOT_DF documents or more, by their first ``bits`` + 24 bits.

    Tokens travel packed, three bytes each, in rows of one for each bucket.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in slices(b):
                all_ = np.sort(np.concatenate([np.zeros(0, np.uint64), *(shingles(t) for t in texts)])) >> np.uint64(40 - bits)
                if not len(all_):
                    continue
                own, cut = _packets((all_ >> np.uint64(24)).astype(np.int32))
                low = np.ascontiguousarray(all_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([low[i:j].tobytes() for i, j in cut], pa.binary())], names=["bucket", "tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(k, []).append(t)
        for k in list(held):
            raw = np.frombuffer(b"".join(held.pop(k)), np.uint8).reshape(-1, 3)
            low = np.zeros((len(raw), 4), np.uint8)
            low[:, :3] = raw
            t, n = np.unique(low.view("<u4").ravel(), return_counts=True)
            hot = n >= HOT_DF
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(k) << 24) | t[hot].astype(np.int64)), pa.array(n[hot].astype(np.int64))], names=["token", "df"])

    return docs.mapInArrow(pack, "bucket int, tokens binary").repartition("bucket").mapInArrow(count, "token long, df long")


def hot_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent tokens, at most MAX_HOT, in order, the power of two of each one's df, and their bits."""
    bits = bucket_bits(text_bytes(docs))
    with scratch(docs.sparkSession) as space:
        counts = materialize(token_counts(docs, bits), "token-counts", space).withColumn("k", F.floor(F.log2("df")).cast("int"))
        per = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.count("*").alias("n")).collect()}
        total, least = 0, None
        for k in sorted(per, reverse=True):
            total += per[k]
            if total > MAX_HOT:
                break
            least = k
        if least is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int8), bits + 24
        found = counts.where(F.col("k") >= least).select("token", "k").toArrow()
        token, k = found.column(0).to_numpy(), found.column(1).to_numpy()
        order = np.argsort(token)
        return token[order], k[order].astype(np.int8), bits + 24


SIGNATURES = "doc_id long, n long, s1 long, s2 long, mins array<long>, cold binary, n_index int, hot array<long>, n_hot_index int, sketch binary"


def signatures(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """For each row: set size, 128-bit hash of the set, minimum hashes, prefix tokens.

    Prefix tokens are 42 bits of the hash (equal ones make a shared count too high at
    most, never too low): cold ones in 6 bytes each, then hot ones by rising df; the
    first n_index and n_hot_index are those of the matrix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, level, bits = shared.value
        for b in batches:
            for part, texts in slices(b):
                n, sig, mins, cold, warm, own, drawn = [], [], [], [], [], [], []
                for t in texts:
                    s = shingles(t)
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    drawn.append(sketch(s))
                    if not len(s):
                        mins.append([]), cold.append(b""), warm.append([]), own.append((0, 0))
                        continue
                    m = s * _MULT[:, None]
                    m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    mins.append(m.min(axis=1).view(np.int64).tolist())
                    index, probe = prefixes(len(s))
                    # One order for all documents: by the power of two of df, then by the 42 bits.
                    key = np.unique((s >> np.uint64(64 - KEY_BITS)).astype(np.int64))
                    seen = key >> (KEY_BITS - bits)
                    at = np.minimum(np.searchsorted(hot, seen), max(len(hot) - 1, 0))
                    is_hot = hot[at] == seen if len(hot) else np.zeros(len(key), bool)
                    first = key[~is_hot][:probe]
                    cold.append(first.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                    late = key[is_hot]
                    late = late[np.argsort(level[at[is_hot]], kind="stable")][: probe - len(first)]
                    warm.append(late.tolist())
                    own.append((min(len(first), index), max(0, min(len(late), index - len(first)))))
                halves = np.frombuffer(b"".join(sig), np.int64).reshape(-1, 2)
                i, j = zip(*own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(mins, pa.list_(pa.int64())), pa.array(cold, pa.binary()), pa.array(i, pa.int32()), pa.array(warm, pa.list_(pa.int64())), pa.array(j, pa.int32()), pa.array(drawn, pa.binary())],
                    names=[x.split()[0] for x in SIGNATURES.split(", ")],
                )

    return docs.mapInArrow(run, SIGNATURES)


def cold_postings(sigs: DataFrame) -> DataFrame:
    """(token, rep, held) of the cold prefix tokens that several rows share; held: in the matrix.

    Tokens and ids travel packed by bucket, four bytes each where a packet's ids lie close together.
    """
    rows = sigs.where("n > 0 and doc_id is not null").select("doc_id", "cold", "n_index")
    low_bits = KEY_BITS - bucket_bits(rows.agg(F.sum(F.length("cold"))).first()[0] or 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cold, index = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for lo in range(0, len(ids), 2000):
                part = cold[lo : lo + 2000]
                raw = np.frombuffer(b"".join(part), np.uint8).reshape(-1, 6)
                if not len(raw):
                    continue
                size = np.array([len(x) // 6 for x in part])
                t = np.zeros((len(raw), 8), np.uint8)
                t[:, :6] = raw
                t = t.view("<i8").ravel()
                who = np.repeat(ids[lo : lo + 2000], size)
                place = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
                held = place < np.repeat(index[lo : lo + 2000], size)
                order = np.argsort(t)
                t, who, held = t[order], who[order], held[order]
                own, cut = _packets((t >> low_bits).astype(np.int32))
                low = (t & ((1 << low_bits) - 1)).astype(np.uint32)
                base = [int(who[i:j].min()) for i, j in cut]
                near = [int(who[i:j].max()) - x < 1 << 32 for (i, j), x in zip(cut, base)]
                near_ids = [(who[i:j] - x).astype(np.uint32).tobytes() if k else who[i:j].tobytes() for (i, j), x, k in zip(cut, base, near)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array([low[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([x if k else None for x, k in zip(base, near)], pa.int64()), pa.array(near_ids, pa.binary()), pa.array([np.packbits(held[i:j]).tobytes() for i, j in cut], pa.binary())],
                    names=["bucket", "tokens", "base", "ids", "held"],
                )

    def unpack(t: bytes, base: int | None, ids: bytes, held: bytes) -> tuple:
        who = np.frombuffer(ids, np.int64) if base is None else np.frombuffer(ids, np.uint32).astype(np.int64) + base
        return np.frombuffer(t, np.uint32), who, np.unpackbits(np.frombuffer(held, np.uint8), count=len(who))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                kept.setdefault(k, []).append(row)
        for k in list(kept):
            t, who, held = (np.concatenate(x) for x in zip(*(unpack(*row) for row in kept.pop(k))))
            order = np.lexsort((who, t))
            t, who, held = t[order], who[order], held[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (who[1:] != who[:-1])
            t, who, held = t[new], who[new], held[new]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            n = np.diff([*first, len(t)])
            keep = np.repeat((n > 1) & (np.add.reduceat(held.astype(np.int64), first) > 0), n)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(k) << low_bits) | t[keep].astype(np.int64)), pa.array(who[keep]), pa.array(held[keep] > 0)], names=["token", "rep", "held"])

    return rows.mapInArrow(pack, "bucket int, tokens binary, base long, ids binary, held binary").repartition("bucket").mapInArrow(meet, "token long, rep long, held boolean")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, tokens) for the rows whose id may be in ``ids`` (column id): a second scan.

    A bit filter is broadcast; what else it lets through is dropped by later joins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64("id").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            b = b.filter(pa.array(may_hold(table, b.column(2).to_numpy())))
            for part, texts in slices(b):
                sets = [shingles(t).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "tokens"])

    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    return rows.mapInArrow(run, "rep long, tokens binary")


def sketch(s: np.ndarray) -> bytes:
    """The size of a set and a bitmap of its tokens, four to eight bits each."""
    bits = 1 << max(6, (4 * len(s) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return len(s).to_bytes(8, "little") + np.packbits(marks, bitorder="little").tobytes()


def _marks(x: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(x[:8], "little"), np.frombuffer(x, np.uint64, offset=8)


def most_common(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> int:
    """At most so many tokens are in both sets: each mark of one that the other lacks is a token for itself."""
    (n, x), (m, y) = a, b
    k = min(len(x), len(y))
    if len(x) != len(y):  # the longer bitmap is folded to the length of the shorter
        x, y = (np.bitwise_or.reduce(v.reshape(-1, k), axis=0) for v in (x, y))
    both = int(np.bitwise_count(x & y).sum())
    return min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum())) + both


def deal(pairs: DataFrame, members: DataFrame, sets: DataFrame, space: list[str]) -> DataFrame:
    """Rows (g, part, q, rep, one, tokens) by group and part: members first (q null), then queries.

    A group with many queries is dealt over several tasks.
    """
    parts = pairs.groupBy("g").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    held = members.join(parts, "g").select("g", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(None).cast("long").alias("q"), "rep", "one")
    many = materialize(parts.where("parts > 1"), "parts", space)
    asked = pairs.join(many, "g", "left").select("g", F.pmod(F.xxhash64("q"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "q", F.col("q").alias("rep"), F.lit(False).alias("one"))
    rows = held.union(asked).join(sets, "rep").select("g", "part", "q", "rep", "one", "tokens")
    return rows.repartition("g", "part").sortWithinPartitions("g", "part", F.col("q").asc_nulls_first())


def verify(docs: DataFrame, pairs: DataFrame, members: DataFrame, sketches: DataFrame, space: list[str], percent: int = PERCENT) -> DataFrame:
    """Open groups: pairs (g, q) and members (g, rep, one) -> the links (a, b) of q with members.

    First the members' bitmaps, a sixteenth of their sets, tell which queries can reach
    any of them; the whole sets of the others are never read.  A task holds one group's
    sets (a block of them at most) and their union; queries pass by one at a time, and
    only those that the union can satisfy meet the members.  ``one``: the members are
    linked already, so a single link is enough.
    """

    def fits(n: int, m: int, common: int) -> bool:
        return 100 * min(n, m) >= percent * max(n, m) and 100 * common >= percent * (n + m - common)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            g_out, q_out = [], []
            for g, part, q, rep, _, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, part) != key:
                    key, own = (g, part), []
                t = _marks(t)
                if q is None:
                    own.append((rep, t))
                elif any(rep != q and fits(x[0], t[0], most_common(x, t)) for rep, x in own):
                    g_out.append(g)
                    q_out.append(q)
            if g_out:
                yield pa.RecordBatch.from_arrays([pa.array(g_out, pa.int64()), pa.array(q_out, pa.int64())], names=["g", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, union, one = None, [], None, False
        for batch in batches:
            a_out, b_out = [], []
            for g, part, q, rep, single, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, part) != key:
                    key, own, union = (g, part), [], None
                t = np.frombuffer(t, np.uint64)
                if q is None:
                    own.append((rep, t))
                    one = single
                    continue
                if union is None:
                    union = own[0][1] if len(own) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, x in own)]))
                if not len(union):
                    continue
                at = np.minimum(np.searchsorted(union, t), len(union) - 1)
                if 100 * np.count_nonzero(union[at] == t) < percent * len(t):
                    continue
                for rep, x in own:
                    if rep != q and 100 * min(len(x), len(t)) >= percent * max(len(x), len(t)) and links(x, t, percent):
                        a_out.append(rep)
                        b_out.append(q)
                        if one:
                            break
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    with scratch(docs.sparkSession) as own_space:
        pairs = materialize(pairs, "pairs", own_space)
        drawn = sketches.select(F.col("doc_id").alias("rep"), F.col("sketch").alias("tokens"))
        left = materialize(deal(pairs, members, drawn, own_space).mapInArrow(sift, "g long, q long").distinct(), "sifted", own_space)
        held = materialize(members.join(left.select("g").distinct(), "g"), "opened", own_space)
        ids = held.select(F.col("rep").alias("id")).union(left.select(F.col("q").alias("id")))
        return materialize(deal(left, held, sets_of(docs, ids), own_space).mapInArrow(run, "a long, b long"), "verified", space)


def _close(n: str, m: str) -> Column:
    return F.expr(f"100 * {n} >= {PERCENT} * {m} and 100 * {m} >= {PERCENT} * {n}")


def _bound(m: str, slack: int = 0) -> str:
    """SQL: s shared prefix tokens leave room for the intersection that sizes qn and m need.

    Beyond the prefix that ends first, at most that set's remaining tokens can be shared.
    """
    rest_q = f"(qn * {PERCENT} + 99) div 100 - qn * {SPARE} div 100 - 1"
    rest_m = f"({m} * {2 * PERCENT} + {99 + PERCENT}) div {100 + PERCENT} - {m} * {SPARE} div 100 - 1"
    return f"s + {slack} + greatest({rest_q}, {rest_m}, 0) >= ({PERCENT} * (qn + {m}) + {99 + PERCENT}) div {100 + PERCENT}"


def _opens() -> str:
    """SQL: the bound holds for some size from low to high.

    But for its roundings the room less the need is convex in the size, so largest at an
    end; the roundings (two up in the room, one up in the need) can hide at most 2.
    """
    ends = f"({_bound('low')}) or ({_bound('high')})"
    near = f"({_bound('low', 2)}) or ({_bound('high', 2)})"
    return f"{ends} or (high - low > 1 and ({near}) and exists(sequence(low + 1, high - 1), m -> {_bound('m')}))"


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    docs = ids_and_text(documents, id_col, text_col)
    with scratch(docs.sparkSession) as space, scratch(docs.sparkSession) as first_space:
        sigs = materialize(signatures(docs, hot_tokens(docs)), "signatures", first_space)
        met_cold = materialize(cold_postings(sigs), "cold-postings", space)
        # The cold tokens, most of the table, have done their part.
        sketches = materialize(sigs.where("n > 0 and doc_id is not null").select("doc_id", "sketch"), "sketches", space)
        sigs = materialize(sigs.drop("cold", "n_index", "sketch"), "rows", space)
        drop_tables(docs.sparkSession, first_space)
        some = sigs.where("n > 0 and doc_id is not null")
        classes = materialize(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes", space)
        reps = classes.select("rep", "n").distinct()

        # 1. Groups of similar classes.
        mins = some.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).where("doc_id = rep").select("rep", "n", F.posexplode("mins").alias("k", "v")).distinct()
        mins = materialize(mins, "minimums", space)
        first = mins.groupBy("k", "v").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
        met = mins.join(materialize(first, "leaders", space), ["k", "v"])
        pairs = met.where((F.col("rep") != F.col("lead.rep")) & _close("n", "lead.n")).select(F.col("lead.rep").alias("g"), F.col("rep").alias("q")).distinct()
        near = verify(docs, pairs, pairs.select("g", F.col("g").alias("rep"), F.lit(True).alias("one")).distinct(), sketches, space)
        comp = components(near, space=space)
        # Classes without a link are grouped by the minimum hash that most share.
        most = met.groupBy("rep").agg(F.max(F.struct("c", F.xxhash64("k", "v").alias("key"))).alias("m")).select("rep", F.col("m.key").alias("key"))
        group = reps.join(comp, F.col("rep") == F.col("node"), "left").join(most, "rep", "left")
        group = group.select("rep", "n", F.coalesce("component", "rep").alias("component"), F.col("component").isNotNull().alias("one"), F.coalesce("component", "key", "rep").alias("set"))
        # Written first: both sides of the join are then dealt anew, and a hot set's partition can be split.
        group = materialize(group, "sets-of-classes", space)
        sizes = materialize(group.groupBy("set").agg(F.count("*").alias("size")).where("size > 1"), "set-sizes", space)
        alone = F.col("size").isNull()
        group = group.join(sizes, "set", "left").select(
            "rep", "n", "component", "one", F.when(alone, F.col("rep")).otherwise(F.col("set")).alias("set"),
            F.when(alone, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK))).cast("int").alias("block"),
        ).withColumn("g", F.xxhash64("set", "block"))
        group = materialize(group, "matrix-groups", space)

        # 2. The matrix: tokens by group, and what queries share with it.
        warm = some.where(F.size("hot") > 0).join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).where("doc_id = rep")
        warm = warm.select(F.posexplode("hot").alias("place", "token"), "rep", "n_hot_index").select("token", "rep", (F.col("place") < F.col("n_hot_index")).alias("held"))
        posts = materialize(met_cold.union(warm).join(group, "rep"), "postings", space)
        shared = posts.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("held").alias("held")).where("x <> y and held").select("token")
        posts = posts.join(shared, "token")
        matrix = posts.where("held").groupBy("token", "set", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        query = posts.select("token", F.col("rep").alias("q"), F.col("n").alias("qn"), F.col("component").alias("own"))
        # A query looks for sets of its own size or less.
        met = query.join(matrix, "token").where(f"own <> set and low <= qn and 100 * high >= {PERCENT} * qn")
        met = met.groupBy("q", "qn", "g").agg(F.count("*").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
        # 3. The bound, over the sizes that a member can have.
        met = met.withColumn("low", F.greatest("low", F.expr(f"(qn * {PERCENT} + 99) div 100"))).withColumn("high", F.least("high", "qn"))
        pairs = met.where(_opens()).select("g", "q")
        more = verify(docs, pairs, group.select("g", "rep", "one"), sketches, space)

        final = components(more.union(comp.select("component", "node")), space=space)
        named = classes.join(final, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("c"))
        # A row's class may have a smaller id than the row; both are in one component.
        out = sigs.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
        linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        return materialize(out.withColumn("kept", F.expr("doc_id <=> component_id")), "near-duplicates")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
