"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a fixed hashed order and cut into blocks.
With a share w of all weights, the source's i-th block may run from slot
floor(i/w) and must have run before slot ceil((i+1)/w); the earliest deadline goes
first (ties: the source that stands first by name).  At every slot each source has
then had its exact share but for less than one block.

Shares are exact fractions of the given weights.  Shares rounded to a period are
used for a phase only where every block still keeps its exact window.  When a source
has no blocks left, a new phase begins with the weights of the rest, so every
document gets a slot.  The driver schedules blocks one by one and holds three
numbers for each; they reach the documents by a broadcast.

Defined results: a null source is the source ''; repeated rows and rows with a null id
keep a slot each; ties in the hashed order are settled by id and a hash of the text,
null texts first; texts of any length are carried whole and never read; an empty table gives no
rows; a source missing from given weights gets the smallest given weight.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: Buckets of the hashed order within a source, each ranked by itself; sources of more rows than these hold have more.
BUCKETS, BUCKET_ROWS = 1024, 1 << 14
#: Consecutive blocks of a source in one row of the plan.
CHUNK = 1024
#: Blocks of a plan that is broadcast (32 bytes each); longer plans are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 1 << 21


def integer_weights(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Shares of ``period`` in proportion to the weights, at least 1 each (largest remainders)."""
    total = float(sum(weights.values()))
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(out.values()) >= period:
            break
        out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def edf(weights: Mapping[str, int], period: int) -> dict[str, list[int]]:
    """For each source the slots of its blocks within one period."""
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []  # by deadline
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            i = len(slots[s])
            heapq.heappush(ready, (-(-(i + 1) * period // weights[s]), s))
        if not ready:
            continue
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        i = len(slots[s])
        if i < weights[s]:
            heapq.heappush(waiting, (i * period // weights[s], s))
    return slots


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in parts.values()))
    out = {s: int(x * scale) for s, x in parts.items()}
    common = math.gcd(*out.values())
    return {s: w // common for s, w in out.items()}


def run_phase(left: Mapping[str, int], weights: Mapping[str, int], target: Mapping[str, int] | None = None) -> dict[str, tuple[array, array, array]] | None:
    """By source the slots, releases and deadlines of its blocks until the first source of ``left`` runs out.

    With ``target`` weights: None as soon as a block misses its window under those.
    """
    size, goal = sum(weights.values()), sum((target or weights).values())
    out = {s: (array("q"), array("q"), array("q")) for s in left}
    waiting = [(0, s) for s in sorted(left)]  # by release
    ready: list[tuple[int, str]] = []  # by deadline
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            release, s = heapq.heappop(waiting)
            slots, releases, deadlines = out[s]
            deadline = -(-(len(slots) + 1) * size // weights[s])
            releases.append(release)
            deadlines.append(deadline)
            heapq.heappush(ready, (deadline, s))
        _, s = heapq.heappop(ready)  # never empty: the shares fill every slot
        slots = out[s][0]
        i = len(slots)
        if target is not None and not i * goal // target[s] <= t < -(-(i + 1) * goal // target[s]):
            return None
        slots.append(t)
        t += 1
        if i + 1 == left[s]:
            break
        heapq.heappush(waiting, ((i + 1) * size // weights[s], s))
    # A block that is due but hasn't run by the end would be a whole block behind.
    if target is not None and any((len(out[s][0]) + 1) * goal <= t * target[s] for s in left):
        return None
    return {s: (x, y[: len(x)], z[: len(x)]) for s, (x, y, z) in out.items()}


def plan(blocks: Mapping[str, int], weights: Mapping[str, float], period: int) -> dict[str, list[np.ndarray]]:
    """By source four arrays over its blocks: phase, slot, release, deadline."""
    left, base, phase = {s: n for s, n in blocks.items() if n}, 0, 0
    out = {s: [array("q") for _ in range(4)] for s in left}
    while left:
        exact = exact_weights({s: weights[s] for s in left})
        total, found = sum(exact.values()), None
        if all(w * period >= total for w in exact.values()):
            found = run_phase(left, integer_weights({s: weights[s] for s in left}, period), exact)
        found = found or run_phase(left, exact)
        for s, (slots, releases, deadlines) in found.items():
            out[s][0].extend([phase] * len(slots))
            for own, part in zip(out[s][1:], (slots, releases, deadlines)):
                own.extend(x + base for x in part)
            left[s] -= len(slots)
            if not left[s]:
                del left[s]
        base += sum(len(x) for x, _, _ in found.values())
        phase += 1
    return {s: [np.frombuffer(x, np.int64) for x in columns] for s, columns in out.items()}


PLAN = ("phase", "slot", "release", "deadline")
PLAN_SCHEMA = T.StructType([T.StructField("__s", T.StringType()), T.StructField("__chunk", T.LongType()), *(T.StructField(f"__{c}s", T.ArrayType(T.LongType())) for c in PLAN)])


def plan_table(planned: Mapping[str, list[np.ndarray]]) -> pa.Table:
    """A row for each source and chunk of blocks."""
    keys = [(s, k) for s, x in planned.items() for k in range(-(-len(x[0]) // CHUNK))]
    edges = np.cumsum([0, *(min(CHUNK, len(planned[s][0]) - k * CHUNK) for s, k in keys)])
    lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x[c] for x in planned.values())]))) for c in range(len(PLAN))]
    return pa.table([pa.array([s for s, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int64()), *lists], names=PLAN_SCHEMA.names)


OUT = ("block", "phase", "slot", "release", "deadline", "place")


def _scheduled(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = 16, period: int = 1000, max_sources: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tempering: float = 0.5) -> DataFrame:
    """``docs`` with the columns of OUT, each named with two underscores before it."""
    spark = docs.sparkSession
    # Rows without an id are told apart by their texts, else all would have one place in the order.
    h = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(F.col(id_col)))
    rows = docs.withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("__h", h)
    sizes = {r["__source"]: r["n"] for r in rows.groupBy("__source").agg(F.count("*").alias("n")).limit(max_sources + 1).collect()}
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    large = {s: -(-n // BUCKET_ROWS) for s, n in sizes.items() if n > BUCKETS * BUCKET_ROWS}
    buckets = F.coalesce(F.create_map(*(F.lit(x) for pair in large.items() for x in pair))[F.col("__source")], F.lit(BUCKETS)) if large else F.lit(BUCKETS)
    rows = rows.withColumn("__bucket", F.pmod("__h", buckets).cast("int"))
    parts = rows.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    if weights is None:
        weights = {s: n**tempering for s, n in sizes.items()}
    least = min((w for w in weights.values() if w > 0), default=1.0)
    weights = {s: weights.get(s) if (weights.get(s) or 0) > 0 else least for s in sizes}
    blocks = {s: -(-n // block_docs) for s, n in sizes.items()}
    table = spark.createDataFrame(plan_table(plan(blocks, weights, period)), PLAN_SCHEMA)

    order = Window.partitionBy("__source", "__bucket").orderBy("__h", F.col(id_col), F.xxhash64(F.col(text_col)))
    ranked = rows.withColumn("__rank", F.row_number().over(order) - 1).join(starts, ["__source", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__start"))
    ranked = ranked.withColumn("__block", F.floor(F.col("__rank") / block_docs).cast("long")).withColumn("__place", F.pmod("__rank", F.lit(block_docs)).cast("long"))
    # Rows of the plan are as many documents apart, so its join has no hot key where it is too large to broadcast.
    table = F.broadcast(table) if sum(blocks.values()) <= MAX_BROADCAST_BLOCKS else table
    out = ranked.withColumn("__chunk", F.expr(f"__block div {CHUNK}")).join(table.withColumnRenamed("__s", "__source"), ["__source", "__chunk"])
    return out.withColumns({f"__{c}": F.get(f"__{c}s", F.pmod("__block", F.lit(CHUNK)).cast("int")) for c in PLAN})


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = 16, period: int = 1000, max_sources: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tempering: float = 0.5) -> DataFrame:
    """``docs`` with block, phase, slot, release, deadline and place (within the block).

    ``weights``: target weight by source; by default each source's number of
    documents to the power ``tempering``, which evens out large and small ones.
    ``period``: slots of a round of rounded shares, where these keep the exact windows.
    Columns of ``docs`` with these names give way to the new ones.
    """
    rows = _scheduled(docs, weights, block_docs, period, max_sources, id_col, source_col, text_col, tempering)
    return rows.select(*(c for c in docs.columns if c not in OUT), *(F.col(f"__{c}").alias(c) for c in OUT))


def in_order(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = 16, period: int = 1000, max_sources: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tempering: float = 0.5) -> DataFrame:
    """``docs`` as they are, all of them, sorted by slot and place (files and rows in mixed order)."""
    rows = _scheduled(docs, weights, block_docs, period, max_sources, id_col, source_col, text_col, tempering)
    return rows.orderBy("__slot", "__place").select(*docs.columns)


def with_places(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with slot and place, which say the mixed order however its files are read; sorted by them."""
    rest = [c for c in docs.columns if c not in ("slot", "place")]
    rows = _scheduled(docs, **how)
    return rows.orderBy("__slot", "__place").select(*rest, F.col("__slot").alias("slot"), F.col("__place").alias("place"))
