"""Vector functions on array columns, in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


# The palette, and the colours of noise and of clusters without points.
PALETTE = ("#1f77b4", "#d62728", "#2ca02c", "#ff7f0e", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")
NOISE_COLOR, NO_POINTS_COLOR = "#b8b8b8", "#999999"


def cluster_color(cluster: Column) -> Column:
    palette = F.array(*(F.lit(x) for x in PALETTE))
    return F.when(cluster == -1, F.lit(NOISE_COLOR)).otherwise(F.element_at(palette, (F.pmod(cluster, F.lit(len(PALETTE))) + 1).cast("int")))


# Thresholds and sentences of the interpretation.
HIGH, MODERATE = 0.75, 0.55
BANDS = ("High similarity to prior art in this corpus.", "Moderate similarity to prior art in this corpus.", "Relatively novel with respect to this corpus.")


def interpretation(similarity: Column) -> Column:
    return F.when(similarity >= HIGH, F.lit(BANDS[0])).when(similarity >= MODERATE, F.lit(BANDS[1])).otherwise(F.lit(BANDS[2]))


def scale(x: Column, low: Column, high: Column, size: float, pad: float, invert: bool = False) -> Column:
    """Linear map of [low, high] to [pad, size - pad]; the middle if they are equal."""
    share = (x - low) / (high - low)
    at = pad + ((1 - share) if invert else share) * (size - 2 * pad)
    return F.when(high == low, F.lit(size / 2)).otherwise(at)
