"""Text encoders, keyphrases and saved indexes: the pluggable parts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v

Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoding(docs: DataFrame, dim: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, embedding: signed hashed word counts of unit length, wholly in the JVM.

    Offline stand-in for a sentence encoder; similar texts get similar vectors.
    A text without words has the zero vector.
    """
    h = F.xxhash64("w")
    words = docs.select(id_col, F.explode_outer(t.word_tokens(F.col(text_col))).alias("w"))
    cells = words.select(id_col, F.pmod(h, F.lit(dim)).cast("int").alias("c"), F.when(F.col("w").isNull(), F.lit(0.0)).when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("x"))
    sums = cells.groupBy(id_col, "c").agg(F.sum("x").alias("x"))
    by = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("c", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return by.select(id_col, v.l2_normalize(dense).cast("array<float>").alias("embedding"))


def encode(docs: DataFrame, encoder: Encoder, batch: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, embedding by an injected model: Arrow batches, ``batch`` texts at a time, unit length."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            rows: list = []
            for lo in range(0, len(s), batch):
                m = np.asarray(encoder(s.iloc[lo : lo + batch].fillna("").tolist()), "f4")
                n = np.linalg.norm(m, axis=1, keepdims=True)
                rows += list(np.divide(m, n, out=np.zeros_like(m), where=n > 0))
            yield pd.Series(rows)

    return docs.select(id_col, run(text_col).alias("embedding"))


def keyphrases(joined: DataFrame, extract: Callable[[str], list[tuple[str, float]]] | None = None, cluster: str = "cluster") -> DataFrame:
    """cluster, keyword_scores (phrase -> score to 4 places) by an injected extractor; none: empty maps."""
    if extract is None:
        return joined.select(cluster, F.create_map().cast("map<string,double>").alias("keyword_scores"))

    @F.udf("map<string,double>")
    def run(text: str | None) -> dict[str, float]:
        return {p: round(float(s), 4) for p, s in extract(text or "")}

    return joined.select(cluster, run("text").alias("keyword_scores"))


def keyphrase_extractor(encoder: Encoder, longest: int = 2, top_n: int = 10, stop: tuple[str, ...] = t.ENGLISH_STOP) -> Callable[[str], list[tuple[str, float]]]:
    """An extractor for keyphrases(): the n-grams whose vectors lie nearest to the whole text's (ties by phrase)."""

    def extract(text: str) -> list[tuple[str, float]]:
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
        phrases = sorted({" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)})
        if not phrases:
            return []
        m = np.asarray(encoder([text, *phrases]), "f8")
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        score = m[1:] @ m[0]
        return [(phrases[i], float(score[i])) for i in np.argsort(-score, kind="stable")[:top_n]]

    return extract


def saved(spark: SparkSession, path: str, expected_rows: int, build: Callable[[], DataFrame]) -> DataFrame:
    """A saved table, built anew if it is missing, unreadable or of another number of rows."""
    try:
        found = spark.read.parquet(path)
        if found.count() == expected_rows:
            return found
    except Exception as e:  # missing or damaged: rebuilt below
        spark._jvm.org.slf4j.LoggerFactory.getLogger("lexigrove").info(f"rebuilding {path}: {type(e).__name__}")
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
