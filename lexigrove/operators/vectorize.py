"""TF-IDF and BM25 in long form (id, term, weight), with vocabulary pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


#: A vocabulary of at most so many terms is broadcast (some 40 bytes each); longer or unbounded ones are joined by a shuffle.
MAX_BROADCAST_TERMS = 1 << 20


def term_counts(docs: DataFrame, longest: int = 2, stop: tuple[str, ...] = t.ENGLISH_STOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf); counted within each document, so hot terms don't meet here.

    Texts are dealt by id before they are taken apart: they are smaller than their
    n-grams, which then need no further exchange to be counted or normed by id.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = t.ngrams(t.word_tokens(F.col(text_col), stop), longest)
    return docs.select(id_col, text_col).repartition(n, id_col).select(id_col, F.explode(terms).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, cf): min_df <= df <= max_df * n, then the most frequent, ties by term."""
    v = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is None:
        return v
    v = v.orderBy(F.desc("cf"), "term").limit(max_features)
    return F.broadcast(v) if max_features <= MAX_BROADCAST_TERMS else v


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: int, id_col: str = "doc_id") -> DataFrame:
    """tf * (ln((1+n)/(1+df)) + 1), each row of unit length."""
    w = counts.join(vocab.select("term", "df"), "term").withColumn("w", F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def bm25(counts: DataFrame, vocab: DataFrame, n_docs: int, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """Okapi weights; lengths and their mean are taken after pruning, over all documents."""
    # What is left after pruning has as many words as the vocabulary has occurrences.
    total = vocab.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total"))
    avg = F.when(F.col("total") > 0, F.col("total") / F.lit(float(max(n_docs, 1)))).otherwise(F.lit(1.0))
    idf = F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    j = counts.join(vocab.select("term", "df"), "term").withColumn("len", F.sum("tf").over(Window.partitionBy(id_col))).join(F.broadcast(total.select(avg.alias("avg"))))
    return j.select(id_col, "term", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))).alias("weight"))


def query_weights(queries: DataFrame, vocab: DataFrame, n_docs: int, longest: int = 2, stop: tuple[str, ...] = t.ENGLISH_STOP, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """Queries in the corpus's space: unseen terms drop out."""
    return tfidf(term_counts(queries, longest, stop, id_col, text_col), vocab, n_docs, id_col)


def rank_by_similarity(weights: DataFrame, query: DataFrame, corpus_ids: DataFrame, queries: DataFrame, top_k: int, id_col: str = "doc_id", query_col: str = "query_id", key: Column | None = None) -> DataFrame:
    """query, id, similarity, rank: the top_k by cosine, ties by id; zero rows fill up.

    Only rows with a common term are joined.  The first 2 * top_k ids are enough to
    fill up from, whatever rows of them have a similarity already.
    """
    hit = query.select(query_col, "term", F.col("weight").alias("qw")).join(weights, "term").groupBy(query_col, id_col).agg(F.round(F.sum(F.col("qw") * F.col("weight")), 12).alias("similarity"))
    fill = queries.select(query_col).distinct().join(F.broadcast(corpus_ids.select(id_col).distinct().orderBy(id_col).limit(2 * top_k)))
    zero = fill.withColumn("similarity", F.lit(0.0))
    w = Window.partitionBy(query_col).orderBy(F.desc("similarity"), id_col)
    both = hit.union(zero.select(hit.columns)).groupBy(query_col, id_col).agg(F.max("similarity").alias("similarity"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
