"""Retrieval for question answering: chunks, ranking, context and the answer without a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import knn
from .space import Space

# The answers given without a language model, and the prompt's chunk header.
NOTHING_FOUND = "No supporting passages were retrieved from the patent corpus."
ANSWER = (
    "LLM generation is unavailable, so this is a retrieval-only response. The question appears most related to these domains: ",
    ". The strongest supporting patents retrieved were ",
    ".",
)
CONTEXT_HEADER = "[Patent %s | %s | score=%.3f]\n%s"
# What a language model is told, and how it is asked.
SYSTEM_MESSAGE = "You are a patent analysis assistant. Answer only from the provided retrieval context. Be concise, mention uncertainty when needed, and cite patent ids explicitly."
USER_MESSAGE = "Question: {question}\n\nRetrieved context:\n{context}"
TEMPERATURE = 0.2
TOP_K_RANGE = (1, 10)


def check_top_k(k: int) -> int:
    if not TOP_K_RANGE[0] <= k <= TOP_K_RANGE[1]:
        raise ValueError(f"top_k must lie in {TOP_K_RANGE[0]}..{TOP_K_RANGE[1]}")
    return k


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, chunk_index, text); indexes count the chunks that are kept."""
    return docs.select(id_col, F.posexplode(t.chunks(F.col(text_col), **how)).alias("chunk_index", "text"))


def chunk_id(id_col: str = "doc_id"):
    return F.struct(F.col(id_col).alias("doc_id"), "chunk_index")


def chunk_stats(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks, documents (those without a chunk too) and the average."""
    per = docs.select(id_col).join(chunks.groupBy(id_col).agg(F.count("*").alias("n")), id_col, "left")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count("*").alias("n_docs"), F.count_if(F.col("n").isNull()).alias("n_without"), (F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_chunks"))


def retrieve_tfidf(questions: DataFrame, chunks: DataFrame, top_k: int = 6, max_features: int = 16_000) -> DataFrame:
    """query_id, rank, doc_id, chunk_index, similarity by TF-IDF over the chunks."""
    check_top_k(top_k)
    rows = chunks.select(chunk_id().alias("chunk_id"), "text")
    ranked = Space(rows, max_features=max_features, id_col="chunk_id").rank(questions.where(t.strip(F.col("text")) != ""), top_k)
    return ranked.select("query_id", "rank", "chunk_id.doc_id", "chunk_id.chunk_index", "similarity")


def messages(question: str, text: str) -> list[dict[str, str]]:
    """The two messages that a chat model gets."""
    return [{"role": "system", "content": SYSTEM_MESSAGE}, {"role": "user", "content": USER_MESSAGE.format(question=question, context=text)}]


def retrieve_chunk_vectors(queries: DataFrame, chunk_vectors: DataFrame, top_k: int = 6) -> DataFrame:
    """query_id, rank, doc_id, chunk_index, similarity by inner product over the chunks' vectors.

    ``queries``: query_id, embedding; ``chunk_vectors``: doc_id, chunk_index, embedding.  Equal
    scores go to the smaller number of the chunk in order of (doc_id, chunk_index) hashes.
    """
    check_top_k(top_k)
    numbered = chunk_vectors.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))
    asked = queries.select(F.col("query_id").alias("chunk_id"), "embedding")
    near = knn.nearest(asked, numbered, top_k, id_col="chunk_id").withColumnRenamed("neighbor_id", "chunk_id")
    return near.join(numbered.select("chunk_id", "doc_id", "chunk_index"), "chunk_id").select("query_id", "rank", "doc_id", "chunk_index", F.col("score").alias("similarity"))


def retrieve_vector(queries: DataFrame, vectors: DataFrame, docs: DataFrame, top_k: int = 6, id_col: str = "vec_id") -> DataFrame:
    """The same by inner product; metadata by a left lookup with defaults."""
    near = knn.nearest(queries, vectors, check_top_k(top_k), id_col=id_col)
    meta = docs.select(F.col("doc_id").alias("neighbor_id"), F.col("title"), F.col("domain"))
    j = near.join(meta, "neighbor_id", "left")
    return j.select("query_id", "rank", F.col("neighbor_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("domain", F.lit("unknown")).alias("domain"), F.col("score").alias("similarity"))


def with_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    j = chunks.join(docs.select("doc_id", "title", "domain"), "doc_id", "left")
    return j.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("domain", F.coalesce("domain", F.lit("unknown")))


def top_domains(found: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, place, domain, n): the most frequent domains, ties by first rank."""
    by = found.groupBy("query_id", "domain").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "first")
    return by.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "place", "domain", "n")


def supporting_docs(found: DataFrame) -> DataFrame:
    """(query_id, place, doc_id): each document once, by its first rank."""
    by = found.groupBy("query_id", "doc_id", "title").agg(F.min("rank").alias("first"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).select("query_id", "place", "doc_id", "title")


def context(found: DataFrame) -> DataFrame:
    """query_id, context: the chunks in order of rank under their headers."""
    part = F.format_string(CONTEXT_HEADER, F.col("doc_id").cast("string"), F.col("title"), F.col("similarity"), F.col("text"))
    by = found.select("query_id", F.struct("rank", part.alias("p")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return by.select("query_id", F.array_join(F.transform("xs", lambda x: x["p"]), "\n\n").alias("context"))


def answer(questions: DataFrame, found: DataFrame, llm: Callable[[str, str], str] | None = None) -> DataFrame:
    """query_id, answer, mode.  ``llm``: an optional function (question, context) -> answer;

    where it's missing or fails, the retrieval-only sentence is given.
    """
    d = top_domains(found).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "domain"))), lambda x: x["domain"]), ", ").alias("_d"))
    s = supporting_docs(found).where(F.col("place") <= 3)
    s = s.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("doc_id").cast("string"), F.lit(" ("), F.col("title"), F.lit(")")).alias("p")))), lambda x: x["p"]), ", ").alias("_s"))
    j = questions.join(d, "query_id", "left").join(s, "query_id", "left")
    local = F.when(F.col("_d").isNull(), F.lit(NOTHING_FOUND)).otherwise(F.concat(F.lit(ANSWER[0]), "_d", F.lit(ANSWER[1]), "_s", F.lit(ANSWER[2])))
    if llm is None:
        return j.select("query_id", local.alias("answer"), F.lit("retrieval-only").alias("mode"))

    @F.udf("string")
    def ask(question: str, text: str) -> str | None:
        try:
            return llm(question, text)
        except Exception:  # a failing model falls back to the local answer
            return None

    j = j.join(context(found), "query_id", "left").withColumn("_llm", ask("text", "context"))
    return j.select("query_id", F.coalesce("_llm", local).alias("answer"), F.when(F.col("_llm").isNull(), F.lit("retrieval-only")).otherwise(F.lit("llm")).alias("mode"))
