"""Training-corpus pipeline: identify, deduplicate, cut repeats, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared checkpoint folder and read again as the next stage's docs.
The first three stages return the columns of ``documents``; mixing adds slot and place
(see op8_pfair_mix), which the result carries: sorted by (slot, place) it is in mixed
order, whatever the order in which its files are read.

Defined results: null, empty and letterless texts leave at the first stage; texts of
any length are worked on whole; of repeated rows one stays; equal documents keep the
one of the smallest id; documents with a null id stay and are mixed by their place
among null ids; an empty table gives no rows; further columns are carried, but for
slot, place, ids and n_tokens, which give way to the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import group_matrix_join, language_nb, pfair_mix, sentence_spans, sentencepiece_unigram
from lexigrove.llm.common import drop_tables, materialize, passing, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, texts of no one language, and texts unlike every language go.

    The model is of the labelled rows of ``docs``; where there are none, no row stays.
    """
    return language_nb.keep_identified(docs, language_nb.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays.

    Of rows that repeat id and text (null ids too) the one whose columns hash least
    stays; documents with a null id are compared with nothing else.
    """
    found = group_matrix_join.near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return kept
    repeated = F.col("doc_id").cast("long").eqNullSafe(F.col("__again"))
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    many = kept.join(again, repeated, "left_semi")
    # A minimum has partial results, so a third of all rows may be one document.
    one = many.groupBy(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("__row"))
    return kept.join(again, repeated, "left_anti").union(one.select("__row.*"))


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences covered by a repeated span go, but for its first place; n_chars follows."""
    cut = sentence_spans.cut_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and place in the mixing schedule."""
    return pfair_mix.with_places(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, slot and place with their piece ids (ids) and their number (n_tokens).

    Columns of these two names give way.
    """
    docs = docs.drop("ids", "n_tokens")
    rows = sentencepiece_unigram.encode(docs, sentencepiece_unigram.load())
    return rows.select(*docs.columns, "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_spans),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_text),
]

#: SQL can't express the trained and scheduled stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's tables go as soon as the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES[:-1]):
        space: list[str] = []
        with passing(space):
            out = stage(spark, docs, sf_dir)
        # The last table is read by the result itself.
        last = i + 2 == len(STAGES)
        docs = materialize(out, f"stage-{i}", None if last else (now := []))
        drop_tables(spark, [*before, *space])
        before = [] if last else now
    return STAGES[-1][1](spark, docs, sf_dir)
