"""Scans, record assembly and sinks."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file; never with an inferred schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.element_at(F.split("_metadata.file_path", "/"), -1))


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("id"), F.col("value").alias("text"))


def check_alignment(vectors: DataFrame, metadata: DataFrame, key: str) -> None:
    """Both sides must have the same ids (positions aren't used)."""
    odd = vectors.select(key).join(metadata.select(key), key, "left_anti").limit(1).count() + metadata.select(key).join(vectors.select(key), key, "left_anti").limit(1).count()
    if odd:
        raise ValueError("vectors and metadata don't have the same ids")


def keep_language(rows: DataFrame, language: str = "en", scholar: str | None = None, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Rows with an id and of the language (missing counts as it), without scholarly results."""
    cond = (F.coalesce(F.col(id_col).cast("string"), F.lit("")) != "") & (F.lower(F.coalesce(lang_col, F.lit(language))) == language)
    if scholar:
        cond &= ~F.coalesce(F.col(scholar), F.lit(False))
    return rows.where(cond)


def assemble(meta: DataFrame, details: DataFrame, key: str = "publication_number") -> DataFrame:
    """Metadata with details where they were fetched; an empty detail gives way to the metadata."""
    d = details.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in details.columns if c != key))
    j = meta.join(d, F.col(key) == F.col("__k"), "left")

    def pick(c: str):
        own = F.col(c) if c in meta.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")) if f"__{c}" in j.columns else F.lit(None).cast("string"), F.nullif(own, F.lit("")), F.lit("")).alias(c)

    text = ("title", "abstract", "description", "inventor", "assignee", "filing_date", "grant_date", "publication_date", "priority_date")
    claims = F.coalesce(F.col("__claims"), F.array().cast("array<string>")) if "claims" in details.columns else F.array().cast("array<string>")
    return j.select(t.safe_id(F.col(key)).alias("patent_id"), key, *(pick(c) for c in text), claims.alias("claims"))


def catalog(records: DataFrame) -> DataFrame:
    """Presence flags and list length of each record."""
    full = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return records.select(
        "doc_id", "domain", full("abstract").alias("has_abstract"), F.coalesce(F.size("claims") > 0, F.lit(False)).alias("has_claims"),
        full("description").alias("has_description"), F.greatest(F.size("claims"), F.lit(0)).cast("long").alias("claim_count"),
    )


def resume(pending: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inputs without an output yet."""
    return pending.join(done.select(key), key, "left_anti")


class _Description(html.parser.HTMLParser):
    """Walks <ul class="description">: headings in capitals, description lines as one line each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.run, self.kind, self.level = 0, [], [], None, 0

    def handle_starttag(self, tag, attrs):
        cls = (dict(attrs).get("class") or "").split()
        if tag == "ul" and (self.depth or "description" in cls):
            self.depth += 1
        elif self.depth and self.kind is None and (tag == "heading" or tag == "div" and any("description-line" in c for c in cls)):
            self.kind, self.run, self.level = tag, [], 1
        elif self.kind == tag:
            self.level += 1

    def handle_endtag(self, tag):
        if tag == "ul" and self.depth:
            self.depth -= 1
        elif self.kind == tag:
            self.level -= 1
            if not self.level:
                line = re.sub(r"\s+", " ", " ".join(self.run)).strip()
                if line:
                    self.out.append(f"\n[{line.upper()}]" if tag == "heading" else line)
                self.kind = None

    def handle_data(self, data):
        if self.kind and data.strip():
            self.run.append(data.strip())


def description_container(source: str | None) -> str | None:
    """Text of the description container, or None if the page has none."""
    if not source or "description" not in source:
        return None
    p = _Description()
    p.feed(source)
    return "\n".join(p.out) or None


def html_to_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The description container where there is one, else the body's text.

    Only pages with a container go through Python; the rest stays in the JVM.
    """
    has = F.col(html_col).rlike(r"(?is)<ul\b[^>]*class=[\"'][^\"'>]*\bdescription\b")

    @F.pandas_udf("string")
    def container(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(description_container)

    plain = pages.where(~F.coalesce(has, F.lit(False))).select(id_col, t.html_fallback(F.col(html_col)).alias("text"))
    rich = pages.where(has).select(id_col, t.cut_page(F.coalesce(container(F.col(html_col)), F.lit(""))).alias("text"))
    return plain.union(rich)


def write_table(df: DataFrame, path: str, by: str | None = None, fmt: str = "parquet") -> None:
    """One table instead of a file for each row; optionally a folder for each value of ``by``."""
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(by) if by else w).save(path)


def write_records(records: DataFrame, path: str, text: Column, by: str = "domain", id_col: str = "patent_id") -> None:
    """Records as JSON lines and their rendered texts as a table of (id, text), both in folders by ``by``."""
    records.write.mode("overwrite").partitionBy(by).json(f"{path.rstrip('/')}/json")
    records.select(id_col, by, text.alias("text")).write.mode("overwrite").partitionBy(by).parquet(f"{path.rstrip('/')}/text")


def write_run(assignments: DataFrame, metrics: DataFrame, path: str, method: str) -> None:
    """A clustering run: its assignments, and its one row of metrics with the method's name."""
    assignments.write.mode("overwrite").json(f"{path.rstrip('/')}/{method}_assignments")
    metrics.select(F.lit(method).alias("method"), *metrics.columns).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{method}_metrics")
