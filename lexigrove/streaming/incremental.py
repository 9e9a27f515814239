"""Incremental cleaning: new raw files are cleaned once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t


def clean_new(pending: DataFrame, done: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batch form: rows without an output yet, cleaned, each id once."""
    fresh = pending.join(done.select(key), key, "left_anti").dropDuplicates([key])
    return fresh.withColumn(text_col, t.clean_text(F.col(text_col)))


def clean_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "doc_id", text_col: str = "text", fmt: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Watch a folder; each batch drops ids that the target has and appends the rest.

    The anti-join makes a replayed batch harmless, so the sink is exactly-once by id.
    """

    def append(batch: DataFrame, _: int) -> None:
        try:
            done = batch.sparkSession.read.format(fmt).load(target)
        except Exception as e:  # the first batch finds no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = batch.limit(0)
        clean_new(batch, done, key, text_col).write.mode("append").format(fmt).save(target)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
