"""What tasks and waiting workers hold in memory."""

import pyarrow as pa
from pyspark.sql import functions as F

from lexigrove.llm import common


def test_batches_are_bounded_by_bytes(spark):
    """Rows of 10 KB came in batches of 15 MB, which JVM and Python workers both held."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    common.small_batches(spark)
    got = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 1500
    assert max(r["size"] for r in got) <= common.BATCH_BYTES + 20_000
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64k")
        common.small_batches(spark)
        assert spark.conf.get(key) == "64k"  # a smaller bound is left as it is
    finally:
        spark.conf.set(key, before)


def test_a_batch_is_handed_back_at_its_end(monkeypatch):
    done = []
    monkeypatch.setattr(common, "hand_back", lambda: done.append(1), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"a" * 10] * 3)], names=["id", "text"])
    parts = common.slices(batch, limit=10)
    assert [(part.column(0).to_pylist(), texts, len(done)) for part, texts in parts] == [([i], [b"a" * 10], 0) for i in (1, 2, 3)]
    assert len(done) == 1
    monkeypatch.undo()
    common.hand_back()
