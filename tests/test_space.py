"""The space by arrays against the plain plans of vectorize."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.operators import knn, learn, rag, space, vectorize
from lexigrove.plans import queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 90}"
    rows = [(i % 57, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(60)]  # ids 0, 1 and 2 occur twice
    return spark.createDataFrame([*rows, (90, None), (91, ""), (92, "the of"), (93, "w1 " * 300)], "doc_id long, text string").repartition(3)


def plain(df):
    return sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())


@pytest.mark.parametrize("buckets, how", [(64, (1, 1.0, 40)), (64, (2, 0.5, 25)), (1 << 21, (1, 1.0, 100_000))])
def test_vocabulary_and_weights(spark, docs, monkeypatch, buckets, how):
    """Equal to the plain plans, also where many terms share a counter and counters must be opened again."""
    monkeypatch.setattr(space, "BUCKETS", buckets)
    monkeypatch.setattr(space, "PART", 32)
    monkeypatch.setattr(space, "SLICE_BYTES", 500)
    counts, n = vectorize.term_counts(docs), docs.count()
    vocab = vectorize.vocabulary(counts, n, *how).persist()
    s = space.Space(docs, *how)
    assert s.vocabulary().collect() == vocab.orderBy(F.desc("cf"), "term").collect()
    assert plain(s.tfidf()) == plain(vectorize.tfidf(counts, vocab, n))
    assert plain(s.bm25()) == plain(vectorize.bm25(counts, vocab, n))


def test_ranking_equals_the_join(spark, docs, monkeypatch):
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w5"), (3, "unseen"), (4, None), (5, "w1 w1 w1 w9 w80"), (5, "w2")], "query_id long, text string")
    counts, n = vectorize.term_counts(docs), docs.count()
    vocab = vectorize.vocabulary(counts, n, 1, 1.0, 60)
    want = vectorize.rank_by_similarity(vectorize.tfidf(counts, vocab, n), vectorize.query_weights(asked, vocab, n), docs, asked, 4).select("query_id", "rank", "doc_id", F.round("similarity", 9)).collect()
    for bytes_ in (600, 32 << 20):  # many blocks, few
        monkeypatch.setattr(space, "BLOCK_BYTES", bytes_)
        got = space.Space(docs, max_features=60).rank(asked, 4).select("query_id", "rank", "doc_id", F.round("similarity", 9))
        assert sorted(got.collect()) == sorted(want)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_retrieval_makes_no_row_for_a_common_term(spark):
    """Questions and chunks meet by blocks: no row for each term that a question shares with a chunk."""
    chunks = rag.chunk_table(queries.docs(spark, SF))
    plan = _plan(rag.retrieve_tfidf(queries.questions(spark, SF), chunks))
    assert "term" not in plan and "MapInArrow" in plan


def test_nearest_rows_equal_brute_force():
    """By distance with ties, barred and unusable rows, and far from the origin, where a product in single precision can't tell."""
    rng = np.random.default_rng(3)
    for a, b, width, k, shift in ((20, 300, 64, 4, 0), (10, 40, 5, 4, 0), (5, 3, 5, 4, 0), (20, 500, 3, 4, 1e6), (5, 200, 2, 3, 1e17)):
        x, m = rng.integers(0, 9, (a, width)) + shift, rng.integers(0, 9, (b, width)) + shift
        x, m = x.astype("f8"), m.astype("f8")
        m[-1, 0] = np.nan if shift == 0 else m[-1, 0]
        low, high = np.zeros(a, int), np.zeros(a, int)
        high[0] = 1
        i, j, _ = knn.nearest_rows(x, knn.Rows(m), k, (low, high))
        d = np.sqrt(((x[:, None] - m[None]) ** 2).sum(2))
        d[0, 0] = np.nan
        want = [(p, q) for p in range(a) for q in np.lexsort((np.arange(b), d[p]))[:k].tolist() if np.isfinite(d[p, q])]
        assert list(zip(i.tolist(), j.tolist())) == want


def test_core_distances_come_with_the_neighbours(spark):
    """One search by blocks for both, and no tile is sorted whole."""
    assert _plan(knn.mutual_reachability(queries.vecs(spark, SF), 4, 4)).count("InMemoryRelation") == 3


def test_svd_rows_stay_in_the_jvm(spark, monkeypatch):
    """The solver's steps don't convert rows in Python again; scores and values are those of numpy."""
    from pyspark.ml.linalg import Vectors
    from pyspark.mllib.linalg import distributed
    from pyspark.sql import DataFrame

    given, make = [], distributed.RowMatrix.__init__
    monkeypatch.setattr(distributed.RowMatrix, "__init__", lambda self, rows, *a, **b: (given.append(rows), make(self, rows, *a, **b))[1])
    a = np.random.default_rng(2).normal(size=(30, 7))
    rows = spark.createDataFrame([(i, Vectors.sparse(7, list(range(7)), x.tolist())) for i, x in enumerate(a)], ["doc_id", "features"])
    scores, values = learn.truncated_svd(rows, 3)
    assert isinstance(given[0], DataFrame)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:3])
    got = np.array([r.projected for r in scores.orderBy("doc_id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]))
