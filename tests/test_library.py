"""Operators of the library against hand-computed values and plain-Python versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove import service
from lexigrove.functions import text as t
from lexigrove.functions import vectors as v
from lexigrove.operators import boolean, cluster, encode, knn, labels, learn, neighbours, rag, vectorize
from lexigrove.sources import search, tables
from lexigrove.streaming import incremental


def column(spark, values, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_cleaning(spark):
    raw = "This application is a continuation of X. See FIG. 3A and figs. 1-2 [0001] <b>bold</b> &amp; ±5 docket AB-12345US01  end\n\n\n\nU.S. Pat. No. 8,879,416 stays   out"
    assert column(spark, [raw], t.clean_text) == ["See and bold 5 docket end\n\n stays out"]
    assert column(spark, ["  a \t\t b\n\n\n\nc  "], t.normalize_whitespace) == ["a b\n\nc"]
    assert column(spark, ["US-8,1 é/2"], t.safe_id) == ["US_8_1_é_2"]


@pytest.mark.parametrize("n, windows", [(0, 0), (1, 1), (240, 1), (280, 1), (281, 2), (520, 2), (521, 3)])
def test_chunk_windows(spark, n, windows):
    text = " ".join(f"w{i}" for i in range(n))
    got = column(spark, [text], lambda c: t.chunks(c, least=0))[0]
    words, want = text.split(), []
    for at in range(0, len(words), 240):
        want.append(" ".join(words[at : at + 280]))
        if at + 280 >= len(words):
            break
    assert got == want and len(got) == windows
    with pytest.raises(ValueError):
        t.chunks(F.lit(""), 10, 10)


def test_titles_and_candidates(spark):
    assert column(spark, ["a  b\nc", "x" * 130], t.truncate_title) == ["a b c", "x" * 119 + "…"]
    assert column(spark, ["y" * 250], t.summarize_text) == ["y" * 220 + "... [truncated 30 chars]"]
    assert column(spark, [" a "], lambda c: t.candidate_text(c, F.lit(" "), F.lit("b"))) == ["a. b"]
    assert column(spark, ["der hund und die katze", "the dog and the cat", "123", ""], t.profile_language) == ["de", "en", "unknown", "unknown"]
    assert column(spark, ["The cats, and 3 dogs of Ann"], t.process_text) == ["cats dogs ann"]


def test_ngrams_bridge_stop_words(spark):
    assert column(spark, ["state of the art", "one", ""], lambda c: t.ngrams(t.word_tokens(c))) == [["state", "art", "state art"], ["one"], []]


MICRO = [(1, "alpha beta beta"), (2, "beta gamma"), (3, "alpha beta delta delta")]


def test_tfidf_and_bm25_micro_fixture(spark):
    df = spark.createDataFrame(MICRO, "doc_id long, text string")
    counts = vectorize.term_counts(df, 1, ())
    vocab = vectorize.vocabulary(counts, 3)
    got = {(r.doc_id, r.term): round(r.weight, 6) for r in vectorize.tfidf(counts, vocab, 3).collect()}
    assert got == {(1, "alpha"): 0.541343, (1, "beta"): 0.840802, (2, "beta"): 0.508542, (2, "gamma"): 0.861037, (3, "alpha"): 0.34262, (3, "beta"): 0.266075, (3, "delta"): 0.901008}
    got = {(r.doc_id, r.term): round(r.weight, 6) for r in vectorize.bm25(counts, vocab, 3).collect()}
    assert got == {(1, "alpha"): 0.470004, (1, "beta"): 0.190759, (2, "beta"): 0.157096, (2, "gamma"): 1.153917, (3, "alpha"): 0.408699, (3, "beta"): 0.116114, (3, "delta"): 1.265586}


CLUSTERS = list(zip("aaabbbcc", (0, 0, 1, 1, 1, 1, 2, -1)))


def test_cluster_metrics_micro_fixture(spark):
    df = spark.createDataFrame(CLUSTERS, "label string, cluster int")
    one = lambda d: round(d.first()[0], 6)
    assert [one(f(df)) for f in (cluster.ari, cluster.nmi, cluster.homogeneity, cluster.purity)] == [0.428571, 0.698002, 0.740188, 0.875]
    assert one(cluster.purity(df, without_noise=True)) == 0.857143
    assert tuple(cluster.counts(df).first()) == (8, 3, 1)
    same = spark.createDataFrame([("a", 0)] * 3, "label string, cluster int")
    assert one(cluster.ari(same)) == 1 and one(cluster.nmi(same)) == 1 and one(cluster.homogeneity(same)) == 1


def test_silhouette_micro_fixture(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [4.0, 0.0], 1), (3, [4.0, 3.0], 1), (4, [9.0, 9.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    assert {r.vec_id: round(r.silhouette, 6) for r in knn.silhouette(df).collect()} == {0: 0.777778, 1: 0.767313, 2: 0.261366, 3: 0.366563, 4: 0}
    assert all(r.silhouette is None for r in knn.silhouette(df.where("cluster = 0")).collect())


def test_neighbours(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.8, -0.6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for how in ("native", "blocked"):
        got = {r.vec_id: (r.neighbor_id, round(r.similarity, 6), round(r.novelty_score, 6)) for r in knn.corpus_novelty(df, how).collect()}
        assert got == {1: (4, 0.8, 0.2), 2: (3, 0.8, 0.2), 3: (2, 0.8, 0.2), 4: (1, 0.8, 0.2)}
    one = knn.corpus_novelty(df.where("vec_id = 1")).first()
    assert one.neighbor_id == 1 and abs(one.novelty_score) < 1e-9
    rng = np.random.default_rng(0)
    big = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(knn, "LEAST_ROWS", 7)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 7 * 8 * 8)
    a, b = ({r.vec_id: (r.neighbor_id, r.similarity) for r in knn.corpus_novelty(big, how).collect()} for how in ("native", "blocked"))
    assert {k: x[0] for k, x in a.items()} == {k: x[0] for k, x in b.items()} and all(abs(a[k][1] - b[k][1]) < 1e-12 for k in a)
    with pytest.raises(ValueError):
        knn.corpus_novelty(df, "other")


def test_hdbscan_on_separable_points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (np.array([10.0 * (i // 12), 0.0]) + rng.normal(size=2) * 0.3).tolist()) for i in range(36)] + [(99, [100.0, 100.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for method in ("leaf", "eom"):
        got = {r.vec_id: r.cluster for r in cluster.hdbscan(df, 4, 4, method).collect()}
        assert got[99] == -1 and [len(set(got[i] for i in range(12 * k, 12 * k + 12)) - {-1}) >= 1 for k in range(3)] == [True] * 3
        if method == "eom":
            assert len({got[i] for i in range(36)} - {-1}) == 3
    with pytest.raises(ValueError):
        cluster.hdbscan(df, max_points=5)


def test_neighbour_embedding_keeps_groups_apart(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 10)) * 6
    rows = [(100 + i, (centres[i % 4] + rng.normal(size=10)).tolist()) for i in range(160)] + [(999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: np.array(r.projected) for r in neighbours.umap(df, epochs=200).collect()}
    assert set(got) == {i for i, v in rows if v}
    y = np.array([got[100 + i] for i in range(160)])
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)) + np.eye(160) * 1e9
    same = np.arange(160) % 4
    assert (same[d.argmin(axis=1)] == same).mean() > 0.97
    mids = np.array([y[same == k].mean(axis=0) for k in range(4)])
    inner = np.mean([np.linalg.norm(y[same == k] - mids[k], axis=1).mean() for k in range(4)])
    assert min(np.linalg.norm(mids[a] - mids[b]) for a in range(4) for b in range(a)) > 3 * inner
    again = {r.vec_id: r.projected for r in neighbours.umap(df, epochs=200).collect()}
    assert all(np.allclose(again[i], got[i], atol=1e-6) for i in got)
    assert [len(r.projected) for r in neighbours.umap(df.limit(2)).collect()] == [2, 2]


def test_memberships_sum_to_the_logarithm():
    d = np.sort(np.random.default_rng(1).random((20, 14)) + 0.1, axis=1)
    w = neighbours.smooth(d)
    assert np.allclose(w.sum(axis=1), np.log2(14), atol=1e-3) and np.allclose(w[:, 0], 1) and (np.diff(w, axis=1) <= 0).all()
    a, b = neighbours.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01


def test_keyphrases_near_the_text(spark):
    words = ["solar", "panel", "cell", "market"]
    bag = lambda texts: np.array([[t.split().count(w) + 0.0 for w in words] for t in texts])
    extract = encode.keyphrase_extractor(bag, top_n=2)
    assert [p for p, _ in extract("solar panel solar panel cell")] == ["panel solar", "solar panel"] and extract("the of") == []
    df = spark.createDataFrame([(1, "solar panel solar"), (2, None)], "cluster int, text string")
    got = {r.cluster: r.keyword_scores for r in encode.keyphrases(df, extract).collect()}
    assert got[2] == {} and max(got[1], key=got[1].get) in ("solar panel", "panel solar")


def test_hdbscan_beyond_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(3 * i, (np.array([8.0 * (i // 30), 1.0 * (i % 2)]) + rng.normal(size=2) * 0.4).tolist()) for i in range(120)] + [(1000, [50.0, 50.0]), (1001, [-9.0, 30.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in sorted(rows)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 3]
    total = sum(w for w, _, _ in cluster.spanning_tree(df.toDF("id", "vec"), np.array(sorted(i for i, _ in rows)), 3))
    reach, seen, want = np.maximum(d, np.maximum(core[:, None], core[None])), [0], 0.0
    near = reach[0].copy()
    near[0] = np.inf
    for _ in range(len(x) - 1):
        k = int(np.argmin(near))
        want += near[k]
        seen.append(k)
        near = np.minimum(near, reach[k])
        near[seen] = np.inf
    assert total == pytest.approx(want)
    for method in ("leaf", "eom"):
        one = {r.vec_id: r.cluster for r in cluster.hdbscan(df, 6, 3, method).collect()}
        with monkeypatch.context() as m:
            m.setattr(cluster, "LOCAL_POINTS", 10)
            many = {r.vec_id: r.cluster for r in cluster.hdbscan(df, 6, 3, method).collect()}
        names = {}
        assert all(names.setdefault(one[i], many[i]) == many[i] for i in one) and len(set(names.values())) == len(names) and names.get(-1, -1) == -1


def test_noise_goes_to_the_nearest_centroid(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.1, 0.8], -1), (5, [0.5, 0.5], -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    got = {r.vec_id: (r.cluster, r.was_noise) for r in cluster.assign_noise(df).collect()}
    assert got[4] == (1, True) and got[1] == (0, False) and got[5][1]
    alone = cluster.assign_noise(df.where("cluster = -1")).collect()
    assert all(r.cluster == -1 and not r.was_noise for r in alone)


ACCEPT = ["(5g OR telecom) AND NOT satellite", "a OR b AND c", "NOT a AND b", "NOT (NOT a)", "a and not b", '"a b"', "NOT NOT a", "café"]
REJECT = ["a b", "face-to-face", "a NOT b", "a AND", "()", "(a", "a)", "", '""', "AND"]


@pytest.mark.parametrize("query", ACCEPT)
def test_boolean_accepts(query):
    boolean.parse(query)


@pytest.mark.parametrize("query", REJECT)
def test_boolean_rejects(query):
    with pytest.raises(ValueError):
        boolean.parse(query)


def test_boolean_search(spark):
    rows = [(1, "alpha beta."), (2, "Beta, alpha-gamma"), (3, "gamma"), (4, "  "), (5, "alpha betas beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    find = lambda q: sorted(r.doc_id for r in boolean.search(df, q).collect())
    assert find("alpha AND beta") == [1, 2, 5] and find("NOT alpha") == [3] and find("alpha OR gamma AND beta") == [1, 2, 5]
    assert find('"alpha beta"') == [1, 5] and find('"beta, alpha"') == [2] and find("NOT (alpha AND beta)") == find("NOT alpha OR NOT beta") == [3]
    index, universe = boolean.inverted_index(df), df.where("trim(text) <> ''")
    for q in ("alpha AND NOT gamma", "NOT NOT alpha", "beta OR gamma"):
        assert sorted(r.doc_id for r in boolean.lookup(index, q, universe).collect()) == find(q)
    assert [tuple(r) for r in boolean.top(df, "alpha", 2).collect()] == [(1, 3), (2, 3)]
    assert {r.term: r.doc_ids for r in boolean.posting_lists(index).collect()}["beta"] == [1, 2, 5]


def test_ranking_fills_up_with_zero_rows(spark):
    df = spark.createDataFrame(MICRO, "doc_id long, text string")
    counts = vectorize.term_counts(df, 1, ())
    vocab = vectorize.vocabulary(counts, 3)
    q = spark.createDataFrame([(7, "gamma unseen"), (8, "nothing known")], "query_id long, text string")
    got = vectorize.rank_by_similarity(vectorize.tfidf(counts, vocab, 3), vectorize.query_weights(q, vocab, 3, 1, ()), df, q, 2).collect()
    assert {(r.query_id, r.rank): (r.doc_id, round(r.similarity, 6)) for r in got} == {(7, 1): (2, 0.861037), (7, 2): (1, 0), (8, 1): (1, 0), (8, 2): (2, 0)}


def records(spark, n=6):
    rng = random.Random(1)
    words = [f"term{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + f" special{i}", f"Title {i}", f"d{i % 2}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, title string, domain string")


def test_service(spark):
    s = service.Service(spark, records(spark), mode="tfidf")
    assert s.health()["status"] == "ok" and s.retrieval_mode() == "tfidf"
    r = s.score_novelty(title="special3 term1", top_k=3)
    assert len(r["matches"]) == 3 and r["matches"][0]["doc_id"] == 3 and r["novelty_score"] == 1 - r["top_similarity"]
    a = s.ask("What about special2?", 3)
    assert len(a["retrieved_chunks"]) == 3 and a["retrieved_chunks"][0]["doc_id"] == 2 and a["mode"] == "retrieval-only" and "2 (Title 2)" in a["answer"]
    talk = service.Service(spark, records(spark), llm=lambda q, c: "said").ask("special1", 1)
    assert (talk["answer"], talk["mode"]) == ("said", "llm")

    def broken(q, c):
        raise RuntimeError

    assert service.Service(spark, records(spark), llm=broken).ask("special1", 1)["mode"] == "retrieval-only"
    for bad in (lambda: s.score_novelty(), lambda: s.ask("  "), lambda: s.ask("x", 11), lambda: s.score_novelty("x", top_k=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(service.ConfigurationError):
        service.Service(spark, records(spark), mode="semantic").retrieval_mode()
    assert service.Service(spark, records(spark), mode="semantic").health()["status"] == "degraded"
    vec = spark.createDataFrame([(i, [float(i == k) for k in range(6)]) for i in range(6)], "doc_id long, embedding array<double>")
    sem = service.Service(spark, records(spark), vec, lambda _: [0, 0, 0, 0, 1, 0]).score_novelty("x", top_k=1)
    assert sem["retrieval_mode"] == "semantic" and sem["matches"][0]["doc_id"] == 4 and sem["interpretation"] == v.BANDS[0]


def test_service_answers_questions_by_chunk_vectors(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(300)), f"T{i}", "d") for i in range(4)], "doc_id long, text string, title string, domain string")
    chunks = spark.createDataFrame([(i, c, [float(i == k) + 0.1 * c for k in range(4)]) for i in range(4) for c in range(2)], "doc_id long, chunk_index int, embedding array<double>")
    asked = []
    s = service.Service(spark, docs, encoder=lambda q: [0, 0, 1, 0], chunk_vectors=chunks, chat=lambda m: asked.append(m) or "told")
    a = s.ask("which?", 2)
    assert a["retrieval_mode"] == "semantic" and (a["answer"], a["mode"]) == ("told", "llm")
    assert [(c["doc_id"], c["chunk_index"], c["rank"]) for c in a["retrieved_chunks"]] == [(2, 1, 1), (2, 0, 2)] and a["supporting_documents"] == [{"doc_id": 2, "title": "T2", "domain": "d"}]
    assert s.health()["runtime"]["chunk_index_vectors"] == 8 and s.health()["runtime"]["llm_configured"]
    system, user = rag.messages("which?", "context")
    assert (system["role"], user["role"]) == ("system", "user") and user["content"] == "Question: which?\n\nRetrieved context:\ncontext"

    def broken(text):
        raise OSError("no encoder today")

    fallen = service.Service(spark, docs, encoder=broken, chunk_vectors=chunks, mode="semantic")
    assert fallen.ask("word3x7", 1)["retrieval_mode"] == "tfidf" and fallen.ask("word3x7", 1)["retrieved_chunks"][0]["doc_id"] == 3


def test_service_dashboard_and_errors(spark):
    s = service.Service(spark, records(spark))
    assert s.handle("dashboard")[0] == 503
    points = spark.createDataFrame([(1, 0, "a", 0.0, 1.0), (2, 0, "b", 1.0, 1.0), (3, 1, "a", 0.5, 0.0), (4, -1, "a", 0.0, 0.0)], "doc_id long, cluster int, domain string, x double, y double")
    named = spark.createDataFrame([(0, "Zero", ["k"]), (1, "One", []), (7, "Gone", None)], "cluster int, label string, keywords array<string>")
    terms = spark.createDataFrame([(0, 2, "beta"), (0, 1, "alpha"), (1, 1, "gamma")], "cluster int, rank int, term string")
    s.clusters, s.assignments = labels.dashboard_rows(named, terms, points), points
    s.metrics = spark.createDataFrame([(0.5, 3)], "ari double, noise_points int")
    status, page, headers = s.handle("dashboard", request_id="r1")
    assert status == 200 and headers == {"X-Request-ID": "r1"} and set(page) == {"summary", "metrics", "clusters", "points"}
    assert page["summary"] == {"num_documents": 4, "num_clusters": 3, "noise_points": 3, "ari": 0.5, "nmi": None, "homogeneity": None, "purity": None, "silhouette": None}
    zero, one, gone = page["clusters"]
    assert (zero["keywords"], zero["tfidf_terms"], zero["num_docs"], zero["dominant_domain"], zero["sample_docs"]) == (["k"], ["alpha", "beta"], 2, "a", [1, 2])
    assert gone["num_docs"] == 0 and gone["dominant_domain"] == "unknown" and gone["color"] == v.NO_POINTS_COLOR and one["tfidf_terms"] == ["gamma"]
    s.max_points = 3
    assert s.handle("dashboard")[0] == 503
    assert s.handle("health")[1]["status"] == "ok" and s.handle("nothing")[0] == 404
    for body, status in (({}, 422), ({"question": 3}, 422), ({"question": "x", "top_k": 11}, 422), ("{bad", 422), ("[1]", 422), ({"question": "  "}, 400)):
        assert s.handle("rag", body)[0] == status
    assert s.handle("novelty", {"top_k": True})[0] == 422 and s.handle("novelty", {})[0] == 400
    status, body, _ = s.handle("novelty", '{"title": "special3", "top_k": 1}')
    assert status == 200 and body["matches"][0]["doc_id"] == 3
    s.close()
    s.documents = None
    assert s.handle("novelty", {"title": "x"})[:2] == (500, {"detail": "Internal server error"})


def test_files_of_methods_and_runs(spark, tmp_path):
    assert labels.assignments_path("/d/", "sota") == "/d/sota_cluster_assignments.json" and labels.assignments_path("/d", "mine") == "/d/mine_cluster_assignments.json" and labels.assignments_path("/d", "sota", "/x.json") == "/x.json"
    rows = spark.createDataFrame([("A", "d1", "t"), ("B", "d2", "u")], "patent_id string, domain string, title string")
    tables.write_records(rows, f"{tmp_path}/r", F.concat(F.lit("Title: "), "title"))
    assert {(r.patent_id, r.text, r.domain) for r in spark.read.parquet(f"{tmp_path}/r/text").collect()} == {("A", "Title: t", "d1"), ("B", "Title: u", "d2")}
    assert spark.read.json(f"{tmp_path}/r/json").count() == 2
    tables.write_run(rows, spark.createDataFrame([(0.5,)], "ari double"), f"{tmp_path}/c", "sota")
    assert spark.read.json(f"{tmp_path}/c/sota_metrics").first().asDict() == {"method": "sota", "ari": 0.5} and spark.read.json(f"{tmp_path}/c/sota_assignments").count() == 2


def test_chunks_of_any_id(spark):
    text = " ".join(f"word{i}" for i in range(600))
    docs = spark.createDataFrame([(-5, text), (2**62, text + " needle"), (7, "other " * 80)], "doc_id long, text string")
    found = rag.retrieve_tfidf(spark.createDataFrame([(1, "needle")], "query_id long, text string"), rag.chunk_table(docs), 1).collect()
    assert [(r.doc_id, r.chunk_index) for r in found] == [(2**62, 2)]


def test_neighbours_by_product_settle_ties_as_ordered_sums_do(spark):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(60, 12)), 1)
    m[10:20] = m[0]
    i, j, s = knn.best_rows(m, m, 4, np.eye(60, dtype=bool))
    for q in range(60):
        want = sorted(((-float(knn.ordered_dot(m[q : q + 1], m[c : c + 1])[0]), c) for c in range(60) if c != q))[:4]
        assert [(-x, int(c)) for x, c in zip(s[i == q], j[i == q])] == want
    with pytest.raises(Exception, match="several lengths"):
        knn.corpus_novelty(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()


def test_settings_helpers():
    assert service.parse_env("# c\nA=1\nB = 'x=y'\n\nbad") == {"A": "1", "B": "x=y"}
    assert service.parse_bool("Yes") and not service.parse_bool("0") and service.parse_bool(None, True)
    assert service.summarize_body({"a": "x" * 310, "b": 3}) == {"a": "x" * 300 + "... [truncated 10 chars]", "b": 3}


def test_html(spark):
    page = '<html><body><nav>n</nav><ul class="description"><heading>Field</heading><li><div class="description-line x">One\n two</div></li></ul><p>rest</p></body></html>'
    plain = "<html><body><script>x</script><p>a &amp; b</p><footer>f</footer><p>c</p></body></html>"
    df = spark.createDataFrame([(1, page), (2, plain), (3, "<body></body>"), (4, "<body>" + "y" * 100_010)], "page_id long, html string")
    got = {r.page_id: r.text for r in tables.html_to_text(df).collect()}
    assert got[1] == "[FIELD]\nOne two" and got[2].split() == ["a", "&", "b", "c"] and got[3] == ""
    assert got[4] == "y" * 100_000 + "\n\n[TRUNCATED]"


def test_assembly_and_catalog(spark):
    meta = spark.createDataFrame([("US-1", "m", ""), ("US-2", "n", "x")], "publication_number string, title string, abstract string")
    details = spark.createDataFrame([("US-1", "", "long", ["c1"])], "publication_number string, title string, abstract string, claims array<string>")
    got = {r.patent_id: r for r in tables.assemble(meta, details).collect()}
    assert (got["US_1"].title, got["US_1"].abstract, got["US_1"].claims) == ("m", "long", ["c1"])
    assert (got["US_2"].title, got["US_2"].abstract, got["US_2"].claims, got["US_2"].inventor) == ("n", "x", [], "")
    with pytest.raises(ValueError):
        tables.check_alignment(meta, details, "publication_number")


def test_search_source(spark):
    def client(params):
        if "solar" in params["q"]:
            raise OSError
        name, page = params["q"][:3], params["page"]
        if name == "5G " and page > 1:
            return {"organic_results": []}
        own = [{"patent_id": f"patent/{name}{page}{i}/en", "publication_number": f"{name}{page}{i}", "title": "t", "language": ("EN", None, "de")[i % 3]} for i in range(8)]
        return {"organic_results": [*own, {"title": "no id", "language": "en"}, {"patent_id": "scholar/1", "is_scholar": True}]}

    rows = search.search(spark, client, sleep=lambda s: None, per_domain=14).collect()
    by = {}
    for r in rows:
        by.setdefault(r.domain, []).append(r.patent_id)
    assert {k: len(x) for k, x in by.items()} == {"ai_machine_learning": 14, "biotechnology": 14, "semiconductor": 14, "telecommunications_5g": 6}
    assert all(len(set(x)) == len(x) and all(x) for x in by.values()) and all(r.language != "de" for r in rows)
    waits = []
    assert search.fetch(lambda p: 1 / 0, {}, waits.append) is None and waits == [1.2, 2.4, 1.2, 4.8, 1.2, 9.6]


def test_details_and_dry_run(spark):
    found = spark.createDataFrame([("d", "p/1", "N1", "title one"), ("d", "p/2", "N2", "title two"), ("d", "p/1", "N1", "title one")], "domain string, patent_id string, publication_number string, title string")

    def client(params):
        if params["patent_id"] == "p/2":
            raise OSError
        assert params["engine"] == search.DETAIL_ENGINE
        return {"title": "", "abstract": "long", "claims": ["c1", 2]}

    got = search.details(found, client, sleep=lambda s: None)
    rows = {r.patent_id: r for r in got.collect()}
    assert (rows["p/1"].abstract, rows["p/1"].claims, rows["p/1"].found) == ("long", ["c1", "2"], True)
    assert not rows["p/2"].found and rows["p/2"].title is None and rows["p/2"].claims is None
    both = {r.patent_id: r for r in tables.assemble(found.dropDuplicates().drop("patent_id").withColumn("abstract", F.lit("")), got.drop("patent_id", "found", "description")).collect()}
    assert (both["N1"].title, both["N1"].abstract) == ("title one", "long") and both["N2"].title == "title two"
    assert search.dry_run(found) == {"total": 2, "done": 0, "pending": 2}
    assert search.dry_run(found, found.where("publication_number = 'N2'")) == {"total": 2, "done": 1, "pending": 1}


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"patent_id": "A",\n "title": "x"}')
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt/B.txt").write_text("two\nlines")
    got = tables.scan_json(spark, f"{tmp_path}/in", "patent_id string, title string").first()
    assert (got.patent_id, got.title, got.file_name) == ("A", "x", "a.json")
    assert tuple(tables.scan_text(spark, f"{tmp_path}/txt").first()) == ("B", "two\nlines")
    tables.write_table(records(spark), f"{tmp_path}/out", by="domain")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_incremental_cleaning(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    one = spark.createDataFrame([(1, "a  b"), (2, "c")], "doc_id long, text string")
    one.write.parquet(src)
    for extra in ((2, "again"), (3, "x   y")):
        incremental.clean_stream(spark, src, one.schema, out, f"{tmp_path}/cp").awaitTermination()
        spark.createDataFrame([extra], one.schema).write.mode("append").parquet(src)
    incremental.clean_stream(spark, src, one.schema, out, f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a b"), (2, "c"), (3, "x y")]


def test_labels_and_learning(spark):
    docs = records(spark, 8)
    points = docs.select("doc_id", "domain", (F.col("doc_id") % 2).cast("int").alias("cluster"))
    m = labels.members(points, docs.select("doc_id", "text"))
    terms = labels.tfidf_terms(m, top_n=3)
    assert terms.count() == 6
    named = {r.cluster: r.label for r in labels.label(terms, points).collect()}
    assert set(named) == {0, 1} and all(x.count(" · ") == 2 for x in named.values())
    assert labels.label(terms.limit(0), points).where("label = 'Cluster 1'").count() == 1
    s = {r.cluster: r for r in labels.summary(points).collect()}
    assert s[0].num_docs == 4 and s[0].dominant_domain == "d0" and s[1].sample_docs == [1, 3, 5, 7]
    board = labels.dashboard_clusters(labels.label(terms, points).withColumn("num_docs", F.lit(None).cast("long")).withColumn("dominant_domain", F.lit(None).cast("string")).union(spark.createDataFrame([(9, "empty", 0, "x")], "c int, l string, n long, d string")), points)
    assert {r.cluster: r.color for r in board.collect()} == {0: v.PALETTE[0], 1: v.PALETTE[1], 9: v.NO_POINTS_COLOR}
    rng = np.random.default_rng(2)
    vec = spark.createDataFrame([(i, (np.array([8.0 * (i % 3), 0, 0]) + rng.normal(size=3)).tolist()) for i in range(45)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in learn.kmeans(learn.to_vectors(vec), 3, 3).collect()}
    assert len({(i % 3, got[i]) for i in got}) == 3
    xy = learn.project_2d(vec).toPandas()
    assert abs(xy.x.mean()) < 1e-9 and xy.x.var() > xy.y.var()


def test_prompt_context(spark):
    found = spark.createDataFrame([(1, 2, 7, "T", 0.5, "b"), (1, 1, 8, "U", 0.25, "a")], "query_id long, rank int, doc_id long, title string, similarity double, text string")
    assert rag.context(found).first().context == "[Patent 8 | U | score=0.250]\na\n\n[Patent 7 | T | score=0.500]\nb"
    q = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, text string")
    got = {r.query_id: r.answer for r in rag.answer(q, found.withColumn("domain", F.lit("d"))).collect()}
    assert got[2] == rag.NOTHING_FOUND and "8 (U), 7 (T)" in got[1]


def test_color_scale_and_bands(spark):
    df = spark.createDataFrame([(-1,), (0,), (13,)], "c int")
    assert [r[0] for r in df.select(v.cluster_color(F.col("c"))).collect()] == [v.NOISE_COLOR, v.PALETTE[0], v.PALETTE[3]]
    assert spark.range(1).select(v.scale(F.lit(1.0), F.lit(1.0), F.lit(1.0), 1040, 64)).first()[0] == 520
    assert [r[0] for r in spark.createDataFrame([(0.8,), (0.6,), (None,)], "s double").select(v.interpretation(F.col("s"))).collect()] == list(v.BANDS)
    z = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>").select(v.l2_normalize(F.col("v"))).collect()
    assert [r[0] for r in z] == [[0, 0], [0.6, 0.8]]


def test_encoders_and_saved_index(spark, tmp_path):
    from lexigrove.operators import encode

    docs = spark.createDataFrame([(1, "red green blue"), (2, "red green blue"), (3, "other words"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: np.array(r.embedding) for r in encode.hashed_encoding(docs, 32).collect()}
    assert np.allclose(got[1], got[2]) and abs(got[1] @ got[1] - 1) < 1e-6 and abs(got[1] @ got[3]) < 0.9 and not got[4].any()
    made = {r.doc_id: list(r.embedding) for r in encode.encode(docs, lambda xs: [[len(x), 0.0] for x in xs], 2).collect()}
    assert made == {1: [1, 0], 2: [1, 0], 3: [1, 0], 4: [0, 0]}
    text = spark.createDataFrame([(0, "a b")], "cluster int, text string")
    assert encode.keyphrases(text).first().keyword_scores == {}
    assert encode.keyphrases(text, lambda s: [(s, 0.123456)]).first().keyword_scores == {"a b": 0.1235}
    calls = []
    for n in (4, 4, 5):
        assert encode.saved(spark, f"{tmp_path}/index", n, lambda: calls.append(1) or docs).count() == 4
    assert len(calls) == 2


def test_scatter_page(spark):
    from lexigrove.sources import scatter

    rows = spark.createDataFrame([(0.0, 0.0, 0, "a<b"), (1.0, 2.0, -1, "noise")], "x double, y double, cluster int, title string")
    out = scatter.page(rows, {"ari": 0.5, "n": 3, "nmi": None})
    assert out.count("<circle") == 2 and "a&lt;b" in out and v.NOISE_COLOR in out and "<td>0.5000</td>" in out and "N/A" in out
    with pytest.raises(ValueError):
        scatter.page(rows, {}, max_points=1)
