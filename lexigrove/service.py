"""The service's calls as plain functions: health, dashboard, novelty scoring, question answering."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as v
from .operators import knn, rag, vectorize

MODES = ("auto", "semantic", "tfidf")
log = logging.getLogger("lexigrove.service")


class ConfigurationError(RuntimeError):
    """Something that the chosen mode needs is missing (a service answers 503)."""


def parse_bool(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def parse_env(text: str) -> dict[str, str]:
    """key=value lines; quotes around values and lines that start with # don't count."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            out[key.strip()] = value.strip().strip("'\"")
    return out


class InvalidRequest(ValueError):
    """A field is missing, of the wrong type or out of its range (a service answers 422)."""


@dataclass
class Service:
    """Corpus tables and options.

    ``documents``: doc_id, text, title, domain.  ``vectors``: doc_id, embedding, and
    ``chunk_vectors``: doc_id, chunk_index, embedding (both optional).
    ``encoder``: text -> list of floats, for the semantic mode (optional).
    ``llm``: (question, context) -> answer, or ``chat``: messages -> answer (optional).
    ``clusters``: rows of labels.dashboard_rows, ``assignments``: rows of
    cluster.assignment_rows, ``metrics``: one row; for the dashboard (optional).
    """

    spark: SparkSession
    documents: DataFrame
    vectors: DataFrame | None = None
    encoder: Callable[[str], list[float]] | None = None
    llm: Callable[[str, str], str] | None = None
    mode: str = "auto"
    max_features: int = 12_000
    chunk_vectors: DataFrame | None = None
    chat: Callable[[list[dict]], str] | None = None
    clusters: DataFrame | None = None
    assignments: DataFrame | None = None
    metrics: DataFrame | None = None
    max_points: int = 20_000
    _kept: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ConfigurationError(f"unknown retrieval mode {self.mode!r}")

    def retrieval_mode(self, vectors: str = "vectors") -> str:
        """auto takes vectors where there are vectors and an encoder; semantic insists on them."""
        ready = getattr(self, vectors) is not None and self.encoder is not None
        if self.mode == "semantic" and not ready:
            raise ConfigurationError("the semantic mode needs vectors and an encoder")
        return "semantic" if ready and self.mode != "tfidf" else "tfidf"

    def health(self) -> dict:
        try:
            mode = self.retrieval_mode()
        except ConfigurationError as e:
            return {"status": "degraded", "detail": str(e)}
        rows = {name: table.count() if table is not None else 0 for name, table in (("doc_index_vectors", self.vectors), ("chunk_index_vectors", self.chunk_vectors))}
        return {"status": "ok", "runtime": {"configured_retrieval_mode": mode, "semantic_query_model_loaded": self.encoder is not None, "llm_configured": (self.llm or self.chat) is not None, **rows}}

    def dashboard(self) -> dict:
        """summary, metrics, clusters and points; more than ``max_points`` points are an error, not a sample."""
        if self.clusters is None or self.assignments is None:
            raise ConfigurationError("the dashboard needs clusters and assignments")
        points = [r.asDict(True) for r in self.assignments.limit(self.max_points + 1).collect()]
        if len(points) > self.max_points:
            raise ConfigurationError(f"more than {self.max_points} points")
        clusters = [r.asDict(True) for r in self.clusters.orderBy("cluster").collect()]
        first = self.metrics.first() if self.metrics is not None else None
        metrics = first.asDict(True) if first is not None else {}
        counted = {"num_documents": len(points), "num_clusters": len(clusters), "noise_points": 0}
        summary = {name: metrics.get(name, counted.get(name)) for name in (*counted, "ari", "nmi", "homogeneity", "purity", "silhouette")}
        return {"summary": summary, "metrics": metrics, "clusters": clusters, "points": points}

    def _space(self) -> tuple:
        """Vocabulary and weights, computed once and kept until close()."""
        if not self._kept:
            n = self.documents.count()
            counts = vectorize.term_counts(self.documents)
            vocab = vectorize.vocabulary(counts, n, max_features=self.max_features).persist()
            self._kept = {"n": n, "vocab": vocab, "weights": vectorize.tfidf(counts, vocab, n).persist()}
        return self._kept["n"], self._kept["vocab"], self._kept["weights"]

    def close(self) -> None:
        for name in ("vocab", "weights"):
            if name in self._kept:
                self._kept[name].unpersist()
        self._kept = {}

    def _encoded(self, text: str, id_col: str) -> DataFrame:
        return self.spark.createDataFrame([(-1, [float(x) for x in self.encoder(text)])], f"{id_col} long, embedding array<double>")

    def _semantic_or_words(self, mode: str, semantic: Callable[[], list], words: Callable[[], list]) -> tuple[str, list]:
        """The rows of the semantic search; where it fails, for this request those of the words (never a mix)."""
        if mode == "semantic":
            try:
                return mode, semantic()
            except Exception as e:  # an encoder or index that fails must not fail the request
                log.warning("semantic retrieval failed, falling back to words: %s", e)
        return "tfidf", words()

    def score_novelty(self, title: str = "", abstract: str = "", claim_text: str = "", top_k: int = 5) -> dict:
        rag.check_top_k(top_k)
        query = ". ".join(x.strip() for x in (title, abstract, claim_text) if x.strip())
        if not query:
            raise ValueError("empty candidate")

        def named(near: DataFrame) -> list:
            return near.join(self.documents.select("doc_id", "title", "domain"), "doc_id", "left").orderBy("rank").collect()

        def semantic() -> list:
            near = knn.nearest(self._encoded(query, "doc_id"), self.vectors, top_k, id_col="doc_id")
            return named(near.select(F.col("neighbor_id").alias("doc_id"), F.col("score").alias("similarity"), "rank"))

        def words() -> list:
            n, vocab, weights = self._space()
            asked = self.spark.createDataFrame([(0, query)], "query_id long, text string")
            return named(vectorize.rank_by_similarity(weights, vectorize.query_weights(asked, vocab, n), self.documents, asked, top_k))

        mode, rows = self._semantic_or_words(self.retrieval_mode(), semantic, words)
        matches = [{"rank": r.rank, "doc_id": r.doc_id, "title": r.title or "", "domain": r.domain or "unknown", "similarity": r.similarity, "novelty_score": 1 - r.similarity} for r in rows]
        top = matches[0]["similarity"] if matches else None
        band = v.BANDS[0] if top is not None and top >= v.HIGH else v.BANDS[1] if top is not None and top >= v.MODERATE else v.BANDS[2]
        return {"query_text": query, "retrieval_mode": mode, "novelty_score": None if top is None else 1 - top, "top_similarity": top, "interpretation": band, "matches": matches}

    def ask(self, question: str, top_k: int = 6) -> dict:
        rag.check_top_k(top_k)
        if not question.strip():
            raise ValueError("empty question")
        asked = self.spark.createDataFrame([(-1, question)], "query_id long, text string")
        chunks = rag.chunk_table(self.documents)

        def whole(found: DataFrame) -> list:
            rows = rag.with_documents(found, self.documents).join(chunks, ["doc_id", "chunk_index"])
            return rows.orderBy("rank").select("query_id", "rank", "doc_id", "title", "domain", "chunk_index", "similarity", "text").collect()

        mode, rows = self._semantic_or_words(
            self.retrieval_mode("chunk_vectors"),
            lambda: whole(rag.retrieve_chunk_vectors(self._encoded(question, "query_id"), self.chunk_vectors, top_k)),
            lambda: whole(rag.retrieve_tfidf(asked, chunks, top_k)),
        )
        schema = "query_id long, rank int, doc_id long, title string, domain string, chunk_index int, similarity double, text string"
        llm = self.llm or (None if self.chat is None else lambda q, c, chat=self.chat: chat(rag.messages(q, c)))
        answer = rag.answer(asked, self.spark.createDataFrame(rows, schema), llm).first()
        shown = [{k: x for k, x in r.asDict().items() if k != "query_id"} for r in rows]
        seen: dict = {}
        for r in shown:
            seen.setdefault(r["doc_id"], {k: r[k] for k in ("doc_id", "title", "domain")})
        return {"question": question, "answer": answer.answer, "mode": answer.mode, "retrieval_mode": mode, "retrieved_chunks": shown, "supporting_documents": list(seen.values())}

    def handle(self, call: str, body: dict | str | None = None, request_id: str | None = None) -> tuple[int, dict, dict]:
        """(status, answer, headers) of health, dashboard, novelty or rag, as a web service would give them.

        Missing configuration is 503, bad input 400, a field of the wrong type or range
        422, anything else 500 without its cause; the request id is given back.
        """
        headers = {"X-Request-ID": request_id or uuid.uuid4().hex}
        log.info("%s %s %s", headers["X-Request-ID"], call, summarize_body(body))
        try:
            if call == "health":
                return 200, self.health(), headers
            if call == "dashboard":
                return 200, self.dashboard(), headers
            if call not in REQUESTS:
                return 404, {"detail": "Not Found"}, headers
            fields = checked(call, body)
            return 200, (self.score_novelty if call == "novelty" else self.ask)(**fields), headers
        except ConfigurationError as e:
            return 503, {"detail": str(e)}, headers
        except InvalidRequest as e:
            return 422, {"detail": e.args[0]}, headers
        except ValueError as e:
            return 400, {"detail": str(e)}, headers
        except Exception:
            log.exception("unhandled error of %s", call)
            return 500, {"detail": "Internal server error"}, headers


#: Fields of a request: their type, default (... where there is none) and range.
REQUESTS = {
    "novelty": {"title": (str, "", None), "abstract": (str, "", None), "claim_text": (str, "", None), "top_k": (int, 5, rag.TOP_K_RANGE)},
    "rag": {"question": (str, ..., None), "top_k": (int, 6, rag.TOP_K_RANGE)},
}


def checked(call: str, body: dict | str | None) -> dict:
    """The request's fields with their defaults; InvalidRequest lists what is wrong with them."""
    if isinstance(body, str):
        try:
            body = json.loads(body)
        except json.JSONDecodeError as e:
            raise InvalidRequest([{"loc": ["body"], "msg": f"JSON decode error: {e.msg}"}]) from e
    body = {} if body is None else body
    if not isinstance(body, dict):
        raise InvalidRequest([{"loc": ["body"], "msg": "an object is needed"}])
    out, wrong = {}, []
    for name, (kind, default, limits) in REQUESTS[call].items():
        value = body.get(name, default)
        if value is ...:
            wrong.append({"loc": ["body", name], "msg": "Field required"})
        elif not isinstance(value, kind) or isinstance(value, bool):
            wrong.append({"loc": ["body", name], "msg": f"{kind.__name__} needed"})
        elif limits and not limits[0] <= value <= limits[1]:
            wrong.append({"loc": ["body", name], "msg": f"must lie in {limits[0]}..{limits[1]}"})
        else:
            out[name] = value
    if wrong:
        raise InvalidRequest(wrong)
    return out


def summarize_body(body: dict | str | bytes | None, limit: int = 300) -> dict | str:
    """A request body for logs, long strings cut; text that is JSON is read, other text is cut as it is."""
    def short(x: object) -> object:
        return f"{x[:limit]}... [truncated {len(x) - limit} chars]" if isinstance(x, str) and len(x) > limit else x

    if isinstance(body, bytes):
        body = body.decode("utf-8", "replace")
    if isinstance(body, str):
        try:
            body = json.loads(body)
        except json.JSONDecodeError:
            return short(body)
    return {k: short(x) for k, x in body.items()} if isinstance(body, dict) else "" if body is None else short(json.dumps(body))
