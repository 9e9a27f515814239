"""SQL twins of the registered queries, in DuckDB's dialect."""

from __future__ import annotations

from ..functions import text as t
from ..functions import vectors as v
from ..operators import rag


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_quote(w) for w in words) + "]"


STOP = _list(t.ENGLISH_STOP)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def boilerplate(c: str) -> str:
    for flags, pattern in t.BOILERPLATE:
        c = f"regexp_replace({c}, {_quote((f'(?{flags})' if flags else '') + pattern)}, ' ', 'g')"
    return c


def whitespace(c: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({c}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def words(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOP}, x))"


def white_words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"


def grams(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def one_line(c: str) -> str:
    return strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def terms(source: str, key: str, name: str) -> str:
    return f"""{name}_w AS (SELECT {key}, {words('text')} AS w FROM {source}),
{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({grams('w')}) AS term FROM {name}_w) GROUP BY 1, 2)"""


def vocab(counts: str, n: str, name: str, min_df: int, max_df: float, features: int) -> str:
    return f"{name} AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {counts} GROUP BY term HAVING count(*) >= {min_df} AND count(*) <= {max_df} * ({n}) ORDER BY cf DESC, term LIMIT {features})"


def tfidf(counts: str, vocabulary: str, n: str, key: str, name: str) -> str:
    return f"""{name}_r AS (SELECT {key}, term, tf * (ln((1.0::DOUBLE + ({n})) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM {counts} JOIN {vocabulary} USING (term)),
{name}_n AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {name}_r GROUP BY 1),
{name} AS (SELECT {key}, term, w / norm AS weight FROM {name}_r JOIN {name}_n USING ({key}))"""


N_DOCS = "SELECT count(*) FROM documents"
RECORDS = r"rec AS (SELECT doc_id, text, lang, source AS domain, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 1) AS abstract, string_split(text, chr(10)) AS claims, text AS description FROM documents)"

CENTROIDS = """cell AS (SELECT {group} AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM {source} {where}),
mean AS (SELECT cluster, pos, avg(x) AS x FROM cell GROUP BY 1, 2),
size AS (SELECT cluster, sqrt(sum(x * x)) AS norm FROM mean GROUP BY 1),
cen AS (SELECT cluster, list(x / norm ORDER BY pos) AS c FROM mean JOIN size USING (cluster) GROUP BY cluster)"""
LABEL_CENTROIDS = CENTROIDS.format(group="label", source="embeddings", where="")
ASSIGN = f"""{LABEL_CENTROIDS},
sim AS (SELECT vec_id, label, embedding, cluster, round(list_inner_product(embedding::DOUBLE[], c), 12) AS s FROM embeddings, cen),
pts AS (SELECT vec_id, label, embedding, CASE WHEN s < 0.15 THEN -1 ELSE cluster END AS cluster, s AS best FROM sim QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) = 1)"""
TABLE = f"""{ASSIGN},
ct AS (SELECT label, cluster, count(*) AS n FROM pts GROUP BY 1, 2),
rw AS (SELECT label, sum(n) AS n FROM ct GROUP BY 1), cl AS (SELECT cluster, sum(n) AS n FROM ct GROUP BY 1), tot AS (SELECT sum(n)::DOUBLE AS n FROM ct)"""
ARI = "(SELECT (s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS s, (SELECT sum(n * (n - 1) / 2) FROM rw) AS a, (SELECT sum(n * (n - 1) / 2) FROM cl) AS b, (SELECT n FROM tot) AS n))"
MI = "(SELECT sum(ct.n / tot.n * ln(ct.n * tot.n / (rw.n * cl.n))) FROM ct JOIN rw USING (label) JOIN cl USING (cluster), tot)"
H_TRUE = "(SELECT -sum(rw.n / tot.n * ln(rw.n / tot.n)) FROM rw, tot)"
H_PRED = "(SELECT -sum(cl.n / tot.n * ln(cl.n / tot.n)) FROM cl, tot)"
PURITY = "(SELECT sum(m) / sum(n) FROM (SELECT cluster, max(n) AS m, sum(n) AS n FROM ct {} GROUP BY 1))"
DOC_POINTS = f"{ASSIGN},\ndp AS (SELECT vec_id AS doc_id, cluster, source AS domain, text FROM pts JOIN documents ON doc_id = vec_id)"
SUMMARY = """dom AS (SELECT cluster, domain, count(*) AS n, min(doc_id) AS first FROM dp WHERE cluster <> -1 GROUP BY 1, 2),
summ AS (SELECT cluster, sum(n)::BIGINT AS num_docs, arg_max(domain, (n, -first)) AS dominant_domain, string_agg(domain || ':' || n, ',' ORDER BY domain) AS domain_breakdown FROM dom GROUP BY 1)"""
JOINED = """mem AS (SELECT cluster, doc_id, text FROM dp WHERE cluster <> -1 AND trim(text) <> ''),
joined AS (SELECT cluster, substr(string_agg(text, ' ' ORDER BY doc_id), 1, 10000) AS text FROM mem GROUP BY 1)"""
CLUSTER_TERMS = f"""{DOC_POINTS},
{JOINED},
{terms('joined', 'cluster', 'cc')},
{vocab('cc', 'SELECT count(*) FROM joined', 'cv', 1, 1.0, 5000)},
{tfidf('cc', 'cv', 'SELECT count(*) FROM joined', 'cluster', 'cw')},
ctt AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 12) DESC, term) AS rank, term, round(weight, 12) AS weight FROM cw QUALIFY rank <= 10)"""
LABELS = f"""{CLUSTER_TERMS},
lab AS (SELECT cluster, array_to_string(list_transform(string_split(string_agg(term, ' · ' ORDER BY rank), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM ctt WHERE rank <= 3 GROUP BY 1)"""

CHUNKS = f"""cwords AS (SELECT doc_id, {white_words('text')} AS w FROM documents),
cstart AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {t.CHUNK_OVERLAP}, 1), {t.CHUNK_WORDS - t.CHUNK_OVERLAP})) AS i FROM cwords WHERE len(w) > 0),
cwin AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {t.CHUNK_WORDS}], ' ') AS text FROM cstart),
chunk AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, text FROM cwin WHERE length(text) >= {t.CHUNK_MIN_CHARS})"""


def ranked(corpus: str, key: str, asked: str, features: int, top_k: int) -> str:
    """CTEs up to ranked(query_id, key, similarity, rank)."""
    n = f"SELECT count(*) FROM {corpus}"
    return f"""{terms(corpus, key, 'dc')},
{vocab('dc', n, 'dv', 1, 1.0, features)},
{tfidf('dc', 'dv', n, key, 'dw')},
{terms(asked, 'query_id', 'qc')},
{tfidf('qc', 'dv', n, 'query_id', 'qw')},
hit AS (SELECT query_id, {key}, round(sum(qw.weight * dw.weight), 12) AS similarity FROM qw JOIN dw USING (term) GROUP BY 1, 2),
every AS (SELECT query_id, {key}, 0.0::DOUBLE AS similarity FROM (SELECT DISTINCT query_id FROM {asked}), (SELECT DISTINCT {key} FROM {corpus} ORDER BY {key} LIMIT {2 * top_k})),
ranked AS (SELECT query_id, {key}, max(similarity) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY max(similarity) DESC, {key}) AS rank FROM (FROM hit UNION ALL FROM every) GROUP BY 1, 2 QUALIFY rank <= {top_k})"""


ITEMS = "ask AS (SELECT item_id AS query_id, text FROM benchmark)"
QUESTIONS = "ask AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user' AND trim(text) <> '')"
ITEM_RANKS = f"WITH {ITEMS}, {ranked('documents', 'doc_id', 'ask', 12_000, 5)}"
ITEM_TOP = f"WITH {ITEMS}, {ranked('documents', 'doc_id', 'ask', 12_000, 1)}"
RAG = f"""WITH {CHUNKS}, {QUESTIONS}, {RECORDS},
ch AS (SELECT doc_id::BIGINT * 1000000 + chunk_index AS chunk_id, text FROM chunk),
{ranked('ch', 'chunk_id', 'ask', 16_000, 6)},
found AS (SELECT query_id, rank, r.chunk_id // 1000000 AS doc_id, (r.chunk_id % 1000000)::INT AS chunk_index, similarity, coalesce(title, '') AS title, coalesce(domain, 'unknown') AS domain FROM ranked r LEFT JOIN rec ON rec.doc_id = r.chunk_id // 1000000)"""
BAND = f"CASE WHEN similarity >= {v.HIGH} THEN {_quote(v.BANDS[0])} WHEN similarity >= {v.MODERATE} THEN {_quote(v.BANDS[1])} ELSE {_quote(v.BANDS[2])} END"
TOP_DOMAINS = "td AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) AS place, domain, count(*) AS n FROM found GROUP BY query_id, domain QUALIFY place <= 3)"
SUPPORT = "sd AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place, doc_id, title FROM found GROUP BY query_id, doc_id, title)"

PAIRS = "pair AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
NOVELTY = f"{PAIRS}, nov AS (SELECT a AS vec_id, b AS neighbor_id, s AS similarity, 1 - s AS novelty_score FROM pair QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1)"
DIST = "dist AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), near AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM dist QUALIFY rank <= 4), core AS (SELECT a AS vec_id, max(d) AS core FROM near GROUP BY 1)"


def _html(c: str) -> str:
    for tag in t.DROPPED:
        c = rf"regexp_replace({c}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', '', 'g')"
    c = f"regexp_replace({c}, '(?is)<!--.*?-->', '', 'g')"
    c = f"regexp_replace({c}, '(?is)^.*?<body[^>]*>', '', 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]*>', chr(10), 'g')"
    for entity, value in t.ENTITIES:
        c = f"replace({c}, {_quote(entity)}, {_quote(value)})"
    c = rf"regexp_replace({c}, '[ \t]*\n[ \t]*', chr(10), 'g')"
    return strip(rf"regexp_replace(regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")


def _truncated(c: str, limit: int, tail: str) -> str:
    return f"CASE WHEN length({c}) > {limit} THEN {tail} ELSE {c} END"


def _profile() -> str:
    w = r"regexp_extract_all(lower(substr(text, 1, 800)), '\p{L}+')"
    scores = [f"{{'n': len(list_filter(w, lambda x: list_contains({_list(own)}, x))), 'o': {-i}, 'lang': '{name}'}}" for i, (name, own) in enumerate(sorted(t.LANGUAGE_PROFILE.items()))]
    return f"SELECT doc_id, CASE WHEN m.n > 0 THEN m.lang ELSE 'unknown' END AS lang_detected FROM (SELECT doc_id, list_max([{', '.join(scores)}]) AS m FROM (SELECT doc_id, {w} AS w FROM documents))"


def _has(word: str) -> str:
    return f"list_contains(k, '{word}')"


TOKENS = "tk AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9_]+') AS k FROM documents WHERE trim(text) <> '')"
STATUS = f"CASE WHEN text IS NULL THEN 'failed' WHEN length({strip('abstract')}) = 0 AND length({strip('description')}) = 0 THEN 'empty' WHEN coalesce(lang, 'en') <> 'en' THEN 'language' ELSE 'ok' END"
CLEAN = whitespace(boilerplate("text"))
RENDERED = (
    "'PATENT ID: ' || doc_id || chr(10) || 'TITLE: ' || title || chr(10) || 'DOMAIN: ' || domain || chr(10) || 'INVENTOR: ' || chr(10) || 'ASSIGNEE: ' || chr(10) || 'FILING DATE: ' "
    "|| chr(10) || chr(10) || '=== ABSTRACT ===' || chr(10) || CASE WHEN abstract <> '' THEN abstract ELSE 'N/A' END "
    "|| chr(10) || chr(10) || '=== CLAIMS ===' || chr(10) || array_to_string(list_transform(claims, lambda x: '  ' || x), chr(10)) "
    "|| chr(10) || chr(10) || '=== DESCRIPTION ===' || chr(10) || CASE WHEN description <> '' THEN description ELSE 'N/A' END"
)


def _scale(x: str, low: str, high: str, size: int, pad: int, invert: bool) -> str:
    share = f"(({x} - {low}) / ({high} - {low}))"
    return f"CASE WHEN {low} = {high} THEN {size / 2} ELSE {pad} + {f'(1 - {share})' if invert else share} * {size - 2 * pad} END"


def oracle_sql() -> dict[str, str]:
    color = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(v.PALETTE))
    color = f"CASE WHEN cluster = -1 THEN '{v.NOISE_COLOR}' ELSE CASE cluster % {len(v.PALETTE)} {color} END END"
    n_white = lambda c: f"len({white_words(c)})"
    found = {
        "scan_documents": "SELECT doc_id, lang, source, n_chars, length(text) AS length FROM documents",
        "scan_vectors": "SELECT vec_id, label, len(embedding) AS dim FROM embeddings",
        "vector_stats": "SELECT count(*) AS n, max(len(embedding)) AS dim, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings",
        "l2_normalize": "WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3.0::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e) SELECT vec_id, round(v[1] / n, 6) AS x0, round(sqrt(list_inner_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n))), 6) AS norm FROM u",
        "cosine_pairs": f"WITH {LABEL_CENTROIDS} SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], c), 6) AS similarity FROM embeddings JOIN cen ON cluster = label",
        "filter_language": "SELECT doc_id, lang FROM documents WHERE lower(coalesce(lang, 'en')) = 'en'",
        "lang_profile": _profile(),
        "drop_empty": f"WITH {RECORDS} SELECT doc_id FROM rec WHERE length({strip('abstract')}) > 0 OR length({strip('description')}) > 0",
        "process_status": f"WITH {RECORDS} SELECT doc_id, {STATUS} AS status FROM rec",
        "status_counts": f"WITH {RECORDS} SELECT {STATUS} AS status, count(*) AS n FROM rec GROUP BY 1",
        "clean_boilerplate": f"SELECT doc_id, {boilerplate('text')} AS text FROM documents",
        "normalize_ws": f"SELECT doc_id, {whitespace('text')} AS text FROM documents",
        "clean_text": f"SELECT doc_id, {CLEAN} AS text FROM documents",
        "process_text": rf"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower({CLEAN}), '\p{{L}}+'), lambda x: length(x) > 2 AND NOT list_contains({STOP}, x)), ' ') AS text FROM documents",
        "token_counts": f"SELECT doc_id, {n_white('text')} AS tokens_raw, {n_white(CLEAN)} AS tokens_clean FROM documents",
        "catalog": f"WITH {RECORDS} SELECT doc_id, domain, length(abstract) > 0 AS has_abstract, len(claims) > 0 AS has_claims, length(description) > 0 AS has_description, len(claims) AS claim_count FROM rec",
        "resume_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "safe_id": r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_]', '_', 'g') AS safe_id FROM pages",
        "truncate_title": f"SELECT doc_id, {_truncated('t', 120, 'rtrim(substr(t, 1, 119)) || chr(8230)')} AS title FROM (SELECT doc_id, {one_line('text')} AS t FROM documents)",
        "summarize_text": f"""SELECT doc_id, {_truncated('t', 220, "substr(t, 1, 220) || '... [truncated ' || (length(t) - 220) || ' chars]'")} AS summary FROM (SELECT doc_id, {one_line('text')} AS t FROM documents)""",
        "candidate_text": f"SELECT doc_id, concat_ws('. ', nullif({strip('lang')}, ''), nullif({strip('source')}, ''), nullif({strip('text')}, '')) AS query_text FROM documents",
        "render_doc_text": f"WITH {RECORDS} SELECT doc_id, {strip(chr(39).join(['title || ', '. ', ' || abstract || ', ' ', ' || coalesce(claims[1], ', '', ')']))} AS text FROM rec",
        "render_rag_text": f"WITH {RECORDS} SELECT doc_id, {strip(RENDERED)} AS text FROM rec",
        "join_inner_meta": "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
        "join_left_meta": "SELECT d.doc_id, d.source, coalesce(l.quality::VARCHAR, '') AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
        "html_to_text": f"SELECT page_id, {_html('html')} AS text FROM pages",
        "tokenize_index": "SELECT doc_id, len(k) AS n_tokens, len(list_distinct(k)) AS n_terms, array_to_string(k, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS k FROM documents)",
        "inverted_index": f"WITH {TOKENS} SELECT term, count(*) AS df, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(doc_id)::BIGINT AS id_sum FROM (SELECT doc_id, unnest(list_distinct(k)) AS term FROM tk) GROUP BY 1",
        "boolean_term": f"WITH {TOKENS} SELECT doc_id FROM tk WHERE {_has('the')}",
        "boolean_and": f"WITH {TOKENS} SELECT doc_id FROM tk WHERE {_has('the')} AND {_has('und')}",
        "boolean_or": f"WITH {TOKENS} SELECT doc_id FROM tk WHERE {_has('que')} OR {_has('und')}",
        "boolean_not": f"WITH {TOKENS} SELECT doc_id FROM tk WHERE NOT {_has('the')}",
        "boolean_nested": f"WITH {TOKENS} SELECT doc_id FROM tk WHERE ({_has('the')} OR {_has('que')}) AND NOT ({_has('und')} OR {_has('les')})",
        "boolean_phrase": f"WITH {TOKENS} SELECT doc_id FROM tk WHERE {_has('of')} AND {_has('the')} AND contains(lower(text), 'of the')",
        "boolean_search": f"WITH {TOKENS}, h AS (SELECT doc_id FROM tk WHERE {_has('the')} AND NOT ({_has('que')} OR {_has('und')})) SELECT doc_id, (SELECT count(*) FROM h) AS total_matches FROM h ORDER BY doc_id LIMIT 10",
        "ngrams": f"SELECT doc_id, array_to_string({grams('w')}, '|') AS ngrams FROM (SELECT doc_id, {words('text')} AS w FROM documents)",
        "term_stats": f"WITH {terms('documents', 'doc_id', 'c')} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c GROUP BY 1",
        "vocab": f"WITH {terms('documents', 'doc_id', 'c')}, {vocab('c', N_DOCS, 'v', 2, 0.95, 12000)} SELECT * FROM v",
        "tfidf": f"WITH {terms('documents', 'doc_id', 'c')}, {vocab('c', N_DOCS, 'v', 2, 0.95, 12000)}, {tfidf('c', 'v', N_DOCS, 'doc_id', 'x')} SELECT doc_id, term, round(weight, 6) AS weight FROM x",
        "bm25": f"""WITH {terms('documents', 'doc_id', 'c')}, {vocab('c', N_DOCS, 'v', 2, 0.95, 12000)},
            k AS (SELECT doc_id, term, tf, df FROM c JOIN v USING (term)), l AS (SELECT doc_id, sum(tf) AS len FROM k GROUP BY 1), a AS (SELECT sum(len) / ({N_DOCS})::DOUBLE AS avg FROM l)
            SELECT doc_id, term, round(ln(1 + (({N_DOCS}) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)), 6) AS weight FROM k JOIN l USING (doc_id), a""",
        "chunk_text": f"WITH {CHUNKS} SELECT doc_id, chunk_index, text FROM chunk",
        "chunk_stats": f"WITH {CHUNKS}, p AS (SELECT d.doc_id, n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunk GROUP BY 1) c ON c.doc_id = d.doc_id) SELECT coalesce(sum(n), 0)::BIGINT AS n_chunks, count(*) AS n_docs, count(*) FILTER (n IS NULL) AS n_without, round(coalesce(sum(n), 0) / count(*), 6) AS avg_chunks FROM p",
        "chunk_join_doc": f"WITH {CHUNKS}, {RECORDS} SELECT c.doc_id, chunk_index, coalesce(title, '') AS title, coalesce(domain, 'unknown') AS domain FROM chunk c LEFT JOIN rec ON rec.doc_id = c.doc_id",
        "tfidf_topk": f"{ITEM_RANKS} SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM ranked",
        "novelty_tfidf": f"{ITEM_TOP} SELECT query_id, doc_id, round(similarity, 6) AS top_similarity, round(1 - similarity, 6) AS novelty_score, {BAND} AS interpretation FROM ranked",
        "novelty_band": f"{ITEM_TOP} SELECT {BAND} AS interpretation, count(*) AS n FROM ranked GROUP BY 1",
        "novelty_query": "SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id)::INT AS rank, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5",
        "novelty_corpus": f"WITH {NOVELTY} SELECT vec_id, neighbor_id, round(similarity, 6) AS similarity, round(novelty_score, 6) AS novelty_score FROM nov",
        "novelty_summary": f"WITH {NOVELTY} SELECT count(*) AS n, round(avg(similarity), 6) AS mean_similarity, round(avg(novelty_score), 6) AS mean_novelty, round(median(novelty_score), 6) AS median_novelty, round(min(novelty_score), 6) AS min_novelty, round(max(novelty_score), 6) AS max_novelty FROM nov",
        "rag_tfidf": f"{RAG} SELECT query_id, rank::INT AS rank, doc_id, chunk_index, round(similarity, 6) AS similarity FROM found",
        "rag_vector": f"WITH {RECORDS}, r AS (SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id)::INT AS rank, b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 6) SELECT query_id, rank, r.doc_id, coalesce(title, '') AS title, coalesce(domain, 'unknown') AS domain, similarity FROM r LEFT JOIN rec ON rec.doc_id = r.doc_id",
        "rag_domains": f"{RAG}, {TOP_DOMAINS} SELECT query_id, place::INT AS place, domain, n FROM td",
        "supporting_docs": f"{RAG}, {SUPPORT} SELECT query_id, place::INT AS place, doc_id, title FROM sd",
        "rag_context": f"{RAG} SELECT query_id, string_agg(printf('[Patent %s | %s | score=%.3f]', f.doc_id::VARCHAR, title, similarity) || chr(10) || c.text, chr(10) || chr(10) ORDER BY rank) AS context FROM found f JOIN chunk c ON c.doc_id = f.doc_id AND c.chunk_index = f.chunk_index GROUP BY 1",
        "rag_answer": f"""{RAG}, {TOP_DOMAINS}, {SUPPORT}, a AS (SELECT query_id, string_agg(domain, ', ' ORDER BY place) AS d FROM td GROUP BY 1), b AS (SELECT query_id, string_agg(doc_id || ' (' || title || ')', ', ' ORDER BY place) AS s FROM sd WHERE place <= 3 GROUP BY 1)
            SELECT q.query_id, CASE WHEN d IS NULL THEN {_quote(rag.NOTHING_FOUND)} ELSE {_quote(rag.ANSWER[0])} || d || {_quote(rag.ANSWER[1])} || s || {_quote(rag.ANSWER[2])} END AS answer, 'retrieval-only' AS mode
            FROM (SELECT conv_id * 1000 + turn AS query_id FROM conversations WHERE role = 'user') q LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""",
        "assign_centroid": f"WITH {ASSIGN} SELECT vec_id, label, cluster, round(best, 6) AS best FROM pts",
        "contingency": f"WITH {TABLE} SELECT label, cluster, n FROM ct",
        "ari": f"WITH {TABLE} SELECT round({ARI}, 6) AS ari",
        "nmi": f"WITH {TABLE} SELECT round({MI} / (({H_TRUE} + {H_PRED}) / 2), 6) AS nmi",
        "homogeneity": f"WITH {TABLE} SELECT round({MI} / {H_TRUE}, 6) AS homogeneity",
        "purity": f"WITH {TABLE} SELECT round({PURITY.format('')}, 6) AS purity",
        "purity_non_noise": f"WITH {TABLE} SELECT round({PURITY.format('WHERE cluster <> -1')}, 6) AS purity",
        "cluster_counts": f"WITH {ASSIGN} SELECT count(*) AS n_points, count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters, count(*) FILTER (cluster = -1) AS n_noise FROM pts",
        "centroids": f"WITH {ASSIGN}, c2 AS (SELECT cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM pts WHERE cluster <> -1), m2 AS (SELECT cluster, pos, avg(x) AS x FROM c2 GROUP BY 1, 2), s2 AS (SELECT cluster, sqrt(sum(x * x)) AS norm FROM m2 GROUP BY 1) SELECT cluster, pos - 1 AS pos, round(x / norm, 6) AS x FROM m2 JOIN s2 USING (cluster)",
        "assign_noise": f"WITH {ASSIGN}, c2 AS (SELECT cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM pts WHERE cluster <> -1), m2 AS (SELECT cluster, pos, avg(x) AS x FROM c2 GROUP BY 1, 2), s2 AS (SELECT cluster, sqrt(sum(x * x)) AS norm FROM m2 GROUP BY 1), e2 AS (SELECT cluster, list(x / norm ORDER BY pos) AS c FROM m2 JOIN s2 USING (cluster) GROUP BY 1), b2 AS (SELECT vec_id, e2.cluster AS near FROM pts, e2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(embedding::DOUBLE[], c), 12) DESC, e2.cluster) = 1) SELECT vec_id, cluster AS raw_cluster, CASE WHEN cluster = -1 THEN near ELSE cluster END AS cluster, cluster = -1 AS was_noise FROM pts JOIN b2 USING (vec_id)",
        "silhouette": f"WITH {ASSIGN}, p AS (SELECT vec_id, cluster, embedding::DOUBLE[] AS e FROM pts WHERE cluster <> -1), s AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.e, b.e)) AS total, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3), r AS (SELECT vec_id, max(total / (n - 1)) FILTER (own = other AND n > 1) AS a, min(total / n) FILTER (own <> other) AS b FROM s GROUP BY 1) SELECT vec_id, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM r",
        "core_distance": f"WITH {DIST} SELECT vec_id, round(core, 6) AS core FROM core",
        "mutual_reachability": f"WITH {DIST} SELECT n.a AS query_id, rank::INT AS rank, round(greatest(x.core, y.core, d), 6) AS reach FROM near n JOIN core x ON x.vec_id = a JOIN core y ON y.vec_id = b",
        "cluster_members": f"WITH {DOC_POINTS}, {JOINED} SELECT cluster, count(*) AS n, sum(length(text))::BIGINT AS chars, min(doc_id) AS first_id FROM mem GROUP BY 1",
        "cluster_summary": f"WITH {DOC_POINTS}, {SUMMARY}, smp AS (SELECT cluster, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS sample_docs FROM (SELECT cluster, doc_id FROM dp WHERE cluster <> -1 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY doc_id) <= 5) GROUP BY 1) SELECT cluster, num_docs, dominant_domain, domain_breakdown, sample_docs FROM summ JOIN smp USING (cluster)",
        "cluster_tfidf_terms": f"WITH {CLUSTER_TERMS} SELECT cluster, rank::INT AS rank, term, round(weight, 6) AS weight FROM ctt",
        "cluster_label": f"WITH {LABELS} SELECT cluster, label FROM lab",
        "cluster_label_merge": f"WITH {LABELS}, {SUMMARY} SELECT cluster, label, num_docs, dominant_domain FROM lab JOIN summ USING (cluster)",
        "dashboard_clusters": f"WITH {LABELS}, {SUMMARY} SELECT cluster, label, num_docs, dominant_domain, {color} AS color FROM lab JOIN summ USING (cluster)",
        "dashboard_summary": f"WITH {TABLE} SELECT (SELECT count(*) FROM pts) AS n_points, (SELECT count(DISTINCT cluster) FROM pts WHERE cluster <> -1) AS n_clusters, (SELECT count(*) FROM pts WHERE cluster = -1) AS n_noise, round({ARI}, 6) AS ari, round({MI} / (({H_TRUE} + {H_PRED}) / 2), 6) AS nmi, round({MI} / {H_TRUE}, 6) AS homogeneity, round({PURITY.format('')}, 6) AS purity",
        "dashboard_rows": f"WITH {LABELS}, {SUMMARY}, smp AS (SELECT cluster, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS sample_docs FROM (SELECT cluster, doc_id FROM dp WHERE cluster <> -1 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY doc_id) <= 5) GROUP BY 1), tt AS (SELECT cluster, string_agg(term, '|' ORDER BY rank) AS tfidf_terms FROM ctt GROUP BY 1) SELECT cluster, label, '' AS keywords, tfidf_terms, num_docs, dominant_domain, domain_breakdown, sample_docs, {color} AS color FROM lab JOIN tt USING (cluster) JOIN summ USING (cluster) JOIN smp USING (cluster)",
        "domain_share": f"WITH {DOC_POINTS}, b AS (SELECT cluster, domain, count(*) AS n FROM dp WHERE cluster <> -1 GROUP BY 1, 2) SELECT cluster, domain, floor(n * 100 / sum(n) OVER (PARTITION BY cluster) + 0.5)::BIGINT AS percent FROM b",
        "cluster_color": f"WITH {ASSIGN} SELECT vec_id, {color} AS color FROM pts",
        "plot_scale": f"WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) SELECT vec_id, round({_scale('x', 'x0', 'x1', 1040, 64, False)}, 6) AS px, round({_scale('y', 'y0', 'y1', 700, 64, True)}, 6) AS py FROM p, e",
    }
    # Queries over others.
    found["dashboard_metrics"] = f"SELECT * FROM ({found['dashboard_summary']}) CROSS JOIN (SELECT round(avg(silhouette), 6) AS silhouette FROM ({found['silhouette'].replace(', 6) AS silhouette', ', 15) AS silhouette')}))"
    found["assignment_rows"] = f"SELECT n.vec_id, n.cluster, raw_cluster, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, was_noise, {color.replace('cluster', 'n.cluster')} AS color FROM ({found['assign_noise']}) n JOIN embeddings USING (vec_id)"
    return found
