"""Text functions as Spark expressions: cleaning, tokens, n-grams, chunks, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ten substitutions, in order, as (inline flags, pattern); each match becomes a blank.
BOILERPLATE = (
    ("is", r"(this application (is a continuation|claims priority|hereby incorporates)[^.]*\.[\s]*)+"),
    ("i", r"(each of which is hereby incorporated by reference[^.]*\.)"),
    ("i", r"(U\.S\.|WO|EP|PCT)\s+(Pat\.|patent|application)\s+(App\.|Pub\.|No\.)\s+[\w,/]+"),
    ("i", r"\bfigs?\.?\s*\d+[\w\-]*\b"),
    ("", r"\[\d{4}\]"),
    ("", r"<[^>]+>"),
    ("", r"&[a-zA-Z]+;|&#\d+;"),
    ("", r"[âÂ©®°±×÷€£¥§¶†‡•…‰›‹«»]"),
    ("is", r"(a non-transitory computer.readable medium containing instructions[^,]*,\s*when executed[^,]*,\s*cause[^:]*:)"),
    ("", r"\b[A-Z]{2,6}-\d{4,}[A-Z]{0,4}\d{0,2}\b"),
)
# Window, overlap and least length of chunks; truncation limits.
CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_MIN_CHARS = 280, 40, 100
TITLE_LIMIT, SUMMARY_LIMIT, PAGE_LIMIT, LABEL_TEXT_LIMIT = 120, 220, 100_000, 10_000

#: Our own short stop lists (the libraries' lists aren't part of this project).
ENGLISH_STOP = tuple("a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you".split())
LANGUAGE_PROFILE = {
    "de": tuple("der die das und ist nicht ein eine zu den mit von auf für im".split()),
    "en": ENGLISH_STOP,
    "es": tuple("el la los las de que y en un una es por con para no".split()),
    "fr": tuple("le la les de des et est un une dans que pour qui sur avec".split()),
}


def words_in(names: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(w) for w in names))


def strip(c: Column) -> Column:
    """Without white space at both ends (F.trim removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_boilerplate(c: Column) -> Column:
    for flags, pattern in BOILERPLATE:
        c = F.regexp_replace(c, f"(?{flags}U){pattern}", " ")
    return c


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    return normalize_whitespace(remove_boilerplate(c))


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w]", "_")


def whitespace_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def index_tokens(c: Column) -> Column:
    """ASCII words for the inverted index."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), 0)


def word_tokens(c: Column, stop: tuple[str, ...] = ENGLISH_STOP) -> Column:
    """Words of two letters or more, without stop words."""
    w = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    return F.filter(w, lambda x: ~x.isin(*stop)) if stop else w


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once: inside f it is a variable, not an expression.

    Without this, a lambda within f would compute the value anew for every element.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ngrams(words: Column, longest: int = 2) -> Column:
    """All 1- to ``longest``-grams of an array of words that hold no white space.

    Longer ones are read off the joined words by one expression each: from every
    word on, what stands ahead; no array is made for a single n-gram.
    """

    def of(w: Column) -> Column:
        joined = F.array_join(w, " ")
        return F.concat(w, *(F.regexp_extract_all(joined, F.lit(rf"(?=(\S+(?: \S+){{{n - 1}}}))\S+"), F.lit(1)) for n in range(2, longest + 1)))

    return bind(words, of)


def process_text(c: Column, stop: tuple[str, ...] = ENGLISH_STOP, lemma: Column | None = None) -> Column:
    """Lower-cased alphabetic words over two letters, no stop words, joined by blanks.

    ``lemma``: an optional map column from word to lemma; words it lacks stay.
    """
    w = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), 0), lambda x: (F.length(x) > 2) & ~x.isin(*stop))
    if lemma is not None:
        w = F.transform(w, lambda x: F.coalesce(F.element_at(lemma, x), x))
    return F.array_join(w, " ")


def chunks(c: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_MIN_CHARS) -> Column:
    """Array of overlapping word windows; the first that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the window size")

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))

    return F.filter(bind(whitespace_words(c), of), lambda x: F.length(x) >= least)


def truncate_title(c: Column, limit: int = TITLE_LIMIT) -> Column:
    t = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def summarize_text(c: Column, limit: int = SUMMARY_LIMIT) -> Column:
    t = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("... [truncated "), (F.length(t) - limit).cast("string"), F.lit(" chars]"))).otherwise(t)


def candidate_text(*parts: Column) -> Column:
    """Trimmed parts that aren't empty, joined by '. '."""
    return F.concat_ws(". ", *(F.when(F.length(strip(p)) > 0, strip(p)) for p in parts))


def doc_text(title: Column, abstract: Column, claims: Column) -> Column:
    return strip(F.concat(title, F.lit(". "), abstract, F.lit(" "), F.coalesce(F.get(claims, F.lit(0)), F.lit(""))))


def _or_na(c: Column) -> Column:
    return F.when(F.length(c) > 0, c).otherwise(F.lit("N/A"))


def flat_text(headers: list[tuple[str, Column]], abstract: Column, claims: Column, description: Column) -> Column:
    """Header lines, then the three sections; empty ones say N/A."""
    listed = F.when(F.size(claims) > 0, F.array_join(F.transform(claims, lambda x: F.concat(F.lit("  "), x)), "\n")).otherwise(F.lit("  N/A"))
    head = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in headers))
    return strip(F.concat(head, F.lit("\n\n=== ABSTRACT ===\n"), _or_na(abstract), F.lit("\n\n=== CLAIMS ===\n"), listed, F.lit("\n\n=== DESCRIPTION ===\n"), _or_na(description)))


def profile_language(c: Column, sample_chars: int = 800) -> Column:
    """The profile with most stop words in the sample's words; none: 'unknown'; ties by name."""
    w = F.regexp_extract_all(F.lower(F.substring(c, 1, sample_chars)), F.lit(r"\p{L}+"), 0)

    def score(words: Column, place: int, name: str, own: tuple[str, ...]) -> Column:
        return F.struct(F.size(F.filter(words, lambda x: x.isin(*own))).alias("n"), F.lit(-place).alias("o"), F.lit(name).alias("lang"))

    best = bind(w, lambda words: F.array_max(F.array(*(score(words, i, name, own) for i, (name, own) in enumerate(sorted(LANGUAGE_PROFILE.items()))))))
    return bind(best, lambda b: F.when(b["n"] > 0, b["lang"]).otherwise(F.lit("unknown")))


# Elements dropped with their content, and entities that are decoded.
DROPPED = ("script", "style", "nav", "header", "footer")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_fallback(c: Column, limit: int | None = PAGE_LIMIT, blank: str = r"(?U)\s") -> Column:
    """Body text without the dropped elements: tags become line ends, blank runs collapse.

    ``limit``: None keeps the whole text; ``blank``: what is stripped at both ends.
    """
    for tag in DROPPED:
        # Not \b and (?is): these differ from SQL's for letters beyond ASCII.
        c = F.regexp_replace(c, rf"(?isu)<{tag}(?![A-Za-z0-9_])[^>]*>.*?</{tag}>", "")
    c = F.regexp_replace(c, r"(?is)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)^.*?<body[^>]*>", "")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    for entity, value in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(value))
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    return cut_page(c, limit, blank)


def cut_page(c: Column, limit: int | None = PAGE_LIMIT, blank: str = r"(?U)\s") -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " ")
    c = F.regexp_replace(c, rf"^{blank}+|{blank}+\z", "")
    return c if limit is None else F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("\n\n[TRUNCATED]"))).otherwise(c)
