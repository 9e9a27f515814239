"""Inverted index and Boolean search: a query string becomes one column predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Fixed value: quoted phrases, parentheses, operators in any case, words; the rest is skipped.
_LEX = re.compile(r'"([^"]*)"|([()])|\b(AND|OR|NOT)\b|([A-Za-z0-9_]+)', re.I)


def lex(query: str) -> list[tuple[str, str]]:
    """(kind, value): phrase, paren, op or term; ValueError if nothing is found."""
    out = []
    for m in _LEX.finditer(query):
        phrase, paren, op, term = m.groups()
        if phrase is not None:
            if phrase.strip():
                out.append(("phrase", phrase.strip().lower()))
        elif paren:
            out.append(("paren", paren))
        elif op:
            out.append(("op", op.upper()))
        else:
            out.append(("term", term.lower()))
    if not out:
        raise ValueError("Empty query")
    return out


class _Parser:
    """or := and (OR and)* ; and := not (AND not)* ; not := NOT not | atom (NOT binds to its right)."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def binary(self, op: str, below) -> tuple:
        left = below()
        while self.peek() == ("op", op):
            self.at += 1
            left = (op, left, below())
        return left

    def either(self) -> tuple:
        return self.binary("OR", self.both)

    def both(self) -> tuple:
        return self.binary("AND", self.negated)

    def negated(self) -> tuple:
        if self.peek() == ("op", "NOT"):
            self.at += 1
            return ("NOT", self.negated())
        return self.atom()

    def atom(self) -> tuple:
        tok = self.peek()
        if tok is None:
            raise ValueError("Missing operand")
        self.at += 1
        if tok[0] in ("term", "phrase"):
            return tok
        if tok == ("paren", "("):
            inner = self.either()
            if self.peek() != ("paren", ")"):
                raise ValueError("Mismatched parentheses")
            self.at += 1
            return inner
        raise ValueError("Invalid query syntax" if tok[0] == "op" else "Mismatched parentheses")


def parse(query: str) -> tuple:
    p = _Parser(lex(query))
    tree = p.either()
    if p.peek() is not None:
        raise ValueError("Mismatched parentheses" if p.peek() == ("paren", ")") else "Invalid query syntax")
    return tree


def predicate(tree: tuple, tokens: Column, text: Column) -> Column:
    """Membership tests stand before the substring test, which then runs on few rows."""
    kind = tree[0]
    if kind == "NOT":
        return ~predicate(tree[1], tokens, text)
    if kind in ("AND", "OR"):
        a, b = predicate(tree[1], tokens, text), predicate(tree[2], tokens, text)
        return (a & b) if kind == "AND" else (a | b)
    if kind == "term":
        return F.array_contains(tokens, tree[1])
    words = re.findall(r"[a-z0-9_]+", tree[1])
    if not words:
        return F.lit(False)
    out = F.array_contains(tokens, words[0])
    for w in words[1:]:
        out = out & F.array_contains(tokens, w)
    return out & F.contains(F.lower(text), F.lit(tree[1]))


def search(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of the documents that match."""
    # The tokens are bound to a variable, as each term of the query would else take them anew.
    found = t.bind(t.index_tokens(F.col(text_col)), lambda tokens: predicate(parse(query), tokens, F.col(text_col)))
    return docs.where((t.strip(F.col(text_col)) != "") & found).select(id_col)


def top(docs: DataFrame, query: str, top_k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """First ``top_k`` matches by id, with the full number of matches beside."""
    hits = search(docs, query, id_col=id_col)
    total = hits.agg(F.count("*").alias("total_matches"))
    return hits.orderBy(id_col).limit(top_k).join(F.broadcast(total))


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id) in long form: a term of all documents is no single huge row."""
    return docs.where(t.strip(F.col(text_col)) != "").select(id_col, F.explode(F.array_distinct(t.index_tokens(F.col(text_col)))).alias("term"))


def posting_lists(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """term -> sorted ids, for small vocabularies or partitions of the index."""
    return index.groupBy("term").agg(F.array_sort(F.collect_set(id_col)).alias("doc_ids"))


def lookup(index: DataFrame, query: str, universe: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same queries (without phrases) by set operations on the saved index."""

    def walk(tree: tuple) -> DataFrame:
        if tree[0] == "term":
            return index.where(F.col("term") == tree[1]).select(id_col)
        if tree[0] == "NOT":
            return universe.select(id_col).exceptAll(walk(tree[1]))
        if tree[0] == "AND":
            return walk(tree[1]).intersect(walk(tree[2]))
        if tree[0] == "OR":
            return walk(tree[1]).union(walk(tree[2])).distinct()
        raise ValueError("phrases need the texts")

    return walk(parse(query))
