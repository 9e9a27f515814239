"""License scans: ordered signature rules with overlap suppression.

A rule is a hand-written regular expression with a label, a priority and a keyword
(see license_signatures).  A text is first tested for the keywords (one automaton
pass over the lower-cased bytes); only rules whose keyword occurs are run.  Detections
that lie inside another rule's interval are suppressed when the other has the higher
priority, or the same priority and a longer interval; of equal intervals the rule that
stands first stays.

Defined results: a null or empty text has no words and no detections; texts of any
length are scanned whole; repeated rows and rows with a null id are scanned alike; an
empty table gives no rows; other columns are never read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_text, map_arrow
from .license_signatures import SIGNATURES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The base phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: What the notation of the signatures stands for (see license_signatures).
NOTATION = (
    ("license", r"licen[cs]e"),
    ("$", r"(?!\.?\d)"),
    ("^", r"(?<![a-z0-9-])"),
    ("@", r"(?![a-z0-9])"),
    ("~", r"(?:[\"'`]|\xe2\x80[\x98-\x9d])*"),
    ("[ -]?", r"[\s-]?"),
    ("[ -]+", r"(?:\s|-)+"),
    ("[ -]", r"(?:\s+|-)"),
    (" ?", r"\s*"),
    (" ", r"\s+(?:[*#/;]+\s+)*"),
)
#: Words of comment marks alone, which may stand between the words of a signature.
_MARKS = re.compile(rb"[*#/;]+\Z")


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern


def _compile(label: str, priority: int, keyword: str, pattern: str) -> Rule:
    for sign, meaning in NOTATION:
        pattern = pattern.replace(sign, meaning)
    return Rule(label, priority, keyword.encode(), re.compile(pattern.encode(), re.S))


def build_rules() -> list[Rule]:
    """All rules, in the order of the signatures."""
    return [_compile(*x) for x in SIGNATURES]


class Scanner:
    def __init__(self) -> None:
        self.rules = build_rules()
        by: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            by.setdefault(r.keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, v in by.items():
            self.automaton.add_word(k.decode(), v)
        self.automaton.make_automaton()

    def gate(self, low: bytes) -> set[int]:
        """Rules whose keyword occurs.  Keywords hold single blanks, so white space and comment marks count as one."""
        words = low.split()
        if any(x in low for x in (b"*", b"#", b"/", b";")):
            words = [w for w in words if w[0] not in b"*#/;" or not _MARKS.match(w)]
        out: set[int] = set()
        for _, own in self.automaton.iter(b" ".join(words).decode("latin-1")):
            out.update(own)
        return out

    def detect(self, low: bytes, prefilter: bool = True) -> list[tuple[int, int, int]]:
        """(start, end, rule) of the detections that stay, by start."""
        gate = self.gate(low) if prefilter else range(len(self.rules))
        found = [(m.start(), m.end(), i) for i in sorted(gate) for m in self.rules[i].pattern.finditer(low)]
        return suppress(found, [r.priority for r in self.rules])


def suppress(found: list[tuple[int, int, int]], priority: list[int]) -> list[tuple[int, int, int]]:
    """Drop each interval that lies inside one of a stronger detection.

    Stronger: higher priority, then longer, then earlier start and rule.  Strong
    detections are placed first; one that lies inside a placed interval goes.
    Of the placed intervals only those inside no other are searched, by bisection.
    """
    order = sorted(found, key=lambda x: (-priority[x[2]], x[0] - x[1], x[0], x[2]))
    kept = []
    outer: list[tuple[int, int]] = []  # no interval of these lies inside another: starts and ends both rise
    for s, e, i in order:
        k = bisect_right(outer, (s, 1 << 62))
        if k and outer[k - 1][1] >= e:
            continue
        kept.append((s, e, i))
        j = k
        while j < len(outer) and outer[j][1] <= e:
            j += 1
        outer[k:j] = [(s, e)]
    return sorted(kept)


def base_places(low: bytes) -> list[tuple[int, str]]:
    """(word index, label) of every place of a base phrase."""
    hit = [(p, label) for p, label in _BASE if p[0] in low and p[-1] in low]
    if not hit:
        return []
    words = WORD.findall(low)
    first = {p[0] for p, _ in hit}
    return [(i, label) for i, w in enumerate(words) if w in first for p, label in hit if tuple(words[i : i + len(p)]) == p]


_BASE = tuple((tuple(w.encode() for w in p.split()), label) for p, label in BASE_PHRASES)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def count_words(low: bytes) -> int:
    if not low:
        return 0
    inside = _IN_WORD[np.frombuffer(low, np.uint8)]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def scan(text: bytes | None, scanner: Scanner) -> tuple:
    low = (text or b"").lower()
    places = base_places(low)
    found = scanner.detect(low)
    base = {label for _, label in places}
    labels = base | {scanner.rules[i].label for _, _, i in found}
    at = [i for i, _ in places]
    # Confidence: the strongest signature; a base phrase alone gives that of a mention.
    score = max([0.3 * bool(base), *(scanner.rules[i].priority / 100 for _, _, i in found)])
    spans = [f"{s}-{e}:{scanner.rules[i].label}" for s, e, i in found]
    return count_words(low), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(found), spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long, spans array<string>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``; spans are byte ranges in the lower-cased text."""
    state: list[Scanner] = []

    def step(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        if not state:
            state.append(Scanner())
        cols = list(zip(*(scan(t, state[0]) for t in texts)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(ids_and_text(docs, id_col, text_col), step, SCHEMA)
