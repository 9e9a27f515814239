"""Near duplicates of vectors and texts, substring dedup, mixing, components."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from lexigrove.llm import graph, group_matrix_join, pfair_mix, pivot_permutation, sentence_spans

DOCS = "doc_id long, text string, source string, n int, id string, block string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "a", "b") for i, t, s in rows], DOCS)


def roots(ids, pairs):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, 400 + i) for i in range(1, 50)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = {k: v for k, v in roots({x for p in pairs for x in p}, pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_vectors(rows, threshold=0.9):
    ok = {i: np.array(v, "f4").astype("f8") for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold]
    links = {i: sum(a == i for a, _ in pairs) for i, _ in rows}
    return links, roots([i for i, _ in rows if i is not None], pairs)


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    for i in range(60):  # near copies, some of them near the threshold
        v = np.array(rows[i % 10][1])
        rows.append((200 + i, (v + rng.normal(size=16) * np.linalg.norm(v) / 4 * (0.1 + 0.4 * (i % 3) / 2)).tolist()))
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(400, [2 * x for x in rows[3][1]])]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [float("inf")] * 16), (504, [None] + [1.0] * 15), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [])]
    return rows


@pytest.mark.parametrize("chunk", [512, 20])
def test_vectors_match_brute_force(spark, chunk):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + rows[:5]], "vec_id long, embedding array<float>, label int")
    out = pivot_permutation.near_duplicates(df, prefix=10, n_pivots=32, chunk=chunk).collect()
    links, comp = brute_vectors(rows)
    assert len(out) == len(rows)
    assert {r.vec_id: r.n_links for r in out} == links
    assert {r.vec_id: r.component_id for r in out} == comp
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_vectors_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * n
    rows = [(int(i), x.tolist()) for i, x in enumerate(np.vstack([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = pivot_permutation.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert found >= 0.9 * sum(brute_vectors(rows)[0].values())


def test_vectors_empty_table(spark):
    assert pivot_permutation.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_copies(seed=7, n=40):
    rng = random.Random(seed)
    rows = []
    passage = " ".join(f"common{i}" for i in range(60))
    for i in range(n):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = list(words)
            for _ in range(rng.choice([0, 1, 2, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
        rows.append((len(rows), passage + " " + " ".join(words[: rng.choice([0, 5, 14, 20])])))
    return rows


@pytest.mark.parametrize("hot, block", [(64, 64), (2, 2), (10**9, 64)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(group_matrix_join, "HOT_DF", hot)
    monkeypatch.setattr(group_matrix_join, "BLOCK", block)
    monkeypatch.setattr(group_matrix_join, "STAR", 4)
    rows = near_copies() + [(900, None), (901, ""), (902, "  "), (903, "A b"), (904, "a B"), (905, "long " * 30_000)]
    df = docs(spark, [(i, t, "s") for i, t in rows] + [(0, rows[0][1], "s"), (None, rows[0][1], "s")])
    out = group_matrix_join.near_duplicates(df).collect()
    assert len(out) == len(rows) + 2
    sets = {i: brute_shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, pairs)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
        else:
            assert r.component_id is None


def test_jaccard_join_empty_table(spark):
    assert group_matrix_join.near_duplicates(docs(spark, [])).collect() == []


def minimal_runs(sizes, min_sentences=2, min_words=16):
    """(first, end) of the shortest runs from each sentence on and up to each sentence's end."""
    found = set()
    for least in (1, min_sentences):
        good = [(k, e) for k in range(len(sizes)) for e in range(k + least, min(len(sizes), k + 40) + 1) if sum(sizes[k:e]) >= min_words]
        found |= {(k, min(e for x, e in good if x == k)) for k, _ in good} | {(max(k for k, x in good if x == e), e) for _, e in good}
    return sorted(found)


def brute_cut(rows, min_sentences=2, min_words=16):
    runs, first = {}, {}
    for i, t in sorted((i, t) for i, t in rows if t):
        cut = sentence_spans.sentences(t.encode())
        plain = [b" ".join(t.encode()[a:b].split()) for a, b in cut]
        for k, e in minimal_runs([len(x.split()) for x in plain], min_sentences, min_words):
            key = tuple(plain[k:e])
            first.setdefault(key, (i, k))
            runs.setdefault(i, []).append((k, e, key))
    out = {}
    for i, t in rows:
        gone = {x for k, e, key in runs.get(i, []) if first[key] != (i, k) for x in range(k, e)}
        out[i] = t if not t else b"".join(t.encode()[a:b] for x, (a, b) in enumerate(sentence_spans.sentences(t.encode())) if x not in gone).decode()
    return out


def test_sentences_cover_the_text():
    t = 'One two. Three!? "Four." five 3.5 six\n\nSeven   \n'.encode()
    parts = sentence_spans.sentences(t)
    assert b"".join(t[a:b] for a, b in parts) == t and len(parts) == 5


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(2, 14))).capitalize() + rng.choice([". ", "! ", ".\n"])
    passage = "".join(sentence() for _ in range(8))
    rows = []
    for i in range(40):
        body = [sentence() for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        rows.append((i, "".join(body)))
    rows += [(100, rows[5][1]), (101, None), (102, ""), (103, passage + passage), (104, "x " * 500)]
    df = docs(spark, [(i, t, "s") for i, t in rows])
    out = sentence_spans.cut_repeats(df, report=True)
    assert out.columns == [*df.columns, "n_sentences", "n_removed"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_cut(rows)
    assert sum(passage[:40] in (t or "") for t in got.values()) == 1
    again = sentence_spans.cut_repeats(docs(spark, [(1, passage, "s"), (1, passage, "s")])).collect()
    assert [r.text for r in again] == [passage, passage]
    assert sentence_spans.cut_repeats(docs(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_edf_keeps_windows_and_stays_within_a_block(seed):
    rng = random.Random(seed)
    weights = pfair_mix.integer_weights({f"s{i}": rng.random() + 0.01 for i in range(rng.randrange(1, 30))}, 500)
    assert sum(weights.values()) == 500 and min(weights.values()) >= 1
    slots = pfair_mix.edf(weights, 500)
    assert sorted(t for own in slots.values() for t in own) == list(range(500))
    for s, w in weights.items():
        assert len(slots[s]) == w
        for i, t in enumerate(slots[s]):
            assert i * 500 // w <= t < -(-(i + 1) * 500 // w)
        for t in range(501):
            assert abs(sum(x < t for x in slots[s]) - Fraction(w * t, 500)) < 1


def test_mix_matches_brute_force(spark):
    sizes = {"a": 57, "b": 23, "c": 5, None: 9}
    rows = [(1000 * k + i, f"t{i}", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = docs(spark, rows + rows[:2])
    weights = {"a": 1.0, "b": 2.0, "c": 1.0}
    out = pfair_mix.mix(df, weights, block_docs=4, period=10)
    got = out.collect()
    assert out.columns == [c for c in df.columns if c != "block"] + list(pfair_mix.OUT) and len(got) == len(rows) + 2
    slots = {}
    for r in got:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
        assert r.release <= r.slot < r.deadline and 0 <= r.place < 4
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    # Slot by slot: the source of the earliest deadline among the released ones, phase by phase.
    left = {"": 3, "a": 15, "b": 6, "c": 2}
    order = [next(iter(slots[t]))[0] or "" for t in sorted(slots)]
    at = 0
    while left:
        share = pfair_mix.integer_weights({s: weights.get(s, 1.0) for s in left}, 10)
        done, t = dict.fromkeys(left, 0), 0
        while min(left[s] - done[s] for s in left) > 0:
            ready = [(-(-(done[s] + 1) * 10 // share[s]), s) for s in left if done[s] * 10 // share[s] <= t]
            s = min(ready)[1]
            assert order[at + t] == s
            done[s] += 1
            t += 1
        at += t
        left = {s: n - done[s] for s, n in left.items() if n > done[s]}
    ordered = pfair_mix.in_order(df, weights, block_docs=4, period=10)
    assert ordered.columns == df.columns and ordered.count() == len(rows) + 2
    assert pfair_mix.mix(docs(spark, [])).collect() == []


def test_mix_keeps_exact_target_weights():
    cases = [({"hot": 9000, **{f"s{i:02}": 900 for i in range(20)}}, 0.5), ({"a": 4000, "b": 4000, "c": 4000}, 0.5), ({"hot": 3000, **{f"s{i:03}": 20 for i in range(999)}}, 0.5), ({"a": 700, "b": 41, "c": 5}, 0.3)]
    for blocks, power in cases:
        weights = {s: n**power for s, n in blocks.items()}
        planned = pfair_mix.plan(blocks, weights, 1000)
        assert sorted(t for x in planned.values() for t in x[1].tolist()) == list(range(sum(blocks.values())))
        n = sum(int((x[0] == 0).sum()) for x in planned.values())  # slots of the first phase
        total = sum(Fraction(w) for w in weights.values())
        for s, (phase, slot, release, deadline) in planned.items():
            w, first = Fraction(weights[s]) / total, slot[phase == 0].tolist()
            # The share is furthest off just before and just after a block, and at the end.
            for i, t in enumerate(first):
                assert t * w - i < 1 and i + 1 - (t + 1) * w < 1
            assert abs(len(first) - n * w) < 1
            assert (release <= slot).all() and (slot < deadline).all()


def common_stretch(a, b):
    """Words of the longest verbatim common stretch."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


@pytest.mark.parametrize("mark", [0, 5, 9, 16, 30, 70, 200])
def test_every_repeated_stretch_of_over_50_words_is_cut(mark):
    rng = random.Random(mark)
    for trial in range(60):
        word = lambda: f"w{rng.randrange(10**6)}" + (". " if mark and rng.randrange(mark) == 0 else " ")
        stretch = [word() for _ in range(51)]
        if trial % 5 == 0:  # few words, many ties
            stretch = [rng.choice(["x ", "y "]) for _ in range(51)]
        a, b = (("".join([word() for _ in range(rng.randrange(60))] + stretch + [word() for _ in range(rng.randrange(60))])).encode() for _ in range(2))
        found = [{h for _, _, h in sentence_spans.runs(t, 2, 16)} for t in (a, b)]
        assert found[0] & found[1], (trial, a, b)


PLAIN_END = re.compile(rb"[.!?]+[\"')\]]*\Z")


def plain_words(text):
    dense = rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2}"
    return [(m.start(), m.end()) for m in re.finditer(rb"(?:%s)|(?:(?!%s)\S)+" % (dense, dense), text)]


def plain_runs(text, min_sentences=2, min_words=16):
    """Sentences and runs of a text, word by word; runs as their words by sentence."""
    words = plain_words(text)
    begin = [i for i, (a, _) in enumerate(words) if i == 0 or a > words[i - 1][1] and (PLAIN_END.search(text[slice(*words[i - 1])]) or b"\n" in text[words[i - 1][1] : a])]
    data = np.frombuffer(text + b"\n", np.uint8)
    h = sentence_spans.word_hashes(data, *(np.array(x, np.int64) for x in zip(*words))) if words else []
    cuts = set(begin)
    for a, b in zip(begin, [*begin[1:], len(words)]):
        if b - a > sentence_spans.LONG:
            cuts |= {min(range(k, k + sentence_spans.ANCHOR), key=lambda i: (h[i], i)) for k in range(a, b - sentence_spans.ANCHOR + 1)}
    begin = sorted(cuts)
    parts = [[text[slice(*words[i])] for i in range(a, b)] for a, b in zip(begin, [*begin[1:], len(words)])]
    found = {(k, e - k, tuple(map(tuple, parts[k:e]))) for k, e in minimal_runs(list(map(len, parts)), min_sentences, min_words)}
    where = [0, *(words[i][0] for i in begin[1:]), len(text)]
    return list(zip(where, where[1:])) if text else [], sorted(found)


def test_cutting_and_hashing_match_a_plain_version():
    rng = random.Random(12)
    pieces = ["a", "bc", "the", "Mr.", "end.", "done!", 'so."', "(x.)", "é", "3.5", "...", "]]", "日本", "ไทย", "x日y", "\U00020000z"]
    texts = ["", " \n ", "one", ". . .", "\n\nlead", "tail. \n"]
    for _ in range(120):
        texts.append("".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "  ", "\n", " \n ", "\t", ""]) for _ in range(rng.randrange(1, 120))))
    data = [t.encode() for t in texts]
    which, first, n, h1, h2 = sentence_spans.slice_runs([*data, None], 2, 16)
    by, hashes = {}, {}
    for row in zip(which.tolist(), first.tolist(), n.tolist(), h1.tolist(), h2.tolist()):
        by.setdefault(row[0], []).append(row[1:])
    for i, t in enumerate(data):
        ranges, want = plain_runs(t)
        assert sentence_spans.sentences(t) == ranges
        assert sorted((a, k) for a, k, *_ in by.get(i, [])) == [(a, k) for a, k, _ in want]
        for (a, k, *h), (_, _, words) in zip(sorted(by.get(i, [])), want):
            assert hashes.setdefault(words, h) == h
    assert len({tuple(h) for h in hashes.values()}) == len(hashes) > 500


def test_a_word_longer_than_a_stroke(monkeypatch):
    text = ("ab " * 40 + "x" * 5000 + " cd. ef " + "yz" * 300 + "\n").encode() * 2
    want = sentence_spans.slice_runs([text], 2, 16)
    monkeypatch.setattr(sentence_spans, "STROKE", 64)
    assert all((a == b).all() for a, b in zip(want, sentence_spans.slice_runs([text], 2, 16)))


def test_substring_dedup_edges(spark):
    schema = "doc_id long, text string, n_sentences int, n_removed string, extra string"
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(None, passage, 1, "a", "x"), (None, passage, 1, "a", "x"), (1, passage, 1, "a", None), (2, None, 1, "a", "x"), (3, "  \n", None, None, None), (4, ("word " * 9 + ". ") * 30_000, 1, "a", "x")]
    df = spark.createDataFrame(rows, schema)
    out = sentence_spans.cut_repeats(df, report=True)
    assert out.columns == ["doc_id", "text", "extra", "n_sentences", "n_removed"]
    got = [tuple(r) for r in out.collect()]
    assert sum(r[0] is None and r[1] == passage and r[4] == 0 for r in got) == 2  # null ids come first
    by = {r[0]: r for r in got}
    assert by[1][1] == "" and by[2][1] is None and by[2][3:] == (0, 0) and by[3][1:2] + by[3][3:] == ("  \n", 1, 0) and 0 < len(by[4][1]) < 200
    assert sentence_spans.cut_repeats(df.limit(0), report=True).collect() == []


def test_long_and_unmarked_sentences_are_cut(spark):
    rng = random.Random(1)
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    long = fill(60)
    han = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(150))
    rows = [(1, long), (2, long), (3, f"{fill(20)} {long} {fill(20)}"), (4, f"{fill(9)}. {long}. {fill(9)}."), (5, han), (6, f"{han[20:120]}"), (7, fill(200))]
    got = {r.doc_id: r.text for r in sentence_spans.cut_repeats(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got[1] == long and got[2] == "" and got[5] == han and got[7] == rows[6][1]
    assert all(common_stretch(got[i].split(), long.split()) <= 50 for i in (3, 4))
    assert len(got[6]) <= 50


def test_a_group_opens_for_every_size_between(spark):
    jm = group_matrix_join
    need = lambda q, m: -(-75 * (q + m) // 175)

    def least(q, m):
        """Shared tokens within both prefixes with which sizes q and m can still link."""
        return need(q, m) - max(q - jm.prefixes(q)[1], m - jm.prefixes(m)[0], 0)

    rows = []
    for q in range(5, 160):
        sizes = range(-(-75 * q // 100), q + 1)
        for low in sizes:
            for high in range(low, q + 1, 3):
                # One token fewer than any size needs, and just enough for one of them.
                s = min(least(q, m) for m in range(low, high + 1))
                rows += [(q, low, high, s, True), (q, low, high, s - 1, False)]
    rows += [(29, 23, 28, 2, True)]
    df = spark.createDataFrame(rows, "qn long, low long, high long, s long, want boolean")
    assert df.where(f"({jm._opens()}) <> want").limit(5).collect() == []


def test_jaccard_join_finds_mixed_sizes_at_exactly_75_percent(spark):
    rng = random.Random(4)
    rows, word = [], lambda: f"v{rng.randrange(10**9)}"
    for _ in range(60):
        # 24 shingles shared of 32: sizes 29 and 27; members of 23 and 28 shingles share less.
        core = [word() for _ in range(28)]
        texts = [core + [word() for _ in range(5)], core + [word() for _ in range(3)], core[:14] + [word() for _ in range(13)], core[:14] + [word() for _ in range(18)]]
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate(texts)]
    out = group_matrix_join.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    sets = {i: brute_shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(pairs) == 60 and all(100 * len(sets[a] & sets[b]) == 75 * len(sets[a] | sets[b]) for a, b in pairs)
    want = roots(sets, pairs)
    assert {r.doc_id: r.component_id for r in out} == want


def test_jaccard_join_at_random_sizes(spark):
    """Families of sets of 20 to 200 shingles around 75 %, with hot passages, against brute force."""
    rng = random.Random(11)
    rows, passage = [], [f"hot{i}" for i in range(40)]
    for family in range(45):
        core = [f"u{family}x{i}" for i in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(2, 6)):
            k = rng.randrange(int(0.72 * len(core)), len(core) + 1)
            own = [f"z{rng.randrange(10**9)}" for _ in range(rng.randrange(0, max(1, len(core) // 3)))]
            words = core[:k] + own if rng.random() < 0.5 else own + core[-k:]
            rows.append((len(rows), " ".join((passage if rng.random() < 0.4 else []) + words)))
    # Sizes of 34 against 32 to 34, which share just enough.
    for _ in range(20):
        core = [f"v{rng.randrange(10**9)}" for _ in range(33)]
        rows += [(len(rows) + k, " ".join(core[:33] + [f"y{rng.randrange(10**9)}" for _ in range(e)])) for k, e in enumerate((5, 3, 4, 9))]
    out = group_matrix_join.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    sets = {i: brute_shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, pairs)
    assert len(pairs) > 40 and {r.doc_id: r.component_id for r in out} == want


def test_sketches_bound_the_intersection():
    rng = np.random.default_rng(6)
    for _ in range(400):
        n, m, common = rng.integers(1, 400), rng.integers(1, 400), rng.integers(0, 300)
        core = rng.integers(0, 1 << 63, common).astype(np.uint64)
        a, b = (np.unique(np.concatenate([core, rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in (n, m))
        most = group_matrix_join.most_common(*(group_matrix_join._marks(group_matrix_join.sketch(x)) for x in (a, b)))
        both = len(np.intersect1d(a, b))
        assert both <= most <= both + 0.45 * min(len(a), len(b)) + 12


def test_buckets_grow_with_the_input():
    bits = [group_matrix_join.bucket_bits(x) for x in (0, 10**9, 10**12, 10**15)]
    assert bits[0] == bits[1] == 10 and bits[1] < bits[2] <= bits[3] <= group_matrix_join.KEY_BITS - 24


def test_packed_tokens_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(group_matrix_join, "BUCKET_BYTES", 1)
    rows = near_copies(3, 12) + [(10**15, near_copies(3, 12)[0][1])]
    out = {r.doc_id: r.component_id for r in group_matrix_join.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    sets = {i: brute_shingles(t) for i, t in rows}
    assert out == roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])


def test_mixing_a_source_of_many_buckets(spark, monkeypatch):
    rows = [(None if i < 40 else i, f"text {i}", "hot" if i % 4 else "s") for i in range(300)]
    monkeypatch.setattr(pfair_mix, "BUCKETS", 2)
    monkeypatch.setattr(pfair_mix, "BUCKET_ROWS", 16)
    out = pfair_mix.mix(docs(spark, rows), block_docs=4).collect()
    assert len({(r.slot, r.place) for r in out}) == len(out) == 300
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert {(r.doc_id, r.text, r.source) for r in out} == set(rows)


def test_mixing_plan_too_long_to_broadcast(spark, monkeypatch):
    df = docs(spark, [(None if i % 9 == 0 else i, None if i % 7 == 0 else "long " * (20_000 if i == 5 else 1), f"s{i % 3}") for i in range(200)])
    want = sorted(map(str, pfair_mix.mix(df, block_docs=2).collect()))
    monkeypatch.setattr(pfair_mix, "MAX_BROADCAST_BLOCKS", 1)
    assert sorted(map(str, pfair_mix.mix(df, block_docs=2).collect())) == want and len(want) == 200


def test_vectors_of_every_length_are_linked(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in range(1, 71):
        v = rng.normal(size=n)
        rows += [(10 * n, v.tolist()), (10 * n + 1, (v * 1.5 + 1e-3 * np.abs(v).max() * (np.arange(n) == 0)).tolist()), (10 * n + 2, (-v).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in pivot_permutation.near_duplicates(df).collect()}
    assert out == {i: (0, i) if i % 10 == 2 else (1, i - i % 10) for i, _ in rows}


def test_vectors_of_large_components_and_clashing_columns(spark):
    rows = [(1, [1e200, 2e200, 0.0], 5, "x"), (2, [1.1e200, 2e200, 1e190], 5, "y"), (2, [0.0, 1e-200, 3e-200], 5, "z"), (3, [0.0, 1.1, 3.0], 1, "x"), (4, [-1e300, 0.0, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, component_id string")
    out = pivot_permutation.near_duplicates(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {tuple(r) for r in out.collect()} == {(1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)}


def test_vectors_under_one_id_are_one_node(spark):
    rows = [(7, [1.0, 0.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0, 0.0]), (7, [0.0, 0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.1]), (9, [0.0, 1.0, 0.1, 0.0]), (2, [0.0, 0.0, 0.0, 1.0])]
    out = pivot_permutation.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {tuple(r) for r in out.collect()} == {(7, 2, 3, False), (3, 1, 3, True), (9, 1, 3, False), (2, 0, 2, True)}


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(3)
    x = pivot_permutation.unit(np.vstack([rng.normal(size=(300, 40)), rng.standard_cauchy(size=(300, 40))]))
    codes, scale, err = pivot_permutation.encode(x)
    about = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    assert (np.abs(about - x @ x.T) <= err[:, None] + (1 + err[:, None]) * err[None, :] + 1e-12).all()


def test_long_lists_are_split_and_open_pairs_verified(spark):
    """A hot pivot: most vectors lie around one direction, many pairs near the threshold."""
    rng = np.random.default_rng(8)
    hot = np.array([1.0] + [0.0] * 15) * 2.6
    rows = [(i, (hot + rng.normal(size=16) * (0.55 if i % 3 else 0.1)).tolist()) for i in range(240)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(60)]
    links, comp = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for chunk in (10_000, 60, 8):
        out = pivot_permutation.near_duplicates(df, prefix=16, n_pivots=24, chunk=chunk).collect()
        assert {r.vec_id: r.n_links for r in out} == links
        assert {r.vec_id: r.component_id for r in out} == comp
    assert 0.05 < sum(links.values()) / 240**2 < 0.95


@pytest.mark.parametrize("n", [1_000, 100_000])
def test_pairs_at_the_threshold_meet(n):
    """The share of pairs at cosine 0.905 that share enough pivots, for the pivots of n vectors."""
    rng = np.random.default_rng(n)
    a = pivot_permutation.unit(rng.normal(size=(1500, 64)))
    side = rng.normal(size=a.shape)
    side = pivot_permutation.unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * side
    k = pivot_permutation.n_pivots_for(n)
    pivots = pivot_permutation.fit_pivots(rng.normal(size=(min(n, 4096), 64)), k)
    p, q = (pivot_permutation.permutation_prefix(x, pivots, pivot_permutation.prefix_for(k)) for x in (a, b))
    same = p[:, :, None] == q[:, None, :]
    shared = same.sum((1, 2)) - same[:, 0, -1] - same[:, -1, 0]
    assert (shared >= 2).mean() >= 0.93
