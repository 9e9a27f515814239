"""HTML rendering, SentencePiece and the pipeline."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrove.llm import html_layout, sentencepiece_unigram

CASES = {
    "<p>One <b>two</b>\n three<p>Four<br>five": "One two three\n\nFour\nfive",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>after": "- a\n- b\n  3. c\n  4. d\n\nafter",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1</table>": "Name       N\nlong name  1",
    "<table><tbody><td colspan=2>both<tr><td>x<td>y</table>": "both\nx  y",
    "<pre>\n a  b\n   c</pre>": " a  b\n   c",
    "<style>.z{display:none} #q, b{color:red}</style><div class='y z'>gone</div><i hidden>no</i><b style='display: none'>no</b>yes": "yes",
    "<script>var a='</p>';</script>x<!-- c -->y &amp; 1 < 2": "xy & 1 < 2",
    "<title>t</title><noscript>n</noscript><select><option>o</select><p>shown": "shown",
    "<details><summary>s</summary>shut</details><details open><summary>t</summary>seen</details>": "s\nt\nseen",
    "<div>a</div>b<span>c</span><h1>d</h1>e": "a\nbc\n\nd\n\ne",
    "<dl><dt>T<dd>D</dl>": "T\n    D",
    "<p>unclosed <a href='x>y": "unclosed y",
    "": "",
    "plain": "plain",
}


@pytest.mark.parametrize("source", CASES)
def test_render(source):
    assert html_layout.render(source) == CASES[source]


def test_render_survives_depth_and_size():
    assert html_layout.render("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert html_layout.render("<a " * 20_000) is not None
    assert len(html_layout.render("<p>word " * 20_000).split()) == 20_000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abpliutrd \n\"'=&;-!", max_size=60))
def test_render_never_fails(source):
    html_layout.render(source)


def test_render_pages(spark):
    rows = [(1, "u", "<p>a</p>"), (2, "u", None), (3, "u", ""), (1, "u", "<p>a</p>"), (None, "u", "<p>b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_lines, r.n_chars) for r in html_layout.render_pages(df).collect()), key=str)
    assert got == sorted([(1, "a", 1, 1), (1, "a", 1, 1), (2, None, None, None), (3, "", 0, 0), (0, "b", 1, 1)], key=str)
    assert html_layout.render_pages(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def model():
    return sentencepiece_unigram.load()


def brute_best(model, text):
    """Best sum of log scores by plain dynamic programming over a dictionary."""
    pieces = {p: model.scores[i] for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == sentencepiece_unigram.NORMAL}
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 20), j):
            if text[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[text[i:j]])
        if text[j - 1 : j] not in pieces:
            best[j] = max(best[j], best[j - 1] + model.unknown)
    return best[-1]


def total(model, ids):
    out, run = 0.0, bytearray()
    for i in [*ids, None]:
        if i is not None and model.kinds[i] == sentencepiece_unigram.BYTE:
            run.append(int(model.pieces[i][3:5], 16))
        else:
            out += model.unknown * len(run.decode())
            run = bytearray()
            out += model.scores[i] if i is not None else 0
    return out


TEXTS = ["", "the cat", "  two  blanks ", "a\nb\n\nc", "日本語 тест 🙂", "x" * 300, "don't $$$ stop!", "\t", "Éan de aiê la.", "one 🙂🙂 two", "no-break space"]


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_is_best_and_round_trips(model, text):
    ids = model.encode(text)
    assert model.decode(ids) == text
    if text:
        assert total(model, ids) == pytest.approx(brute_best(model, "▁" + text.replace(" ", "▁")))
        assert ids == [i for w in model.words(text) for i in model.best(w.encode())]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_characters="▁", exclude_categories=["Cs"]), max_size=40))
def test_round_trip(text):
    m = sentencepiece_unigram.load() if not hasattr(test_round_trip, "m") else test_round_trip.m
    test_round_trip.m = m
    assert m.decode(m.encode(text)) == text


def test_trie_finds_all_prefixes():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff", b"abd" * 9]
    trie = sentencepiece_unigram.DoubleArray([(k, i) for i, k in enumerate(keys)])
    for text in (b"abcd", b"b", b"", b"\xffa", b"abd" * 9 + b"x", b"zzz"):
        assert list(trie.prefixes(text, 0)) == sorted((len(k), i) for i, k in enumerate(keys) if text.startswith(k))


def test_encode_and_decode_tables(spark, model):
    rows = [(1, "the cat", "old"), (2, None, "old"), (3, "", "old"), (1, "the cat", "old"), (4, "word " * 40_000, "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentencepiece_unigram.decode(sentencepiece_unigram.encode(df, model), model).collect()
    assert len(out) == len(rows) and all(r.decoded == r.text for r in out)
    assert {r.doc_id: r.ids for r in out}[2] is None and {r.doc_id: r.ids for r in out}[3] == []
    assert sentencepiece_unigram.encode(df.limit(0), model).collect() == []


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup_operators import brute_cut, brute_shingles, roots

    english, german = "the cat sat on the mat and the dog lay by the door of house", "der hund liegt vor der tür und die katze sitzt auf dem dach von haus"
    rows = []
    for i in range(40):
        base = english if i % 2 else german
        rows.append((i, " ".join(f"{w}{(i * 7 + k) % 31}" for k, w in enumerate((base + " " + base).split())) + ". " + base + f" {i}.", "en" if i % 2 else "de", f"s{i % 3}", 1))
    passage = "A passage of many words stands here for all to see and read. It goes on and on with words that no other text has had. And a third one."
    rows[6] = (6, rows[6][1] + " " + passage, *rows[6][2:])
    rows += [(50, rows[9][1], "en", "s1", 1), (51, rows[10][1] + " x", "de", "s1", 1), (52, rows[12][1] + " " + passage + " end of it all.", "de", "s2", 1), (53, "12 34", "en", "s0", 1), (54, None, "en", "s0", 1), (55, "", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(r[0], r[1]) for r in rows if r[0] < 53]
    sets = {i: brute_shingles(t) for i, t in left}
    root = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    want = brute_cut([(i, t) for i, t in left if root[i] == i])
    assert {i: r.text for i, r in out.items()} == want
    model = sentencepiece_unigram.load()
    for r in out.values():
        assert r.ids == model.encode(r.text) and r.n_tokens == len(r.ids) and r.n_chars == len(r.text)
    assert 50 not in out and 51 not in out and passage[:20] in out[6].text and passage[:20] not in out.get(52, out[6]).text or 52 not in out
    stage = corpus_pipeline.STAGES[1][1](spark, df, str(tmp_path))
    assert stage.columns == df.columns


def test_pipeline_edges(spark, tmp_path):
    """Clashing columns, null ids, repeated rows, very long texts, an empty table, and no tables left but the last."""
    import os

    import corpus_pipeline

    english = "the cat sat on the mat and the dog lay by the door of the house"
    text = lambda i: " ".join(f"{w}{(i * 7 + k) % 97}x{i}" for k, w in enumerate(english.split())) + " " + english
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens int, slot int, place string, component_id int, tags map<string,int>"
    rest = ("a", 7, 1, "b", 9, {"k": 1})
    rows = [(i, text(i), "en", "s", 1, *rest) for i in range(20)]
    rows += [(3, text(3), "en", "other", 1, *rest), (4, text(4), "en", "s", 1, *rest), (None, text(50), "en", "s", 1, *rest), (None, text(50), "en", "t", 2, *rest), (None, text(51), None, None, None, *rest)]
    rows += [(90, (english + " ") * 9_000 + "tail", "en", "s", 1, *rest), (91, None, None, None, None, None, None, None, None, None, None), (92, "", "en", "s", 1, *rest)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [*range(20), 90]
    assert sum(r.doc_id is None for r in got) == 2
    assert all(r.n_tokens == len(r.ids) and r.component_id == 9 and r.tags == {"k": 1} for r in got)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert [x.split("-")[0] for x in set(os.listdir(shared)) - before] == ["stage"]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_repeated_rows_keep_the_same_one(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "a b c d e f g", f"s{i}") for i in range(9)] + [(2, "other words here", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    again = corpus_pipeline.drop_near_duplicates(spark, df.orderBy(F.desc("source")), "").collect()
    assert sorted(first) == sorted(again) and len(first) == 2


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from lexigrove.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_root(Session)
    Session.sparkContext.master = "local[4]"
    assert common.checkpoint_root(Session)


def test_pipeline_result_carries_the_mixed_order(spark, tmp_path):
    import corpus_pipeline
    from lexigrove.llm import pfair_mix

    english = "the cat sat on the mat and the dog lay by the door of the house"
    rows = [(i, " ".join(f"{w}{(i * 7 + k) % 97}x{i}" for k, w in enumerate(english.split())) + " " + english, "en", "ab"[i % 5 == 0], 1) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).repartition(3).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("slot", "place").collect()
    want = pfair_mix.mix(df).orderBy("slot", "place").collect()
    assert [(r.doc_id, r.slot, r.place) for r in out] == [(r.doc_id, r.slot, r.place) for r in want]
    assert len({(r.slot, r.place) for r in out}) == len(rows)


@pytest.mark.parametrize("tag", ["font", "div", "span"])
def test_deep_nesting_keeps_visibility_and_layout(tag):
    deep = f"<{tag}>" * 400
    page = f"<div hidden>a{deep}b<div>c</div></div>" if tag != "div" else f"<section hidden>a{deep}b<div>c</div></section>"
    assert html_layout.render(page + "shown") == "shown"
    got = html_layout.render(f"{deep}<p>one<p>two<i style='display:none'>no</i><table><tr><td>x<td>y</table><pre>a  b</pre><ul><li>l<li>m</ul><select><option>o</select>")
    assert got == "one\n\ntwo\n\nx  y\n\na  b\n\n- l\n- m"


def test_deep_quotes_and_lists_stay_bounded():
    for tag in ("blockquote", "dd", "ul><li"):
        got = html_layout.render(f"<{tag}>x" * 3000)
        assert got.count("x") == 3000 and len(got) < 3000 * 5 * html_layout.MAX_INDENT


STYLES = {
    "@media print { .c { display:none } }": True,
    "@media screen { .c { display:none } }": False,
    "@media (max-width: 600px) { .c { display:none } }": True,
    "@media only screen and (min-width: 40em) { .c { display:none } }": False,
    "@media not print { .c { display:none } }": False,
    "@media print, (width >= 600px) { .c { display:none } }": False,
    "@media print { .x { color: red } .c { display:none } } .y { color: red }": True,
    "@supports not (display: grid) { .c { display:none } }": True,
    "@import url(x.css); @charset 'u'; .c { display:none }": False,
    "@font-face { src: url('a{b') } .c { display:none }": False,
    ".c { display:none } .c { display:block }": True,
    ".c { display:block } .c { display:none }": False,
    ".c { display:none !important } .c { display:block }": False,
    "#i { display:block } .c { display:none }": True,
    "div { display:none } .c { display:block }": True,
    ".c { display:none; display:block }": True,
    "/* .c { display:none } */": True,
    ".c { /* } */ display:none }": False,
    ".c { display:none": False,
}


@pytest.mark.parametrize("css", STYLES)
def test_styles_follow_the_cascade(css):
    got = html_layout.render(f"<style>{css}</style><div class='c' id='i'>text</div>end")
    assert got == ("text\nend" if STYLES[css] else "end")


TABLES = {
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>x<td rowspan=0>y<td>z<tr><td>1<td>2<tbody><tr><td>n<td>o<td>p</table>": "x  y  z\n1     2\nn  o  p",
    "<table><tr><td rowspan=3>a<td colspan=2>wide one<tr><td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>": "a  wide one\n   b  c\n   d  e\nf  g  h",
    "<table><tr><td>" + "w" * 50 + "<td>b<tr><td>a<td>c</table>": "w" * 50 + "  b\na" + " " * 51 + "c",
    "<table><tr><td>" + "word " * 30 + "<td>b<tr><td>a<td>c</table>": ("word " * 20).strip().ljust(102) + "b\n" + ("word " * 10).strip() + "\na" + " " * 101 + "c",
    "<table><tr><td>a<td>" + "long " * 60 + "</table>": "a  " + ("long " * 60).strip(),
    "a <svg><defs><text>no</text></defs><title>no</title><text>one</text><text>two</text></svg> b": "a\none\ntwo\nb",
    "x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>": "x y=2",
    "<textarea>\n one\n  two &amp; <b></textarea>": " one\n  two & <b>",
}


@pytest.mark.parametrize("source", TABLES)
def test_tables_drawings_and_text_areas(source):
    assert html_layout.render(source) == TABLES[source]


def test_no_visible_word_of_a_table_is_lost():
    import random

    rng = random.Random(5)
    for _ in range(60):
        words, source = [], "<table>"
        for _ in range(rng.randrange(1, 6)):
            source += "<tr>"
            for _ in range(rng.randrange(1, 5)):
                own = [f"w{rng.randrange(10**6)}" + "x" * rng.choice([0, 0, 0, 130]) for _ in range(rng.choice([1, 3, 40]))]
                words += own
                source += f"<td rowspan={rng.randrange(4)} colspan={rng.randrange(1, 4)}>{' '.join(own)}</td>"
            source += "</tr>"
        got = "".join(html_layout.render(source + "</table>").split())
        assert sorted(got) == sorted("".join(words)) and all(w in got or len(w) > 100 or len(words) > 1 for w in words)


class PlainPage:
    """A page as a tree of marks, its source, and its text by the plain rules: a stream of texts and breaks."""

    HIDE = ("<i hidden>{}</i>", "<div style='display:none'>{}</div>", "<script>{}</script>", "<b class=gone>{}</b>", "<select><option>{}</select>", "<!--{}-->")

    def __init__(self, rng):
        self.rng, self.n, self.events = rng, 0, []
        self.source = "<style>.gone{display:none} @media print{p{display:none}}</style>" + self.blocks(4)

    def word(self):
        self.n += 1
        return f"w{self.n}"

    def inline(self):
        out = ""
        for _ in range(self.rng.randrange(1, 4)):
            kind = self.rng.randrange(5)
            if kind == 0:
                out += self.rng.choice(self.HIDE[:1] + self.HIDE[2:]).format("no")
            elif kind == 1:
                w = self.word()
                out += f"<span><em>{w}</em></span>"
                self.events.append(w)
            elif kind == 2:
                out += " \n "
                self.events.append(" ")
            else:
                w = self.word()
                out += w
                self.events.append(w)
        return out

    def blocks(self, depth):
        out = ""
        for _ in range(self.rng.randrange(1, 4)):
            kind = self.rng.randrange(6) if depth else 0
            if kind == 0:
                out += self.inline()
                continue
            if kind == 5:
                out += f"<div hidden>{'<div>no' * self.rng.randrange(1, 200)}</div>" if self.rng.random() < 0.3 else self.HIDE[1].format("<p>no")
                out += "</div>" * out[out.rfind("<div hidden>") if "<div hidden>" in out else len(out) :].count("<div>no")
                continue
            gap, tag = (1, "div") if kind == 1 else (2, "p") if kind == 2 else (2, "h2") if kind == 3 else (1, "section")
            at = len(self.events)
            out += f"<{tag}>" + (self.inline() if tag in ("p", "h2") else self.blocks(depth - 1)) + f"</{tag}>"
            # A block without visible text makes no space.
            gap = gap if any(isinstance(e, str) and e.strip() for e in self.events[at:]) else 1
            self.events[at:] = [gap, *self.events[at:], gap]
        return out

    def text(self):
        lines, run, gap = [], "", 0
        for e in [*self.events, 1]:
            if isinstance(e, str):
                run += e
                continue
            row = " ".join(run.split())
            run = ""
            if row:
                if lines and gap == 2:
                    lines.append("")
                lines.append(row)
                gap = 0
            gap = max(gap, e)
        return "\n".join(lines)


@pytest.mark.parametrize("seed", range(150))
def test_pages_match_a_plain_renderer(seed):
    import random

    page = PlainPage(random.Random(seed))
    assert html_layout.render(page.source) == page.text()


def test_xmp_and_style_of_another_medium_are_shown():
    assert html_layout.render("a<xmp>\n <b>x</b>  &amp;\n</xmp>b") == "a\n\n <b>x</b>  &amp;\n\nb"
    assert html_layout.render("<style media=print>p{display:none}</style><p>seen") == "seen"
    assert html_layout.render("<style>.m{display:flex}</style><div hidden class=m>seen</div><div hidden>no</div>") == "seen"
