"""Fertility rules, license templates, decontamination and HTML layout against brute force and fixed cases."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from cohort.llm import decontaminate as D, fertility, html_layout, license_templates as L
from tests.llm.cases import SCHEMA, as_bag, docs, empty, rows


# Fertility ---------------------------------------------------------------------------------------------------------

def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked),
            len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_base_counts_against_brute_force(spark):
    small = [r for r in rows() if r[0] != 105]
    got = fertility.fertility_rules(spark.createDataFrame(small, SCHEMA)).collect()
    assert as_bag(tuple(r)[:7] for r in got) == as_bag((i, *brute_base(t)) for i, t, *_ in small)


def test_measures_of_tokens():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = "Water runs downhill, slowly. " * 3 + "𓀀 über Wasser"
    m = dict(zip(("n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept script n_tokens chars_per_token "
                  "fallback_share token_entropy").split(), (c[0] for c in fertility.measure([text.encode()]))))
    ids = [i for w in text.split() for i in model.encode(w)]
    shares = [n / len(ids) for n in Counter(ids).values()]
    letters = sum(c not in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text if not c.isspace())
    assert m["n_tokens"] == len(ids) and m["script"] == "latin"
    assert m["chars_per_token"] == pytest.approx(letters / len(ids))
    assert m["fallback_share"] == pytest.approx(sum(map(model.is_byte, ids)) / len(ids)) and m["fallback_share"] > 0
    assert m["token_entropy"] == pytest.approx(-sum(s * math.log2(s) for s in shares))


def test_verdicts():
    rng = random.Random(4)
    words = [a + b for a in "river stone garden light water mountain winter".split() for b in ("", "s", "ing", "er", "less", "side")]
    clean = " ".join(rng.choice(words) for _ in range(200))
    noisy = " ".join(rng.choice(words)[:4] + "###" for _ in range(200))
    coded = " ".join("".join(chr(rng.randint(0x13000, 0x1342E)) for _ in range(2)) + "abcdef" for _ in range(200))
    short = "too short"
    kept = fertility.measure([t.encode() for t in (clean, noisy, coded, short, "")])[6]
    assert kept == [True, False, False, False, False]
    assert [fertility.script_of(t.encode()) for t in ("привет мир", "日本語の文", "שלום", "γειά", "12 34", "hello")] == [
        "cyrillic", "cjk", "semitic", "greek", "other", "latin"]


def test_fertile_rows_keep_their_columns(spark):
    got = fertility.keep_fertile(docs(spark))
    want = [r for r, k in zip(rows(), fertility.measure([(t or "").encode() for _, t, *_ in rows()])[6]) if k]
    assert as_bag(map(tuple, got.collect())) == as_bag(want) and got.columns == docs(spark).columns and want
    assert fertility.keep_fertile(empty(spark)).count() == 0 == fertility.fertility_rules(empty(spark)).count()


# Licenses ----------------------------------------------------------------------------------------------------------

def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for i in range(len(words)) for p, label in L.BASE.items() if words[i:i + len(p.split())] == p.split()]
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


LICENSED = [
    (501, "Released under the MIT License. MIT-license! Apache\nLicense", 0, "", 1, 1),
    (502, "This work is licensed under the GNU General Public License, version 3.", 0, "", 1, 1),
    (503, "mit licenses and general public licence", 0, "", 1, 1), (504, "GENERAL PUBLIC LICENSE general public license", 0, "", 1, 1),
    (505, "Licensed under CC BY-NC 4.0.", 0, "", 1, 1), (506, None, 0, "", 1, 1), (507, "", 0, "", 1, 1), (None, "MİT license mit license", 0, "", 1, 1),
]


def test_phrases_against_brute_force(spark):
    table = LICENSED + rows()
    got = L.license_scan(spark.createDataFrame(table, SCHEMA)).collect()
    assert as_bag(tuple(r)[:6] for r in got) == as_bag((i, *brute_phrases(t)) for i, t, *_ in table)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[501] == ("apache,mit", 1.0) and labels[502] == ("gpl", 1.0) and labels[503] == ("", 0.0)
    assert labels[504] == ("gpl", 0.5) and labels[505] == ("cc", 1.0) and labels[506] == ("", 0.0)
    assert L.license_scan(empty(spark)).count() == 0


def test_usual_headers_and_altered_wording():
    automata = L.compiled()
    labels = lambda text: L.scan(text.encode(), automata)[5]
    gpl = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
    found = L.scan(gpl.encode(), automata)
    assert found[5] == "gpl" and "gpl-header" in [m["template"] for m in found[7]]
    assert labels(gpl.replace("GNU General", "GNU Lesser General")) == "gpl,lgpl" and labels(gpl.replace("GNU General", "GNU Affero General")) == "agpl,gpl"
    assert labels("// This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not\n"
                  "// distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.") == "mpl"
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == "bsd" and labels("spdx license identifier isc") == "isc"
    bsd = re.sub(r"<<var \d+>>", "THE AUTHORS", re.sub(r"<<optional>>|<<end>>", "", L.TEMPLATES["bsd"][1]))
    two = bsd[:bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE"):]
    assert labels(bsd) == labels(two) == "bsd"
    # an altered disclaimer is no match
    assert labels(bsd.replace("ARE DISCLAIMED", "ARE NOT DISCLAIMED")) == labels(two.replace("EVEN IF ADVISED", "IF ADVISED")) == ""
    isc = re.sub(r"<<var \d+>>", "THE AUTHOR", re.sub(r"<<optional>>|<<end>>", "", L.TEMPLATES["isc"][1]))
    assert labels(isc) == "isc" and labels(isc.replace("DISCLAIMS ALL", "DISCLAIMS SOME")) == ""
    free = L.TEMPLATES["unlicense"][1]
    assert labels(free) == "unlicense" and labels(free.replace("sell, or", "or")) == ""


def test_templates_match_their_own_text():
    fill = lambda t, opt: re.sub(r"<<var \d+>>", "ACME Corp", re.sub(r"<<optional>>|<<end>>", "", t) if opt else re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", " ", t, flags=re.S))
    for name, (label, template) in L.TEMPLATES.items():
        for optional in (True, False):
            text = "Some words before. " + fill(template, optional) + " and after"
            found = L.scan(text.encode(), L.compiled())
            assert name in [m["template"] for m in found[7]], (name, optional)
            assert label in found[5]


def test_mandatory_wording_must_be_exact():
    label, template = L.TEMPLATES["mit"]
    text = re.sub(r"<<var \d+>>", "someone", re.sub(r"<<optional>>|<<end>>", "", template))
    changed = text.replace("without restriction", "with restriction")
    assert "mit" in L.scan(text.encode(), L.compiled())[5] and "mit" not in [m["template"] for m in L.scan(changed.encode(), L.compiled())[7]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcx"), max_size=12))
def test_automaton_against_a_pattern(words):
    auto = L.Automaton("a <<optional>>b <<end>><<var 2>> c")
    got = auto.match([w.encode() for w in words], 0) if words[:1] == ["a"] else None
    m = [i for i in range(len(words) + 1) if re.fullmatch(r"a (b )?(\w ){0,2}c ", "".join(w + " " for w in words[:i]))]
    assert got == (max(m) if m else None)


# Decontamination ---------------------------------------------------------------------------------------------------

def made(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma"]) if rng.random() < 0.4 else f"w{rng.randint(0, 4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(9)
    items = [(i, made(rng, rng.randint(6, 90))) for i in range(30)] + [(30, None), (31, ""), (32, "only four words here"), (33, None)]
    items.append((34, items[3][1]))
    texts = [(i, made(rng, rng.randint(0, 400))) for i in range(60)]
    for i in range(0, 40, 2):
        w = texts[i][1].split()
        at = rng.randint(0, len(w))
        texts[i] = (i, " ".join(w[:at] + items[i % 30][1].upper().split() + w[at:]))
    half = items[5][1].split()
    texts += [(90, " ".join(half[:len(half) // 2])), (91, None), (92, ""), (None, items[7][1]), (93, items[7][1]), (93, items[7][1]),
              (94, "so Only, four: words HERE then"), (95, made(rng, 9000) + " " + items[9][1])]
    return texts, items


def brute_leaks(texts, items):
    out = []
    for i, t in texts:
        words = D.words_of(t or "")
        for j, q in items:
            s = D.shingles(D.words_of(q or ""))
            k = len(next(iter(s))) if s else 0
            there = set(zip(*(words[x:] for x in range(k)))) if k else set()
            if s and len(s & there) >= 0.8 * len(s):
                out.append((i, j))
    return out


def test_leaks_against_brute_force(spark, leaky):
    texts, items = leaky
    d, b = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(d, b).collect()
    assert as_bag((r["doc_id"], r["item_id"]) for r in got) == as_bag(brute_leaks(texts, items))
    assert all(r["score"] >= 0.5 - 1e-9 and r["question_overlap"] >= 0.8 and r["answer_overlap"] is None for r in got)
    flagged = {i for i, _ in brute_leaks(texts, items)}
    kept = [r["doc_id"] for r in D.keep_clean(d, b).collect()]
    assert as_bag(kept) == as_bag(i for i, _ in texts if i not in flagged and i is not None)


def test_retrieval_is_exact(leaky):
    texts, items = leaky
    index = D.build_index([(i, q, None) for i, q in items])
    for _, t in texts[:40]:
        words = D.words_of(t or "")
        want = set()
        for start in range(0, max(1, len(words) - index["span"]), index["span"]):
            passage = set(words[start:start + 2 * index["span"]])
            sums = Counter()
            for w in passage:
                if w in index["terms"]:
                    for at, s in zip(*index["parts"][index["terms"][w]]):
                        sums[int(at)] += s
            want |= {index["of"][at] for at, s in sums.items() if s >= 0.5 - 1e-9}
        assert set(D.retrieve(words, index)) == want


def test_answers_and_blocks(spark, leaky, monkeypatch):
    d = spark.createDataFrame([(1, "what is the tallest tree in the old garden it is the copper beech by the wall"),
                               (2, "what is the tallest tree in the old garden nobody knows")], "doc_id long, text string")
    b = spark.createDataFrame([("q", "What is the tallest tree in the old garden?", "It is the copper beech.")], "item_id string, text string, answer string")
    got = D.find_leaks(d, b, answer="answer").collect()
    assert [(r["doc_id"], r["item_id"], r["answer_overlap"]) for r in got] == [(1, "q", 1.0)]
    texts, items = leaky
    monkeypatch.setattr(D, "INDEX_CHARS", 2_000)
    docs_, items_ = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert as_bag((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs_, items_).collect()) == as_bag(brute_leaks(texts, items))


def test_leaks_of_empty_tables(spark, leaky):
    texts, items = leaky
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert D.find_leaks(d, none).count() == 0 and D.keep_clean(d, none).count() == len(texts)
    assert D.find_leaks(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# HTML --------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<div>a</div><div>b <b>c</b>\n d</div>", "a\nb c d"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=4><li>a<li value=9>b<li>c</ol>", "4. a\n9. b\n10. c"),
    ("<table><tr><th>n<th>word<tr><td>10<td>x<tr><td>7</table>", "n   word\n10  x\n7"),
    ("<table><tr><td>日本<td>b<tr><td>abcdef<td>c</table>", "日本    b\nabcdef  c"),
    ("x<script>var a='</p>';if(a<b){}</script><style>p{}</style>y", "xy"),
    ("<div hidden>no</div><p style='color:red; display: none'>no</p><span style=\"visibility:hidden\">no</span>yes", "yes"),
    ("<pre>\na  b\n c</pre>", "a  b\n c"),
    ("a &amp; b &lt;c&gt; &eacute; &#233; 1 < 2", "a & b <c> é é 1 < 2"),
    ("<blockquote>q</blockquote>r", "> q\n\nr"),
    ("<!-- a --><!DOCTYPE html><head><title>T</title><meta x><body>b", "b"),
    ("<details><summary>s</summary>in</details><details open>out</details>", "s\nout"),
    ("</p></div>stray", "stray"), ("", ""), ("<", "<"), ("<a href='x>y", "y"), ("a<!-- open", "a"), ("&nbsp;x", "\xa0x"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("<b>a</b> <i>b</i>", "a b"), ("<select><option>1</select>z", "1z"),
]


PAGES += [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i</table>", "a  b  c\nd     e\nf     g\nh  i"),
    ("<style>.h, p.x{display:none} #i{visibility:hidden} /* .k{display:none} */ @media print{.k{display:none}}</style>"
     "<p class='a h'>no<p class=x>no</p><b class=x>yes</b><p id=i>no<p class=k>k", "yes\n\nk"),
    ("<style>.h{display:none}.h{display:block}</style><div class=h>yes</div><style>.g{display:none}</style><i class=g style='display:inline'>too</i>", "yes\ntoo"),
    ("<textarea>one\n  two</textarea>", "one\n  two"), ("a <select multiple><option>x<option>y</select> b", "a\nx\ny\nb"),
    ("<select><optgroup label=g><option>x<option selected>y</optgroup></select>", "y"),
    ("<svg><title>no</title><g><text>label</text><path d=''/><text>more</text></g> no</svg>after", "label\nmore\nafter"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"), ("<object data=u>fallback</object>", "fallback"),
]


def test_cells_that_span_keep_their_columns():
    """The columns of a grid that is filled cell by cell, against the placement."""
    r = random.Random(7)
    for _ in range(300):
        rows = [[(f"{y}{x}", r.choice([1, 1, 2, 3]), r.choice([1, 1, 2, 4])) for x in range(r.randint(0, 4))] for y in range(r.randint(1, 5))]
        grid, want = {}, []
        for y, cells in enumerate(rows):
            want.append([])
            at = 0
            for text, columns, down in cells:
                while (y, at) in grid:
                    at += 1
                want[-1].append((at, columns, text))
                for dy in range(down):
                    for dx in range(columns):
                        grid[y + dy, at + dx] = text
                at += columns
        assert html_layout.placed(rows) == want


def slow_text(node):
    """Text of a tree of blocks and inline elements by marks for what breaks lines, an independent way."""
    kind, inner = node
    if kind == "text":
        return inner
    body = "".join(map(slow_text, inner))
    mark = {"p": "\2", "h2": "\2", "blocked": "\1", "div": "\1", "section": "\1"}.get(kind, "")
    return "" if kind == "hidden" else mark + body + mark


def as_html(node):
    kind, inner = node
    if kind == "text":
        return inner
    tag = {"hidden": "div hidden", "blocked": "main"}.get(kind, kind)
    return f"<{tag}>" + "".join(map(as_html, inner)) + f"</{tag.split()[0]}>"


def test_pages_against_an_independent_renderer():
    r = random.Random(3)

    def tree(depth, inline=False):
        if depth == 0 or r.random() < 0.2:
            return "text", r.choice(["a", "b c", " d ", "\n", "e  f", ""])
        kind = r.choice(["b", "span"] if inline else ["p", "div", "section", "h2", "blocked", "hidden", "b", "span"])
        return kind, [tree(depth - 1, inline or kind in ("p", "h2", "b", "span")) for _ in range(r.randint(0, 4))]

    for _ in range(500):
        node = ("div", [tree(4) for _ in range(3)])
        flat = re.sub(r"[ \n]+", " ", slow_text(node))
        lines, gap = [], False
        for part in re.split("([\1\2])", flat):
            if part == "\2":
                gap = True
            elif part.strip(" \1"):
                lines += [""] * (gap and bool(lines)) + [re.sub(" +", " ", part).strip(" ")]
                gap = False
        assert html_layout.render(as_html(node))[1] == "\n".join(lines), as_html(node)


def test_time_is_linear_in_depth():
    import time

    def took(n):
        start = time.perf_counter()
        html_layout.render("<p><button>" + "<div>" * n + "x")
        html_layout.render("<ul><li>" * n + "x")
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 40 * max(took(2_000), 0.005)


@pytest.mark.parametrize("html, text", PAGES)
def test_layout(html, text):
    assert html_layout.render(html)[1] == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<ul>", "<li>", "</ul>", "<div hidden>",
                                 "</div>", "<pre>", "</pre>", "x", " y\n", "<br>", "<b", "'", ">", "<!--", "-->", "<script>", "</script>"]), max_size=40))
def test_any_markup_is_nested_and_never_fails(parts):
    depth = []
    for kind, tag, _ in html_layout.events("".join(parts)):
        if kind == "open":
            depth.append(tag)
        elif kind == "close":
            assert depth.pop() == tag
    assert depth == []
    html_layout.render("".join(parts))


def test_deep_nesting_and_pages(spark):
    assert html_layout.render("<div>" * 50_000 + "x")[1] == "x"
    table = [(1, "<title>A b</title><p>x", 5), (1, "<title>A b</title><p>x", 5), (None, None, 6), (2, "", 7)]
    got = html_layout.extract(spark.createDataFrame(table, "page_id long, html string, text int")).collect()
    assert as_bag(map(tuple, got)) == as_bag([(1, "A b", "x", 1), (1, "A b", "x", 1), (None, "", "", 0), (2, "", "", 0)])
    assert html_layout.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
