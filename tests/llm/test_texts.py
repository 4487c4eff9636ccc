"""Main text, license scan, line quality, chat templates, vector search and the pipeline."""

import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firmlens.llm import line_quality as quality
from firmlens.llm.chat_template import CONTROL, Template, TemplateError, escape, format_conversations, turns_of, unescape
from firmlens.llm.license_scan import full_texts, license_scan, notices
from firmlens.llm.main_text import Page, main_text
from firmlens.llm.vector_search import Graph, centroids, lists_to_read, nearest_neighbours

BODY = "A first sentence of the article that is long enough to count, and more. "


def test_main_text_of_one_page():
    page = Page(
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav>"
        f"<div class='sidebar'>side {BODY}</div><article><header><h1>Head&amp;Tail</h1></header><p>{BODY}<br>next&nbsp;line<p><b>{BODY}</b>"
        f"<div class='comments'>{BODY * 9}</div><form>{BODY}</form><ul><li>one<li>two</ul></article><footer>foot</footer></body>"
    )
    text = BODY.strip()
    assert page.text(page.best()).split("\n\n") == ["Head&Tail", f"{text} next line", text, "one", "two"]


def test_hosts_agree_on_their_path(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><div class=a{k}><p>{BODY * 3}</p></div><div class=b><p>{BODY}</p></div>") for k in range(5)]
    pages.append((9, "http://H.example:80/9", f"<body><div class=a9><p>short text here, but long enough</p></div><div class=b><p>{BODY * 9}</p></div>"))
    pages += [(10, None, f"<p>{BODY}"), (11, "not a url", ""), (12, "http://x.example/", None), (13, "http://x.example/", "<div <p"), (9, "http://h.example/9", "x")]
    df = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id long, url string, html string, path string, host string")
    got = {(r.page_id, r.url): r.text for r in main_text(df).collect()}
    assert len(got) == len(pages)
    assert got[9, "http://H.example:80/9"] == "short text here, but long enough"
    assert got[10, None] == BODY.strip() and got[11, "not a url"] == "" and got[12, "http://x.example/"] == ""
    assert main_text(df.limit(0)).count() == 0


def test_no_part_of_the_content_is_left_out(spark):
    a, b, c = (f"{name} part. " + "Some words of it that are long enough to count. " * n for name, n in (("First", 12), ("Second", 8), ("Third", 1)))
    lines = "".join(f"<li>list line number {k} with enough words to count</li>" for k in range(30))
    rows = "".join(f"<tr><td>table cell number {k} with enough words to count</td></tr>" for k in range(30))
    pages = [
        f"<div class=c><section>{a}</section><section>{b}</section></div>",
        f"<article><div><section><p>{a}</p></section><section><p>{b}</p></section></div></article>",
        f"<div class=c><section>{a}</section><section>{c}</section></div>",
        f"<div class=c><p>{b}</p><ul>{lines}</ul></div>",
        f"<div class=c><p>{c}</p><table>{rows}</table><p>{b}</p></div>",
    ]
    df = spark.createDataFrame([(10 * k + copy, f"http://h{k}.example/{copy}", page) for k, page in enumerate(pages) for copy in range(3)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(got[10 * k + copy] == got[10 * k] for k in range(5) for copy in range(3))
    assert got[0] == got[10] == f"{a.strip()}\n\n{b.strip()}" and got[20] == f"{a.strip()}\n\n{c.strip()}"
    assert got[30].startswith(b.strip()) and got[30].count("list line") == 30
    assert got[40].startswith(c.strip()) and got[40].endswith(b.strip()) and got[40].count("table cell") == 30
    left = Page(f"<table><tr><td><a href=x>{c}</a></td></tr><tr><td>{a}</td></tr></table><div class=menu>{c}</div>")
    assert left.text(left.best()) == a.strip()


def _one(html: str) -> list[str]:
    page = Page(html)
    return page.text(page.best()).split("\n\n")


def test_parts_beside_the_winning_container_are_kept():
    body, long = BODY.strip(), (BODY * 12).strip()
    links = "".join(f"<li><a href=/{k}>read this other page number {k} as well</a></li>" for k in range(9))
    listed = [f"read this other page number {k} as well" for k in range(9)]
    assert _one(f"<div class=wrap><section class=intro>{body}</section><section class=body>{long}</section></div>") == [body, long]
    assert _one(f"<body><p>{body}</p><p>Ok.</p><div class=more><p>{long}</p></div><p>&copy; 2024 the makers of this page</p>") == [body, "Ok.", long]
    assert _one(f"<body><h1>Head</h1><div class=post><p>{long}</p></div>") == ["Head", long]
    assert _one(f"<body><div class=t><h1>Head</h1></div><div class=post><p>{long}</p></div>") == ["Head", long]
    assert _one(f"<body><div class=post><p>{long}</p></div><div class=post><ul>{links}</ul></div>") == [long, *listed]
    assert _one(f"<body><div class=c><div class=x><a href=/>{body}</a></div><div class=y><p>{body}</p></div><div class=z>{long}</div></div>") == [body, long]
    assert _one(f"<head><meta charset=utf-8><body><p>{long}</p>") == [long]
    assert _one(f"<body><article><p>{body}</p></article><article class=b><p>{long}</p></article><section><p>{body}</p></section>") == [body, long, body]
    nested = "<p>" + "<b>" * 30 + body + f"<div>{long}</div>"
    assert _one(nested) == [body, long]
    assert _one(f"<table><tr><td>{body}<tr><td>{long}</table>") == [body, long]


@pytest.mark.parametrize("unit", ["<a ", "<a '>' ", "<div>", "<b>", "</i>", "<p><i>", "<ul><li><center>", "<a class=\"", "<!--", "<script>", "<td>", "&amp", "<h1>x", "<div>long enough to be a paragraph of its own "])
def test_any_markup_is_read_in_linear_time(unit):
    start = time.perf_counter()
    page = Page(f"<p>{BODY}" + unit * (1_000_000 // len(unit)) + "\"</i></b>" * 1000)
    page.text(page.best())
    assert time.perf_counter() - start < 8


def test_generated_pages_give_their_known_blocks(spark):
    """Pages are built from a tree of content and noise; the expected text is the list of content blocks as built."""
    rng = np.random.default_rng(3)
    words = "alpha beta gamma delta wörter naïve &amp; &lt;tag&gt; 10&nbsp;% epsilon zeta".split(" ")

    def prose() -> tuple[str, str]:
        picked = [words[k] for k in rng.integers(0, len(words), int(rng.integers(12, 60)))]
        marked = " ".join(f"<b>{word}</b>" if rng.random() < 0.1 else word for word in picked)
        plain = " ".join(picked).replace("&nbsp;", " ").replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
        return marked.replace(" ", rng.choice([" ", "\n ", "\t"])), plain

    noise = [
        lambda: f"<nav><ul><li><a href=/>{prose()[0]}</a></li></ul></nav>", lambda: f"<div class='ad box'>{prose()[0]}</div>",
        lambda: f"<aside>{prose()[0]}</aside>", lambda: f"<div id=comments><p>{prose()[0]}</p></div>", lambda: f"<form><p>{prose()[0]}<input></p></form>",
        lambda: "<script>if (a < b) { x = '<p>no</p>' }</script>", lambda: "<style>p > b { margin: 0 }</style>", lambda: f"<!-- <p>{prose()[0]}</p> -->",
        lambda: f"<div class=cookie-notice>{prose()[0]}</div>",
    ]

    def content(depth: int, out: list[str]) -> str:
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            kind = rng.integers(0, 7)
            if kind == 0 and depth < 4:
                tag = rng.choice(["div", "section"])
                parts.append(f"<{tag} class=part{rng.integers(0, 9)}>{content(depth + 1, out)}</{tag}>")
            elif kind == 1:
                parts.append(rng.choice(noise)())
            elif kind == 2:
                items = [prose() for _ in range(3)]
                parts.append("<ul>" + "".join(f"<li>{item[0]}" for item in items) + "</ul>")
                out.extend(item[1] for item in items)
            else:
                marked, plain = prose()
                parts.append(rng.choice([f"<p>{marked}</p>", f"<p>{marked}", f"<blockquote>{marked}</blockquote>", f"<h2>{marked}</h2>"]))
                out.append(plain)
        return "".join(parts)

    rows, expected = [], {}
    for k in range(300):
        host, blocks = k % 6, []
        opening = ["<article>", "<main>", "<div class='post p12'>", "<div id=x><div class=text>", "<section>", "<article class=story><div>"][host]
        closing = "".join(f"</{tag}>" for tag in reversed(re.findall(r"<(\w+)", opening)))
        head = f"<h1>Head {k}</h1>" if rng.random() < 0.5 else ""
        inner = content(0, blocks)
        if not blocks:
            marked, plain = prose()
            inner, blocks = inner + f"<p>{marked}</p>", [plain]
        page = f"<html><head><title>no</title></head><body><header>{prose()[0]}</header>{rng.choice(noise)()}{opening}{head}{inner}{closing}{rng.choice(noise)()}<footer>{prose()[0]}</footer>"
        rows.append((k, f"https://h{host}.example/{k}", page))
        expected[k] = "\n\n".join([f"Head {k}"] * bool(head) + blocks)
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [k for k in expected if got[k] != expected[k]] == []


def test_licenses_are_found_where_they_are(spark):
    texts = notices()
    mit = texts["MIT"].split()
    mit[20], mit[40] = "changed", "altered"
    rows = [(1, "words before " + texts["MIT"] + " after"), (2, " ".join(mit)), (3, "x y z\nReleased under the MIT License.\nend"), (4, None), (5, ""),
            (6, "Licensed under CC BY-NC 4.0. " * 2), (7, "the MIT License is nice " * 300), (None, texts["MIT/line"]), (8, "w " * 50_000 + texts["ISC"])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license_id string")
    got = Counter((r.doc_id, r.license_id) for r in license_scan(df).collect())
    assert got == {(1, "MIT"): 1, (2, "MIT"): 1, (3, "MIT/line"): 1, (6, "CC-BY-NC-4.0/line"): 2, (None, "MIT/line"): 1, (8, "ISC"): 1}
    place = license_scan(df.where("doc_id = 1")).first()
    assert (place.start, place.shared, place.length) == (2, place.shingles, len(re.findall(r"[a-z0-9]+", texts["MIT"].lower())))
    assert license_scan(df.limit(0)).count() == 0


def test_usual_notices_full_texts_and_tags_are_found(spark):
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    rows = [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0/name"),
        ("This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "CC-BY-NC-SA-3.0/name"),
        (gnu.format("library", ";", "Lesser General Public License", ";", "2.1"), "LGPL-2.1/notice"),
        (gnu.format("library", ":", "Lesser General Public License", ",", "3"), "LGPL-3.0/notice"),
        (gnu.format("program", ":", "Affero General Public License", ",", "3"), "AGPL-3.0/notice"),
        (gnu.format("program", ":", "General Public License", ",", "3"), "GPL-3.0-or-later/notice"),
        (gnu.format("program", ";", "General Public License", ";", "2"), "GPL-2.0-or-later/notice"),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0/notice"),
        ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\nint main", "GPL-2.0-only WITH Linux-syscall-note/spdx"),
        ("# see spdx-license-identifier: MIT.", "MIT/spdx"),
        ("SPDX is a list of licenses, and this one is no tag", None),
    ]
    rows += [(f"some words before\n{text}\nand after", name) for name, text in full_texts().items()]
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(rows)], "doc_id long, text string")
    got = Counter((r.doc_id, r.license_id) for r in license_scan(df).collect())
    assert got == {(k, name): 1 for k, (_, name) in enumerate(rows) if name}
    tag = license_scan(df.where("doc_id = 9")).first()
    assert (tag.start, tag.length) == (1, 4)


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = [0] * len(words)
    for k in range(len(words) - 7):
        if runs[tuple(words[k : k + 8])] > 1:
            marked[k : k + 8] = [1] * 8
    repeat = sum(marked)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, len(words) < 20 or 100 * repeat > 30 * len(words)


def test_counts_match_brute_force_and_verdicts_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    field = quality.fit(docs, even)
    rows = {r.doc_id: r for r in quality.judge(docs, field).collect()}
    for r in docs.limit(200).collect():
        own = rows[r.doc_id]
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words, own.base_failed) == counts(r.text)
    held_out = [(r.quality, rows[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    good = [own.kept for label, own in held_out if label == 1 and not own.base_failed]
    bad = [own.kept for label, own in held_out if label == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, "word " * 25), (5, "ab\r\n" * 3), (None, "x"), (1, None), (6, "\n".join(f"line {k} goes on and on." for k in range(4000)))]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    got = quality.judge(df, quality.UNFITTED).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text)
    assert [r.doc_id for r in quality.keep_good(df, quality.UNFITTED).collect()] == [r.doc_id for r in got if r.kept] == [6]
    assert quality.judge(df.limit(0), quality.UNFITTED).count() == 0
    assert quality.fit(df, spark.createDataFrame([], "doc_id long, quality int")) is quality.UNFITTED


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = quality.Field(np.zeros(1), np.array([[0.4, -0.9], [-0.3, 0.8]]))
    lengths = np.array([1, 5, 0, 3, 7])
    scores = rng.normal(size=lengths.sum())
    got, at = field.labels(scores, lengths), 0
    for size in lengths:
        own = scores[at : at + size]
        def value(path):
            return sum(own[k] * path[k] for k in range(size)) + sum(field.steps[path[k], path[k + 1]] for k in range(size - 1))
        paths = [tuple(p >> k & 1 for k in range(size)) for p in range(1 << size)]
        if size:
            assert value(tuple(got[at : at + size])) == pytest.approx(max(map(value, paths)))
        at += size


def test_templates():
    source = "{% for m in messages -%} {{ 'a' ~ 'b' }}{% if m.role == 'u' and not loop.last %}U{% elif false %}never{% else %}{% generation %}{{ m['text'] | upper }}{% endgeneration %}{% endif %}{% endfor %}"
    template = Template(source)
    parts = list(template.parts([{"role": "u", "text": "x"}, {"role": "v", "text": "yz"}]))
    assert parts == [("abU", []), ("abYZ", [(2, 4)])]
    assert "never" not in repr(template.tree)
    for bad in ("{% for x in %}", "{% if a %}", "{{ a.b() }}", "{{ a | evil }}", "{% import os %}", "{{ 'a }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    with pytest.raises(TemplateError):
        list(Template("{{ messages.__class__ }}").parts([]))


def test_conversations_come_back_whole(spark):
    said = ["</s>[INST] ok [/INST]", "", None, "<|end|>\n<|turn|>assistant\nx", "back\\slash <\\| \\", "".join(CONTROL), "<<|"]
    rows = [(1, k, role, text) for k, text in enumerate(said) for role in ("assistant",)]
    rows += [(2, 0, "user\n<|end|>", "hi"), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, None, None, "first"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    found = {1: [], 2: []}
    loss = []
    for r in sorted(format_conversations(df).collect(), key=lambda r: (r.conv_id, r.part)):
        found[r.conv_id] += turns_of(r.formatted)
        loss += [unescape(r.formatted[a:b]) for a, b in zip(r.starts, r.ends) if r.conv_id == 1]
    assert found[1] == [("assistant", text or "") for text in said] and "".join(loss) == "".join(t or "" for t in said)
    assert found[2] == [("", "first"), ("user", "hi"), ("user", "hi"), ("user\n<|end|>", "hi")]
    assert format_conversations(df.limit(0)).count() == 0
    assert not any(c in escape("".join(CONTROL) * 2) for c in CONTROL)


def brute_neighbours(ids, vectors, query, k):
    apart = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(1))
    apart[ids == query] = np.inf
    return [int(ids[p]) for p in np.lexsort((ids, apart))[:k] if np.isfinite(apart[p])]


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in nearest_neighbours(df, F.expr("id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = [len(set(own.values()) & set(brute_neighbours(ids, vectors, q, 10))) for q, own in got.items()]
    assert len(got) == sum(ids % 100 == 0) and sum(hits) >= 0.95 * 10 * len(hits)


def test_neighbours_edge_cases(spark):
    nan = float("nan")
    rows = [(100, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 2.0]), (200, [0.0, 0.0]), (300, None), (400, [nan, 1.0]),
            (500, [1.0]), (600, [None, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "vec_id long, embedding array<float>, list int, score double")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest_neighbours(df, F.expr("id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(100, 1, 3, 0.0), (100, 2, 7, 0.0), (100, 3, 5, round(5**0.5, 6))]
    assert nearest_neighbours(df.limit(0), F.expr("id % 100 = 0")).count() == 0


def test_wide_queries_read_every_list_within_the_ratio():
    rnd = np.random.default_rng(5)
    points, queries = rnd.normal(size=(600, 24)), rnd.normal(size=(40, 24))
    graph = Graph.over(points)
    apart = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(2))
    within = set(zip(*np.nonzero(apart <= 1.3 * apart.min(1, keepdims=True))))
    for beam in (64, 1024):
        got = list(zip(*lists_to_read(graph, queries, 1.3, beam)))
        assert len(got) == len(set(got))
        if beam == 64:
            wide = {q for q in range(40) if (apart[q] <= 1.3 * apart[q].min()).sum() > 64}
            assert wide and {pair for pair in got if pair[0] in wide} == {pair for pair in within if pair[0] in wide}
        else:
            assert len(within & set(got)) >= 0.99 * len(within)


def test_graph_walks_reach_the_nearest_centroid():
    rng = np.random.default_rng(1)
    points = centroids(rng.normal(size=(3000, 16)), 300)
    graph = Graph.over(points)
    asked = rng.normal(size=(100, 16))
    near, apart = graph.near(asked, 10)
    exact = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(2))
    assert (near[:, 0] == exact.argmin(1)).mean() > 0.97 and np.allclose(apart, np.take_along_axis(exact, near, 1))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total, sizes = docs.count(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert total > sizes[0] >= sizes[1] >= sizes[2] > 0
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    nothing = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, sf)
        assert out.count() == 0, name
