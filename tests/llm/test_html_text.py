"""Main text: pages whose text must stay, hostile markup, and template counts against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest

from texlith.llm import html_text

KEPT = [
    ('<div class="layout no-sidebar"><article><p>Long main text is here.</p></article></div>', "Long main text is here."),
    ('<div class="content has-comments"><p>Main text.</p><div class="comments"><p>no</p></div></div>', "Main text."),
    ('<article><header class="entry-header"><h1>Title</h1></header><p>Text of it.</p></article>', "Title\nText of it."),
    ('<main><p>One two.</p><div class="alert">Watch out.</div></main>', "One two.\nWatch out."),
    ("<form><main><p>in a form</p></main><input></form>", "in a form"),
    ("<table><tr><td>a<td>b<tr><td>c</table><p>x<p>y", "a\nb\nc\nx\ny"),
    ('<p title="a>b">q</p>', "q"),
    ('<a href=x>y</a "><p>z</p>', "y\nz"),
    ('<p x="unclosed>text</p><p>more</p>', "text\nmore"),
    ("x < y and <3 z <", "x < y and <3 z <"),
    ("<div hidden>no</div><p>yes</p>", "yes"),
    ('<body><div class="side-nav"><p>side</p></div><p>the page has some text of its own</p></body>', "the page has some text of its own"),
    ("", ""),
]


@pytest.mark.parametrize("page, text", KEPT)
def test_main_text_stays(page, text):
    assert html_text.extract(page) == text


HOSTILE = {
    "quotes": '<a "' * 20000, "quotes, end": '<a "' * 20000 + ">", "attributes": '<a x="' * 20001 + ">", "deep": "<div>" * 20000 + "</i>" * 20000, "in an i": "<i>" + "<div>" * 10000 + "</i>x" * 10000,
    "barrier": "<i><article>" + "<b>" * 10000 + "</i>x" * 10000, "blocks": "<p><b>" + "<b>" * 10000 + "<div></div>" * 10000, "less": "<" * 60000, "comments": "<!--" * 20000, "cells": "<td>" * 20000,
    "blanks": "<a " + " " * 90000, "tables": "<table><tr>" * 8000 + "x", "items": "<ul><li>" * 9000 + "</li>" * 9000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_linear(name):
    page = HOSTILE[name]
    began = time.perf_counter()
    html_text.extract(page)
    once = time.perf_counter() - began
    assert once < 1.0
    began = time.perf_counter()
    html_text.extract(page * 4)
    assert time.perf_counter() - began < 12 * once + 0.5


def test_counts_equal_brute_force(spark):
    """The template of a small site, counted in Python from the same hashes, gives the texts that Spark's count gives."""
    rng = random.Random(3)
    lines = [f"Line number {k} that some pages have." for k in range(6)]
    rows = []
    for i in range(60):
        host = rng.choice(["a.org", "b.org", "www.a.org"])
        top = f"<div><p>{rng.choice(lines[:2])}</p></div>" + "".join(f'<ul class="m"><li><a href="/{k}">link {rng.randrange(99)}</a></li></ul>' for k in range(1))
        menu = '<div class="links">' + "".join(f"<a>{rng.randrange(9**9)}</a> " for _ in range(4)) + "</div>"
        body = f"<article><h1>T {i}</h1><p>{rng.choice(lines)}</p><p>{'own words ' * 5}{i}</p></article>" if rng.random() < 0.5 else f"<div><p>{rng.choice(lines[3:])}</p><p>{'own words ' * 9}{i}</p></div>"
        rows.append((i, f"http://{host}/{i}", f"<body>{top}{menu}{body}</body>"))
    rows += [(100 + k, *rows[0][1:]) for k in range(7)] + [(200, None, None), (201, "::", "<p>x"), (201, "::", "<p>x")]
    host = lambda u: u.split("/")[2].removeprefix("www.") if u and u.startswith("http") else ""
    seen, pages = defaultdict(set), defaultdict(set)
    for _, url, page in rows:
        nodes = html_text.measure(page or "")
        text = html_text.text_of(nodes[0], set())
        pages[host(url)].add(text)
        for kind, digest, _ in html_text.counted(nodes):
            seen[host(url), kind, digest].add(text)
    template = defaultdict(set)
    for (h, kind, digest), where in seen.items():
        if len(where) >= 5 and len(where) >= len(pages[h]) * (0.5 if kind == 1 else 0.1):
            template[h].add((kind, digest))
    want = Counter((i, html_text.extract(page or "", frozenset(template[host(url)]))) for i, url, page in rows)
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "page_id long, url string, html string, host string, template int, kind int")
    got = html_text.extract_pages(df).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(len(t) for t in template.values()) > 5 and any("some pages have" in t for _, t in want) and not any(re.search(r"(\d+ ){3}\d", t) for _, t in want)
    assert html_text.extract_pages(df.limit(0)).count() == 0
