"""Page extraction: broken markup in linear time, the style tree against a plain version, hot hosts."""

import math
import random
import time
from collections import defaultdict

import pytest


def test_broken_markup_takes_time_in_proportion():
    from presswork.llm.html_extract import main_text

    n = 100_000
    for page in ('<b x="y> t ' * n, "<b " * n, "<b " * n + '"', "<div>" * n, "<x>" * n, "<p>" + "<span>" * n + "</z>" * n, "<b '\" \" " * n,
                 "<button><p>" + "<x>" * n + "</p>" * n, "<svg><foreignobject>" + "<x><b>" * (n // 2), "<i>" * n + "</b>" * n,
                 '<b "' * (n | 1), "<!-- " * n, "<script>" * n):
        start = time.perf_counter()
        main_text(page + "last")
        assert time.perf_counter() - start < 15, page[:40]  # hours where it takes the square


def test_tags_end_outside_quotes():
    from presswork.llm.html_extract import main_text

    assert main_text('<p title="a > b">x</p><p data-x=\'"\' y>z</p>') == "x z"
    assert main_text('<p title="open>x</p>') == '<p title="open>x'  # no tag, since its quote never ends
    assert main_text("<p <b>x</b>") == "x" and main_text("1 < 2 <3") == "1 < 2 <3" and main_text('</p "x') == ""
    assert main_text("<" * 1000) == "<" * 1000


def _rows(rnd, hosts=3, pages=14):
    """Pages without articles: own text, shared notes in two branches, a subhead on some pages."""
    out = []
    for h in range(hosts):
        notes = [f"Shared note {h} {k}" for k in range(3)]
        for i in range(pages):
            body = f"<div class=text><p>{f'own {h} {i} ' * rnd.randint(5, 30)}</p></div>"
            side = "".join(f"<div class=n{k % 2}><span>{notes[k]}</span></div>" for k in range(3) if rnd.random() < 0.8)
            extra = "<section><h2>Overview</h2></section>" if rnd.random() < 0.4 else ""
            out.append((len(out), f"http://H{h}.org/{i}", f"<body>{side}{body}{extra}</body>"))
        out += [(None, url, html) for _, url, html in out[-4:]]  # copies, without an id
    return out + [(990, None, None), (991, "odd", ""), (992, "http://h0.org/", "   ")]


def _tree(rows):
    """{(host, path, content)} that the style tree gives up, from the definition."""
    from presswork.llm.html_extract import GAMMA, LEAST_PAGES, THRESHOLD, _content, _hash, _host, parse

    pages = defaultdict(dict)
    for _, url, html in rows:
        page = parse(html)
        blocks = _content(page)
        if not any(b.in_article for b in blocks):
            pages[_host(url)].setdefault(tuple(b.text for b in blocks), (page, blocks))
    out = set()
    for host, known in pages.items():
        m = len(known)
        if m < LEAST_PAGES:
            continue
        texts, parents, chars, shapes = defaultdict(lambda: defaultdict(int)), {}, defaultdict(int), defaultdict(lambda: defaultdict(int))
        for page, blocks in known.values():
            for path, text in {(b.path, b.text) for b in blocks}:
                texts[path][text] += 1
            for b in blocks:
                parents[b.path] = b.parent
                chars[b.path] += len(b.text)
            for path, shape in set(page.children):
                shapes[path][shape] += 1
        main = max(chars, key=lambda p: (chars[p], p))
        for path, of in texts.items():
            content = 1 - sum(math.log(n, m) for n in of.values()) / len(of)
            counts = shapes.get(parents[path], {}).values()
            presentation = -sum(n / sum(counts) * math.log(n / sum(counts), m) for n in counts)
            if path != main and (1 - GAMMA) * presentation + GAMMA * content < THRESHOLD:
                out |= {(host, path, _hash(t)) for t, n in of.items() if n > 1}
    return out


def test_style_tree_against_its_definition(spark):
    from presswork.llm.html_extract import style_tree

    rows = _rows(random.Random(4))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.host, r.path, r.feature) for r in style_tree(pages).collect()}
    assert got == _tree(rows) and got


@pytest.mark.parametrize("seed", [1, 2])
def test_joined_and_broadcast_agree(spark, seed):
    from presswork.llm.html_extract import _content, _hash, _host, extract, parse

    rows = _rows(random.Random(seed), hosts=1, pages=60) + _rows(random.Random(seed + 9), hosts=2, pages=5)
    noisy = _tree(rows)

    def want(url, html):
        return " ".join(b.text for b in _content(parse(html)) if b.in_article or (_host(url), b.path, _hash(b.text)) not in noisy)

    pages = spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id long, url string, html string, low string, page string")
    wanted = sorted((str(i), u or "", want(u, h)) for i, u, h in rows)
    for bound in (1_000_000, -1):
        got = extract(pages, broadcast_rows=bound)
        assert sorted((str(r.page_id), r.url or "", r.text) for r in got.collect()) == wanted
    assert any("Shared" in h and "Shared" not in want(u, h) for _, u, h in rows if h)
    for bound in (1_000_000, -1):
        assert extract(pages.limit(0), broadcast_rows=bound).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, -1])
def test_pages_with_articles_are_in_the_tree(spark, bound):
    """The notice is seen on pages with long articles; it goes from pages without one, and no short article gives way to it."""
    from presswork.llm.html_extract import extract, style_tree

    notice = f"<div class=x1>{'All texts on this site belong to somebody. ' * 8}</div>"
    menu = "<nav><ul><li>Home</li><li>News</li></ul></nav>"

    def page(i, body):
        return i, f"http://h.org/{i}", f"<head><title>T</title></head><body>{menu}{body}{notice}</body>"

    long = [page(i, f"<article><h1>Overview</h1><p>{f'long {i} ' * 80}</p></article>") for i in range(12)]
    short = [page(i, f"<article><p>short {i}</p></article>") for i in range(12, 15)]
    plain = [page(i, f"<div class=t><p>{f'plain {i} ' * 9}</p></div>") for i in range(15, 17)]
    pages = spark.createDataFrame(long + short + plain, "page_id long, url string, html string")
    want = {i: f"Overview {f'long {i} ' * 80}".strip() for i in range(12)}  # a subhead that all share stays in an article
    want |= {i: f"short {i}" for i in range(12, 15)} | {i: (f"plain {i} " * 9).strip() for i in range(15, 17)}
    assert {r.page_id: r.text for r in extract(pages, broadcast_rows=bound).collect()} == want
    tree = style_tree(pages)
    assert tree.filter("open").select("path").distinct().count() == 2  # the notice and the subhead
    assert tree.filter("not open").select("feature").distinct().count() == 2  # both entries of the menu
