import html
import itertools
import random
import re

from corpus import SF

from starmill.llm import html_extract as x
from starmill.llm.queries import QUERIES


def cut_cost(labels, scores, edges):
    own = sum(s for s, on in zip(scores, labels) if s > 0 and not on)
    own += sum(-s for s, on in zip(scores, labels) if s < 0 and on)
    return own + sum(w for (a, b), w in edges.items() if labels[a] != labels[b])


def test_labels_are_a_minimum_cut():
    draw = random.Random(7)
    for _ in range(300):
        blocks = draw.randint(1, 6)
        nodes = blocks + draw.randint(0, 3)
        scores = [draw.randint(-60, 60) for _ in range(blocks)]
        edges = {}
        for _ in range(draw.randint(0, 12)):
            a, b = draw.randrange(nodes), draw.randrange(nodes)
            if a != b:
                edges[a, b] = edges.get((a, b), 0) + draw.randint(1, 40)
        labels = tuple(x.label(scores, edges, nodes))
        full = scores + [0] * (nodes - blocks)
        costs = {
            c: cut_cost(c, full, edges) for c in itertools.product([True, False], repeat=nodes)
        }
        best = min(costs.values())
        minimal = {c[:blocks] for c, cost in costs.items() if cost == best}
        assert labels in minimal and sum(labels) == max(map(sum, minimal))


def article_of(source):
    """The given pages' article, read off their markup."""
    inner = re.search("<article>(.*?)</article>", source, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())
              for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_whole_table_matches_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op6_html_extract"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


LONG = "This is a sentence of the story that goes on for quite a while, as stories do."


def test_furniture_of_many_kinds_is_left_out():
    page = f"""<html><body class="menu sidebar"><header><h1>Site</h1><nav>Home</nav></header>
    <div id="cookie-notice"><p>{LONG} We use cookies.</p></div>
    <main><article><header><h1>Title &amp; more</h1></header><p>{LONG}<br>Next&nbsp;line <b>bold</b></p>
    <p>Hi.</p><aside>{LONG}</aside><form><p>{LONG}</p></form><div class="ad"><p>Buy. {LONG}</p></div>
    <ul><li>one<li>two</ul><script>var a = "<p>no</p>";</script><style>p {{}}</style>
    <section id="comments"><p>{LONG} I agree.</p></section></article></main>
    <div class="sidebar"><p>{LONG}</p></div><footer><p>{LONG}</p></footer></body></html>"""
    assert x.main_text(page) == (
        f"Title & more\n{LONG} Next line bold\nHi.\none\ntwo"
    )


def test_page_without_article_uses_density_and_neighbours():
    links = "".join(f'<a href="/{i}">link {i}</a> ' for i in range(9))
    page = f"<div>{links}</div><div><p>{LONG}</p><p>Short one</p><p>{LONG}</p></div><div>{links}</div>"
    assert x.main_text(page) == f"{LONG}\nShort one\n{LONG}"


def decided(source):
    """Blocks whose label is not the sign of their own score."""
    page, scores, labels = x.labelled(source)
    return [b.text for b, s, on in zip(page.blocks, scores, labels) if (s > 0) != on]


def test_the_cut_decides_blocks_of_the_given_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    changed = [d for d in map(decided, pages) if d]
    assert changed
    for source in pages:
        assert x.main_text(source) == article_of(source)


def test_unmarked_blocks_go_with_their_surroundings():
    """Divs only: short lines between paragraphs stay; rights, links and a reader's remark go."""
    menu = "".join(f'<div><a href="/{i}">Topic {i}</a></div>' for i in range(6))
    body = "".join(f"<p>{LONG}</p>" for _ in range(3)) + "<p>And then</p>" + f"<p>{LONG}</p><p>Why</p>"
    page = f"""<div>{menu}</div><div><h2>Heading of it</h2>{body}</div>
    <div><p>Great read, thank you all.</p></div><div>© 2024 Some Company, all rights reserved</div>"""
    text = x.main_text(page).split("\n")
    assert text == ["Heading of it", LONG, LONG, LONG, "And then", LONG, "Why"]
    assert {"And then", "Why"} <= set(decided(page))


def test_names_are_matched_whole():
    article = f"""<article><p>{LONG}</p><div class="share-prices"><p>Prices rose by a tenth. {LONG}</p></div>
    <div class="share"><p>Tell your friends. {LONG}</p></div><div class="site-comments"><p>{LONG}</p></div>
    <div id="top-ad"><p>{LONG}</p></div><p>All rights reserved.</p></article>"""
    assert x.main_text(article) == f"{LONG}\nPrices rose by a tenth. {LONG}\nAll rights reserved."
    teaser = f"<aside><article><p>{LONG}</p></article></aside><div><p>{LONG}</p><p>{LONG} More.</p></div>"
    assert x.main_text(teaser) == f"{LONG}\n{LONG} More."


def test_edges(spark):
    assert x.main_text("") == x.main_text("<!-- only -->") == ""
    assert x.main_text("<article><p>a &am b &lt;x&gt; &copy 3 < 4</article>") == "a &am b <x> © 3 < 4"
    assert x.main_text("<article><p>open <script>never closed </p>") == "open"
    assert x.main_text("<article>" + "<div>" * 5000 + LONG + "</p></i>") == LONG
    deep = "<article>" + f"<p>{LONG}</p>" * 20_000
    assert x.main_text(deep).count("\n") == 19_999
    messy = "<div>" + "".join(f"<p>word {i}</p><div>{LONG}</div>" for i in range(2000)) + "</div>"
    assert LONG in x.main_text(messy)
    frame = spark.createDataFrame(
        [(1, None, None, "x"), (None, "u", "<p>t</p>", "y"), (1, None, None, "x")],
        "page_id long, url string, html string, text string")
    rows = x.extract(frame).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows)[1:] == [(1, "", 0), (1, "", 0)]
    assert x.extract(frame.where("false")).count() == 0
