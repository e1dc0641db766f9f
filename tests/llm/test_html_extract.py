import html
import itertools
import random
import re

import numpy as np

from dupweave.llm import html_extract as H
from dupweave.llm.html_blocks import leaf_blocks
from dupweave.llm.html_training import labelled_pages


def test_held_out_pages():
    model = H.trained_model()
    right = total = whole = 0
    pages = labelled_pages(200, 1234)
    for page, marked in pages:
        blocks = leaf_blocks(page)
        states = model.decode(blocks)
        good = [s == (b.text in marked) for s, b in zip(states, blocks, strict=True)]
        right, total, whole = right + sum(good), total + len(good), whole + all(good)
    assert right / total > 0.98 and whole / len(pages) > 0.8


def test_viterbi_is_the_best_sequence():
    r = random.Random(3)
    for _ in range(50):
        page, _ = labelled_pages(1, r.randrange(10**6))[0]
        blocks = leaf_blocks(page)[: r.randint(1, 9)]
        model = H.ChainModel({f: (r.gauss(0, 1), r.gauss(0, 1)) for f in ("bias", "t:p", "t:article", "words:3", "ends:True", "links:0")}, [[r.gauss(0, 1) for _ in range(2)] for _ in range(2)])
        scores = model.scores(blocks)
        value = lambda s: sum(scores[k][x] for k, x in enumerate(s)) + sum(model.pair[a][b] for a, b in itertools.pairwise(s))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert abs(value(best) - value(model.decode(blocks))) < 1e-9


def test_training_separates_by_neighbours():
    """Only the order tells these states apart: after an `a` come main blocks until a `z`."""
    r = random.Random(4)
    pages = []
    for _ in range(80):
        rows, states, inside = [], [], 0
        for _ in range(12):
            f = r.choice("axxxxz")
            inside = 1 if f == "a" else 0 if f == "z" else inside
            rows.append([f"f:{f}"])
            states.append(inside)
        pages.append((rows, states))
    model = H.train(pages, steps=200)
    (aa, ab), (ba, bb) = model.pair
    assert aa + bb - ab - ba > 1 and np.isfinite(model.pair).all()


def test_blocks():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p>a <b>b</b>c<p>d<br>e&amp;&eacute;&#39;</p><script>if (a<b) '</p>'</script>x") == ["a bc", "d e&é'", "x"]
    assert texts("<div>a<ul><li>b<li>c</ul>d</div><!-- <p>no</p> --><style>p{}</style><td>e") == ["a", "b", "c", "d", "e"]
    assert texts("a < b > c <not closed") == ["a < b > c"] and texts("") == [] and texts("<p>&nbsp; \n</p>") == []
    assert texts("<p title='x > y'>q</p></div></p><textarea>no</textarea>r<script>never closed <p>z") == ["q", "r"]
    deep = leaf_blocks("<div>" * 3000 + "x")
    assert len(deep) == 1 and len(deep[0].path()) == 3000
    assert texts("<p>E = <math><mi>m</mi><mn>2</mn></math>, and <svg><text>a circle</text></svg>.</p>") == ["E = m2, and a circle."]
    again = leaf_blocks('<div class="a b"><p>x<div class="b c"><p id=a>y')
    assert [sorted(f for e in b.path() for f in e.own) for b in again] == [["n:a", "n:b", "t:div", "t:p"], ["n:a", "n:b", "n:c", "t:div", "t:p"]]


def test_time_and_memory_follow_the_page():
    """Unclosed elements, in ways that would make a search of the open ones long."""
    import time
    import tracemalloc

    model = H.trained_model()
    for page, n in (("<div>x" * 30_000, 30_000), ("<p><button>" + "<b><p>y</p>" * 8_000, 8_000), ("<table><tr><td>" + "<i><td>z" * 8_000, 8_000), ("<ul>" + "<li><b>q<a>" * 8_000, 8_000)):
        tracemalloc.start()
        began = time.monotonic()
        assert len(leaf_blocks(page)) == n
        model.main_text(page)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300e6 and time.monotonic() - began < 60, (page[:30], peak)


#: Written by hand, in ways of their own: (page, its main text).
PAGES = [
    (
        """<html><body><div class="top"><a href=/>Home</a> <a href=/n>News</a></div><div class="story"><h1>A storm over the coast</h1>
<div>The storm came in the night, and it took roofs from many houses.</div><div>People went to the school, where food was given out until noon.</div>
<dl><dt>Wind</dt><dd>It blew at ninety knots for three hours.</dd></dl><figure><img src=a.png><figcaption>The harbour after the storm.</figcaption></figure></div>
<div class="reply">I was there too, it was terrible and loud.</div></body></html>""",
        "A storm over the coast The storm came in the night, and it took roofs from many houses. People went to the school, where food was given out until noon. Wind It blew at ninety knots for three hours. The harbour after the storm.",
    ),
    (
        """<!doctype html><title>Bread</title><header><a href="/">The Baker's Page</a><nav><ul><li><a href=/b>Breads</a><li><a href=/c>Cakes</a></ul></nav></header>
<main><h1>How to bake a plain loaf</h1><p>Mix the flour with water, salt and yeast, and leave it for an hour.<ol><li>Heat the oven until it is very hot.<li>Put the loaf in, and wait for forty minutes.</ol>
<p>Let it cool on a rack, since warm bread can't be cut well.</main><aside><h3>More recipes</h3><ul><li><a href=/1>Rye bread</a><li><a href=/2>Rolls</a></ul></aside>
<footer>&copy; The Baker, all rights reserved. <a href=/imprint>Imprint</a></footer>""",
        "How to bake a plain loaf Mix the flour with water, salt and yeast, and leave it for an hour. Heat the oven until it is very hot. Put the loaf in, and wait for forty minutes. Let it cool on a rack, since warm bread can't be cut well.",
    ),
    (
        """<html><body><div id="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept</button></div>
<div class="wrapper"><div class="sidebar"><h4>Archive</h4><ul><li><a href=/a>March</a></li><li><a href=/b>April</a></li></ul></div>
<div class="post-content"><h2>Notes on a small garden</h2><p>Beans need little care, but they want sun &amp; water.</p><blockquote><p>Plant in May, pick in August.</p></blockquote>
<p>In autumn, dig the beds over. See <a href="/beds">the page on beds</a> for more of it.</p></div></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>Mine never grew, sadly.</p></div><div class="comment"><b>Bo</b><p>Try again next year, it was too dry.</p></div></div></body></html>""",
        "Notes on a small garden Beans need little care, but they want sun & water. Plant in May, pick in August. In autumn, dig the beds over. See the page on beds for more of it.",
    ),
]


def test_pages_written_by_hand():
    for page, text in PAGES:
        assert H.trained_model().main_text(page) == text


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract_main_text(pages).collect()}
    exact = 0
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        expected = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
        exact += got[r.page_id].text == expected
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert exact >= 248


def test_comments_and_menus_go_without_semantic_tags():
    page = "<div class=menu><a href=/>Home</a></div><div id=content><h1>A title here</h1><p>First sentence of the text, with words. And more of it.</p><p>Second one follows, as it should.</p></div><div id=comments><div class=comment><p>Nice text, thanks a lot for it.</p></div></div><div class=footer>Copyright 2020</div>"
    assert H.trained_model().main_text(page) == "A title here First sentence of the text, with words. And more of it. Second one follows, as it should."


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, N_CHARS int"
    rows = [(1, None, None, "t", 1), (2, "u", "", "t", 1), (None, "u", "<article><p>Some text here.</p></article>", "t", 1), (3, "u", "<article><p>" + "long words here, and more. " * 50_000 + "</p></article>", "t", 1), (4, "u", "<p>a", "t", 1), (4, "u", "<p>a", "t", 1)]
    got = H.extract_main_text(spark.createDataFrame(rows, schema).repartition(2)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == by[2].text == "" and by[None].text == "Some text here." and by[3].n_chars == len("long words here, and more. ") * 50_000 - 1
    assert H.extract_main_text(spark.createDataFrame([], schema)).isEmpty()
