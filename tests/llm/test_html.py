"""Main texts of pages: held-out pages, other templates, broken markup, exact decoding."""

from __future__ import annotations

import html
import itertools
import re
import time
import tracemalloc

import pytest

from fieldbeat.llm import html as pages
from fieldbeat.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crf(spark):
    return pages.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def article(page):
    """The blocks of the test pages' article element."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    found = [re.sub("<[^>]*>", "", b) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(t for b in found if (t := " ".join(html.unescape(b).split())))


def test_query(spark):
    rows = queries.op6_html(spark, SF_DIR).collect()
    given = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        assert (r["url"], r["text"]) == (given[r["page_id"]]["url"], article(given[r["page_id"]]["html"]))
        assert r["n_chars"] == len(r["text"])


def test_held_out_pages(spark, crf):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").limit(600).collect()
    assert all(pages.main_text(r["html"], crf) == article(r["html"]) for r in rows)


LONG = "A long sentence of the article, with commas, and more words than a menu has; it goes on."


def test_other_parts_of_an_article(crf):
    page = f"""<html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header><p>{LONG}</p></header>
    <main><h2>Head &amp; line</h2><p>{LONG}<script>x = "<p>no</p>"</script><ul><li>{LONG}<li>{LONG}</ul>
    <div class="comments"><p>{LONG}</p></div><aside><p>{LONG}</p></aside><form><p>{LONG}</p><button>Go</button></form>
    <blockquote>one<br>two &lt;b&gt; &#233;</blockquote></main><div id="cookie-notice">{LONG}</div><footer>{LONG}</footer>"""
    got = pages.main_text(page, crf).split("\n")
    assert got == ["Head & line", LONG, LONG, LONG, "one two <b> é"]


@pytest.mark.parametrize("start", [
    '<main class="content no-sidebar">', '<article class="post tag-related">', '<article id="legal-news">',
    '<article class="sponsored">', '<article><div class="legal-news">', '<article><div class="commented has-comments">',
    '<article><section id="share-of-voice">', '<body class="nav"><article role="main">'])
def test_names_do_not_lose_articles(crf, start):
    page = f"<nav><a href=x>Home</a></nav>{start}<h1>Headline</h1><p>{LONG}</p><p>{LONG}</p></div></article></main><footer>(c) x</footer>"
    assert pages.main_text(page, crf).split("\n")[-3:] == ["Headline", LONG, LONG]


@pytest.mark.parametrize("names", [
    "class=comments", 'class="user-discussion"', "id=comments-list", 'class="x ad-slot-2"', "class=adsbox",
    "role=complementary", 'class="reader-comments"', "class=cookie_notice", "class=newsletter-form"])
def test_names_that_are_not_the_article(crf, names):
    page = f"<article><h1>Headline</h1><p>{LONG}</p><p>{LONG}</p><section {names}><p>{LONG}</p><p>{LONG}</p></section></article>"
    assert pages.main_text(page, crf) == f"Headline\n{LONG}\n{LONG}"


@pytest.mark.parametrize("part", [
    "<span>text <h2>word</h2>", "<div><p>text", "<b><i>x", "<ul><li>one", "<a href=x>link <h3>w</h3>", "</p></div>x"])
def test_very_long_pages_without_ends(crf, part):
    page = "<article>" + part * (2_000_000 // len(part))
    tracemalloc.start()
    started = time.process_time()
    found = pages.blocks(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and len(pages.features(found[-1], 1.0)) < 20
    assert time.process_time() - started < 60 and peak < 300 << 20  # traced, which slows it tenfold


def test_pages_without_landmarks(crf):
    page = f"<body><div>Home</div><h1>The headline of it</h1><p>{LONG}<p>{LONG}</p><div class=ad>Buy now.</div><footer>(c)</footer>"
    assert pages.main_text(page, crf).split("\n")[-2:] == [LONG, LONG]


@pytest.mark.parametrize("tag", sorted(pages.HIDDEN - {"head", "script", "style", "iframe"}))
def test_hidden_text_at_any_depth(tag):
    """Whatever is open inside a hidden element; what follows its end is seen again."""
    inner = "<g>" * 6 + "<text>no</text>" + "</g>" * 6 if tag == "svg" else "<div><div><ul><li><p>no <b>no</b></ul></div></div>"
    page = f"<article><p>{LONG}</p><{tag}>{inner}</{tag}><p>Seen.</p><div><{tag}>{inner}</div><p>Again.</p></article>"
    assert [b.text for b in pages.blocks(page)] == [LONG, "Seen.", "Again."]
    assert [b.text for b in pages.blocks(f"<p>One <{tag}>{inner}</{tag}> two.</p>")][0] == "One two."


def test_viterbi_finds_the_best_sequence():
    crf = pages.Crf({"a": 1.5, "b": -0.7, "c": 0.2}, [0.3, -0.9, -0.4, 0.6])
    for n in range(1, 7):
        for kinds in itertools.product("abc", repeat=n):
            scores = [crf.states[k] for k in kinds]

            def value(labels, scores=scores):
                moves = sum(crf.moves[2 * a + b] for a, b in itertools.pairwise(labels))
                return moves + sum(s for s, y in zip(scores, labels, strict=True) if y)

            best = max(value(y) for y in itertools.product((0, 1), repeat=n))
            assert value(crf.decode([[k] for k in kinds])) == pytest.approx(best)


def test_odd_rows(make_df, crf):
    schema = "page_id long, html string, text int, n_chars string"
    many = "<article>" + "<p>" + f"</p><p>".join([LONG] * 3000) + "</article>"
    given = [None, "", "no markup", "<<<>>&&;", "<article><p>" + "x " * 30_000, many, "<p></p>", "</div></p>", "<!--", "<article>\0"]
    df = make_df(schema, [{"page_id": i, "html": h} for i, h in enumerate(given)] + [{"html": given[4]}] * 2)
    rows = pages.extract(df, crf).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(given) + 2 and got[0] == got[1] == got[6] == got[7] == ""
    assert got[4] == got[None] == " ".join(["x"] * 30_000)
    assert got[5].count("\n") == 2999
    assert pages.extract(df.limit(0), crf).collect() == []


def test_few_labelled_pages_among_many(make_df):
    """Pages without an article, and copies, take no place in the sample."""
    lines = "<nav><p>Home</p></nav>{}<footer><p>(c) {}</p></footer>"
    rows = [{"page_id": i, "html": lines.format(f"<!-- <article> --><p>{LONG}</p>", i)} for i in range(1500)]
    rows += [{"html": lines.format(f"<article><p>{LONG}</p></article>", "copy")}] * 900
    rows += [{"page_id": 5000 + i, "html": lines.format(f"<article><p>{LONG} {i}</p><p>{LONG}</p></article>", i)} for i in range(12)]
    seen = []
    real, pages.train = pages.train, lambda learned: seen.extend(learned) or real(learned)
    try:
        learned = pages.fit(make_df("page_id long, html string", rows))
    finally:
        pages.train = real
    assert len(seen) == 13
    assert pages.main_text(rows[-1]["html"], learned) == f"{LONG} 11\n{LONG}"


def test_nothing_to_learn_from(make_df):
    empty = pages.fit(make_df("page_id long, html string", [{"page_id": 1}, {"html": "<p>x"}]))
    assert pages.main_text(f"<article><p>{LONG}", empty) == ""
