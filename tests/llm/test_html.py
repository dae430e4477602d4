"""The minimum cut against enumerated labellings, its effect on pages of several layouts, and hostile pages."""

import itertools
import random
import time

import pytest

from pixelgrove.llm import html_mincut as H


def cost(labels, costs, edges):
    own = sum(max(e, 0) if not x else max(-e, 0) for x, e in zip(labels, costs))
    return own + sum(c for i, j, c in edges if labels[i] != labels[j])


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def layout(rng, kind, advert_sentences=4):
    """A page and the texts of its article."""
    title = sentence(rng, 5)[:-1]
    body = [" ".join(sentence(rng, rng.randrange(5, 12)) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 8))]
    body.insert(rng.randrange(1, len(body)), "Er")  # a very short paragraph
    menu = "".join(f"<li><a href=/{i}>{sentence(rng, 2)[:-1]}</a></li>" for i in range(6))
    advert = " ".join(sentence(rng, 10) for _ in range(advert_sentences))
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    comment = f"<article class=comment><p>{advert}</p></article>"
    page = {
        "semantic": f"<nav><ul>{menu}</ul></nav><article><h1>{title}</h1>{paragraphs}<aside><p>{advert}</p></aside></article><footer><p>{advert}</p></footer>",
        "words": f'<div class="top-nav"><ul>{menu}</ul></div><div id="main-content"><h1>{title}</h1>{paragraphs}<div class="ad-box"><div>{advert}</div></div></div><div id="comments">{comment}</div>',
        "plain": f"<div><ul>{menu}</ul></div><div><h1>{title}</h1>{paragraphs}</div><div><ul>{menu}</ul></div>",
        "related": f'<main><h1>{title}</h1>{paragraphs}<section class="related-work"><p>{body[0]}</p></section><ul class="related-posts">{menu}</ul></main>',
    }[kind]
    more = [body[0]] if kind == "related" else []
    return f"<html><body>{page}</body></html>", [title, *body, *more]


KINDS = ("semantic", "words", "plain", "related")


def texts(page, edges=True):
    blocks = H.blocks_of(page)
    costs, joined = H.graph(blocks)
    keep = H.minimum_cut(costs, joined if edges else [])
    return [b.text for b, x in zip(blocks, keep) if x], keep[: len(blocks)]


def test_whole_small_pages_against_every_labelling():
    rng = random.Random(4)
    for trial in range(30):
        inner = "".join(rng.choice(["<p>%s</p>", "<li><a>%s</a></li>", "<div class=post-share>%s</div>", "<div>%s<div>", "</div>"]).replace("%s", sentence(rng, rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5)))
        page = rng.choice(["<div>%s</div>", '<div class="story">%s</div>', "%s", "<article>%s</article>"]).replace("%s", inner)
        blocks = H.blocks_of(page)
        costs, edges = H.graph(blocks)
        if len(costs) > 14:
            continue
        costs = [max(-20.0, min(20.0, e)) for e in costs]
        best = min(cost(x, costs, edges) for x in itertools.product((False, True), repeat=len(costs)))
        assert abs(cost(H.minimum_cut(costs, edges), costs, edges) - best) < 0.02


def test_random_graphs_against_every_labelling():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 9)
        costs = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(i, j, round(rng.uniform(0, 2), 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        best = min(cost(x, costs, edges) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(H.minimum_cut(costs, edges), costs, edges) - best) < 1e-6


def test_the_cut_decides():
    rng = random.Random(9)
    changed = total = wrong = wrong_alone = 0
    for trial in range(80):
        page, want = layout(rng, KINDS[trial % 4])
        got, keep = texts(page)
        alone, keep_alone = texts(page, edges=False)
        total += len(keep)
        changed += sum(a != b for a, b in zip(keep, keep_alone))
        wrong += got != want
        wrong_alone += alone != want
    assert wrong == 0
    assert wrong_alone >= 30  # of 80 pages
    assert changed > total / 20


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><section class="related-work"><p>The methods were published before. They differ.</p></section></article>', "The methods were published before. They differ."),
        ('<article id="post-share"><p class="reply-quote">He said that it was fine. Nobody believed it.</p></article>', "He said that it was fine. Nobody believed it."),
        ('<div class="story"><div class="story-form"><p>He said that it was fine. Nobody believed it.</p></div></div>', "He said that it was fine. Nobody believed it."),
        ("<article><p title=don't>It's a long day today. We go home now.</p></article>", "It's a long day today. We go home now."),
        ('<article><p title="a > b">x &amp; y</p></article>', "x & y"),
        ('<body class="has-sidebar"><div class="content with-sidebar"><div class="entry-header"><h1>Hello</h1></div><p>Text one.</p></div><div id="sidebar">Long text here. With marks. More.</div></body>', "Hello Text one."),
        ('<header><p>Some site, and what it says of itself.</p></header><main class="sidebar-left"><h1>T</h1><p>short</p><form>name</form></main>', "T short"),
        ("<div hidden><p>Some hidden text is in here. Nobody sees it.</p></div>", ""),
        ("<p>&lt;b&gt; unclosed <i>words and <b>more. Sentence two is here.", "<b> unclosed words and more. Sentence two is here."),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


HOSTILE = {
    "stray ends": "<div>" * 100_000 + "</p>" * 100_000,
    "unclosed raw elements": "<button>" * 125_000,
    "doubtful blocks": "<div>aa bb cc dd ee ff. <a>xx yy zz</a></div>" * 4000,
    "quotes": '<a b="' * 160_000,
    "brackets": "<" * 1_000_000,
    "comments": "<!--" * 250_000,
    "deep": "<article>" * 50_000 + "x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages(name):
    begin = time.process_time()
    H.main_text(HOSTILE[name])
    assert time.process_time() - begin < 4  # 2 s on an idle machine


def test_fitted_weights(spark):
    rng = random.Random(2)
    rows = [(i, layout(rng, KINDS[i % 4], 1)[0]) for i in range(120)] + [(200, None), (201, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    weights = H.fit(pages)
    assert weights == pytest.approx(H.fit(pages.repartition(7)), abs=1e-9)
    assert weights != H.PRIOR and len(weights) == len(H.PRIOR)
    rng = random.Random(77)
    for trial in range(40):  # a held set
        page, want = layout(rng, KINDS[trial % 4])
        assert H.main_text(page, weights) == " ".join(want)
    assert H.fit(pages.where("page_id = 201")) == H.PRIOR


_START = "<h1>Title of it</h1><p>First paragraph of the article, with some words in it. And a second sentence here.</p>"
_END = "<p>The last paragraph of the article is here, with some more words.</p>"


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "fb-comments", "discussion", "comments-area", "gdpr-cookie-law-info", "site-cookie-consent", "newsletter-box-2"])
def test_readers_and_notices_whatever_words_stand_beside(name):
    other = "I think this article is wrong. Nobody asked me about it."
    for page in (f'<article>{_START}{_END}<div class="{name}"><p>{other}</p></div></article>', f'<main>{_START}{_END}</main><div class="{name}"><div><p>{other}</p></div></div>'):
        text = H.main_text(f"<html><body>{page}</body></html>")
        assert other not in text and text.endswith("some more words.")


@pytest.mark.parametrize("part", ['<h2 id="form">Form of it</h2>', '<section id="search"><p>Search is a topic of this text, with words.</p></section>', '<p id="form">The form of things is told here in a sentence.</p>', '<p class="related">Related matters are told here in a sentence.</p>', '<section id="legal"><h2>Legal</h2><p>What the law says of it is told here.</p></section>'])
def test_subjects_are_no_purposes(part):
    text = H.main_text(f"<html><body><nav><a href=/>Home</a></nav><article>{_START}{part}{_END}</article></body></html>")
    assert all(x in text for x in part.replace(">", "<").split("<") if " " in x and "=" not in x) and "Home" not in text


def test_class_names_that_say_nothing():
    """Names are random strings: the text alone, its links and its neighbours decide."""
    rng = random.Random(6)
    name = lambda: "x" + "".join(rng.choice("bcdfghjkz") for _ in range(8))
    for _ in range(20):
        menu = "".join(f'<li class="{name()}"><a href="/{k}">{sentence(rng, 2)[:-1]}</a></li>' for k in range(6))
        body = [" ".join(sentence(rng, rng.randrange(6, 12)) for _ in range(3)) for _ in range(6)]
        page = f'<body><div class="{name()}"><ul>{menu}</ul></div><div class="{name()}" id="{name()}">' + "".join(f'<p class="{name()}">{x}</p>' for x in body) + f'</div><div class="{name()}"><ul>{menu}</ul></div></body>'
        assert H.main_text(page) == " ".join(body)
