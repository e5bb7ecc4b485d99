"""Extraction of pages that are made here, so that their articles are known."""

import html
import random
import time

import pytest

from tidelog.llm.html_extract import main_text

WORDS = "river stone light quiet market, window paper garden, number winter morning & letter, <b>bold</b> road <i>early</i> story engine".split()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>Head</h1><p title=don't>First...</p><p>Second para, it's fine.</p></article>", "Head First... Second para, it's fine."),
        ("<article><p title=don't>Only one, with a mark.</p></article>", "Only one, with a mark."),
        ("<article><p title='a > b' data-x=\"<p>\">Signs in quotes.</p></article>", "Signs in quotes."),
        ("<script src=https://cdn.example/js/>var leaked = 1;</script><article><p>Text, here.</p></article>", "Text, here."),
        ("<article><p>Text, here.</p><script src='x.js'/>var leaked = 1;</script></article>", "Text, here."),
        ("<article><p>One <svg viewBox='0'><title>icon</title></svg>two <svg/>three, four.</p></article>", "One two three, four."),
        ("<article><p>a < b, and c.</p></article>", "a < b, and c."),
        ("<article><p>Text, here.</p><!--> <p>More, of it.</p><!-- gone", "Text, here. More, of it."),
        ("<div class='post social-studies'><h1>Title</h1><p>Long text, with commas, of it.</p></div>", "Title Long text, with commas, of it."),
        ("<div class='responses-to-war'><h1>Title</h1><p>Long text, with commas, of it.</p></div>", "Title Long text, with commas, of it."),
        ("<article><h2 id='privacy'>Privacy</h2><p>One, here.</p><section id='privacy-law'><p>Law, text.</p></section><p id='search-algorithms'>Sorts, all.</p><p>An <span class='related'>inline</span> piece.</p></article>", "Privacy One, here. Law, text. Sorts, all. An inline piece."),
        ("<article><h1>T</h1><section><div><p>One, two, three, four.</p></div></section><section><div><p>Five, six.</p></div></section></article>", "T One, two, three, four. Five, six."),
        ("<div>before it <div><p>One, two, three, four.</p><p>more text, of it, here</p></div> after</div><div id=comments><p>I like it, a lot, really, and more, and, more</p></div>", "before it One, two, three, four. more text, of it, here after"),
        ("<article><p>One, two.</p><div class='share-buttons'>Share</div><div class='related-posts'><p>Other, things, to read.</p></div><div class='newsletter signup-box'>Mail</div><p class='ad'>Buy, now.</p></article>", "One, two."),
        ("<div class='site-header'><h1>Site</h1></div><div id='content'><p>One, two, three, four and five.</p></div><div class='cookie-notice'>We use, some, cookies, here.</div>", "One, two, three, four and five."),
        ("<article><p>One, two.</p><ol class='comment-list'><li>I, think, so, too, really.</ol></article>", "One, two."),
    ],
)
def test_page(page, text):
    assert main_text(f"<html><body>{page}</body></html>") == text


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</p>" * 20_000, "<p " * 20_000, "<svg>" * 20_000 + "a", "<center>" * 20_000 + "<p>a</center>" * 20_000, "<!--" * 20_000, '<a ="' * 20_000, "<li><ul>" * 20_000])
def test_hostile_pages_take_time_in_proportion(page):
    begun = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - begun < 5


def paragraph(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(12, 60))) + "."


def plain(markup):
    for tag in ("b", "i"):
        markup = markup.replace(f"<{tag}>", "").replace(f"</{tag}>", "")
    return html.unescape(" ".join(markup.split()))


def article(rng):
    """Markup and blocks: headed paragraphs in an article, in a div, or in sections that have wrappers of their own."""
    title, blocks, body = f"Title {rng.randint(0, 99)}", [], []
    for _ in range(rng.randint(2, 4)):
        own = [paragraph(rng) for _ in range(rng.randint(2, 5))]
        body.append(rng.choice(["{}", "{}"]).format("".join(f"<p>{x}</p>" if rng.random() < 0.8 else f"<p>{x}" for x in own)))
        blocks += own
    shape = rng.randrange(3)
    if shape == 0:
        markup = f"<article><h1>{title}</h1>{''.join(body)}<div class='share-buttons'>Share this</div></article>"
    elif shape == 1:
        markup = f"<div class='main-content'><h1>{title}</h1>{''.join(body)}</div>"
    else:
        markup = f"<article><h1>{title}</h1>{''.join(f'<section><div class=text>{x}</div></section>' for x in body)}</article>"
    return markup, " ".join([title, *map(plain, blocks)])


OTHERS = [
    "<nav><ul><li><a href=/a>Home, start</a><li><a href=/b>News</a></ul></nav>", "<header><h2>Site name</h2></header>", "<div class='ad-slot-1'>Buy, buy, buy this now, it is cheap, and good.</div>",
    "<aside><p>Popular things, many of them, elsewhere.</p></aside>", "<form><p>Your name, your mail</p><input></form>", "<div id=comments><article class=comment><p>I like it, a lot, really, thanks, and so on.</p></article></div>",
    "<footer>&copy; someone, somewhere</footer>", "<style>p { margin: 0 }</style>", "<script>if (a < b) document.write('<p>x</p>')</script>", "<div class='cookie-banner'>We use cookies, as all do.</div>", "<!-- <p>no</p> -->",
]


@pytest.mark.parametrize("seed", range(60))
def test_round_trip(seed):
    rng = random.Random(seed)
    markup, text = article(rng)
    before, after = ("".join(rng.sample(OTHERS, rng.randint(0, 5))) for _ in range(2))
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{markup}{after}</body></html>") == text
