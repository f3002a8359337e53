"""HTML extraction on generated pages whose article is known, and on odd markup."""

import html
import random
import re
import time

import pytest

from strandloom.llm.html_extract import main_text

WORDS = "river stone & <light> über naïve paper garden quiet 12 road don't".split()


def words(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def article(rnd, parts):
    """Markup and, beside it, its text by a plain rule."""
    out, text = [f"<h1>{html.escape(words(rnd, 4))}</h1>"], []
    for _ in range(parts):
        kind, body = rnd.randrange(6), html.escape(words(rnd, rnd.randrange(20, 90)), quote=False)
        out.append(
            [f"<p>{body}</p>", f"<p>{body}", f"<div><p>{body}<br>{body}</p></div>", f"<ul><li>{body}<li>{body}</ul>", f"<section><h2>Part</h2><p>{body} <b>{body}</b></p></section>", f"<blockquote>{body}</blockquote>"][kind]
        )
    markup = "".join(out)
    text = html.unescape(re.sub(r"<[a-z/][^<>]*>", " ", markup))
    return markup, " ".join(text.split())


FURNITURE = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>',
    '<div class="ad">{short}</div>',
    '<div class="cookie-notice" id="x1">{short}</div>',
    '<div class="siteHeader"><p>{short}</p></div>',
    '<ul class="related-posts"><li><a href="/c">{short}</a></li></ul>',
    "<aside><p>{long}</p></aside>",
    '<div class="sidebar"><p>{long}</p></div>',
    "<form><label>Mail</label><input></form>",
    '<script>if (a < b) { x = "<!-- <p>no</p>"; }</script><style>p > a {{ }}</style>',
    "<!-- {long} -->",
    '<div role="search">{short}</div>',
    '<div hidden>{long}</div><p style="display: none">{long}</p>',
)
AFTER = ('<section id="comments"><h2>Comments</h2><p>{long}</p></section>', '<div class="comment-list"><article><p>{long}</p></article></div>', "<footer>{long}</footer>")


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    rnd = random.Random(seed)
    markup, want = article(rnd, rnd.randrange(4, 12))
    fill = lambda parts: "".join(p.replace("{short}", "Some words").replace("{long}", words(rnd, 30).replace("<", "").replace("&", "")).replace("{{ }}", "{ }") for p in parts)
    holder = rnd.choice(["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<div class="has-sidebar"><article>%s</article></div>'])
    before, after = rnd.sample(FURNITURE, 5), rnd.sample(FURNITURE, 3) + rnd.sample(AFTER, 2)
    assert main_text("<html><head><title>T</title></head><body>" + fill(before) + holder % markup + fill(after) + "</body></html>") == want


@pytest.mark.parametrize("names", ['class="layout has-sidebar"', 'id="with-sidebar"', 'class="content widget"', 'class="post share-enabled"', 'id="related-work"', 'class="comments-open post"', 'class="no-header"'])
@pytest.mark.parametrize("shape", ["<div %s>{}</div>", "<div %s><article>{}</article></div>", "<article><div %s>{}</div></article>", "<span %s>{}</span>"])
def test_wrappers_are_no_furniture(names, shape):
    markup, want = article(random.Random(1), 6)
    page = '<body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>' + (shape % names).format(markup) + '<div class="sidebar"><p>Other stories</p></div><footer>End</footer></body>'
    assert main_text(page) == want


def test_comments_in_scripts_and_open_ends():
    for start in ('<script>var a="<!--";</script>', "<style>/* <!-- */</style>", "<!-- a > b -->"):
        assert main_text(start + "<article><p>Hello there, friend.</p></article>") == "Hello there, friend."
    assert main_text("<p>Before.</p><!-- open <p>after</p>") == "Before."
    assert main_text("<p>Before.</p><script>open <p>after</p>") == "Before."
    assert main_text('<p>Before.</p><a href="cut') == "Before."
    assert main_text("<p>1 < 2 & 3 &lt 4") == "1 < 2 & 3 < 4"


def test_boxes_of_links_go_and_short_lines_stay():
    markup, want = article(random.Random(2), 8)
    teaser = '<div class="%s"><p><a href="1">Read more</a></p><p><a href="2">Something else</a></p></div>'
    for name in ("rail", "x"):
        assert main_text("<article>" + markup + teaser % name + "<p>End.</p></article>") == want + " End."
    assert main_text('<article><div class="entry-header"><h2>Title</h2></div>' + markup + "</article>") == "Title " + want


def test_names_do_not_empty_a_page():
    assert main_text('<div class="comments"><p>All the text there is on this page.</p></div>') == "All the text there is on this page."
    assert main_text("<article><p>Short one.</p></article><div id=comments><p>" + "long comment " * 300 + "</p></div>") == "Short one."


def test_long_and_unbalanced_pages_take_linear_time():
    def seconds(page):
        began = time.perf_counter()
        main_text(page)
        return time.perf_counter() - began

    for unit in (("<div>", "</b></p></span>x"), ("<b>", "<p>x"), ("<p class=a>word ", "</div>"), ("<li>x<table><td>", "y")):
        small, large = (min(seconds(unit[0] * n + unit[1] * n) for _ in range(2)) for n in (2000, 16000))
        assert large < 30 * small + 0.5
    body = words(random.Random(3), 200_000).replace("<light>", "light").replace("&", "and")
    assert main_text(f"<nav>n</nav><article><p>{body}</p></article>") == body
