import math
import time

import pytest

from pairwright.llm.html_text import extract, main_text, parse, weigh

from .common import prose, rng

LONG = "This is a sentence of the article that goes on for a while, so that it has some weight in the page. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style><script>var t = '</p><p>no';</script></head><body>{body}</body></html>"


def clean(text):
    return " ".join(text.split())


def test_article_without_what_surrounds_it():
    text = main_text(page(f"<nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- x --><div class='ad'>Buy now</div><article><h1>Title &amp; more</h1><p><b>First&nbsp;line<br><p>{LONG}</p><p>A &lt;b&gt; &#233;&eacute;\n  c</p></article><aside>Side</aside><form><input><button>Go</button></form><footer>&copy; foot</footer>"))
    assert text == f"Title & more\n\nFirst line\n\n{clean(LONG)}\n\nA <b> éé c"


def test_plain_divs():
    menu = "".join(f"<a href=/{k}>Item {k}</a> " for k in range(30))
    text = main_text(page(f"<div id=top>{menu}</div><div><div class=content><p>{LONG}</p><p>{LONG}</p><ul><li>One point</li><li>Another</li></ul></div></div><div class='comments-list'><p>{LONG}</p></div>"))
    assert text.startswith(clean(LONG)) and text.count("This is") == 6 and "Item 3" not in text and text.endswith("One point\n\nAnother")


def test_links_lower_density():
    links = "".join(f"<li><a href=/{k}>Some long enough linked heading number {k}</a></li>" for k in range(40))
    text = main_text(page(f"<div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>"))
    assert "linked heading" not in text and "This is" in text


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("<p", ""), ("plain words", "plain words"), ("<article><p>cut off &amp", "cut off &"), ("<p>a<p>b", "a\n\nb"), ("<br><br/>", ""), ("<p>a<td>b</p>", "a b")])
def test_odd_pages(html, want):
    assert main_text(html) == want


def test_cookie_notices_and_headers():
    text = main_text(page(f"<header><h2>Site</h2></header><div class='cookie-notice'>We use cookies</div><main><header><h1>Head</h1></header><p>{LONG}</p></main><div role='complementary'>More</div>"))
    assert text == f"Head\n\n{clean(LONG)}"


def test_hidden_parts():
    assert main_text(page(f"<article><p>{LONG}</p><p hidden>no</p><div style='display: none'>no</div><p class=hidden-note>yes</p></article>")) == f"{clean(LONG)}\n\nyes"


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='no-sidebar'", "div class='content with-sidebar'", "div class='ad-free'", "div class='page-header-layout'", "div id='page' class='site header'", "form role=search"])
def test_wrappers_whose_names_only_mention_a_part_beside(wrapper):
    tag = wrapper.split()[0]
    body = f"<{wrapper}><div class='sidebar'><p>Side</p></div><div><p>{LONG}</p><p>{LONG}</p></div></{tag}>"
    assert main_text(page(body)) == f"{clean(LONG)}\n\n{clean(LONG)}"
    assert main_text(page(f"<{wrapper}><div class='sidebar'>{LONG * 3}</div><article><p>{LONG}</p></article></{tag}>")) == clean(LONG)


def test_hidden_is_the_name_of_an_attribute():
    for mark in ("data-title='The hidden life of trees'", 'class="is hidden md:block"', "title='a display: none b'", "data-hidden=1"):
        assert main_text(page(f"<article {mark}><p>{LONG}</p></article>")) == clean(LONG), mark
    for mark in ("hidden", "HIDDEN=''", "id=a hidden", 'style="color:red; display:none"'):
        assert main_text(page(f"<article><p>{LONG}</p><div {mark}>no</div></article>")) == clean(LONG), mark


def test_parts_beside_stay_set_aside():
    teasers = "<article class='teaser'><p>Another story</p></article>" * 3
    assert main_text(page(f"<article><p>{LONG}</p></article><div class='related-list'>{teasers}</div><ul id=comments><li><article class='comment-body'><p>{LONG * 3}</p></article></ul>")) == clean(LONG)
    assert main_text(page(f"<article><p>Some <span class='share-buttons'>Share</span>more words</p><p>{LONG}</p></article>")) == f"Some more words\n\n{clean(LONG)}"


@pytest.mark.parametrize(
    "part", ["<nav><a href=/>Home</a>", "<aside>Beside", "<footer>Foot", "<form><input>", "<div class='sidebar'><div>Side</div>", "<div class='sidebar'><div>Side", "<select><option>A<option>B", "<svg><path d=x>", "<dialog>Ask<p>Why"]
)
def test_parts_beside_without_an_end(part):
    assert main_text(page(f"<div>{part}</div></div><article><p>{LONG}</p></article>")) == clean(LONG)
    assert clean(LONG) in main_text(page(f"{part}<article><p>{LONG}</p></article>"))
    assert clean(LONG) in main_text(page(f"{part}<div class=text><p>{LONG}</p><p>{LONG}</p></div>"))


def test_implied_ends_of_parts_beside():
    text = main_text(page(f"<article><ul><li class='share'>Share<li>One point<li>Two</ul><p hidden>no<p>{LONG}<p hidden>no<h2>Head</h2></article>"))
    assert text == f"One point\n\nTwo\n\n{clean(LONG)}\n\nHead"
    assert main_text(f"<html><head><meta charset=utf-8><body><p>{LONG}") == clean(LONG)


def test_very_long_pages_are_read_whole_and_quickly():
    began = time.time()
    text = main_text(page("<article>" + "<p>word &lt; other</p>" * 50_000 + "<p>last"))
    assert text.count("\n\n") == 50_000 and text.endswith("last") and time.time() - began < 20
    assert main_text("<div>" * 20_000 + "deep") == "deep"


def test_query_columns(spark):
    rows = [(1, "u", "<p>a b", "x"), (None, None, None, "y"), (1, "u", "<p>a b", "x")]
    got = sorted(map(tuple, extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3), (None, None, "", 0), (1, "u", "a b", 3)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_time_grows_with_the_page():
    for odd in ("<span>" * 20_000 + "x</b>" * 20_000, "<label>" * 20_000 + "<p>hello</p>", "<p><table><td>" + "<span>" * 20_000 + "<hr>" * 20_000, "<li>" * 20_000 + "</ul>" * 20_000):
        began = time.time()
        main_text(odd)
        assert time.time() - began < 5, odd[:20]


def test_text_beside_the_densest_node():
    inner = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    for wrap in ("article", "div", "section"):
        body = f"<div class=ad>Buy</div><{wrap}><h1>Head</h1>{inner}<p>Tail words outside the inner div</p></{wrap}><footer>Foot</footer>"
        assert main_text(page(body)) == f"Head\n\n{clean(LONG)}\n\n{clean(LONG)}\n\nTail words outside the inner div"
    assert main_text(page(f"<article><div class='article-header'><h1>Head</h1><p>Intro</p></div>{inner}</article>")).startswith("Head\n\nIntro\n\nThis is")
    assert main_text(page(f"<h1>Head</h1>{inner}<p><a href=/x>More of this kind</a></p>")) == f"Head\n\n{clean(LONG)}\n\n{clean(LONG)}"
    for name in ("related-work", "search-results-page"):
        assert clean(LONG) in main_text(page(f"<div class='{name}'><p>{LONG}</p><p>{LONG}</p></div>"))


def brute_core(node):
    """The first element of the largest density sum, straight from the definition; elements are (tag, text, children)."""

    def count(n):
        own = [count(x) for x in n[2]]
        return len("".join(n[1].split())) + sum(x[0] for x in own), sum(x[1] for x in own) if n[0] != "a" else len("".join(n[1].split())) + sum(x[0] for x in own), sum(1 + x[2] for x in own), sum((y[0] == "a") + x[3] for x, y in zip(own, n[2], strict=True))

    whole = count(node)

    def density(n):
        c, lc, t, lt = count(n)
        if not c:
            return 0.0
        t = max(t, 1)
        base = math.log(c / max(c - lc, 1) * lc + whole[1] / max(whole[0], 1) * c + math.e)
        return c / t * math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(base + math.e - 1)

    def every(n):
        yield n
        for x in n[2]:
            yield from every(x)

    return max(every(node), key=lambda n: sum(density(x) for x in n[2])), density


def test_core_against_the_definition():
    r = rng(41)

    def tree(depth):
        tag = r.choice(["div", "div", "section", "span", "a"])
        return (tag, prose(r, r.randrange(0, 30)), [tree(depth - 1) for _ in range(r.randrange(0, 4))] if depth and tag != "a" else [])

    def written(n):
        return f"<{n[0]}>{n[1]}" + "".join(map(written, n[2])) + f"</{n[0]}>"

    def order(n):  # as the parser keeps its nodes: level by level
        level = [n]
        while level:
            yield from level
            level = [x for y in level for x in y[2]]

    for _ in range(200):
        top = ("html", "", [tree(4) for _ in range(r.randrange(1, 4))])
        root, _ = parse("".join(map(written, top[2])))
        nodes = weigh(root)
        core, density = brute_core(top)
        for n, x in zip(nodes, order(top), strict=True):
            assert n.tag == x[0] and n.density == pytest.approx(density(x))
        assert root.best.total == pytest.approx(sum(density(x) for x in core[2]))


def test_short_sections_of_a_document_stay():
    page = f"<body><div><section><h2>One</h2>{'<p>' + 'long text ' * 40 + '</p>'}</section><section><h2>Two</h2><p>Short second section.</p></section></div></body>"
    assert main_text(page).endswith("Two\n\nShort second section.")
    menu = "<section>" + "<a href='#'>link</a> " * 20 + "</section>"
    assert "link" not in main_text(page.replace("<section><h2>One", menu + "<section><h2>One"))


@pytest.mark.parametrize("name,stays", [("price-alert", True), ("application-form", True), ("site-notice", True), ("alert", False), ("cookie-notice", False), ("comments", False), ("user-comments", False), ("newsletter-form", False)])
def test_names_within_an_article(name, stays):
    page = f"<article><p>{'some long text ' * 30}</p><div class='{name}'><p>Named part.</p></div><p>{'more long text ' * 30}</p></article>"
    assert ("Named part." in main_text(page)) == stays
    assert "Named part." not in main_text(f"<div><p>{'some long text ' * 30}</p></div><div class='{name}'><p>Named part.</p></div>")


def test_references_do_not_reach_over_tags():
    pad = "x" * 80
    assert main_text(f"<p>AT&am<b>p;</b>T {pad}</p>") == f"AT&amp;T {pad}"
    assert main_text(f"<p>a &amp; b &lt;i&gt; {pad}</p>") == f"a & b <i> {pad}"


@pytest.mark.parametrize("tag", ["svg", "math", "title"])
def test_elements_that_never_end_take_linear_time(tag):
    import time

    began = time.perf_counter()
    main_text(f"<p>{'text ' * 20}</p>" + f"<{tag}>" * 80_000)
    assert time.perf_counter() - began < 2
