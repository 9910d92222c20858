"""Main text: cases of names, a slow reference of the density, and odd tables."""

import math
import random
from html.parser import HTMLParser

import pytest

from terrafold.llm import html_text
from terrafold.llm.common import stage

ARTICLE = "<h1>T</h1><p>" + "one two three. " * 40 + "</p><p>" + "four five six. " * 30 + "</p>"
TEXT = "\n".join(["T", ("one two three. " * 40).strip(), ("four five six. " * 30).strip()])


@pytest.mark.parametrize("name", "no-sidebar|has-sidebar|layout-sidebar-right|share-price|widget|login-required|post related-topics|menu-open|ad-free|comments-open".split("|"))
def test_wrappers_keep_their_article(name):
    assert html_text.main_text(f"<body><nav><a href=x>Home</a></nav><div class='{name}'>{ARTICLE}</div><footer>f</footer></body>") == TEXT
    assert html_text.main_text(f"<body><div class='{name}'><main><article>{ARTICLE}</article></main><aside>side</aside></div></body>") == TEXT
    assert html_text.main_text(f"<body><form id=aspnet><div class='{name}'>{ARTICLE}</div><input><label>x</label></form></body>") == TEXT


def test_boilerplate_goes():
    parts = [
        "<div class='sidebar'><p>Words about the author of this site</p></div>", "<div id='main-menu'><ul><li>One</li><li>Two</li></ul></div>", "<div class='ad-slot'>Buy this now</div>",
        "<div role='complementary'>Elsewhere in the news</div>", "<form><p>Sign up for letters</p></form>", "<div class='cookie-notice'>We use them</div>",
        "<div id=comments>" + "<div class=comment><p>I think this is quite a great article and so on</p></div>" * 60 + "</div>",
    ]
    for part in [*parts, "".join(parts)]:
        assert html_text.main_text(f"<body><div class=content>{ARTICLE}</div>{part}</body>") == TEXT
        assert html_text.main_text(f"<body>{part}<main><article>{ARTICLE}</article></main></body>") == TEXT
    links = "<div><a href=a>Related one thing</a> <a href=b>Other thing of note</a></div>"
    assert html_text.main_text(f"<body><main><article>{ARTICLE}</article>{links}</main></body>") == TEXT
    assert html_text.main_text(f"<body><main>{ARTICLE}{links}</main></body>") == TEXT
    cards = "".join(f"<article><h3>Card {i}</h3><p>A short teaser of some other text</p></article>" for i in range(5))
    assert html_text.main_text(f"<body><main><article>{ARTICLE}</article><section>{cards}</section></main></body>") == TEXT


class Tree(HTMLParser):
    """Explicit tree of a well-formed page."""

    def __init__(self, source):
        super().__init__()
        self.root = {"tag": "#root", "kids": [], "texts": []}
        self.stack = [self.root]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "kids": [], "texts": []}
        self.stack[-1]["kids"].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1]["texts"].append(data)


def slow_densities(source):
    """(tag, density, sum of the children's densities) of each node in document order, each from its whole subtree."""
    root, out = Tree(source).root, []

    def subtree(node, linked=False):
        linked = linked or node["tag"] == "a"
        own = sum(len(t.strip()) for t in node["texts"])
        total = [own, own * linked, 1, int(linked)]
        for kid in node["kids"]:
            total = [a + b for a, b in zip(total, subtree(kid, linked))]
        return total

    all_chars, all_links, _, _ = subtree(root)

    def density(node, linked):
        c, lc, t, lt = subtree(node, linked)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + all_links / all_chars * c + math.e)
        much = c / max(lc, 1) * (t / max(lt, 1))
        return max(0.0, c / t * math.log(much) / math.log(base)) if base > 1 else c / t * max(0.0, math.log(max(much, 1.0)))

    def walk(node, linked):
        inside = linked or node["tag"] == "a"
        out.append((node["tag"], density(node, linked), sum(density(k, inside) for k in node["kids"])))
        for kid in node["kids"]:
            walk(kid, inside)

    walk(root, False)
    return out


def test_density_brute_force():
    draw = random.Random(5)

    def page(depth):
        words = " ".join("abcdefgh"[: draw.randrange(1, 8)] for _ in range(draw.randrange(0, 30)))
        if depth == 0:
            return f"<p>{words}</p>" if draw.random() < 0.7 else f"<p><a>{words}</a></p>"
        return "<div>" + "".join(page(draw.randrange(depth)) for _ in range(draw.randrange(1, 5))) + "</div>"

    for _ in range(60):
        source = f"<html><body>{page(4)}</body></html>"
        got, want = html_text.Page(source), slow_densities(source)
        density, sums = got.densities()
        assert got.tag == [t for t, _, _ in want]
        assert density == pytest.approx([d for _, d, _ in want]) and sums == pytest.approx([s for _, _, s in want])


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, off int"
    rows = [(1, "u", None, "x", "y", 3), (2, None, "", "x", "y", 3), (None, "u", ARTICLE, "x", "y", 3), (3, "u", ARTICLE, None, None, None), (3, "u", ARTICLE, None, None, None), (4, "u", "<p>" + "word " * 200_000, "x", "y", 3), (5, "u", "<" * 50 + "&#x41;&nbsp;&bogus;", "x", "y", 3)]
    df = stage(spark.createDataFrame(rows, schema), "pages")
    got = html_text.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got if r.page_id != 5) == sorted([(1, 0), (2, 0), (0, len(TEXT)), (3, len(TEXT)), (3, len(TEXT)), (4, 999_999)])
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    assert html_text.extract_pages(df.limit(0)).count() == 0
