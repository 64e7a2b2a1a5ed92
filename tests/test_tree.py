"""Flat page trees: any depth, implied end tags, selectors against a plain reading of the ancestors."""

import random
import time

from eventloom.sources import tree
from eventloom.sources.dom import configured, description, list_rows, suggest
from eventloom.sources.html import declared


def test_depth():
    for piece, tag, n in (("<li>x", "li", 100_000), ("<p>x", "p", 100_000), ("<tr><td>x", "td", 50_000), ("<div>x", "div", 100_000), ("<span>x", "span", 100_000)):
        start = time.time()
        root = tree.parse("<body>" + piece * n)
        assert len(tree.select(root, f"body {tag}")) == n
        assert root.text() == "x" * n
        assert sum(1 for _ in root.strings(tree.hidden)) == n
        assert description(root) is None or tag == "p"
        assert list_rows(root, "http://a.de/") == [] == declared(root)
        assert suggest(root, "y") is None and configured(root, {"title": ([".none"], "text")}) == {}
        assert time.time() - start < 60


def test_implied_ends():
    root = tree.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<div>f</div><table><tr><td>g<td>h<tr><td>i</table><dl><dt>j<dd>k<dt>l</dl>")
    parents = {n.text(): n.parent.tag for n in root.walk() if n.tag in ("li", "p", "td", "dd", "dt", "div")}
    assert parents == {"abc": "ul", "b": "ul", "c": "ul", "d": "ul", "e": "", "f": "", "g": "tr", "h": "tr", "i": "tr", "j": "dl", "k": "dl", "l": "dl"}


def plain_fits(node, css):
    """Whether an element, its ancestors taken one by one, fits a selector of blanks."""
    *above, own = css.split()
    if not tree.fits(node.tag, node.attrs, tree._PART.findall(own)):
        return False
    at = node.parent
    for part in reversed(above):
        while at is not None and at.tag and not tree.fits(at.tag, at.attrs, tree._PART.findall(part)):
            at = at.parent
        if at is None or not at.tag:
            return False
        at = at.parent
    return True


def test_selectors_by_ancestors():
    r = random.Random(5)
    tags, classes = ["div", "p", "li", "ul", "span", "b", "td", "tr", "table"], ["a", "b", "c"]
    for _ in range(300):
        html = "".join(r.choice([f'<{t} class="{r.choice(classes)} {r.choice(classes)}" id="i{r.randint(0, 5)}">', f"<{t}>", f"</{t}>", "x", "<br>", "</"]) for t in r.choices(tags, k=40))
        root = tree.parse(html)
        for css in ("div p", "ul li", ".a .b", "div.a span", "#i1 b", "div div .c", "table td, p.b", "[class*=a] [id=i2]", "* *", "ul .a li"):
            want = [n for n in root.walk() if any(plain_fits(n, g.strip()) for g in css.split(","))]
            assert tree.select(root, css) == want, (css, html)
            assert tree.select(root, css, 1) == want[:1]
            assert tree.select(root, css, 3) == want[:3]
            if want:
                inner = r.choice(want)
                below = [n for n in inner.walk() if plain_fits(n, "p")]
                assert tree.select(inner, "p") == below


def test_names_of_any_shape():
    page = lambda name: f'<script type="application/ld+json">{{"@type": "Event", "name": {name}, "startDate": {{"@value": "2026-01-02"}}}}</script>'
    for name, want in (('["A", "B"]', "A"), ('{"@value": "A"}', "A"), ("5", "5"), ("[]", None), ('"A"', "A"), ("null", None)):
        found = declared(tree.parse(page(name)))
        assert [(e["title"], e["start"]) for e in found] == ([(want, "2026-01-02")] if want else [])
