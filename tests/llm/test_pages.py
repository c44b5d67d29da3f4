"""Page extraction: text that must not be lost, long lists, many layouts, and articles against a plain extractor."""

import random
import time
import tracemalloc
from html.parser import HTMLParser

from citywright.llm import html_content as h
from citywright.llm.html_content import align, main_text, parse

BLOCKS = {"p", "h1", "h2", "div", "ul", "li", "section", "blockquote", "article", "body", "table", "tr", "td"}


class Plain(HTMLParser):
    """Text of the article by block, white space and references as asked; nothing else is looked at."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("svg", "script", "style"):
            self.skip += 1
        if tag in BLOCKS:
            self.blocks.append("")
        if tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.blocks.append("")
        if tag in ("svg", "script", "style"):
            self.skip -= 1
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def plain(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    return "\n".join(t for b in parser.blocks if (t := " ".join(b.split())))


def article(rng):
    words = lambda: " ".join(rng.choices(["story", "caf&eacute;", "a &lt; b", "&#x1F600;", "two\n lines", "naïve", "&nbsp;x"], k=rng.randrange(1, 7)))
    inline = lambda: rng.choice([words(), f"<b>{words()}</b>", f'<a href="/x">{words()}</a>', f'<a name="t">{words()}', f"{words()}<br>{words()}", f"<svg class='i'/>{words()}", f"<svg><svg><text>no</text></svg><text>no</text></svg>{words()}", f"<math><mi>{words()}</mi></math>", f"<script>var x = '<p>no</p>';</script>{words()}", f"<a href=y>{words()}"])
    block = lambda depth: rng.choice([f"<p>{inline()} {inline()}</p>", f"<h2>{words()}</h2>", f"<ul>{''.join(f'<li>{inline()}</li>' for _ in range(3))}</ul>", f"<blockquote>{block(depth - 1)}</blockquote>" if depth else words(), f"<div>{''.join(block(depth - 1) for _ in range(2))}</div>" if depth else f"<p>{words()}</p>", f"<table><tr><td>{inline()}</td><td>{words()}</td></tr></table>"])
    return "".join(block(3) for _ in range(rng.randrange(1, 8)))


def test_articles_equal_a_plain_extractor():
    rng = random.Random(12)
    for _ in range(400):
        page = f"<html><body><nav><a href='/'>Home</a></nav><article>{article(rng)}</article><footer>Foot</footer></body></html>"
        assert main_text(page, []) == plain(page), page


def test_nothing_is_lost_to_tags_that_are_never_closed():
    assert main_text('<body><a name="top"><p>one</p><p>two</p></body>', []) == "one\ntwo"
    assert main_text("<body><p>one <a href=x>two <p>three</p><div>four</div>", []) == "one two\nthree\nfour"
    assert main_text('<article><p>one</p><svg class="i"/><p>two</p></article>', []) == "one\ntwo"
    assert main_text("<article><p>one</p><svg><svg/><g>no</g></svg><object><object>no</object>no</object><p>two</p></article>", []) == "one\ntwo"
    assert main_text("<article><p>one</p><iframe src=x><p>two</p><noscript><p>three</p></article>", []) == "one\ntwo\nthree"
    assert main_text("<p>let <math><mi>x</mi> = 2<annotation>x=2</annotation></math> be</p>", []) == "let x = 2 be"
    assert main_text("<article><p>one</p><style>p {}", []) == "one"


def test_one_linked_line_is_text_and_several_are_a_menu():
    assert main_text('<p>Some text.</p><p><a href="/more">Everything about it</a></p><p>More text.</p>', []) == "Some text.\nEverything about it\nMore text."
    assert main_text('<div><a href="/a">One</a> | <a href="/b">Two</a></div><p>Text.</p>', []) == "Text."
    assert main_text('<ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul><p>Text.</p>', []) == "Text."


def best_score(a, b, x, y):
    """The greatest score of two trees, over all choices of children."""
    if a.tag[x] != b.tag[y]:
        return 0
    own = h.PAIR + (h.SAME_TEXT if a.digest[x] and a.digest[x] == b.digest[y] else 0) + (a.names[x] == b.names[y])

    def rows(mine, yours):
        if not mine or not yours:
            return 0
        s = best_score(a, b, mine[0], yours[0])
        return max(rows(mine[1:], yours), rows(mine, yours[1:]), s + rows(mine[1:], yours[1:]) if s else 0)

    return own + rows(a.kids[x], b.kids[y])


def test_alignment_has_the_greatest_score():
    rng = random.Random(17)

    def tree():
        n = rng.randrange(2, 10)
        parent = [-1] + [rng.randrange(max(0, k - 4), k) for k in range(1, n)]
        return h.Tree(parent, ["root"] + rng.choices("ab", k=n - 1), rng.choices(["", "c", "d"], k=n), [rng.randrange(4) for _ in range(n)])

    for _ in range(600):
        a, b = tree(), tree()
        found = align(a, b)
        got = sum(h.PAIR + (h.SAME_TEXT if a.digest[x] and a.digest[x] == b.digest[y] else 0) + (a.names[x] == b.names[y]) for y, x in enumerate(found) if x >= 0)
        assert got == best_score(a, b, 0, 0)


def test_coarse_lists_still_have_the_most_pairs(monkeypatch):
    rng = random.Random(3)
    rows = lambda k: "".join(f"<tr><td>{rng.randrange(9)}<td>{rng.randrange(9)}{'<td>x' * rng.randrange(2)}</tr>" for _ in range(k))
    for _ in range(30):
        a, b = (parse(f"<table>{rows(rng.randrange(3, 12))}</table>")[0] for _ in range(2))
        exact = sum(x >= 0 for x in align(a, b))
        monkeypatch.setattr(h, "MOST_KINDS", 1)
        monkeypatch.setattr(h, "FEW", 0)
        found = align(a, b)
        monkeypatch.undo()
        assert sum(x >= 0 for x in found) == exact
        assert all(y == 0 or found[b.parent[y]] == a.parent[x] for y, x in enumerate(found) if x >= 0)


def test_ten_thousand_siblings():
    shapes = [lambda k, s: f"<p>text {s} {k}</p>", lambda k, s: f"<tr><td>{s}{k}<td>Reply<td>{k % 7}</tr>", lambda k, s: f"<tr><td>{(k * 7919 + 5 * s) % 10_007}<td>Reply</tr>"]
    for shape in shapes:
        a, b = (parse("<body>" + "".join(shape(k, s) for k in range(10_000 + 13 * s)))[0] for s in (0, 1))
        tracemalloc.start()
        began = time.process_time()
        found = align(a, b)
        assert time.process_time() - began < 20 and tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()
        assert sum(x >= 0 for x in found) == len(a)


def test_every_common_layout_has_a_template(spark):
    """Seven layouts of one host, more than are compared with pages that have none of their own."""
    tags = ["div", "section", "table", "ul", "blockquote", "details", "dl"]

    def page(n, k):
        wrap = tags[n]
        inner = f"<{wrap}>" * 2 + f"<div class='t{wrap}'><p>Story {n} {k}. {'Words here. ' * (3 + k)}</p></div>" + f"</{wrap}>" * 2
        return f"<body><{wrap}><div>Shop of {wrap}</div></{wrap}>{inner}<div>Call us</div></body>"

    rows = [(10 * n + k, "http://many.example/", page(n, k)) for n in range(7) for k in range(4)]
    got = {r.page_id: r.text for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * n + k: f"Story {n} {k}. " + ("Words here. " * (3 + k)).strip() for n in range(7) for k in range(4)}
