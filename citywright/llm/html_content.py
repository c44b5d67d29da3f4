"""Main text of web pages by wrapper induction over the pages of a host.

The pages of a host are aligned with some of their own by simple tree matching. What is known then of every element of the
template - on how many pages it stands, which text it has most often, how much text varies below it - decides where
the article is: the smallest container in which nearly all varying text lies. What stands beside it is template, and so is what
has one text on nearly all pages inside it. Element names, roles and class names decide only what the wrapper leaves open.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

# Elements by what they do to text.
RAW = frozenset("script style noscript template iframe textarea select svg object title annotation annotation-xml".split())
#: Of these, elements that can hold others of their kind, and those that an end at their opening tag (``/>``) closes.
NESTED, EMPTY_TAG = frozenset("svg object template noscript".split()), frozenset("svg annotation annotation-xml".split())
#: An element of these that is never closed holds the rest of the page; of others without an end only the tag goes.
TO_THE_END = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul head".split())
#: Elements that an opening tag of one of these ends, if they are open inside the nearest of the given ancestors.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
#: Elements that hold text rather than other blocks: none of them is the container of an article.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote caption figcaption legend summary option".split())
#: Elements and roles that are never the article, and whole class or id names that say so.
OUTSIDE = frozenset("nav footer aside head button dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
NOT_CONTENT = re.compile(
    r"(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|sidebar|cookies?|consent|gdpr|popup|nav|navbar|navigation|breadcrumbs?|masthead|footer|share|sharing|related|recommended|newsletter|subscribe|signup|login|comments?|respond|replies|disqus|pagination|pager)"
    r"|(?:ads?|advert|cookies?|consent|gdpr|newsletter|promo|share|sharing|social|related|recommended|comments?|breadcrumbs?|pagination|login|signup|subscribe|sponsor|nav|menu|footer|sidebar|widget)[-_](?:banner|bar|box|block|links?|list|area|form|buttons?|posts?|articles?|items?|container|wrapper|notice|popup|menu|section|widget)"
    r"|(?:site|global)[-_](?:header|footer|nav|navigation|menu)|(?:main|top|page)[-_](?:footer|nav|navigation|menu)",
    re.I,
)
#: Names that stand for other things too: they count outside of articles only, and where no wrapper is known.
PERHAPS = re.compile(r"banner|side|notices?|alert|modal|overlay|menu|header|social|widget|toolbar|skip|tags|byline-links", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<[!?][^>]*>", re.S)
#: Name and value of every attribute in turn, so that nothing is found inside a value or as a part of a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: References of a host: the smallest page of each of its commonest layouts. Pages of other layouts are aligned with the nearest of the first few.
REFERENCES, COMPARED = 64, 4
#: Tables of children of so many cells at most are plain lists.
FEW = 400
#: Lists with more kinds of items than this on both sides are aligned by the items' shapes and by equal items.
MOST_KINDS = 200
#: A layout is the set of paths to containers of this depth at most.
LAYOUT_DEPTH = 5
#: The article is the smallest container with this share of all varying text. A long page's text counts as so many characters.
REGION_SHARE, MOST_WEIGHT = 0.6, 5000
#: Inside the article, a node is template if it has one text on this share of the pages that have it, and these are so many at least.
SAME_SHARE, LEAST_PAGES = 0.9, 3
#: A page is read by its reference if this share of its containers has a counterpart there.
LIKE_SHARE = 0.7
#: What a pair of nodes counts in alignment, and what the same text adds to it; the same classes add 1.
PAIR, SAME_TEXT = 1 << 40, 1 << 20
#: Outside of articles, several links that make up more than this share of their blocks are a menu.
LINK_SHARE = 0.6
#: Wrappers are broadcast up to this many bytes for all hosts together, and joined by shuffling beyond.
MOST_BROADCAST = 32 << 20


def _number(text: str) -> int:
    """A 63-bit hash, 0 for no text."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()) >> 1 if text else 0


class Tree:
    """Block elements in page order: each one's parent, tag, class names, and a hash of its own text. Element 0 is the page."""

    def __init__(self, parent: list[int], tag: list[str], names: list[str], digest: list[int]):
        self.parent, self.tag, self.names, self.digest = parent, tag, names, digest
        self._layout: int | None = None
        self.kids: list[list[int]] = [[] for _ in tag]
        for k in range(1, len(parent)):
            self.kids[parent[k]].append(k)

    def __len__(self) -> int:
        return len(self.tag)

    def layout(self) -> int:
        """A hash of the paths to containers near the top, without the numbers that names hold."""
        if self._layout is None:
            self._layout = self._hashed_layout()
        return self._layout

    def _hashed_layout(self) -> int:
        paths, depth, seen = [""] * len(self), [0] * len(self), set()
        for k in range(1, len(self)):
            p = self.parent[k]
            depth[k] = depth[p] + 1
            if depth[k] <= LAYOUT_DEPTH and self.tag[k] not in TEXTUAL:
                paths[k] = f"{paths[p]}/{self.tag[k]}.{re.sub('[0-9]+', '', self.names[k])}"
                seen.add(paths[k])
        return _number("\n".join(sorted(seen)))

    def to_json(self) -> str:
        return json.dumps([self.parent, self.tag, self.names, self.digest], separators=(",", ":"))


class Block:
    """A piece of text: its element, what the element's name, role and classes say of it, the share of it in links and their number."""

    __slots__ = ("node", "text", "outside", "perhaps", "article", "form", "linked", "links")

    def __init__(self, node: int, text: str, outside: bool, perhaps: bool, article: int, form: int, linked: float, links: int):
        self.node, self.text, self.outside, self.perhaps, self.article, self.form, self.linked, self.links = node, text, outside, perhaps, article, form, linked, links

    @property
    def inside(self) -> bool:
        return self.article >= 0


def _end_of(tag: str, html: str, end: int) -> int:
    """Where the raw element whose opening tag ends at ``end`` is over."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?![\w:-])[^>]*?(/?)>", re.I).finditer(html, end):
        if m.group(1):
            depth -= 1
        elif tag in NESTED and not (m.group(2) and tag in EMPTY_TAG):
            depth += 1
        if depth == 0:
            return m.end()
    return len(html) if tag in TO_THE_END else end


def parse(html: str) -> tuple[Tree, list[Block]]:
    """The tree of block elements and the blocks of text in page order."""
    parents, tags, classes, own = [-1], ["root"], [""], [[]]
    # open elements: (tag, node, outside the article, perhaps so, the article and the form around)
    stack = [("", 0, False, False, -1, -1)]
    blocks: list[Block] = []
    text: list[str] = []
    # characters in links and number of links of the open block, and whether a link is open
    links, n_links, in_link = 0, 0, False

    def flush() -> None:
        nonlocal links, n_links
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                _, node, outside, perhaps, article, form = stack[-1]
                own[node].append(whole)
                blocks.append(Block(node, whole, outside, perhaps, article, form, links / len(whole), n_links))
            links, n_links = 0, int(in_link)

    def add(piece: str) -> None:
        nonlocal links
        piece = entities.unescape(piece) if "&" in piece else piece
        text.append(piece)
        if in_link:
            links += len(piece)

    at, end, size = 0, 0, len(html)
    search = TOKEN.search
    while True:
        m = search(html, at)
        if m is None:
            if end < size:
                add(html[end:])
            break
        if m.start() > end:
            add(html[end : m.start()])
        at = end = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                in_link = False
            elif tag in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        # a link that is not closed ends with the block around it
                        in_link = False
                        flush()
                        del stack[depth:]
                        break
            continue
        if tag in RAW:
            if not (tag in EMPTY_TAG and m.group(3).endswith("/")):
                at = end = _end_of(tag, html, end)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            # a link ends the one before; an anchor without an address is none
            in_link = "href" in m.group(3).lower() and any(name.lower() == "href" for name, *_ in ATTRIBUTE.findall(m.group(3)))
            n_links += in_link
            continue
        if tag not in BLOCK:
            continue
        # a block element ends an open paragraph
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == "p":
                in_link = False
                flush()
                del stack[depth:]
                break
            if stack[depth][0] in ("article", "section", "div", "body", "td", "li", "main", "blockquote"):
                break
        flush()
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in within:
                    break
                if stack[depth][0] in ends:
                    del stack[depth:]
        _, parent, outside, perhaps, article, form = stack[-1]
        if tag == "hr":
            continue
        names, node = "", len(tags)
        outside = outside or tag in OUTSIDE or (tag == "header" and article < 0)
        if tag == "form":
            form = node
        if m.group(3):
            for name, a, b, c in ATTRIBUTE.findall(m.group(3)):
                value = a or b or c
                name = name.lower()
                if name in ("class", "id"):
                    if name == "class":
                        names = " ".join(sorted(value.split()))
                    if tag not in ("html", "body", "article", "main") or name == "class" and tag == "article":
                        outside = outside or any(map(NOT_CONTENT.fullmatch, value.split()))
                        perhaps = perhaps or any(map(PERHAPS.fullmatch, value.split()))
                elif name == "role":
                    outside = outside or value.lower() in ROLES
                    article = node if value.lower() == "main" else article
                elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
                    outside = True
        article = node if tag in ("article", "main") else article
        parents.append(parent)
        tags.append(tag)
        classes.append(names)
        own.append([])
        stack.append((tag, node, outside, perhaps, article, form))
    flush()
    _judge_forms(blocks)
    return Tree(parents, tags, classes, [_number("\n".join(o)) for o in own]), blocks


def _judge_forms(blocks: list[Block]) -> None:
    """Forms are not content, but for those around an article, or, where they are in none, around most of the page's text."""
    whole = sum(len(b.text) for b in blocks if not b.outside)
    held: dict[int, int] = {}
    around = set()
    for b in blocks:
        if b.form >= 0 and not b.outside:
            held[b.form] = held.get(b.form, 0) + len(b.text)
            # elements are numbered in page order, so an article of a higher number is in the form
            if b.article > b.form:
                around.add(b.form)
    for b in blocks:
        if b.form >= 0 and b.form not in around and (b.inside or 2 * held.get(b.form, 0) <= whole):
            b.outside = True


class _Kinds:
    """Subtrees of two trees by number: equal numbers are equal subtrees, and ``score`` compares two numbers.

    Texts and class names that only one of the trees has can match nothing, so they are left out first: rows
    of a list that differ in such texts only are of one kind.
    """

    def __init__(self, a: Tree, b: Tree):
        texts, names = set(a.digest) & set(b.digest) - {0}, set(a.names) & set(b.names)
        self.number: dict[tuple, int] = {}
        self.tag, self.text, self.name, self.kids, self.whole, self.shape = [], [], [], [], [], []
        self.of = [self._numbered(t, side, texts, names) for side, t in enumerate((a, b))]
        self.known: dict[tuple[int, int], int] = {}

    def _numbered(self, tree: Tree, side: int, texts: set[int], names: set[str]) -> list[int]:
        out = [0] * len(tree)
        for k in range(len(tree) - 1, -1, -1):
            text = tree.digest[k] if tree.digest[k] in texts else 0
            name = tree.names[k] if tree.names[k] in names else side
            out[k] = self._of(tree.tag[k], text, name, tuple([out[c] for c in tree.kids[k]]))
        return out

    def _of(self, tag: str, text: int, name: str | int, kids: tuple[int, ...]) -> int:
        key = (tag, text, name, kids)
        n = self.number.get(key)
        if n is None:
            bare = all(self.shape[c] == c for c in kids) and not text
            n = self.number[key] = len(self.tag)
            self.tag.append(tag)
            self.text.append(text)
            self.name.append(name)
            self.kids.append(kids)
            self.whole.append(PAIR + (SAME_TEXT if text else 0) + 1 + sum([self.whole[c] for c in kids]))
            self.shape.append(n)
            if not bare:
                self.shape[n] = self._of(tag, 0, name, tuple([self.shape[c] for c in kids]))
        return n

    def alone(self, x: int, y: int) -> int:
        return PAIR + (SAME_TEXT if self.text[x] and self.text[x] == self.text[y] else 0) + (self.name[x] == self.name[y])

    def score(self, x: int, y: int) -> int:
        """The best alignment's score of two kinds, without recursion."""
        known = self._ready(x, y)
        if known is not None:
            return known
        todo = [(x, y)]
        while todo:
            u, v = todo[-1]
            if self._ready(u, v) is not None:
                todo.pop()
                continue
            mine, yours = _trimmed(self.kids[u], self.kids[v])[2:]
            need = [p for p in self.needed(mine, yours) if self._ready(*p) is None]
            if need:
                todo += need
                continue
            total = self.alone(u, v) + sum([self.whole[c] for c in self.kids[u]]) - sum([self.whole[c] for c in mine])
            if len(mine) * len(yours) <= FEW:
                total += _table(mine, yours, self._ready)[-1][-1]
            else:
                for _, row in _rows(mine, self.gains(mine, yours)):
                    pass
                total += int(row[-1])
            self.known[u, v] = total
            todo.pop()
        return self._ready(x, y)

    def needed(self, mine: Sequence[int], yours: Sequence[int]) -> list[tuple[int, int]]:
        """Pairs of kinds whose scores a table of these children takes."""
        one, two = set(mine), set(yours)
        if len(one) * len(two) > MOST_KINDS**2:
            one, two = {self.shape[k] for k in one}, {self.shape[k] for k in two}
        return [(u, v) for u in one for v in two if self.tag[u] == self.tag[v]]

    def gains(self, mine: Sequence[int], yours: Sequence[int]) -> Callable[[int], np.ndarray]:
        """For a kind, what it gains with each of ``yours``; scores that are needed have to be known."""
        coarse = len(set(mine)) * len(set(yours)) > MOST_KINDS**2
        exact = np.array(yours)
        kinds, where = np.unique(np.array([self.shape[k] for k in yours]) if coarse else exact, return_inverse=True)
        order = np.argsort(exact, kind="stable")
        by_kind: dict[int, np.ndarray] = {}

        def of(x: int) -> np.ndarray:
            own = self.shape[x] if coarse else x
            if own not in by_kind:
                by_kind[own] = np.array([self._ready(own, k) for k in kinds.tolist()], dtype=np.int64)[where]
            gain = by_kind[own]
            if coarse:
                same = order[np.searchsorted(exact, x, "left", sorter=order) : np.searchsorted(exact, x, "right", sorter=order)]
                if len(same):
                    gain = gain.copy()
                    gain[same] = self.whole[x]
            return gain

        return of

    def _ready(self, x: int, y: int) -> int | None:
        """The score of two kinds, 0 where their tags differ, None if it has to be worked out first."""
        if self.tag[x] != self.tag[y]:
            return 0
        if x == y and self.name[x] == self.name[y]:
            return self.whole[x]
        if not self.kids[x] or not self.kids[y]:
            return self.alone(x, y)
        return self.known.get((x, y))


def _trimmed(mine: Sequence[int], yours: Sequence[int]) -> tuple[int, int, Sequence[int], Sequence[int]]:
    """(equal children in front, equal ones behind, what is left of both): a child matches an equal one as well as any."""
    least, front, behind = min(len(mine), len(yours)), 0, 0
    while front < least and mine[front] == yours[front]:
        front += 1
    while behind < least - front and mine[-1 - behind] == yours[-1 - behind]:
        behind += 1
    return front, behind, mine[front : len(mine) - behind], yours[front : len(yours) - behind]


def _rows(mine: Sequence[int], gains: Callable[[int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row above, row) of the table of best scores of the first i children of one and j of the other, row by row."""
    above = None
    for x in mine:
        gain = gains(x)
        above = np.zeros(len(gain) + 1, dtype=np.int64) if above is None else above
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gain), out=row[1:])
        yield above, row
        above = row


def _table(mine: Sequence[int], yours: Sequence[int], score: Callable[[int, int], int]) -> list[list[int]]:
    """The same table as lists, for few children."""
    rows = [[0] * (len(yours) + 1)]
    for x in mine:
        above, row, best = rows[-1], [0], 0
        for j, y in enumerate(yours):
            best = max(best, above[j + 1], above[j] + score(x, y))
            row.append(best)
        rows.append(row)
    return rows


def _few_matched(mine: Sequence[int], yours: Sequence[int], score: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Places of the pairs of the best alignment of few children."""
    rows, out, i, j = _table(mine, yours, score), [], len(mine), len(yours)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _matched(mine: Sequence[int], gains: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Places of the pairs of the best alignment; a bit a cell says where the table does not grow."""
    up, left = [], []
    for above, row in _rows(mine, gains):
        up.append(np.packbits(row[1:] == above[1:]))
        left.append(np.packbits(row[1:] == row[:-1]))
    out, i, j = [], len(mine), len(row) - 1
    while i and j:
        byte, bit = divmod(j - 1, 8)
        if up[i - 1][byte] >> (7 - bit) & 1:
            i -= 1
        elif left[i - 1][byte] >> (7 - bit) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(reference: Tree, page: Tree) -> list[int]:
    """For each element of ``page`` its counterpart in ``reference``, or -1, by simple tree matching.

    The largest set of pairs of equal tags that keeps parents and the order of siblings; between sets of one size, more
    pairs with the same text decide, then with the same classes. Equal subtrees at the ends of two lists of siblings are matched at once,
    scores are worked out once for each pair of kinds of subtree, and a table of siblings takes a bit a cell. Where a list has more kinds
    than ``MOST_KINDS`` on both sides, single texts inside of its items no longer decide between sets of one size, equal items do.
    """
    found = [-1] * len(page)
    if reference.tag[0] != page.tag[0]:
        return found
    kinds = _Kinds(reference, page)
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        found[b] = a
        mine, yours = reference.kids[a], page.kids[b]
        if not mine or not yours:
            continue
        x, y = [kinds.of[0][k] for k in mine], [kinds.of[1][k] for k in yours]
        front, behind, rest_x, rest_y = _trimmed(x, y)
        todo += zip(mine[:front], yours[:front], strict=True)
        if behind:
            todo += zip(mine[-behind:], yours[-behind:], strict=True)
        if rest_x and rest_y:
            for u, v in kinds.needed(rest_x, rest_y):
                kinds.score(u, v)
            matched = _few_matched(rest_x, rest_y, kinds.score) if len(rest_x) * len(rest_y) <= FEW else _matched(rest_x, kinds.gains(rest_x, rest_y))
            todo += [(mine[front + i], yours[front + j]) for i, j in matched]
    return found


def nearest(references: list[Tree], page: Tree) -> tuple[int, list[int]]:
    """(number of the reference of the page's layout, or of the first ``COMPARED`` the one that most of its elements have a counterpart in, the alignment); (-1, []) without references."""
    best, number, pairs = -1.0, -1, []
    layout = page.layout() if len(references) > 1 else None
    same = [k for k, r in enumerate(references) if layout is not None and r.layout() == layout]
    for k in same[:1] or range(min(COMPARED, len(references))):
        own = align(references[k], page)
        like = sum(p >= 0 for p in own) / max(len(references[k]), len(page))
        if like > best:
            best, number, pairs = like, k, own
    return number, pairs


class Template:
    """What a host's pages have in common with a reference: where the article lies, and which nodes have one text."""

    def __init__(self, tree: Tree, nodes: list[dict]):
        """``nodes``: node, n (pages), top_n (pages with the commonest text), top (its hash), same (pages whose text other pages have), varying, lo, hi."""
        self.tree = tree
        varying = [0.0] * len(tree)
        self.constant: dict[int, int] = {}
        self.recurs: set[int] = set()
        for x in nodes:
            varying[x["node"]] += x["varying"]
            if x["top"] and x["n"] >= LEAST_PAGES and x["top_n"] >= SAME_SHARE * x["n"]:
                self.constant[x["node"]] = x["top"]
            if 2 * x["same"] >= x["n"]:
                self.recurs.add(x["node"])
        for k in range(len(tree) - 1, 0, -1):
            varying[tree.parent[k]] += varying[k]
        # pages that are all alike show nothing
        self.known = bool(nodes) and min(x["lo"] for x in nodes) < max(x["hi"] for x in nodes) and varying[0] > 0
        self.region = 0
        while self.known:
            inner = [k for k in tree.kids[self.region] if tree.tag[k] not in TEXTUAL and varying[k] >= REGION_SHARE * varying[0]]
            if not inner:
                break
            self.region = inner[0]
        self.within = [False] * len(tree)
        self.above = {self.region}
        k = self.region
        while k > 0:
            k = tree.parent[k]
            self.above.add(k)
        for k in range(len(tree)):
            self.within[k] = k == self.region or (k > 0 and self.within[tree.parent[k]])

    def verdict(self, page: Tree, pairs: list[int]) -> list[str] | None:
        """For each element of the page "article", "template", "heading" (beside the article) or "open"; None where the page is not like the reference."""
        containers = [k for k in range(len(page)) if page.tag[k] not in TEXTUAL]
        if not self.known or sum(pairs[k] >= 0 for k in containers) < LIKE_SHARE * len(containers) or self.region not in pairs:
            return None
        out: list[str] = []
        ready = False
        for k in range(len(page)):
            a = pairs[k]
            ready = ready or a == self.region
            if a < 0:
                # what has no counterpart belongs to where it stands
                p = out[page.parent[k]]
                out.append("template" if p == "heading" else p)
            elif self.within[a]:
                out.append("template" if page.digest[k] and self.constant.get(a) == page.digest[k] else "article")
            elif a in self.above:
                out.append("template" if page.digest[k] and self.constant.get(a) == page.digest[k] else "open")
            else:
                # a varying headline can stand in front of its article
                out.append("heading" if page.tag[k] in ("h1", "h2") and a not in self.recurs and not ready else "template")
        return out


def _menus(blocks: list[Block]) -> set[int]:
    """Numbers of blocks that are menus by their links: mostly links, and several of them, or next to another such block. One linked line is text."""
    linked = [b.linked > LINK_SHARE for b in blocks]
    return {k for k, b in enumerate(blocks) if linked[k] and (b.links > 1 or k > 0 and linked[k - 1] or k + 1 < len(blocks) and linked[k + 1])}


def main_text(html: str, templates: list[Template], marks: bool = True) -> str:
    """The page's blocks that are content, joined by newlines.

    Blocks that the wrapper finds to be template fall away. In the article, and where the wrapper leaves a block open or does not
    know the page, elements, roles and class names decide; without ``marks`` these count for nothing. Where no article is known by
    either, menus are told by their links.
    """
    tree, blocks = parse(html)
    number, pairs = nearest([t.tree for t in templates], tree)
    verdict = templates[number].verdict(tree, pairs) if number >= 0 else None
    if verdict is None:
        open_ = [b for b in blocks if not marks or not (b.outside or (b.perhaps and not b.inside))]
        menus = _menus(open_)
        chosen = [b for b in open_ if b.inside and marks] or [b for k, b in enumerate(open_) if k not in menus]
        return "\n".join(b.text for b in chosen)
    constant, recurs = templates[number].constant, templates[number].recurs

    def stays(k: int, b: Block) -> bool:
        if marks and b.outside:
            return False
        said = verdict[b.node]
        if said == "template":
            # an element that is marked as the article is believed, if its text varies
            a = pairs[b.node]
            return marks and b.inside and a not in recurs and not (a in constant and constant[a] == tree.digest[b.node])
        return said != "open" or k not in menus

    menus = _menus(blocks)
    open_ = [b for k, b in enumerate(blocks) if stays(k, b)]
    return "\n".join(b.text for b in ([b for b in open_ if b.inside and marks] or open_))


def host_of(url):
    """Lower-cased host of a URL column, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def _with_wrappers(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``pages`` with the column ``wrapper`` of their host, null where there is none."""
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= MOST_BROADCAST else wrappers, "host", "left")


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [parse(h)[0] for h in batch.column(2).to_pylist()]
        # a page without text is no reference
        sizes = [len(t) if any(t.digest) else None for t in trees]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.layout() for t in trees], pa.int64()), pa.array(sizes, pa.int64())], names=["host", "mark", "layout", "size"])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [parse(h)[0] for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.to_json() for t in made], pa.string())], names=["host", "place", "tree"])


class _Hosts:
    """Parsed wrappers of the hosts that a task met last."""

    def __init__(self, read):
        self.read, self.known = read, {}

    def of(self, host: str, wrapper: str | None):
        if host not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            self.known[host] = self.read(json.loads(wrapper)) if wrapper else []
        return self.known[host]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hosts = _Hosts(lambda trees: [Tree(*t) for t in trees])
    for batch in batches:
        votes: dict[tuple[str, int, int, int], list] = {}
        for host, html, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree, blocks = parse(html or "")
            number, pairs = nearest(hosts.of(host, wrapper), tree)
            if number < 0 or not blocks:
                continue
            chars: dict[int, int] = {}
            for b in blocks:
                chars[b.node] = chars.get(b.node, 0) + len(b.text)
            whole = sum(chars.values())
            weight, mark = min(1.0, MOST_WEIGHT / whole), _number("\n".join(b.text for b in blocks))
            for node, n in chars.items():
                a = node
                while pairs[a] < 0:
                    a = tree.parent[a]
                # text without a counterpart varies, where its nearest counterpart is
                v = votes.setdefault((host, number, pairs[a], tree.digest[node] if a == node else 0), [0, 0.0, mark, mark])
                v[0] += a == node
                v[1] += n * weight
                v[2], v[3] = min(v[2], mark), max(v[3], mark)
        if votes:
            keys, values = list(zip(*votes, strict=True)), list(zip(*votes.values(), strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*keys, *values], kinds, strict=True)], names=["host", "reference", "node", "digest", "n", "weight", "lo", "hi"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hosts = _Hosts(lambda made: [Template(Tree(*t["tree"]), t["nodes"]) for t in made])
    for batch in batches:
        ids, urls, pages, names, wrappers = batch.columns
        texts = [main_text(page or "", hosts.of(host, wrapper)) for page, host, wrapper in zip(pages.to_pylist(), names.to_pylist(), wrappers.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def induce_wrappers(source: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html): each host's reference trees with what its pages say of their nodes, as JSON."""
    marked = source.where("html != ''").select("host", F.md5("html").alias("mark"), "html")
    layouts = marked.mapInArrow(_layouts, "host string, mark string, layout long, size long").where("size is not null")
    common = layouts.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min(F.struct("size", "mark")).alias("least"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "layout"))
    chosen = stored(common.withColumn("place", place).where(F.col("place") <= REFERENCES).select("host", F.col("least.mark").alias("mark"), "place"), "layouts")
    few = chosen.count() <= 100_000
    pages = marked.join(F.broadcast(chosen) if few else chosen, ["host", "mark"]).select("host", F.col("place").cast("long").alias("place"), "html")
    # copies of a reference page give the same tree
    trees = stored(pages.mapInArrow(_references, "host string, place long, tree string").groupBy("host", "place").agg(F.min("tree").alias("tree")), "references")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "tree"))), lambda x: x["tree"])
    wrappers = stored(trees.groupBy("host").agg(F.concat(F.lit("["), F.array_join(in_order, ","), F.lit("]")).alias("wrapper")), "wrappers")

    votes = _with_wrappers(source.select("host", "html"), wrappers).select("host", "html", "wrapper").mapInArrow(_votes, "host string, reference long, node long, digest long, n long, weight double, lo long, hi long")
    texts = votes.groupBy("host", "reference", "node", "digest").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # a text recurs if pages that differ have it; exact copies of a page do not count
    recurs = (F.col("digest") != 0) & (F.col("lo") < F.col("hi"))
    nodes = texts.groupBy("host", "reference", "node").agg(
        F.sum("n").alias("n"),
        F.max("n").alias("top_n"),
        F.max_by("digest", F.struct("n", "digest")).alias("top"),
        F.sum(F.when(recurs, F.col("n")).otherwise(0)).alias("same"),
        F.sum(F.when(recurs, 0.0).otherwise(F.round("weight", 3))).alias("varying"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    # as many nodes as a reference page has elements
    told = nodes.groupBy("host", "reference").agg(F.to_json(F.array_sort(F.collect_list(F.struct("node", "n", "top_n", "top", "same", "varying", "lo", "hi")))).alias("nodes"))
    numbered = trees.select("host", (F.row_number().over(Window.partitionBy("host").orderBy("place")) - 1).cast("long").alias("reference"), "tree")
    both = numbered.join(told, ["host", "reference"], "left")
    made = F.concat(F.lit('{"tree":'), F.col("tree"), F.lit(',"nodes":'), F.coalesce("nodes", F.lit("[]")), F.lit("}"))
    one = both.select("host", "reference", made.alias("made")).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("reference", "made"))).alias("all"))
    return stored(one.select("host", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["made"]), ","), F.lit("]")).alias("wrapper")), "templates")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    A host's references are the smallest pages of its commonest layouts. Every page of the host is aligned with the one most like it
    and votes, for each node, for its text and the number of its characters. Votes are summed in each task first,
    so a host with a third of all pages needs no task of its own. Then every page is aligned again, and what lies beside the container
    of the varying text, or has one text on nearly all pages, is template. Two pages that differ are enough. Where a host has fewer, and
    inside articles, menus, headers, footers, sidebars, notices, adverts, forms and comments fall away by element, role or class.

    Character references are decoded, white space in a block becomes one blank, blocks are joined by newlines. Pages may be nested
    as deeply as they like. Null and empty pages have the text ''. Pages with a null url share a host of their own. Of wrappers that
    are equally like a page, the commoner layout's is taken. Repeated rows get a row each; other columns are ignored.
    """
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")).withColumn("host", host_of(F.col("url")))
    kind = pages.schema[id_col].dataType.simpleString()
    joined = _with_wrappers(source, induce_wrappers(source)).select("page_id", "url", "html", "host", "wrapper")
    return joined.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
