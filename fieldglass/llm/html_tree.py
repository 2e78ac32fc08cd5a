"""Block-level trees of web pages and their alignment by simple tree matching."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

#: Elements that do not break a block (fixed values of the HTML standard).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output picture progress q"
    " rp rt ruby s samp small span strike strong sub sup time tt u var wbr img audio video canvas map area".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, or not text of the page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
#: What a new element of the key closes if it is open inside the element's own list or table.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"),
    "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset("ul ol menu dl table select html body".split())

#: What an element's names say of the texts in it: nothing, furniture by name (a hint), reader comments, furniture by element.
PLAIN, HINTED, COMMENT, FIRM = range(4)
#: Elements that never hold the article, and elements that seldom do.
FIRM_ELEMENTS = frozenset("nav footer aside menu dialog button select svg object embed head input textarea".split())
HINTED_ELEMENTS = frozenset("form fieldset header".split())
#: Words in class, id or role that hint at page furniture (fixed values).
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer cookie cookies"
    " consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share"
    " sharing social related recommended recommendations pagination pager widget widgets masthead toolbar topbar"
    " contentinfo complementary search header".split()
)
#: Whole names of reader comments.
_COMMENT_NAME = re.compile(
    r"(?:comments?|commentlist|reply|replies|respond|disqus)(?:[-_]?(?:list|area|section|thread|body|box|form|item|content))?"
)
HEADER_WORDS = frozenset("header banner masthead".split())
MAIN_WORDS = frozenset("articlebody".split())
DEEPEST = 150

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S
)
_CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Tree:
    """Nodes in page order as parallel lists; text nodes have the label '#'."""

    label: list[str] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    furniture: list[int] = field(default_factory=list)
    main: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    shape: list[int] = field(default_factory=list)

    def add(self, label: str, depth: int, text: str = "", furniture: int = PLAIN, main: int = 0, linked: int = 0):
        self.label.append(label)
        self.depth.append(depth)
        self.text.append(text)
        self.mark.append(xxhash.xxh32_intdigest(text) if text else 0)
        self.furniture.append(furniture)
        self.main.append(main)
        self.linked.append(linked)
        self.length.append(len(text))

    def close(self) -> Tree:
        """Fill in children, subtree sizes and shapes."""
        count = len(self.label)
        self.kids = [[] for _ in range(count)]
        path: list[int] = []
        for i, depth in enumerate(self.depth):
            del path[depth:]
            if path:
                self.kids[path[-1]].append(i)
            path.append(i)
        self.size, self.shape = [1] * count, [0] * count
        for i in range(count - 1, -1, -1):
            self.size[i] += sum(self.size[k] for k in self.kids[i])
            self.shape[i] = hash((self.label[i], *(self.shape[k] for k in self.kids[i])))
        return self

    def skeleton(self) -> str:
        """All but the texts themselves, as one line per node."""
        columns = (self.depth, self.mark, self.furniture, self.main, self.linked, self.length, self.label)
        return "\n".join(f"{d} {m:x} {f} {r} {a} {s} {n}" for d, m, f, r, a, s, n in zip(*columns, strict=True))

    def layout(self) -> int:
        """A hash of which elements make up the page, repetitions and lone wrappers aside."""
        at = 0
        while len(kids := [k for k in self.kids[at] if self.label[k] != "#"]) == 1:
            at = kids[0]
        names = sorted({self.label[k] for k in kids})
        return xxhash.xxh64_intdigest(" ".join([self.label[at], *names])) >> 1


def from_skeleton(lines: str) -> Tree:
    tree = Tree()
    for line in lines.split("\n"):
        depth, mark, furniture, main, linked, length, label = line.split(" ", 6)
        tree.label.append(label)
        tree.depth.append(int(depth))
        tree.mark.append(int(mark, 16))
        tree.furniture.append(int(furniture))
        tree.main.append(int(main))
        tree.linked.append(int(linked))
        tree.length.append(int(length))
    return tree.close()


def parse(page: str, hints: bool = True) -> Tree:
    """The tree of a page's block elements and text blocks.

    Tags need not be closed.  Text is decoded, its white space made single
    blanks; blocks end where a block element starts or ends and at line breaks.
    Elements nested deeper than ``DEEPEST`` count as lying at that depth.
    Without ``hints`` no name says anything of the texts in its element.
    """
    tree = Tree()
    tree.add("html", 0)
    # Open elements: name, furniture, main region (1: main, 2: article).
    opened: list[tuple[str, int, int]] = [("html", PLAIN, 0)]
    pieces: list[str] = []
    in_link = linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, furniture, main = opened[-1]
                tree.add("#", min(len(opened), DEEPEST), text, furniture, main, linked)
            pieces.clear()
        linked = 0

    while at < end:
        found = _TAG.search(page, at)
        chunk = page[at:found.start() if found else end]
        if not found:
            chunk = _CUT.sub("", chunk)
        if chunk:
            text = html.unescape(chunk) if "&" in chunk else chunk
            pieces.append(text)
            if in_link:
                linked += len(text)
        if not found:
            break
        at = found.end()
        name = found[2]
        if not name:
            continue
        name = name.lower()
        if found[1]:
            if name == "a":
                in_link = 0
            if name not in INLINE and any(name == o[0] for o in opened[1:]):
                flush()
                while opened.pop()[0] != name:
                    pass
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
            continue
        if name == "a":
            in_link = 1
            continue
        if name in INLINE:
            continue
        flush()
        if name in VOID or name in ("html", "body"):
            continue
        _close_implied(opened, name)
        parent = opened[-1]
        furniture, main, label = _region(name, found[3], parent)
        if not hints:
            furniture = main = 0
        tree.add(label, min(len(opened), DEEPEST), "", furniture, main)
        if not found[3].rstrip().endswith("/") or name not in ("svg", "path", "g"):
            opened.append((name, furniture, main))
    flush()
    return tree.close()


def _close_implied(opened: list[tuple[str, int, int]], name: str) -> None:
    if opened[-1][0] == "p" and name != "p" or name == "p" and opened[-1][0] == "p":
        opened.pop()
    closing = CLOSES.get(name)
    if closing:
        for i in range(len(opened) - 1, 0, -1):
            if opened[i][0] in SCOPES:
                return
            if opened[i][0] in closing:
                del opened[i:]
                if name not in ("tr", "tbody", "tfoot", "thead"):
                    return
    elif opened[-1][0] == "head" and name not in ("head",):
        opened.pop()


def _region(name: str, attributes: str, parent: tuple[str, int, int]) -> tuple[int, int, str]:
    """What the names of a new element say: furniture and main region; and its label for matching.

    An article or main region takes back what names further out only hinted at;
    its own names say nothing against it, but for those of reader comments.
    """
    words: set[str] = set()
    label, comment = name, False
    if "=" in attributes:
        for kind, *values in _NAMES.findall(attributes):
            value = "".join(values).lower()
            own = set(_WORD.findall(value))
            words |= own
            comment = comment or any(_COMMENT_NAME.fullmatch(token) for token in value.split())
            if kind.lower() == "class":
                label = ".".join([name, *sorted(own)])
    furniture, main = parent[1], parent[2]
    marked = 0
    if name == "article":
        marked = 2
    elif name == "main" or "main" in words and "role" in attributes.lower() or words & MAIN_WORDS:
        marked = 1
    if name in FIRM_ELEMENTS:
        furniture = FIRM
    elif comment:
        furniture = max(furniture, COMMENT)
    elif marked:
        furniture = PLAIN if furniture == HINTED else furniture
    else:
        hinted = words & FURNITURE_WORDS
        if main and hinted <= HEADER_WORDS:
            hinted = set()
        if hinted or name in HINTED_ELEMENTS and not (main and name == "header"):
            furniture = max(furniture, HINTED)
    if "hidden" in attributes.lower() or "display" in attributes.lower():
        if _HIDDEN.search(attributes):
            furniture = FIRM
    return furniture, max(main, marked), label


class Matching:
    """Simple tree matching of a page with a pivot page: the largest order-keeping set of matched nodes.

    Nodes match if their labels do and their parents match.  Subtrees of the same
    shape score their size at once; equal texts score once more, so that moved
    but unchanged blocks find each other.
    """

    def __init__(self, pivot: Tree, page: Tree) -> None:
        self.pivot, self.page = pivot, page
        self.known: dict[tuple[int, int], int] = {}

    def score(self, a: int, b: int) -> int:
        pivot, page = self.pivot, self.page
        if pivot.label[a] != page.label[b]:
            return 0
        if pivot.label[a] == "#":
            return 2 if pivot.mark[a] == page.mark[b] else 1
        if pivot.shape[a] == page.shape[b] and pivot.size[a] <= 2:
            kid = pivot.kids[a]
            return pivot.size[a] + (bool(kid) and pivot.mark[kid[0]] == page.mark[page.kids[b][0]])
        key = (a, b)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = 1 + self.table(a, b)[-1][-1]
        return found

    def table(self, a: int, b: int) -> list[list[int]]:
        left, right = self.pivot.kids[a], self.page.kids[b]
        above = [0] * (len(right) + 1)
        rows = [above]
        for i in left:
            row = [0]
            for k, j in enumerate(right, 1):
                best = above[k] if above[k] >= row[k - 1] else row[k - 1]
                gain = self.score(i, j)
                if gain and above[k - 1] + gain > best:
                    best = above[k - 1] + gain
                row.append(best)
            rows.append(row)
            above = row
        return rows

    def texts(self) -> list[tuple[int, int]]:
        """Matched text nodes (pivot, page)."""
        out: list[tuple[int, int]] = []
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if self.pivot.label[a] == "#":
                out.append((a, b))
                continue
            left, right = self.pivot.kids[a], self.page.kids[b]
            if not left or not right:
                continue
            rows = self.table(a, b)
            i, k = len(left), len(right)
            while i and k:
                here = rows[i][k]
                if here == rows[i - 1][k]:
                    i -= 1
                elif here == rows[i][k - 1]:
                    k -= 1
                else:
                    i, k = i - 1, k - 1
                    todo.append((left[i], right[k]))
        return out
