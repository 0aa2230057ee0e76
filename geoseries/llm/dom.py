"""A small DOM of block elements, and simple tree matching between two of them."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select option canvas audio video head".split())
#: Elements whose text flows into the block around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong "
    "sub sup time tt u var picture output meter progress".split()
)
#: What an opening tag ends, up to the nearest ancestor that confines it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONFINES = frozenset("ul ol dl table article section div main body html nav aside footer header form blockquote".split())
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
#: The rest of a tag, quoted values whole. It fails only where a quote has no partner in the rest of the page, once for each kind of
#: quote, so all tags together cost the length of the page; such a tag ends at its first ">".
REST = re.compile(r"""((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
TEXT = "#text"


class Node:
    __slots__ = ("tag", "names", "kids", "text", "shape", "size", "index", "parts", "links")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.kids, self.text, self.parts = tag, names, [], "", None
        self.shape, self.size, self.index = 0, 1, -1
        self.links = 0  # characters inside links: of the open run, or of a leaf

    def close(self) -> None:
        """End the open run of inline text: white space becomes one blank, character references are decoded."""
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                leaf = Node(TEXT)
                leaf.text, leaf.links = text, min(self.links, len(text))
                self.kids.append(leaf)
            self.parts, self.links = None, 0


def _names(attributes: str) -> str:
    found = []
    for name, value in NAMED.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() in ("class", "id", "role", "itemprop"):
            found.append(value)
        elif name.lower() == "hidden" or "display:none" in value.replace(" ", ""):
            found.append("hidden")
    return " ".join(found)


def parse(page: str) -> Node:
    """Tree of the page's block elements; each run of inline text is a leaf. Broken markup is closed where it must be."""
    root = Node("html")
    stack, at = [root], 0
    lower, link = None, 0  # link: how deep the stack was when a link was opened
    while True:
        m = TAG.search(page, at)
        top = stack[-1]
        text = page[at : m.start() if m else len(page)]
        if text:
            top.parts = top.parts or []
            top.parts.append(text)
            link = link if len(stack) >= link else 0
            top.links += len(text.strip()) if link else 0
        if m is None:
            break
        at = m.end()
        name, attributes = (m.group(2) or "").lower(), ""
        if name:
            rest = REST.match(page, at)
            end = rest.end() - 1 if rest else page.find(">", at)
            if end < 0:  # the page's end cuts the tag off
                break
            attributes, at = page[at:end], end + 1
        if not name:  # comment, declaration, or a slash that closes nothing
            end = page.find("-->", at) if m.group() == "<!--" else page.find(">", at)
            at = len(page) if end < 0 else end + (3 if m.group() == "<!--" else 1)
        elif m.group(1):
            if name == "br" or name in INLINE:
                link = 0 if name == "a" else link
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    for node in stack[k:]:
                        node.close()
                    del stack[k:]
                    break
                if stack[k].tag in CONFINES and name not in CONFINES:
                    break
        elif name in RAW:
            if name == "head":  # its children are left out one by one, so that a head without an end costs nothing
                continue
            if not attributes.rstrip().endswith("/") or name in ("script", "style"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{name}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
        elif name in INLINE:
            link = len(stack) if name == "a" else link
            continue
        elif name == "br":
            top.parts = top.parts or []
            top.parts.append(" ")
        elif name in VOID:
            top.close() if name == "hr" else None
        elif name in ("html", "body"):
            top.names += " " + _names(attributes) if name == "body" else ""
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in ENDS.get(name, ()):
                    for node in stack[k:]:
                        node.close()
                    del stack[k:]
                    break
                if stack[k].tag in CONFINES:
                    break
            stack[-1].close()
            node = Node(name, _names(attributes) if attributes else "")
            stack[-1].kids.append(node)
            stack.append(node)
    for node in stack:
        node.close()
    measure(root)
    return root


def measure(root: Node) -> None:
    """Sizes and shapes bottom-up, indices in page order; without recursion, as pages may nest deeply."""
    order, rest = [], [root]
    while rest:
        node = rest.pop()
        node.index = len(order)
        order.append(node)
        rest.extend(reversed(node.kids))
    for node in reversed(order):
        node.size = 1 + sum(k.size for k in node.kids)
        node.shape = hash((node.tag, *(k.shape for k in node.kids)))


def _open(a: Node, b: Node) -> bool:
    """Whether the matching of two trees has to be worked out."""
    return a.tag == b.tag and a.shape != b.shape and bool(a.kids) and bool(b.kids)


def _weight(a: Node, b: Node, memo: dict) -> int:
    """Size of the largest matching of two trees that keeps order and ancestry and starts at their roots."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    return memo[a.shape, b.shape] if a.kids and b.kids else 1


def _fill(a: Node, b: Node, memo: dict) -> None:
    """Weights of all pairs that the matching of two trees asks for, children first; without recursion, at any depth."""
    todo = [(a, b)] if _open(a, b) else []
    while todo:
        x, y = todo[-1]
        if (x.shape, y.shape) in memo:
            todo.pop()
            continue
        first, last = _ends(x.kids, y.kids)
        xs, ys = x.kids[first : len(x.kids) - last], y.kids[first : len(y.kids) - last]
        below = {(p.shape, q.shape): (p, q) for p in xs for q in ys if _open(p, q) and (p.shape, q.shape) not in memo}
        if below:
            todo.extend(below.values())
            continue
        memo[x.shape, y.shape] = 1 + sum(k.size for k in x.kids[:first]) + sum(k.size for k in x.kids[len(x.kids) - last :]) + _table(xs, ys, memo)[-1][-1]
        todo.pop()


def _ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """Equal trees at the front and at the end of two lists: pairing them is never worse than any other choice."""
    most = min(len(xs), len(ys))
    first = next((k for k in range(most) if xs[k].shape != ys[k].shape), most)
    last = next((k for k in range(most - first) if xs[-1 - k].shape != ys[-1 - k].shape), most - first)
    return first, last


def _table(xs: list[Node], ys: list[Node], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row, best = rows[-1], [0], 0
        for k, y in enumerate(ys):
            best = max(best, above[k + 1], above[k] + _weight(x, y, memo))
            row.append(best)
        rows.append(row)
    return rows


def matched(a: Node, b: Node) -> int:
    """Number of nodes that `align` pairs."""
    memo: dict = {}
    _fill(a, b, memo)
    return _weight(a, b, memo)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Matched nodes of two trees by simple tree matching (equal tags, order and ancestry kept)."""
    memo: dict = {}
    _fill(a, b, memo)
    out, rest = [], [(a, b)]
    while rest:
        x, y = rest.pop()
        out.append((x, y))
        if x.shape == y.shape:
            rest.extend(zip(x.kids, y.kids))
        elif x.kids and y.kids:
            first, last = _ends(x.kids, y.kids)
            rest.extend(zip(x.kids[:first], y.kids[:first]))
            rest.extend(zip(x.kids[len(x.kids) - last :], y.kids[len(y.kids) - last :]))
            xs, ys = x.kids[first : len(x.kids) - last], y.kids[first : len(y.kids) - last]
            rows = _table(xs, ys, memo)
            i, j = len(xs), len(ys)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    rest.append((xs[i], ys[j]))
    return out
