"""Main text of web pages by wrapper induction.

Texts that most of a host's distinct pages hold at the same tag path are the host's template; every page counts. The
trees of elements (without paragraphs and the like) of a host's frequent layouts are its wrappers; every page is aligned
with the one that fits it best by simple tree matching, and what all pages hold at a wrapper's nodes (presence, text
length, share of links, number of distinct texts) chooses the main node and the boilerplate nodes in it. A page's text is
what is left of the main node. Rules on tags and class names leave out further menus, headers, footers, side bars,
notices, adverts, forms and comments, and choose the main element where a host has too few pages.
"""

from __future__ import annotations

import json
import re
import zlib
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, staged
from geoseries.llm.dom import TEXT, Node, align, matched, measure, parse

#: Share of a host's distinct pages, and least number of them, that must share a text for it to be template.
SHARE, LEAST = 0.5, 3.0
#: Share of a host's distinct pages that must have a layout for it to be a wrapper, besides the most frequent one.
LAYOUT = 0.05
#: Least share of a wrapper's nodes that a page must match.
FITS = 0.5
#: A node holds boilerplate if so much of its text is links, or if it has so few distinct texts a text found there.
LINKS, ROTATING = 0.5, 0.2
#: The main node is sought in the child with this share of the text; an element with so much own text a page is not left.
HEAVY, OWN = 0.7, 10.0
#: Bytes of the hosts' wrappers that may be broadcast; beyond, pages and wrappers are joined by host.
BROADCAST_BYTES = 16 << 20
#: Elements of running text, whose number differs from page to page; a wrapper counts their text to the element around.
FLOW = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption caption tbody thead tfoot tr td th address hr details summary".split()
)
OUTSIDE = frozenset("nav aside footer form menu dialog button fieldset".split())
#: Words in class, id or role that mark what is not the article.
ROLES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navigation|navbar|menu|breadcrumbs?|"
    r"side-?bar|widgets?|complementary|footer|contentinfo|masthead|site-header|page-header|cookies?|consent|gdpr|notices?|alert|dialog|modal|popup|overlay|"
    r"newsletter|subscri(?:be|ption)|sign-?up|login|search|share|sharing|social|related|recommend(?:ed|ations)?|comments?|comment-?list|commentlist|"
    r"respond|disqus|replies|hidden|skip-link|pagination|toolbar)(?=$|[\s_-])"
)
MAIN = re.compile(r"(?:^|\s)(?:main|articlebody)(?:$|\s)")


def _outside(node: Node, within: bool) -> bool:
    if node.tag in OUTSIDE or node.tag == "header" and not within:
        return True
    return bool(node.names) and node.tag not in ("html", "body") and bool(ROLES.search(node.names))


def _slots(node: Node, constant: set[int], dropped: frozenset[int] = frozenset(), rules: bool = True) -> list[tuple[Node, tuple[Node, ...]]]:
    """Text leaves outside of boilerplate, in page order, with their ancestors. `constant` and `dropped` hold indices of
    template leaves and of boilerplate elements."""
    out, rest = [], [(node, (), False)]
    while rest:
        at, above, inside = rest.pop()
        if at.tag == TEXT:
            if at.index not in constant:
                out.append((at, above))
            continue
        if above and (at.index in dropped or rules and _outside(at, inside)):
            continue
        inside = inside or at.tag in ("article", "main")
        rest.extend((kid, (*above, at), inside) for kid in reversed(at.kids))
    return out


def main_blocks(page: Node, constant: set[int], main: Node | None = None, dropped: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the slots in the main element. That is the wrapper's `main`, or the article that holds or fills it; where
    there is none, the article (or main) with the most text, else the deepest element that holds most of the page's text."""
    slots = _slots(page, constant, dropped)
    weight: dict[int, int] = {}
    for leaf, above in slots:
        for node in above:
            weight[id(node)] = weight.get(id(node), 0) + len(leaf.text)
    if main is not None and not weight.get(id(main)):  # the rules leave nothing of it
        return [leaf.text for leaf, above in _slots(page, constant, dropped, rules=False) if any(n is main for n in above)]
    chosen = None
    for kind in (lambda n: n.tag == "article", lambda n: n.tag == "main" or MAIN.search(n.names)):
        found = {id(n): n for _, above in slots for n in above if kind(n)}
        if main is not None:
            holds = {id(n) for _, above in slots if any(n is main for n in above) for n in above[: next(i for i, n in enumerate(above) if n is main)]}
            within = {id(n) for _, above in slots if any(n is main for n in above) for n in above} - holds
            found = {i: n for i, n in found.items() if i in holds or i in within and weight[i] >= HEAVY * weight[id(main)]}
        if found:
            chosen = max(found.values(), key=lambda n: weight[id(n)])
            break
    if chosen is None:
        chosen = main
    if chosen is None:
        chosen = page
        while True:
            heavy = [k for k in chosen.kids if k.kids and weight.get(id(k), 0) >= 0.7 * weight.get(id(chosen), 1) and k.tag not in ("p", "li")]
            if not heavy:
                break
            chosen = heavy[0]
    return [leaf.text for leaf, above in slots if any(n is chosen for n in above)]


def _number(text: str, key: int = 0) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=key.to_bytes(4, "big")).digest(), "big", signed=True)


class Layout:
    """Tree of a page's elements without running text: `elements` of the page by place in the tree, and `leaves` of the
    page, each with its place and the number of its tag path and text."""

    def __init__(self, page: Node):
        self.root, self.elements, self.leaves, tags = Node(page.tag), [], [], []
        rest: list = [(page, None, -1, 0)]
        while rest:
            at, under, place, path = rest.pop()
            if at is None:
                tags.append("/")
            elif at.tag == TEXT:
                self.leaves.append((at, place, _number(at.text, path)))
            else:
                path = zlib.crc32(at.tag.encode("utf-8", "surrogatepass"), path)
                if at.tag not in FLOW:
                    node = Node(at.tag) if under else self.root
                    if under:
                        under.kids.append(node)
                    place, under = len(self.elements), node
                    self.elements.append(at)
                    tags.append(at.tag)
                    rest.append((None, None, 0, 0))
                rest.extend((kid, under, place, path) for kid in reversed(at.kids))
        measure(self.root)
        self.tags = " ".join(tags)
        self.number = _number(self.tags)


def _tree(tags: str) -> Node:
    root, stack = None, []
    for tag in tags.split(" "):
        if tag == "/":
            stack.pop()
            continue
        node = Node(tag)
        if stack:
            stack[-1].kids.append(node)
        root = root or node
        stack.append(node)
    measure(root)
    return root


def _fit(number: int, root: Node, wrappers: list[dict]) -> tuple[dict | None, dict[int, int]]:
    """The wrapper that matches a tree best, with the wrapper's place of each matched place of the tree."""
    for w in wrappers:
        if w["layout"] == number:
            return w, {i: i for i in range(root.size)}
    best, found = 0.0, None
    for w in wrappers:
        same = matched(root, w["root"])
        if same >= FITS * w["root"].size and 2 * same / (root.size + w["root"].size) > best:
            best, found = 2 * same / (root.size + w["root"].size), w
    return found, {x.index: y.index for x, y in align(root, found["root"])} if found else {}


class _Wrappers:
    """Parsed wrappers of the hosts a task meets; a bounded number is kept."""

    def __init__(self):
        self.held: dict[str, dict | None] = {}

    def __call__(self, host: str, wrapper) -> dict | None:
        if host not in self.held:
            if len(self.held) >= 256:
                self.held.clear()
            text = wrapper.as_py()
            found = json.loads(text) if text else None
            if found:
                for w in found["layouts"]:
                    w["root"] = _tree(w["tags"])
                found["constant"] = frozenset(found.get("constant") or ())
            self.held[host] = found
        return self.held[host]


def text_of(html: str, wrapper: dict | None = None) -> str:
    page = parse(html)
    if wrapper is None:
        return "\n\n".join(main_blocks(page, set()))
    layout = Layout(page)
    constant = {leaf.index for leaf, _, number in layout.leaves if number in wrapper["constant"]}
    fit, places = _fit(layout.number, layout.root, wrapper["layouts"])
    if fit is None:
        return "\n\n".join(main_blocks(page, constant))
    at = {there: here for here, there in places.items()}
    main = layout.elements[at[fit["main"]]] if fit["main"] > 0 and fit["main"] in at else None
    return "\n\n".join(main_blocks(page, constant, main, frozenset(layout.elements[at[d]].index for d in fit["dropped"] if d in at)))


def _with_wrapper(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    # Beyond the bound Spark joins by host; it splits the partition of a hot host, whose other side is one row.
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [f for f, _ in fields])


LEAVES = "host string, layout long, node int, leaf long, tags string, n double, chars double, links double"
NODES = "host string, layout long, node int, n double, chars double, links double, times double, texts double"
CHOSEN = "host string, layout long, main int, dropped array<int>"


def _leaves(batches):
    """Sums over pages for each leaf text at each node of each layout; node -1 stands for the layout itself."""
    sums: dict[tuple, list] = {}
    for batch in rows_of(batches):
        for host, html, weight in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "weight"))):
            page = parse(html)
            layout = Layout(page)
            seen_by_rules = {leaf.index for leaf, _ in _slots(page, set())}
            found, seen = sums.setdefault((host, layout.number, -1, 0), [layout.tags, 0.0, 0.0, 0.0]), set()
            found[1] += weight
            for leaf, place, number in layout.leaves:
                found = sums.setdefault((host, layout.number, place, number), [None, 0.0, 0.0, 0.0])
                if number not in seen:  # a page counts a text once
                    found[1] += weight
                    seen.add(number)
                if not seen_by_rules or leaf.index in seen_by_rules:
                    found[2] += weight * len(leaf.text)
                    found[3] += weight * leaf.links
        if len(sums) > 50_000:
            yield _table([(*k, *v) for k, v in sums.items()], LEAVES)
            sums = {}
    yield _table([(*k, *v) for k, v in sums.items()], LEAVES)


def _nodes(batches):
    """Sums of layouts brought to the nodes of the wrappers; what a wrapper lacks counts to the nearest element it has."""
    parsed = _Wrappers()
    for batch in rows_of(batches):
        out = []
        for i, row in enumerate(batch.drop_columns(["wrapper"]).to_pylist()):
            wrapper, root = parsed(row["host"], batch.column("wrapper")[i]), _tree(row["tags"])
            fit, places = _fit(row["layout"], root, wrapper["layouts"]) if wrapper else (None, {})
            if fit is None:
                continue
            near, rest = {}, [(root, 0)]
            while rest:
                node, above = rest.pop()
                near[node.index] = places.get(node.index, above)
                rest.extend((k, near[node.index]) for k in node.kids)
            out += [(row["host"], fit["layout"], there, row["n"], 0.0, 0.0, 0.0, 0.0) for there in places.values()]
            out += [(row["host"], fit["layout"], near[s["node"]], 0.0, s["chars"], s["links"], s["times"], s["texts"]) for s in row["stats"] or ()]
        yield _table(out, NODES)


def choose(root: Node, sums: dict[int, dict]) -> tuple[int, list[int]]:
    """Place of a wrapper's main node and places of the boilerplate nodes in it, from the sums over pages at its nodes."""
    order, rest = [], [root]
    while rest:
        order.append(rest.pop())
        rest.extend(reversed(order[-1].kids))
    names = ("chars", "links", "times", "texts")
    total = {n.index: [sums.get(n.index, {}).get(k) or 0.0 for k in names] for n in order}
    pages = {n.index: sums.get(n.index, {}).get("n") or 0.0 for n in order}
    own = {i: 0.0 if texts < ROTATING * times else chars - links for i, (chars, links, times, texts) in total.items()}
    mass = dict(own)
    for node in reversed(order):
        for kid in node.kids:
            total[node.index] = [a + b for a, b in zip(total[node.index], total[kid.index])]
            mass[node.index] += mass[kid.index]
    main = root
    while own[main.index] < OWN * pages[main.index]:
        heavy = [k for k in main.kids if mass[k.index] > 0 and mass[k.index] >= HEAVY * mass[main.index]]
        if not heavy:
            break
        main = heavy[0]
    dropped, rest = [], list(main.kids)
    while rest:
        node = rest.pop()
        chars, links, times, texts = total[node.index]
        if pages[node.index] >= SHARE * pages[main.index] and chars > 0 and (links >= LINKS * chars or texts < ROTATING * times):
            dropped.append(node.index)
        else:
            rest.extend(node.kids)
    return main.index, sorted(dropped)


def _chosen(batches):
    for batch in rows_of(batches):
        rows = batch.to_pylist()
        picked = [choose(_tree(r["tags"]), {s["node"]: s for s in r["sums"]}) for r in rows]
        yield _table([(r["host"], r["layout"], *p) for r, p in zip(rows, picked)], CHOSEN)


def induce(pages: DataFrame) -> DataFrame:
    """`host`, `wrapper`: JSON of `constant` (numbers of template texts) and `layouts` (`tags`, `main`, `dropped`).

    `pages` has `host`, `html`, `digest`. Pages that repeat another's html count once, by weights. Hosts with fewer than
    LEAST distinct pages have no row.
    """
    full = pages.filter("html <> ''")
    copies = staged(full.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    weighted = full.join(copies, ["host", "digest"], "left").select("host", "html", (1 / F.coalesce("n", F.lit(1))).alias("weight"))
    leaves = weighted.mapInArrow(_leaves, LEAVES).groupBy("host", "layout", "node", "leaf")
    leaves = staged(leaves.agg(F.max("tags").alias("tags"), *(F.sum(c).alias(c) for c in ("n", "chars", "links"))), "leaves")

    layouts = leaves.filter("node < 0").select("host", "layout", "tags", "n")
    totals = layouts.groupBy("host").agg(F.sum("n").alias("total"), F.max_by("layout", F.struct("n", "layout")).alias("top"))
    totals = staged(totals.filter(F.col("total") > LEAST - 0.001), "totals")
    leaves = leaves.filter("node >= 0")
    common = leaves.groupBy("host", "leaf").agg(F.sum("n").alias("shared")).filter(F.col("shared") > LEAST - 0.001)
    common = common.join(totals, "host").filter(F.col("shared") >= SHARE * F.col("total") - 0.001)
    common = staged(common.select("host", "leaf"), "constants")  # at most 1 / SHARE times one page's texts a host

    sums = (F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("n").alias("times"), F.count(F.lit(1)).cast("double").alias("texts"))
    nodes = leaves.join(common, ["host", "leaf"], "left_anti").groupBy("host", "layout", "node").agg(*sums)
    stats = nodes.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "chars", "links", "times", "texts")).alias("stats"))
    layouts = staged(layouts.join(totals, "host").join(stats, ["host", "layout"], "left"), "layouts")
    frequent = layouts.filter((F.col("layout") == F.col("top")) | (F.col("n") > LEAST - 0.001) & (F.col("n") >= LAYOUT * F.col("total")))
    frequent = frequent.select("host", "layout", "tags")
    trees = frequent.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("layout", "tags"))).alias("layouts"))
    trees = staged(trees.select("host", F.to_json(F.struct("layouts")).alias("wrapper")), "trees")

    sums = _with_wrapper(layouts.select("host", "layout", "tags", "n", "stats"), trees).mapInArrow(_nodes, NODES)
    sums = sums.groupBy("host", "layout", "node").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "links", "times", "texts")))
    sums = sums.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "n", "chars", "links", "times", "texts")).alias("sums"))
    chosen = frequent.join(sums, ["host", "layout"]).mapInArrow(_chosen, CHOSEN).join(frequent, ["host", "layout"])
    chosen = chosen.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("layout", "tags", "main", "dropped"))).alias("layouts"))
    constant = common.groupBy("host").agg(F.collect_list("leaf").alias("constant"))
    found = chosen.join(constant, "host", "left")
    return staged(found.select("host", F.to_json(F.struct("layouts", "constant")).alias("wrapper")), "templates")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars` of every page; a null or empty html gives an empty text.

    Pages without a url (or with one that names no host) are aligned with one another. Repeated rows give repeated rows;
    other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    source = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"),
        host.alias("host"),
    )
    wrappers = induce(source.select("host", "html", F.md5("html").alias("digest")))

    def run(batches):
        parsed = _Wrappers()
        for batch in rows_of(batches):
            hosts, bodies = batch.column("host").to_pylist(), batch.column("html").to_pylist()
            shapes = batch.column("wrapper")
            texts = [text_of(b, parsed(h, w)) for h, b, w in zip(hosts, bodies, shapes)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return _with_wrapper(source, wrappers).mapInArrow(run, "page_id long, url string, text string, n_chars long")
