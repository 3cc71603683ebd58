"""HTML extraction (1): wrappers inferred as union-free regular expressions.

A page is a tree of block elements and texts. A host's wrapper begins as one
page and takes in the others one by one: aligned siblings merge, what only one
side has becomes optional, neighbours of one shape become a repeated group, and
texts that differ become slots. No alternatives arise, so the expression stays
union-free. Wrappers merge by the same step, so they are inferred where the
pages lie, and only wrappers travel.
"""

from __future__ import annotations

import html
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.store import stored

# Elements and names by which pages mark what is not the article.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr",
}
AWAY = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "audio", "video", "object", "map", "math", "label", "fieldset"}
AWAY_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscri\w+|paywall|sidebar|side-bar|widget|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toolbar|masthead|header|footer|copyright|comments?|commentlist|respond|reply|replies|discussion|disqus|share|sharing|social|related|recommend\w*|tags|author-box|login|signup|search)(?:$|[-_ ])"
)
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:article|article-?body|post-?body|post-?content|entry-?content|main-?content|story-?body|page-?content|content)(?:$|[-_ ])")
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "td", "th", "body"}
HEADINGS = {"h1", "h2"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b")
SALTS = 32
HOSTS_HELD, COPIES_HELD = 5000, 200_000
LOOKAHEAD = 4
#: Pairs of siblings that are aligned exactly; beyond, how far the next equal one may be.
CELLS, NEAR = 40_000, 64
#: Pages that must share a text before it is the template's.
LEAST_PAGES = 3
#: Part of all text that differs which the article holds.
MOST = 0.6
#: Elements that hold running text, not articles.
FLOW = {"p", "li", "dd", "dt", "td", "th", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "ul", "ol", "dl", "table", "tbody", "tr"}

_WRAPPER = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])


@dataclass
class Node:
    """An element (label: its tag and names), a text ("#"), or a group of siblings ("+"), of a page or of a wrapper.

    A text that is None is a slot. ``seen``: pages that have the node; ``chars``
    and ``links``: characters of its texts on all of them, and of these those
    in links. ``main`` marks where the article lies.
    """

    label: str
    text: str | None = None
    children: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    seen: int = 1
    chars: int = 0
    links: int = 0
    main: bool = False

    def shape(self) -> str:
        return self.label if self.label != "+" else "+" + " ".join(c.label for c in self.children)

    def every(self) -> Iterator[tuple[int, Node]]:
        """All nodes with their depth, in the page's order."""
        stack = [(0, self)]
        while stack:
            depth, n = stack.pop()
            yield depth, n
            stack += [(depth + 1, c) for c in reversed(n.children)]

    def dump(self) -> str:
        return json.dumps([[d, n.label, n.text, n.optional, n.repeated, n.seen, n.chars, n.links] for d, n in self.every()])

    @classmethod
    def load(cls, data: str) -> Node:
        path: list[Node] = []
        for d, label, text, *rest in json.loads(data):
            n = cls(label, text, [], *rest)
            del path[d:]
            if path:
                path[-1].children.append(n)
            path.append(n)
        return path[0]


def _names(attrs: str) -> str:
    """Class, id and role that tell what an element is; "!" marks what is not the article."""
    if not attrs or attrs.isspace():
        return ""
    names, away = [], False
    for k, v, hidden in _ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'").lower()
        if k in ("class", "id"):
            names += v.split()
        elif k == "role":
            names.append(v)
            away |= v in AWAY_ROLES
        elif k == "itemprop" and v == "articlebody":
            names.append("article-body")
        if hidden or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
            away = True
    names = [n for n in names if not any(c.isdigit() for c in n)]
    away |= any(AWAY_NAMES.search(n) for n in names)
    return ("." + ".".join(sorted(set(names))) if names else "") + "!" * away


def parse(page: str) -> Node:
    """The tree of blocks. Inline elements dissolve in their block's text, unless their names say that they are not the article."""
    root = Node("root")
    stack: list[tuple[str, Node]] = [("root", root)]
    held: list[str] = []
    at, low, linked, in_link = 0, None, 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1][1].children.append(Node("#", text, chars=len(text), links=min(linked, len(text))))
        linked = 0

    while m := _TAG.search(page, at):
        held.append(page[at : m.start()])
        linked += len(held[-1].strip()) * in_link
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing, attrs = (m[1] or m[4]), (m[3] or m[6] or "")
        in_link = not closing if tag == "a" else in_link
        if closing:
            if tag in INLINE and not any(t == tag for t, _ in stack):
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth and not (tag in INLINE and any(t in SCOPE for t, _ in stack[depth + 1 :])):
                flush()
                del stack[depth:]
            continue
        if tag in RAW:
            low = page.lower() if low is None or len(low) != len(page) else low
            end = low.find(f"</{tag}", at)
            if end < 0 and tag not in ("script", "style", "textarea", "title"):
                continue
            end = len(page) if end < 0 else end
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        names = _names(attrs)
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                held.append(" " if tag != "wbr" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in INLINE and not names.endswith("!"):
            continue
        if attrs.rstrip().endswith("/") and tag in ("svg", "path", "use", "g"):
            continue
        flush()
        if tag not in INLINE and stack[-1][0] == "p":  # a block ends an open paragraph
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in CLOSES.get(tag, ()):
                del stack[i:]
                break
            if stack[i][0] in SCOPE:
                break
        node = Node(f"{tag}{names}")
        stack[-1][1].children.append(node)
        stack.append((tag, node))
    held.append(page[at:])
    flush()
    return root


def _deep(depth: int = 1_000_000) -> None:
    """Pages may nest without bound: calls between Python functions do so as well."""
    if sys.getrecursionlimit() < depth:
        sys.setrecursionlimit(depth)


def fold(node: Node) -> Node:
    """Neighbours of one shape, or runs of up to LOOKAHEAD that come again, become repeated groups."""
    out: list[Node] = []
    for c in node.children:
        c = fold(c) if c.children else c
        out.append(c)
        for n in range(1, LOOKAHEAD + 1):
            if n == 1 and len(out) > 1 and out[-2].shape() == c.shape() and c.label != "#":
                b = out.pop()
                out[-1] = merge(out[-1], b, True)
                out[-1].repeated = True
                break
            if n > 1 and len(out) > n and out[-n - 1].label == "+" and [x.label for x in out[-n - 1].children] == [x.label for x in out[-n:]]:
                more = out[-n:]
                del out[-n:]
                out[-1] = Node("+", None, [merge(x, y, True) for x, y in zip(out[-1].children, more, strict=True)], False, True)
                break
            if n > 1 and len(out) >= 2 * n and [x.label for x in out[-n:]] == [x.label for x in out[-2 * n : -n]] and "+" not in (x.label for x in out[-2 * n :]):
                a, b = out[-2 * n : -n], out[-n:]
                del out[-2 * n :]
                out.append(Node("+", None, [merge(x, y, True) for x, y in zip(a, b, strict=True)], False, True))
                break
    return replace(node, children=out)


def matches(a: list[Node], b: list[Node]) -> list[tuple[int | None, int | None]]:
    """An alignment of two runs of siblings by equal shapes, in order.

    Up to CELLS pairs it has as many equal shapes as can be. Longer runs are
    parted at shapes that each side has once, and what is left of these goes by
    the next equal shape: the cost stays linear (but for a sort).
    """
    x, y = [n.shape() for n in a], [n.shape() for n in b]
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and x[i] == y[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= CELLS:
            pairs += _longest(x[i:j], y[k:m], i, k)
            continue
        once, other = _once(x, i, j), _once(y, k, m)
        both = _rising(sorted((t, other[s]) for s, t in once.items() if s in other))
        if both:
            pairs += both
            for (p, q), (r, t) in zip([(i - 1, k - 1), *both], [*both, (j, m)], strict=True):
                todo.append((p + 1, r, q + 1, t))
        else:
            pairs += _next(x, y, i, j, k, m)
    out: list[tuple[int | None, int | None]] = []
    i = k = 0
    for p, q in [*sorted(pairs), (len(x), len(y))]:
        out += [(t, None) for t in range(i, p)] + [(None, t) for t in range(k, q)]
        if p < len(x):
            out.append((p, q))
        i, k = p + 1, q + 1
    return out


def _longest(x: list[str], y: list[str], i: int, k: int) -> list[tuple[int, int]]:
    """A longest common subsequence, as places moved by i and k."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x) - 1, -1, -1):
        for q in range(len(y) - 1, -1, -1):
            best[p][q] = best[p + 1][q + 1] + 1 if x[p] == y[q] else max(best[p + 1][q], best[p][q + 1])
    out, p, q = [], 0, 0
    while p < len(x) and q < len(y):
        if x[p] == y[q]:
            out.append((i + p, k + q))
            p, q = p + 1, q + 1
        elif best[p + 1][q] >= best[p][q + 1]:
            p += 1
        else:
            q += 1
    return out


def _once(x: list[str], i: int, j: int) -> dict[str, int]:
    """Shapes that stand once in x[i:j], with their places."""
    n = Counter(x[i:j])
    return {s: t for t, s in enumerate(x[i:j], i) if n[s] == 1}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rise on both sides."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, q) in enumerate(pairs):
        k = bisect_left(tops, q)
        before[n] = at[k - 1] if k else -1
        tops[k : k + 1] = [q]
        at[k : k + 1] = [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _next(x: list[str], y: list[str], i: int, j: int, k: int, m: int) -> list[tuple[int, int]]:
    """Each of x[i:j] with the next equal one of y[k:m], if that is near."""
    places: dict[str, list[int]] = {}
    for t in range(k, m):
        places.setdefault(y[t], []).append(t)
    out = []
    for p in range(i, j):
        have = places.get(x[p], [])
        n = bisect_left(have, k)
        if n < len(have) and have[n] - k <= NEAR:
            out.append((p, have[n]))
            k = have[n] + 1
    return out


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """The least wrapper of both: of two pages (or wrappers), or of two parts of one page."""
    children = []
    for i, j in matches(a.children, b.children):
        if i is not None and j is not None:
            children.append(merge(a.children[i], b.children[j], same_page))
        else:
            children.append(replace(a.children[i] if j is None else b.children[j], optional=True))
    seen = max(a.seen, b.seen) if same_page else a.seen + b.seen
    return Node(a.label, a.text if a.text == b.text else None, children, a.optional or b.optional, a.repeated or b.repeated, seen, a.chars + b.chars, a.links + b.links)


def infer(trees: Iterator[Node]) -> Node | None:
    """A wrapper of all trees, taken in one by one."""
    found = None
    for t in trees:
        found = fold(t) if found is None else merge(found, fold(t))
    return found


def _tag(label: str) -> str:
    return label.partition(".")[0].rstrip("!")


def _away(label: str, in_article: bool) -> bool:
    return label.endswith("!") or (_tag(label) in AWAY and not (in_article and _tag(label) == "header"))


def named(wrapper: Node) -> tuple[list[Node], str]:
    """Elements that say that they hold the article, and what says so: "article", "names" or "main"."""
    found: dict[str, list[Node]] = {}

    def walk(n: Node) -> None:
        if _away(n.label, False):
            return
        if kind := _says(n.label):
            found.setdefault(kind, []).append(n)
        for c in n.children:
            walk(c)

    walk(wrapper)
    return next(((found[k], k) for k in ("article", "names", "main") if k in found), ([], ""))


def _says(label: str) -> str:
    tag = _tag(label)
    if tag in ("article", "main"):
        return tag
    if ".main" in label and tag != "body":
        return "main"
    return "names" if MAIN_NAMES.search(label.partition(".")[2].replace(".", " ")) else ""


def locate(wrapper: Node) -> Node:
    """Mark where the host's article lies.

    The evidence are the slots: the deepest element that holds most of the text
    that differs from page to page, links aside (on a host of fewer than
    LEAST_PAGES pages, most of its text). Where elements above or below this one
    say that they hold the article, they decide how far it goes; elements
    elsewhere that say so don't.
    """
    few = wrapper.seen < LEAST_PAGES
    mass: dict[int, int] = {}

    def weigh(n: Node) -> int:
        own = 0
        if not _away(n.label, False):
            own = n.chars - n.links if n.label == "#" and (few or n.text is None) else 0
            for c in n.children:
                own += weigh(c)
        mass[id(n)] = own
        return own

    total, path = weigh(wrapper), [wrapper]
    while total and (best := max(path[-1].children, key=lambda c: mass.get(id(c), 0), default=None)) and mass.get(id(best), 0) >= MOST * total:
        path.append(best)
    while len(path) > 1 and (path[-1].repeated or path[-1].label in "#+" or _tag(path[-1].label) in FLOW):
        path.pop()
    says, kind = named(wrapper)
    on_path = {id(n) for n in path}
    below = {id(n) for _, n in path[-1].every()}
    near = [n for n in says if id(n) in on_path or id(n) in below]
    for n in near or (says if not total else []) or [path[-1]]:
        n.main = True
    return wrapper


def extract(page: Node, wrapper: Node) -> list[str]:
    """The texts of a page that stand in the wrapper's main part, in order.

    A text that stands in its slot on all of LEAST_PAGES pages or more is the
    template's, as are repeated groups that are links alone, unless that would
    leave less than it takes.
    """
    out: list[tuple[str, bool]] = []

    def walk(node: Node, slot: Node | None, inside: bool, heading: bool, links: bool) -> None:
        if node.label == "#":
            if inside and not heading:
                out.append((node.text or "", links or (slot is not None and slot.text is not None and slot.seen >= LEAST_PAGES)))
            return
        if _away(node.label, inside):
            return
        inside = inside or (slot is not None and slot.main)
        if _tag(node.label) == "header":
            heading = True
        elif _tag(node.label) in HEADINGS:
            heading = False
        have: dict[str, list[Node]] = {}
        for s in slot.children if slot else ():
            for x in s.children if s.label == "+" else [s]:
                have.setdefault(x.label, []).append(x)
        for c in node.children:
            s = have.get(c.label)
            if s and len(s) > 1 and c.label == "#":  # a fixed text is its own slot
                s = [x for x in s if x.text == c.text] or [x for x in s if x.text is None] or [Node("#")]
            own = s[0] if s else None
            walk(c, own, inside, heading, links or (own is not None and own.repeated and own.seen >= LEAST_PAGES and _linked(own)))

    walk(page, wrapper, wrapper.main, False, False)
    kept = [t for t, fixed in out if not fixed]
    return kept if 2 * sum(map(len, kept)) >= sum(len(t) for t, _ in out) else [t for t, _ in out]


def _linked(n: Node) -> bool:
    """Whether all texts below are links."""
    texts = [x for _, x in n.every() if x.label == "#"]
    return bool(texts) and sum(x.links for x in texts) >= 0.95 * sum(x.chars for x in texts)


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower().rstrip(".") if m else ""


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = TaskContext.get().partitionId() % SALTS
    found: dict[str, Node] = {}
    copies: set[int] = set()
    _deep()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([salt] * len(found), pa.int32()), pa.array([w.dump() for w in found.values()], pa.string())], schema=_WRAPPER)

    for b in batches:
        for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            host = _host(url)
            if page and (copy := hash((host, page))) not in copies:  # a copy tells nothing of what the pages share
                copies.add(copy)
                tree = fold(parse(page))
                found[host] = merge(found[host], tree) if host in found else tree
        if len(found) > HOSTS_HELD or len(copies) > COPIES_HELD:
            yield rows()
            found.clear()
            copies.clear()
    yield rows()


def _unite(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    whole = None
    _deep()
    for w in sorted(table.column("wrapper").to_pylist()):
        w = Node.load(w)
        whole = w if whole is None else merge(whole, w)
    return pa.table([[key[0].as_py()], pa.array([0], pa.int32()), [whole.dump()]], schema=_WRAPPER)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON) for each host, from all its pages.

    Each task infers a wrapper of its own pages of a host. These merge in two
    steps, so that a host with a third of all pages gives no task more than
    some wrappers.
    """
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = "host string, salt int, wrapper string"
    part = rows.mapInArrow(_induce, kinds).groupBy("host", "salt").applyInArrow(_unite, kinds)
    return part.groupBy("host").applyInArrow(_unite, kinds).select("host", "wrapper")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Node] = {}
    _deep()
    for b in batches:
        texts = []
        for page, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
            if not page:
                texts.append("")
                continue
            if len(known) > 1000:
                known.clear()
            if (wrapper := known.get(w)) is None:
                wrapper = known[w] = locate(Node.load(w))
            tree = parse(page)
            found = extract(tree, wrapper) or extract(tree, locate(fold(tree)))  # without its host's article, a page stands for itself
            texts.append("\n\n".join(found))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])


#: Wrappers are broadcast up to this many bytes in all.
BROADCAST_BYTES = 64 << 20


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    The text is the article's blocks in order, joined by two line feeds; white
    space in a block is one space. The host's wrapper tells where the article
    lies and what in it is the template's; what a page holds elsewhere, and what
    its elements' names say is no article, is left out. Null or empty pages and
    pages without main text give "". Pages without a url form one host. Pages
    of any length and depth are read whole. Rows with a repeated id are all
    returned; ids may be of any type. Empty table: no rows. Other columns are
    not looked at.
    """
    found = stored(wrappers(pages, url_col, html_col), "wrappers")
    small = (found.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1), r"\.+$", ""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    joined = rows.join(F.broadcast(found) if small else found, "host", "left").select("id", "url", "html", "wrapper")
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
