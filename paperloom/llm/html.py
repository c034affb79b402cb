"""Main text of web pages by wrapper inference.

The pages of a host come from few templates. Each page becomes a tree of
labelled elements whose texts are leaves. Wrappers are inferred by aligning
trees: repeated neighbours fold into repeated groups, elements that only some
pages have become optional, texts that differ become slots, texts that never
do stay constant. The result is a union-free regular expression over elements.

The host's wrapper decides what is extracted. The article is the element with
the greatest mass of slots among those that call themselves one (or, where none
does, the one reached by going down while one child holds most of the mass).
Inside it, elements whose tag or role says that they are no article go; those
whose class only suggests it (``comments``, ``legal``) go unless they hold most
of the article's slots, and header blocks stay unless they are the same on
all pages. A constant text alone is never a reason to drop a block of the
article. Extraction walks each page along that path; a page that doesn't fit
its host's wrapper, or whose host has no other page, is a wrapper of its own.

Distribution: every page of every host takes part. A task folds its pages into
a wrapper a host, which is merged in two steps (by host and salt, by host), so
a host with a third of all pages sends at most one small tree a task. The
decisions are written as a table, a row a host, and join the pages again.

Defined cases: null or empty html gives an empty text; a null or odd url
belongs to the host ''; broken markup closes at the end of what holds it;
elements nested deeper than ``DEPTH`` count as children of the one at that
depth, so no text is lost; a long page takes memory in proportion to it;
repeated rows give repeated results; ties of mass go to the first element; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>(?:\s+|/|[^\s"'>/=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(?:>|\Z)"""
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'>/=]+)""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: A start tag that ends an open element of these, unless a fence is between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol menu table dl select".split())
#: Elements that are never part of an article.
DROP_TAGS = frozenset("nav footer aside form script style noscript template iframe svg button select textarea input dialog menu head title label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status".split())
#: Words of class and id that suggest what is not the article, and those that
#: do so outside an article only.
DROP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer bottom sidebar aside rail ad ads adv advert adverts advertisement adsense dfp sponsor sponsored promo promotion "
    "notice notices cookie cookies consent gdpr alert popup modal overlay comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login search form widget widgets pagination pager toolbar copyright legal disclaimer skip hidden".split()
)
HEAD_WORDS = frozenset("header masthead topbar banner".split())
MAIN_WORDS = frozenset("article content post entry story main maincontent".split())
#: A text is constant if it is the same on all of at least so many pages.
CONSTANT_PAGES = 3
#: Share of the mass that an element must hold to outweigh its class, and that
#: a child must hold to stand for an element that nothing marks.
MOST, NEARLY_ALL = 0.5, 0.75
DEPTH = 150
#: Wrappers that a task holds before it passes them on.
HELD_HOSTS = 2000
SALTS = 32


class Node:
    """An element: ``hard`` if it is no article by tag, role or style, ``soft``
    if its class suggests so, ``head`` if it may be a page's or an article's
    header."""

    __slots__ = ("tag", "label", "hard", "soft", "head", "main", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs.get("class", "") + " " + attrs.get("id", "")).lower())
        role = attrs.get("role", "").lower()
        self.tag, self.parts = tag, []
        self.label = " ".join([tag, *sorted(set(words)), *([f"@{role}"] if role else [])])
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I)
        self.hard = bool(tag in DROP_TAGS or role in DROP_ROLES or hidden)
        named = tag not in ("html", "body", "article", "main")
        self.soft = bool(named and DROP_WORDS.intersection(words))
        self.head = bool(tag == "header" or (named and HEAD_WORDS.intersection(words)))
        self.main = 3 if tag == "article" else 2 if tag == "main" or role == "main" else 1 if MAIN_WORDS.intersection(words) and tag in BLOCK else 0

    @classmethod
    def of(cls, label: str) -> Node:
        """An element with this label."""
        tag, *words = label.split(" ")
        role = next((x[1:] for x in words if x[0] == "@"), "")
        return cls(tag, {"class": " ".join(x for x in words if x[0] != "@"), "role": role})


class _Deep:
    """An element below ``DEPTH``: what it holds goes to the one at that depth."""

    __slots__ = ("tag", "parts")

    def __init__(self, tag: str, parts: list):
        self.tag, self.parts = tag, parts


def parse(page: str) -> Node:
    """The tree of a page; parts of a node are nodes and decoded texts."""
    root = Node("#root", {})
    stack = [root]
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            stack[-1].parts.append(entities.unescape(m["text"]))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if i > DEPTH and tag in BLOCK:
                        stack[i].parts.append(Node("div", {}))
                    del stack[i:]
                    break
            continue
        closes = ENDS.get(tag, {"p"} if tag in BLOCK and tag != "br" else ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in closes:
                del stack[i:]
                break
            if stack[i].tag in FENCES or (stack[i].tag in BLOCK and tag not in ENDS):
                break
        attrs = {(a[0] or a[4]).lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m["attrs"] or "")}
        node = Node(tag, attrs)
        opens = tag not in VOID and not (m["attrs"] or "").endswith("/")
        if len(stack) <= DEPTH or not opens:
            stack[-1].parts.append(node)
            if opens:
                stack.append(node)
        else:
            if tag in BLOCK:
                stack[-1].parts.append(Node("div", {}))
            stack.append(_Deep(tag, [] if node.hard or node.soft else stack[-1].parts))
    return root


def blocks(node: Node, plan: dict | None = None, inside: bool = False) -> list[str]:
    """The texts of a node's blocks in page order, white space collapsed,
    without what the wrapper's plan says goes."""
    kept, gone = (plan["kept"], plan["gone"]) if plan else ((), ())
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    def walk(x: Node, article: bool):
        for part in x.parts:
            if isinstance(part, str):
                run.append(part)
                continue
            block = part.tag in BLOCK
            if block:
                flush()
            if not (part.hard or (part.soft and part.label not in kept) or (part.head and (not article or part.label in gone))):
                walk(part, article or part.tag == "article")
            if block:
                flush()

    walk(node, inside or node.tag == "article")
    flush()
    return out


# ---- wrappers: [label, pages, repeated, text, children] --------------------
# text: None for elements; for leaves [hash or None for a slot, characters].


def _leaf(texts: list[str]) -> list:
    text = " ".join("".join(texts).split())
    return ["#", 1, 0, [zlib.crc32(text.encode("utf-8", "replace")), len(text)], []]


def tree(node: Node) -> list:
    """A page's tree as a wrapper of one page: inline elements melt into the
    texts around them."""
    kids, run = [], []

    def flush():
        if "".join(run).strip():
            kids.append(_leaf(run))
        run.clear()

    def walk(x: Node):
        for part in x.parts:
            if isinstance(part, str):
                run.append(part)
            elif part.tag not in BLOCK:
                if not part.hard and not part.soft:
                    walk(part)
            else:
                flush()
                if part.tag not in VOID:
                    kids.append(tree(part))

    walk(node)
    flush()
    return [node.label, 1, 0, None, fold(kids)]


def fold(kids: list[list]) -> list[list]:
    """Tandem repeats of up to four labels become repeated groups."""
    for width in (1, 2, 3, 4):
        out: list[list] = []
        for kid in kids:
            out.append(kid)
            if len(out) >= 2 * width and [k[0] for k in out[-width:]] == [k[0] for k in out[-2 * width : -width]]:
                again = out[-width:]
                del out[-width:]
                for i, k in enumerate(again):
                    pages = max(out[i - width][1], k[1])
                    out[i - width] = merge(out[i - width], k)
                    out[i - width][1:3] = [pages, 1]
        kids = out
    return kids


def merge(a: list, b: list) -> list:
    """Align two wrappers with the same label."""
    text = None
    if a[3] is not None:
        text = [a[3][0] if a[3][0] == b[3][0] else None, a[3][1] + b[3][1]]
    return [a[0], a[1] + b[1], a[2] | b[2], text, fold(_align(a[4], b[4]))]


def _align(xs: list[list], ys: list[list]) -> list[list]:
    """Children by longest common sequence of labels; the rest are optional."""
    if [x[0] for x in xs] == [y[0] for y in ys]:
        return [merge(x, y) for x, y in zip(xs, ys)]
    n, m = len(xs), len(ys)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if xs[i][0] == ys[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and xs[i][0] == ys[j][0]:
            out.append(merge(xs[i], ys[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(xs[i])
            i += 1
        else:
            out.append(ys[j])
            j += 1
    return out


def expression(w: list) -> str:
    """A wrapper as a union-free regular expression, for people."""
    if w[3] is not None:
        body = "#SLOT" if w[3][0] is None else f"#{w[3][0]:08x}"
    else:
        body = f"<{w[0]}>" + "".join(expression(k) if k[1] >= w[1] or k[2] else f"({expression(k)})?" for k in w[4]) + "</>"
    return f"({body})+" if w[2] else body


def decide(w: list) -> dict:
    """What a wrapper says about its pages: ``path``, labels from the root to
    the article's element; ``kept``, labels inside whose class doesn't count;
    ``gone``, labels of headers that are the same on all pages."""
    marks: dict[str, Node] = {}

    def of(label: str) -> Node:
        if label not in marks:
            marks[label] = Node.of(label)
        return marks[label]

    def constant(x: list) -> bool:
        return x[3][0] is not None and x[1] >= CONSTANT_PAGES

    def mass(x: list, dropping: bool = True) -> int:
        """Characters in slots."""
        if x[3] is not None:
            return 0 if constant(x) else x[3][1]
        m = of(x[0])
        return 0 if m.hard or (dropping and m.soft) else sum(mass(k, dropping) for k in x[4])

    whole, best = mass(w, False), (0, 0, [], w)

    def enters(k: list) -> bool:
        m = of(k[0])
        return k[3] is None and not m.hard and (not m.soft or mass(k, False) > MOST * whole)

    def walk(x: list, path: list[str]):
        nonlocal best
        for k in filter(enters, x[4]):
            size = mass(k, False)
            if of(k[0]).main and size and (of(k[0]).main, size) > best[:2]:
                best = (of(k[0]).main, size, [*path, k[0]], k)
            walk(k, [*path, k[0]])

    walk(w, [])
    path, node = best[2], best[3]
    while not best[2]:
        kids = [(mass(k), k) for k in node[4] if enters(k)]
        top = max(kids, key=lambda x: x[0], default=(0, None))
        if not top[0] or top[1][2] or top[0] < NEARLY_ALL * mass(node):
            break  # nothing, a repeated group, or no child stands for the whole
        node = top[1]
        path = [*path, node[0]]
    slots = mass(node, False)
    kept, gone = set(), set()

    def judge(x: list):
        for k in x[4]:
            if k[3] is None and not of(k[0]).hard:
                size = mass(k, False)
                if of(k[0]).soft and size > MOST * slots:
                    kept.add(k[0])
                if of(k[0]).head and slots and not size and k[1] >= CONSTANT_PAGES:
                    gone.add(k[0])
                judge(k)

    judge(node)
    return {"path": path, "kept": sorted(kept), "gone": sorted(gone)}


def _follow(root: Node, path: list[str]) -> Node | None:
    """The node at a path of labels; of several, the one with most text."""
    found = [root]
    for label in path:
        found = [p for x in found for p in x.parts if isinstance(p, Node) and p.label == label]
    return max(found, key=lambda x: sum(map(len, blocks(x)))) if len(found) > 1 else found[0] if found else None


def extract(page: str | None, plan: dict | None = None) -> str:
    """The main text of a page, as its host's wrapper says where it fits."""
    if not page:
        return ""
    root = parse(page)
    for own in (plan, None):
        own = own or decide(tree(root))
        node = _follow(root, own["path"])
        found = blocks(node, own) if node is not None else []
        if found:
            return " ".join(found)
    return ""


# ---- distribution ---------------------------------------------------------


def host():
    """The host of a url; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


_WRAPPER = "host string, salt int, wrapper string"


def _merged(texts: list[str]) -> str:
    trees = sorted((json.loads(t) for t in texts), key=lambda t: (-t[1], json.dumps(t)))
    out = trees[0]
    for t in trees[1:]:
        out = merge(out, t)
    return json.dumps(out, separators=(",", ":"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON), over every page of every host."""

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, list] = {}

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()])], ["host", "salt", "wrapper"])

        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tree(parse(page))
                held[name] = merge(held[name], own) if name in held else own
                if len(held) >= HELD_HOSTS:
                    yield batch_of()
                    held.clear()
        if held:
            yield batch_of()

    def join(table):
        import pyarrow as pa

        return pa.table({"host": table["host"].slice(0, 1), "salt": table["salt"].slice(0, 1), "wrapper": pa.array([_merged(table["wrapper"].to_pylist())])})

    parts = pages.where("html is not null").select(host().alias("host"), "html").mapInArrow(gather, _WRAPPER)
    parts = parts.groupBy("host", "salt").applyInArrow(join, _WRAPPER)
    return parts.groupBy("host").applyInArrow(join, _WRAPPER).select("host", "wrapper")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def plans(batches):
        import pyarrow as pa

        for batch in batches:
            found = [json.dumps(decide(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "plan"])

    def apply(batches):
        import pyarrow as pa

        kept: dict = {}
        for batch in batches:
            out = []
            for page, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if found not in kept:
                    if len(kept) > HELD_HOSTS:
                        kept.clear()
                    kept[found] = json.loads(found) if found else None
                out.append(extract(page, kept[found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # As a table: its size is known then, so a small one goes with the tasks and
    # the pages of a large host are not gathered.
    decided = cut(wrappers(pages).mapInArrow(plans, "host string, plan string"), "plans")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    rows = rows.join(decided, "host", "left").select("page_id", "url", "html", "plan")
    return rows.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
