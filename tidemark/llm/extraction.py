"""Main text of web pages by wrapper induction.

A page is parsed to a tree of its elements. Pages of one host are aligned by simple tree
matching: the size of the largest ordered, top-down match of two trees, found for the children
of each matched pair by dynamic programming. The host's wrapper is learned from a bounded sample
of its pages: nodes matched in all of them are template, and the slots whose text varies are
candidates for content. A slot's place in the template decides: places inside navigation,
headers, footers, asides, forms and the like, or marked so by class, id or role, are not content;
of the rest the content root is the deepest node that holds most of the varying text. Each page
is then aligned to its host's wrapper and the text below the matched root is taken, block by
block, without constant text that the template repeats. A page that does not fit its wrapper, or
whose host has one page only, takes the root with most text by the same rules.
"""

from __future__ import annotations

import html as html_text
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch
from tidemark.llm.urls import host_of

PAGES = 8  # of a host that its wrapper is learned from
DEEPEST = 200  # levels; what is nested deeper counts as part of the last
CELLS = 160_000  # pairs of children that one table of the alignment holds; longer lists are halved
CONSTANT_IN = 4  # pages of a host from which on blocks that all repeat are template
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dd", "dt", "pre", "blockquote", "table", "figure", "figcaption", "address", "hr"}
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "select", "textarea", "button"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | BOILERPLATE
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
MARKED = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar|side|footer|header|masthead|breadcrumbs?|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|related|recommend\w*|comments?|replies|disqus|widget|pagination|pager|toolbar|copyright|legal|login|signup|search)(?=$|[-_ \d])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "junk", "label", "size", "tag")

    def __init__(self, tag: str, label: str, junk: bool):
        self.tag, self.label, self.junk = tag, label, junk
        self.children: list = []  # nodes and strings, in order
        self.size = 0


def parse(page: str) -> Node:
    """Tree of the whole page; unclosed and misplaced tags are mended as browsers commonly do."""
    root = Node("#root", "#root", False)
    stack = [root]
    deeper: list[str] = []  # open elements beyond the deepest level that is kept apart
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[0] == "<":
            stack[-1].children.append("<")
            continue
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in deeper:
                while deeper.pop() != tag:
                    pass
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "td", "table") and tag not in BLOCKS:
                    break
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
        if tag in BLOCKS:  # an open paragraph ends where a block begins, inline tags in it with it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        given = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(m[3])}
        names = " ".join(given.get(k, "") for k in ("class", "id", "role"))
        junk = tag in SKIPPED or tag in BOILERPLATE or bool(MARKED.search(names)) or "hidden" in given or given.get("aria-hidden") == "true"
        node = Node(tag, f"{tag}.{names}" if names.strip() else tag, junk)
        stack[-1].children.append(node)
        if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                deeper.append(tag)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def outline(node: Node) -> tuple:
    """(label, children, node): the elements that are aligned; places of boilerplate are leaves."""
    kids: list = []

    def gather(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node):
                if c.tag in BLOCKS or c.junk:
                    kids.append(outline(c))
                else:
                    gather(c)

    if not node.junk:
        gather(node)
    return (node.label, tuple(kids), node)


def blocks_of(node: Node, junk: bool = False) -> list[str]:
    """Texts of the blocks below a node, in page order, without what is not content."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html_text.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list = [(node, 0)]
    while stack:  # by hand: pages may nest deeper than the interpreter's calls
        n, at = stack.pop()
        if at == 0 and n.tag in BLOCKS:
            flush()
        while at < len(n.children):
            c = n.children[at]
            at += 1
            if isinstance(c, str):
                line.append(c)
            elif c.tag == "br":
                line.append(" ")
            elif not c.junk or junk:
                stack.append((n, at))
                stack.append((c, 0))
                break
            elif c.tag in BLOCKS:
                flush()
        else:
            if n.tag in BLOCKS:
                flush()
    flush()
    return out


def matching(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest match, and the matched children of the roots."""
    if a[0] != b[0]:
        return 0, []
    rows, columns = len(a[1]), len(b[1])
    if rows * columns > CELLS:
        return _long_matching(a[1], b[1])
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    won = [[0] * columns for _ in range(rows)]
    for i in range(rows):
        for j in range(columns):
            won[i][j] = matching(a[1][i], b[1][j])[0]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + won[i][j])
    pairs, i, j = [], rows, columns
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return best[rows][columns] + 1, pairs[::-1]


def _long_matching(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
    """As ``matching``, for long lists of children: whole, in memory that grows with their length.

    Children of equal shape are matched once, a row of the table is one vector, and beyond
    ``CELLS`` pairs the first list is halved where the best scores from both ends meet.
    """
    ids: dict[tuple, int] = {}
    seen: dict[int, tuple] = {}

    def shape(t: tuple) -> int:
        return ids.setdefault((t[0], tuple(map(shape, t[1]))), len(ids))

    left, right = ([shape(k) for k in side] for side in (a, b))
    for sides, trees in ((left, a), (right, b)):
        seen |= dict(zip(sides, trees, strict=True))
    kinds = sorted(set(right))
    place = np.searchsorted(kinds, right)
    by_label: dict[str, list[int]] = {}
    for i, k in enumerate(kinds):
        by_label.setdefault(seen[k][0], []).append(i)
    worth: dict[int, np.ndarray] = {}

    def won(i: int) -> np.ndarray:
        """Match sizes of the i-th child of a with every kind of b's children."""
        if left[i] not in worth:
            row = np.zeros(len(kinds), dtype=np.int32)
            for k in by_label.get(a[i][0], ()):
                row[k] = matching(a[i], seen[kinds[k]])[0]
            worth[left[i]] = row
        return worth[left[i]]

    def scores(order: Iterable[int], at: np.ndarray) -> Iterator[np.ndarray]:
        """Best totals of the children so far with every prefix of b's children ``at``."""
        best = np.zeros(len(at) + 1, dtype=np.int64)
        for i in order:
            grown = np.maximum(best[1:], best[:-1] + won(i)[at])
            best = np.concatenate(([0], np.maximum.accumulate(grown)))
            yield best

    pairs: list[tuple[int, int]] = []
    total = 0
    stack = [(0, len(a), 0, len(b))]
    while stack:
        top, end, first, last = stack.pop()
        rows, columns = end - top, last - first
        if not rows or not columns:
            continue
        at = place[first:last]
        if rows * columns > CELLS and rows > 1:
            middle = top + rows // 2
            *_, upper = scores(range(top, middle), at)
            *_, lower = scores(range(end - 1, middle - 1, -1), at[::-1])
            cut = first + int(np.argmax(upper + lower[::-1]))
            stack += [(top, middle, first, cut), (middle, end, cut, last)]
            continue
        best = [np.zeros(columns + 1, dtype=np.int64), *scores(range(top, end), at)]
        i, j = rows, columns
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                total += int(best[i][j] - best[i - 1][j - 1])
                pairs.append((top + i - 1, first + j - 1))
                i, j = i - 1, j - 1
    return total + 1, sorted(pairs)


def _size(tree: tuple) -> int:
    return sum(map(len, blocks_of(tree[2])))


def likely_root(tree: tuple) -> tuple:
    """The deepest element that holds most of the page's text: an article or main if there is one."""
    total = _size(tree)
    while True:
        named = [k for k in tree[1] if k[2].tag in ("article", "main") and not k[2].junk and _size(k)]
        heavy = named or [k for k in tree[1] if not k[2].junk and k[2].tag not in LEAVES and _size(k) >= 0.8 * total]
        if not heavy:
            return tree
        tree = max(heavy, key=_size)


def learned(pages: list[str]) -> dict:
    """Wrapper of a host from some of its pages: template tree, path to the content root, constant blocks."""
    trees = [outline(parse(p)) for p in pages]
    first = trees[0]

    def common(nodes: list[tuple]) -> tuple:
        """(label, children, nodes): what the first node shares with all the others, by alignment."""
        kept = {i: [k] for i, k in enumerate(nodes[0][1])}
        for other in nodes[1:]:
            pairs = dict(matching(nodes[0], other)[1])
            kept = {i: [*k, other[1][pairs[i]]] for i, k in kept.items() if i in pairs}
        return (nodes[0][0], [common(k) for _, k in sorted(kept.items())], nodes)

    template = common(trees) if all(t[0] == first[0] for t in trees) else common([first])

    def varying(t: tuple) -> int:
        """Text below a template node that is not the same in all pages."""
        if t[2][0][2].junk:
            return 0
        texts = [blocks_of(n[2]) for n in t[2]]
        same = set(texts[0]).intersection(*map(set, texts[1:])) if len(texts) > 1 else set()
        return sum(len(b) for x in texts for b in x if b not in same)

    path, here, total = [], template, varying(template)
    while True:
        inner = [(varying(k), -i) for i, k in enumerate(here[1]) if not k[2][0][2].junk and k[2][0][2].tag not in LEAVES]
        if not inner or max(inner)[0] < 0.8 * total or not total:
            break
        path.append(-max(inner)[1])
        here = here[1][path[-1]]
    constant: list[str] = []
    if len(pages) >= CONSTANT_IN and total:
        texts = [blocks_of(n[2]) for n in here[2]]
        constant = sorted(set(texts[0]).intersection(*map(set, texts[1:])))

    def plain(t: tuple) -> list:
        return [t[0], [plain(k) for k in t[1]]]

    return {"tree": plain(template), "path": path, "constant": constant, "pages": len(pages)}


def extracted(page: str, wrapper: dict | None) -> str:
    """Main text of one page by its host's wrapper, or by the page alone if that does not fit."""
    tree = outline(parse(page))
    root = None
    if wrapper and wrapper["pages"] > 1:
        root, pattern = tree, as_tree(wrapper["tree"])
        for step in wrapper["path"]:
            pairs = dict(matching(pattern, root)[1])
            if step not in pairs:
                root = None
                break
            root, pattern = root[1][pairs[step]], pattern[1][step]
    if root is None or not (texts := blocks_of(root[2])):
        return "\n".join(blocks_of(likely_root(tree)[2]))
    kept = [t for t in texts if t not in set(wrapper["constant"])]
    return "\n".join(kept or texts)


def as_tree(plain: list) -> tuple:
    return (plain[0], tuple(as_tree(k) for k in plain[1]), None)


def _wrapped(pdf: pd.DataFrame) -> pd.DataFrame:
    """Wrapper of one host from its few sampled pages."""
    pages = list(dict.fromkeys(p for p in pdf.sort_values("draw")["html"] if p))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(learned(pages)) if pages else None]})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read: dict[str, dict] = {}
    for pdf in batches:
        for w in set(pdf["wrapper"].dropna()) - read.keys():
            if len(read) > 10_000:
                read.clear()
            read[w] = json.loads(w)
        texts = [extracted(p or "", read.get(w) or (json.loads(w) if w else None)) for p, w in zip(pdf["html"], pdf["wrapper"], strict=True)]
        yield pdf[["page_id", "url"]].assign(text=texts)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html; others ignored).

    A null or empty html has an empty text. Pages without a host share one wrapper. Repeated
    rows each keep a row and equal pages of a host have equal texts. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # A few pages of each host: drawn by hash at a rate that follows the host's size, then ranked.
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    draw = F.xxhash64("html", F.lit(29))
    keys = rows.select("host", "page_id", draw.alias("draw")).join(sizes, "host")
    few = keys.where(F.col("draw") / 2.0**64 + 0.5 < F.least(F.lit(1.0), 6.0 * PAGES / F.col("n")))
    few = few.groupBy("host", "draw").agg(F.min("page_id").alias("page_id"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("draw"))  # of about 6 * PAGES rows
    few = few.withColumn("rank", rank).where(F.col("rank") <= PAGES).select("host", "page_id", "draw")
    sample = rows.join(few, ["host", "page_id"]).where(draw == F.col("draw")).select("host", "draw", "html")
    wrappers = scratch.store(sample.groupBy("host").applyInPandas(_wrapped, "host string, wrapper string"))
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInPandas(_texts, "page_id long, url string, text string")
