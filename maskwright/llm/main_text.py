"""Main text of web pages by composite text density.

A page becomes a tree as browsers build it (implied ends of paragraphs, items and cells; raw text of scripts; unknown end
tags). Elements that never belong to an article, by their tag, role, class or id, are taken out. For every other node the density is its
characters for each tag, adjusted by its share of link characters and link tags against the page's; a node's density sum adds up its
children's. The node of the greatest sum is the heart of the article, and the least density on the way from it to the body
is the threshold: what stands beside the heart or above is kept if it is running text, or at least that dense and not mostly
links. A heart inside an article element is completed to the outermost one.

White space inside a block becomes one space, also a line break; blocks are joined by a line feed. Character references are decoded. Null or empty
pages, and pages without text, give the empty text; text without any tag is one block. Pages of any size and depth are taken whole, in linear time; repeated rows
give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from .common import blocks, table


def _words(text: str) -> frozenset:
    return frozenset(text.split())


#: Fixed values of HTML: elements without content, elements whose content is no markup, elements of a head, and blocks.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style title textarea iframe xmp noembed noframes")
HEAD = _words("base link meta noscript script style template title")
BLOCKS = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul"
)
#: Start tags that end an open element, and the elements that such an end can't reach across.
ENDS_P = BLOCKS - _words("body caption html legend option optgroup tbody td tfoot th thead title tr")
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "a": ("a",)}
WALLS = {"p": ("button", "caption", "object", "table", "td", "th"), "li": ("ol", "ul", "menu", "table"), "dt": ("dl",), "dd": ("dl",), "a": ("td", "th")}
CELLS = ("td", "th", "caption", "object")
#: Elements that are no part of an article, and words of roles, classes and ids that say so.
APART = _words("aside button canvas datalist dialog footer form head iframe input menu nav noembed noframes noscript object script search select style svg template textarea title audio video map")
ROLES = _words("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar")
SURE = _words(
    "ad ads adsense advert advertisement advertising adverts breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu nav navbar navigation "
    "newsletter pagination sidebar sponsor sponsored subscribe"
)
VAGUE = _words("alert aside banner disclaimer header login masthead modal notice notices overlay pager popup promo related replies search share sharing signup skip social toolbar topbar widget widgets")
FLOW = _words("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure hgroup")
HEADINGS = _words("h1 h2 h3 h4 h5 h6 hgroup")

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["']))*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[-_]\S+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in RAW}


class _Tree:
    """Nodes in document order, 0 is the body; pieces are (node, text), or (node, None) between two blocks."""

    def __init__(self):
        self.parent, self.tag, self.mark, self.pieces = [-1], ["body"], [0], []
        self.stack, self.open = [0], defaultdict(list)
        self.blocks = [0]

    def start(self, name: str, mark: int) -> None:
        if name in ENDS_P:
            self._imply(("p",), WALLS["p"])
        if name in ENDS:
            self._imply(ENDS[name], WALLS.get(name, ("table",)))
        if name in BLOCKS:
            self.pieces.append((self.stack[-1], None))
        self.parent.append(self.stack[-1])
        self.tag.append(name)
        self.mark.append(mark)
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.open[name].append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def _wall(self, names) -> int:
        return max((self.open[w][-1] for w in names if self.open[w]), default=0)

    def _imply(self, names, walls) -> None:
        wall = self._wall(walls)
        at = min((self.open[n][-1] for n in names if self.open[n] and self.open[n][-1] > wall), default=0)
        if at:
            self._cut(at)

    def end(self, name: str) -> None:
        at = self.open[name][-1] if self.open[name] else 0
        reach = self._wall(CELLS) if name in BLOCKS and name not in ("table", "tr", "tbody", "thead", "tfoot") else 0
        if name not in BLOCKS:  # the end of an inline element doesn't end the blocks in it
            reach = self.blocks[-1]
        if at > reach or at and at == reach and name in CELLS:
            self._cut(at)

    def _cut(self, at: int) -> None:
        while len(self.stack) > at:
            node = self.stack.pop()
            name = self.tag[node]
            self.open[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
                self.pieces.append((node, None))

    def text(self, data: str) -> None:
        if data:
            self.pieces.append((self.stack[-1], unescape(data)))


def _mark(name: str, attributes: str) -> int:
    """2: apart for sure; 1: perhaps, by a vague word; 0: not."""
    if name in APART:
        return 2
    if not attributes or name in ("article", "main", "a"):
        return 0
    if "hidden" in attributes and _HIDDEN.search(re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", "=", attributes)):
        return 2
    found = 0
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"(?i)display\s*:\s*none", value):
            return 2
        if key in ("class", "id"):
            parts = {p.lower() for p in _PART.findall(_ABOUT.sub(" ", value))}
            if parts & SURE:
                return 2
            found |= bool(parts & VAGUE)
    return int(found)


def tree_of(html: str) -> _Tree:
    tree, at = _Tree(), 0
    while found := _TAG.search(html, at):
        tree.text(html[at : found.start()])
        at = found.end()
        comment, other, slash, name = found.groups()
        if comment or other:
            close = html.find("-->" if comment else ">", max(at - 2, 0) if comment else at)
            at = len(html) if close < 0 else close + (3 if comment else 1)
            continue
        rest = _REST.match(html, at)
        if not rest:  # a tag that never closes goes up to the end of the page
            at = len(html)
            break
        attributes, at, name = rest[0][:-1], rest.end(), name.lower()
        if tree.open["head"] and name not in HEAD and name != "head":
            tree._cut(tree.open["head"][-1])
        if name in ("html", "body"):
            continue
        if name == "br":
            tree.text(" ")
        elif slash:
            tree.end(name)
        elif name in VOID:
            if name == "hr":
                tree._imply(("p",), WALLS["p"])
                tree.pieces.append((tree.stack[-1], None))
        else:
            tree.start(name, _mark(name, attributes))
            if name in RAW:
                end = _END[name].search(html, at)
                at = end.start() if end else len(html)
    tree.text(html[at:])
    tree._cut(1)
    return tree


def _apart(tree: _Tree) -> list[bool]:
    """Whether a node is taken out. A word in a class or id doesn't count for what holds an article, or a title and most of the text of
    paragraphs, a vague word not for what holds most of it, a word after has- or no- never, and a header inside an article belongs to it."""
    n = len(tree.tag)
    inside, holds, text, title = [False] * n, [False] * n, [0] * n, [False] * n
    tagged = [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or tree.tag[tree.parent[i]] in ("article", "main")
        tagged[i] = tagged[tree.parent[i]] or tree.tag[i] in APART
    for node, data in tree.pieces:
        if data and not tagged[node]:
            text[node] += len(data.strip()) * (tree.tag[node] not in ("a", "div", "span", "li"))
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] |= holds[i] or tree.tag[i] in ("article", "main")
        title[tree.parent[i]] |= title[i] or tree.tag[i] == "h1"
        text[tree.parent[i]] += text[i]
    out = [False] * n
    for i in range(1, n):
        header = tree.tag[i] == "header" and not inside[i]
        named = tree.tag[i] in APART or tree.mark[i] == 2 and not holds[i] and not (title[i] and 2 * text[i] >= text[0])
        vague = tree.mark[i] == 1 and not inside[i] and not holds[i] and 2 * text[i] <= text[0]
        out[i] = out[tree.parent[i]] or header or named or vague
    return out


def densities(parent: list[int], chars: list[int], link_chars: list[int], links: list[bool]) -> list[float]:
    """Composite text density of nodes in document order, given each node's own characters."""
    n = len(parent)
    c, lc, t, lt = list(chars), list(link_chars), [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        c[p] += c[i]
        lc[p] += lc[i]
        t[p] += t[i] + 1
        lt[p] += lt[i] + links[i]
    share = lc[0] / max(c[0], 1)
    out = []
    for i in range(n):
        if not c[i]:
            out.append(0.0)
            continue
        tags, link, link_tags = max(t[i], 1), max(lc[i], 1), max(lt[i], 1)
        base = math.log(math.log(c[i] / max(c[i] - lc[i], 1) * link + share * c[i] + math.e))
        out.append(c[i] / tags * math.log(max(1.0, c[i] / link * tags / link_tags)) / base)
    return out


def _chosen(tree: _Tree, apart: list[bool]) -> list[bool]:
    """Whether the text of a node belongs to the article."""
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    link = [False] * n
    for i in range(1, n):
        link[i] = link[parent[i]] or tag[i] == "a"
    chars, link_chars = [0] * n, [0] * n
    for node, data in tree.pieces:
        if data and not apart[node]:
            size = len(data.strip())
            chars[node] += size
            link_chars[node] += size * link[node]
    alive = [i for i in range(n) if not apart[i]]
    at = {node: k for k, node in enumerate(alive)}
    up = [at.get(parent[i], -1) for i in alive]
    density = densities(up, [chars[i] for i in alive], [link_chars[i] for i in alive], [tag[i] == "a" for i in alive])
    total, sums = [chars[i] for i in alive], [0.0] * len(alive)
    linked, articles = [link_chars[i] for i in alive], [tag[i] == "article" for i in alive]
    for k in range(len(alive) - 1, 0, -1):
        total[up[k]] += total[k]
        linked[up[k]] += linked[k]
        sums[up[k]] += density[k]
        articles[up[k]] = articles[up[k]] or articles[k]
    outer = [-1] * len(alive)  # the outermost article of a node
    for k in range(1, len(alive)):
        outer[k] = outer[up[k]] if outer[up[k]] >= 0 else k if tag[alive[k]] == "article" and total[k] else -1
    within = any(k >= 0 for k in outer)
    heart = max((k for k in range(len(alive)) if not within or outer[k] >= 0), key=lambda k: (sums[k] + (density[k] if within and not sums[k] else 0), -k))
    path = [heart]
    while path[-1]:
        path.append(up[path[-1]])
    threshold = min(density[k] for k in path)
    keep = [False] * len(alive)
    if within:
        keep[outer[heart]] = True
    else:
        on_path, mostly_links = {k: step for step, k in enumerate(path)}, lambda k: 2 * linked[k] > total[k]
        keep[heart] = heart > 0
        for k in range(1, len(alive)):
            step = on_path.get(up[k])
            if k in on_path or not step and up[k] != 0:
                continue
            if step is not None and (heart == 0 or step > 0) and not mostly_links(k):
                name = tag[alive[k]]
                running = name not in BLOCKS or name in FLOW and (step <= 1 or name in HEADINGS)
                keep[k] = running or density[k] >= threshold
    for k in range(1, len(alive)):
        keep[k] = keep[k] or keep[up[k]]
    if not within:  # text right in a node of the way
        for k in path:
            keep[k] = True
    out = [False] * n
    for k, node in enumerate(alive):
        out[node] = keep[k]
    return out


def main_text(html: str | None) -> str:
    tree = tree_of(html or "")
    chosen = _chosen(tree, _apart(tree))
    out, held = [], []
    for node, data in [*tree.pieces, (0, None)]:
        if data is None:
            text = " ".join("".join(held).split())
            held = []
            if text:
                out.append(text)
        elif chosen[node]:
            held.append(data)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches):
        for part in blocks(batches, "html", 4 << 20):
            text = pa.array([main_text(h) for h in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text, pc.utf8_length(text).cast(pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
