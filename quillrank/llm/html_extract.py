"""Main text of web pages by a site style tree.

The pages of a host are merged: elements with the same path of tags and classes are one node of the host's tree. A
node matters if what it shows differs from page to page, and if it is laid out in different ways; a block that many
pages repeat matters little, whatever stands beside it. Blocks and branches of low importance are cut from each page.
Tags and classes that say that a branch is no article text are a prior: it falls if the branch holds the article that
the page marks, or most of the text of a page that marks none, or if the tree finds that a loosely named branch matters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sizing import fits, lookup_join, split_hot_join
from .registry import bounded_batches
from .words import slices

#: Pages on which a node must have been seen before its importance counts.
LEAST_PAGES = 8
#: Blocks and branches are cut below this importance; what is above counts in full.
CUT = 0.2
#: A branch with a loose name is kept from this importance on.
IMPORTANT = 0.75
#: Weight of the contents against the node they stand in, and against the layout in the importance of a node.
CONTENT = 0.8
#: Pages with repeated blocks, up to which their lists of blocks are broadcast.
SMALL_LISTS = 20_000

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
NO_TEXT = set("script style noscript template head title iframe object svg math canvas audio video button select textarea input label datalist".split())
FRAME_TAGS = set("nav menu aside footer dialog search".split())
CLOSES_P = BLOCKS - {"option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption", "html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote"}
CONTAINERS = {"article", "main"}
# Words in classes, ids and roles of what is no article text; those that also name wrappers of articles, and
# those that also name plain blocks; those of reader comments.
FRAME_WORDS = re.compile(
    r"(?:^|[\s_-])(ad|ads|adv|advert|adverts|advertisement|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"sidebar|side|footer|header|masthead|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|comment|comments|commentlist|disqus|reply|replies|"
    r"respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|widget|pagination|pager|toolbar|contentinfo|complementary)(?=$|[\s_-])",
    re.I,
)
SOFT_WORDS = set("sidebar side masthead popup modal overlay promo promotion share sharing social signup login search toolbar banner".split())
WEAK_WORDS = {"header", "widget"}
COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond".split())
HEADERS = {"header", "masthead"}
COMMENT_ARTICLE = re.compile(r"(?:^|\s)(?:comment|comment-body|comment-content|reply)(?:$|\s)", re.I)
# Names that say what a page lacks or has besides, and elements that are never a frame by name.
ABSENT_WORDS = re.compile(r"(?:^|(?<=[\s_]))(?:no|has|with|without)[_-][\w-]+", re.I)
WHOLE = {"html", "body", "main"}
ARTICLE_WORDS = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post-content|entry-content|article-body|main-content|story-body)(?:$|[\s_-])", re.I)

# How much the name of an element says that it is no article text.
OPEN, WEAK, SOFT, STRONG, COMMENTS, HIDDEN = range(6)


@lru_cache(10_000)
def prior(tag: str, names: str, inside: bool) -> int:
    """What tag and names say of an element; ``inside`` an article, headers belong to it."""
    if tag in NO_TEXT:
        return HIDDEN
    if tag == "article":
        return COMMENTS if COMMENT_ARTICLE.search(names) else OPEN
    level = STRONG if tag in FRAME_TAGS else SOFT if tag == "form" or tag == "header" and not inside else OPEN
    if not names or tag in WHOLE:
        return level
    for match in FRAME_WORDS.finditer(ABSENT_WORDS.sub("", names)):
        word = match[1].lower()
        if not (inside and word in HEADERS):
            level = max(level, WEAK if word in WEAK_WORDS else SOFT if word in SOFT_WORDS else COMMENTS if word in COMMENT_WORDS else STRONG)
    return level


@lru_cache(10_000)
def _style(tag: str, names: str) -> tuple[str, bool]:
    return (f"{tag}.{re.sub('[0-9]+', '0', names)}" if names else tag), tag in CONTAINERS or bool(names and ARTICLE_WORDS.search(names))


class Node:
    """An element with its children in order; text blocks are strings among them.

    ``path`` is a number made of the parent's and the element's own style, so its size doesn't grow with the depth.
    """

    __slots__ = ("tag", "style", "path", "children", "level", "container", "holds")

    def __init__(self, tag: str, names: str, above: Node | None) -> None:
        inside = above is not None and above.container
        self.tag = tag
        self.style, starts = _style(tag, names)
        self.path = _number(f"{above.path if above else 0}>{self.style}")
        self.children: list[Node | str] = []
        self.level = prior(tag, names, inside)
        self.container = inside or starts
        self.holds = False

    @property
    def cut(self) -> bool:
        return self.level >= SOFT


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Builder(HTMLParser):
    """Builds the tree of a page; open elements are closed as HTML implies."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", "", None)
        self.open = [self.root]
        self.depth: Counter = Counter()
        self.text: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.open[-1].children.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in CLOSES_P:
            self.leave("p", stop=SCOPES | {"li", "td", "th", "dd"})
        if tag in SIBLINGS:
            for other in SIBLINGS[tag]:
                self.leave(other, stop=SCOPES)
        if tag in ("td", "th"):
            self.text.append(" ")
        if tag not in BLOCKS and tag not in NO_TEXT:
            return
        self.flush()
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v)
        node = Node(tag, names, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.depth[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in NO_TEXT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in NO_TEXT:
            self.leave(tag)

    def leave(self, tag: str, stop: set[str] = frozenset()) -> None:
        """Close the innermost open ``tag`` and what is open inside it, unless one of ``stop`` is in between."""
        if not self.depth[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.flush()
                self.depth.subtract(node.tag for node in self.open[i:])
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def parse(html: str) -> Node:
    """The tree of a page, with names overruled by what the page itself shows."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.flush()
    _settle(builder.root)
    return builder.root


def _settle(root: Node) -> None:
    """Open the named branches that hold the article.

    The article is the largest marked one outside named branches, else the largest in a softly named branch, else in any
    branch but reader comments, if half of the text stands in that branch. A page that marks none opens softly named branches
    with over half of its text.
    """
    order: list[tuple[Node, int, Node | None, Node | None]] = []  # node, strongest name above, outermost named branch, parent
    todo: list[tuple[Node, int, Node | None, Node | None]] = [(root, root.level, None, None)]
    while todo:
        node, worst, named, above = todo.pop()
        named = named or (node if node.cut else None)
        order.append((node, worst, named, above))
        todo += [(c, max(worst, c.level), named, node) for c in node.children if isinstance(c, Node) and c.level < HIDDEN]
    size: dict[int, tuple[int, int]] = {}  # text, and text outside of strongly named branches
    for node, *_ in reversed(order):  # below before above
        every = light = 0
        for c in node.children:
            if isinstance(c, str):
                every, light = every + len(c), light + len(c)
            elif c.level < HIDDEN:
                every, light = every + size[id(c)][0], light + (size[id(c)][1] if c.level < STRONG else 0)
        size[id(node)] = (every, light)
    every, light = size[id(root)]
    best: dict[int, tuple[int, Node]] = {}
    for node, worst, named, above in order:
        if node.container and not (above and above.container and above.level < SOFT) and worst < COMMENTS:
            own, kind = size[id(node)][1], OPEN if worst < SOFT else worst
            most = named is None or 2 * size[id(named)][0] >= every or kind == SOFT and 2 * size[id(named)][1] >= light
            if most and own > best.get(kind, (0, node))[0]:
                best[kind] = (own, node)
    if best:
        parents = {id(node): above for node, *_, above in order}
        node = best[min(best)][1]
        while node is not None:
            node.level, node.holds = OPEN, True
            node = parents[id(node)]
        return
    for node, *_ in order:
        if node.level == SOFT and size[id(node)][1] * 2 > light:
            node.level = OPEN


def observations(root: Node) -> tuple[dict[tuple[int, int], list[int]], dict[int, int], int]:
    """Of a page: characters of each ``(path, content)`` and whether its branch has a loose name, the layout of each
    path, and a number of the whole text outside named branches."""
    contents: dict[tuple[int, int], list[int]] = {}
    layouts: dict[int, list[str]] = {}
    text = xxhash.xxh3_64()
    todo = [(root, False)]
    while todo:
        node, weak = todo.pop()
        weak = weak or node.level == WEAK
        inner = [c for c in node.children if isinstance(c, Node)]
        shape = [c.style for c in inner]
        layouts.setdefault(node.path, []).append(" ".join(s for i, s in enumerate(shape) if not i or s != shape[i - 1]))
        for c in node.children:
            if isinstance(c, str):
                what = _number(c)
                seen = contents.setdefault((node.path, what), [0, 0])
                seen[0] += len(c)
                seen[1] |= weak
                text.update(what.to_bytes(8, "little", signed=True))
        todo += [(c, weak) for c in inner if not c.cut]
    return contents, {path: _number("\n".join(shapes)) for path, shapes in layouts.items()}, text.intdigest() - (1 << 63)


def _composite(root: Node, low: dict[tuple[int, int], float]) -> dict[int, tuple[float, int]]:
    """Importance of each branch times its characters, and its characters, by node."""
    order, todo = [], [(root, False)]
    while todo:
        node, weak = todo.pop()
        weak = weak or node.level == WEAK
        order.append((node, weak))
        todo += [(c, weak) for c in node.children if isinstance(c, Node) and not c.cut]
    worth: dict[int, tuple[float, int]] = {}
    for node, weak in reversed(order):  # below before above
        total, size = 0.0, 0
        for c in node.children:
            if isinstance(c, str):
                share = low.get((node.path, _number(c)), 0.0 if weak else 1.0) if low else 0.0 if weak else 1.0
                total, size = total + share * len(c), size + len(c)
            elif not c.cut:
                total, size = total + worth[id(c)][0], size + worth[id(c)][1]
        worth[id(node)] = (total, size)
    return worth


def main_text(root: Node, low: dict[tuple[int, int], float]) -> str:
    """Blocks of the page without named branches and without blocks and branches of low importance.

    ``low`` has the importance of blocks by path and content that the host repeats, and of all in loosely named
    branches; other blocks count as 1, those of loosely named branches as 0. A branch that holds the marked article, or
    half of the text of the article or page around it, is never cut as a whole. If the page marks its article, only blocks
    inside count; if all of it is of low importance, all of it stays.
    """
    worth = _composite(root, low)
    marked: list[str] = []
    every: list[str] = []
    spare: list[str] = []
    todo: list[tuple[int, Node | None, Node | str]] = [(worth[id(root)][1], None, root)]
    while todo:
        around, above, item = todo.pop()
        if isinstance(item, str):
            if above.container:
                spare.append(item)
            if low and low.get((above.path, _number(item)), 1.0) < CUT:
                continue
            every.append(item)
            if above.container:
                marked.append(item)
            continue
        total, size = worth.get(id(item), (0.0, 0))
        if item.cut or not size or item.level == WEAK and total < IMPORTANT * size:
            continue
        if not item.holds and 2 * size < around and total < CUT * size:
            continue
        if item.container and not (above is not None and above.container):
            around = size
        todo += [(around, item, c) for c in reversed(item.children)]
    return "\n\n".join(marked or spare or every)


_ITEM = pa.struct([("path", pa.int64()), ("shown", pa.bool_()), ("what", pa.int64()), ("chars", pa.int64()), ("weak", pa.bool_())])


def observed(pages: DataFrame) -> DataFrame:
    """``(key, host, whole, items)``: what each page of a host shows, from ``host``, ``key`` and ``html``. Copies have the same row."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                items, wholes = [], []
                for html in part.column("html").to_pylist():
                    contents, layouts, whole = observations(parse(html or ""))
                    wholes.append(whole)
                    items.append(
                        [{"path": p, "shown": True, "what": w, "chars": n, "weak": bool(loose)} for (p, w), (n, loose) in contents.items()]
                        + [{"path": p, "shown": False, "what": w, "chars": 0, "weak": False} for p, w in layouts.items()]
                    )
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("host"), pa.array(wholes, pa.int64()), pa.array(items, pa.list_(_ITEM))], ["key", "host", "whole", "items"])

    kept = pages.where(F.col("host").isNotNull()).select("key", "host", "html")
    return kept.mapInArrow(observe, "key string, host string, whole long, items array<struct<path:long,shown:boolean,what:long,chars:long,weak:boolean>>")


def site_style(seen: DataFrame) -> DataFrame:
    """``(host, path, what, share)``: importance of the blocks that a host repeats so often that they are cut, and of those
    in loosely named branches.

    A block is worth 1 if no other page shows it there and 0 if all pages with the node do, mixed with the importance of
    the node: the entropies of its contents and of its layouts over their maxima. Pages with the same text count once; nodes
    count from LEAST_PAGES pages on.
    """
    shown, layout = F.col("shown"), ~F.col("shown")
    items = seen.select("host", "whole", F.inline("items"))
    once = items.groupBy("host", "path", "shown", "what", "whole").agg(F.max("chars").alias("chars"), F.max("weak").alias("weak"))
    each = once.groupBy("host", "path", "shown", "what").agg(F.count("whole").alias("pages"), F.sum("chars").alias("chars"), F.max("weak").alias("weak"))
    each = materialize(each, "contents")
    sums = each.groupBy("host", "path").agg(
        F.sum(F.when(layout, F.col("pages"))).alias("m"),
        F.sum(F.when(layout, F.col("pages") * F.log("pages"))).alias("layout_logs"),
        F.sum(F.when(shown, F.col("chars"))).alias("chars"),
        F.sum(F.when(shown, F.col("chars") * F.log("pages"))).alias("content_logs"),
    )
    log_m = F.log("m")
    content = 1 - F.col("content_logs") / (F.col("chars") * log_m)
    form = 1 - F.col("layout_logs") / (F.col("m") * log_m)  # entropy of the layouts over its maximum, log m
    known = sums.where((F.col("m") >= LEAST_PAGES) & (F.col("chars") > 0))
    nodes = known.select("host", "path", log_m.alias("log_m"), (CONTENT * content + (1 - CONTENT) * form).alias("node"))  # few sums, counted and joined
    repeated = each.where(shown & ((F.col("pages") > 1) | F.col("weak"))).select("host", "path", "what", "pages", "weak")
    share = CONTENT * (1 - F.log("pages") / F.col("log_m")) + (1 - CONTENT) * F.col("node")
    rated = lookup_join(repeated, nodes, ["host", "path"], spread_on="what").select("host", "path", "what", share.alias("share"), "weak")
    return rated.where(F.col("weak") | (F.col("share") < CUT)).drop("weak")


def host() -> Column:
    """Host of ``url`` in lower case, null without one."""
    return F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)", 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)``: the main text of every page, an empty string if there is none.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
    page order by two line feeds. Null html counts as empty. A page without a url or host has no site to be compared
    with and is judged by its own markup. Null ids and repeated rows are pages like others; pages of a host with the same
    text count once in its tree. An empty table gives no rows; other columns are not looked at.
    """
    rows = bounded_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    rows = rows.withColumn("host", host()).withColumn("key", F.md5(F.concat_ws("\n", F.coalesce("host", F.lit("")), F.coalesce("html", F.lit("")))))
    seen = materialize(observed(rows), "observed")  # as scanned: the style counts equal texts once, and a list has a block once
    low = materialize(site_style(seen), "style")
    shows = seen.select("key", "host", F.inline(F.filter("items", lambda i: i["shown"]))).select("key", "host", "path", "what")
    met = lookup_join(shows, low, ["host", "path", "what"], spread_on="key")
    lists = met.groupBy("key").agg(F.collect_set(F.struct("path", "what", "share")).alias("low"))  # of one page each
    few = fits(lists, SMALL_LISTS)
    whole = rows.drop("host")  # a plain scan, so it may be read once more to count its keys
    joined = whole.join(F.broadcast(lists), "key", "left") if few else split_hot_join(whole, lists, ["key"], "left", "page_id", stored=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for html, low in zip(part.column("html").to_pylist(), part.column("low").to_pylist()):
                    texts.append(main_text(parse(html or ""), {(x["path"], x["what"]): x["share"] for x in low or []}))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "low").mapInArrow(cut, f"page_id {kind}, url string, text string")
