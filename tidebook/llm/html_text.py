"""Main text of web pages: what recurs across a site's pages is its template and goes."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut

# Element names by their role in HTML, and the words that name furniture in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("head script style noscript template nav aside footer form menu button select textarea iframe object svg canvas audio video dialog map title xmp noembed noframes".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices popup promo promoted promotion related respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
HEADINGS = frozenset(("h1", "h2"))
CONTAINERS = frozenset("div section ul ol dl table figure header nav form fieldset details center td th tr tbody".split())
#: A class that begins so tells the layout of an element, not its role: with-sidebar, has-banner.
LAYOUT = frozenset("with without has no".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.S)
NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
BLANK = re.compile(r"\s+")


class Node:
    """An element: its name, role words, children (elements and texts), and what is known of it."""

    __slots__ = ("name", "attributes", "children", "parent", "digest", "chars", "main", "dropped", "inside", "heading", "holder")

    def __init__(self, name: str, attributes: str, parent: Node | None) -> None:
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []
        self.digest, self.chars, self.main, self.dropped, self.inside = 0, 0, False, False, False
        self.heading = self.holder = False


def parse(text: str) -> Node:
    """The element tree of a page, with the usual repairs of missing and crossed tags.

    The numbers of open elements by name tell whether there is one to close, so that only elements
    that are closed are walked over, and the time stays in proportion to the page.
    """
    root = node = Node("", "", None)
    opened: Counter[str] = Counter()
    at = pos = 0

    def close(last: Node) -> Node:
        """Close elements from the current one up to the given one."""
        up = node
        while up is not last.parent:
            opened[up.name] -= 1
            up = up.parent
        return up

    while True:
        found = TAG.search(text, pos)
        if not found:
            node.children.append(text[at:])
            return root
        if found.start() > at:
            node.children.append(text[at : found.start()])
        at = pos = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            if opened[name] > 0:
                up = node
                while up.name != name:
                    up = up.parent
                node = close(up)
            continue
        if name not in INLINE and opened["p"] > 0:  # then only inline elements are open within it
            up = node
            while up.name in INLINE:
                up = up.parent
            if up.name == "p":
                node = close(up)
        if name in CLOSES and any(opened[x] > 0 for x in CLOSES[name]):
            up, last = node, None
            while up is not root and up.name not in LIMITS[name]:
                if up.name in CLOSES[name]:
                    last = up
                    if up.name == name or name != "tr":
                        break
                up = up.parent
            if last is not None:
                node = close(last)
        child = Node(name, found[3][:-1], node)
        node.children.append(child)
        if name in RAW:
            ending = re.compile(f"</{re.escape(name)}", re.I).search(text, at)
            end = ending.start() if ending else -1
            child.children.append(text[at:end] if end >= 0 else text[at:])
            at = pos = len(text) if end < 0 else end
            if end >= 0:
                node = child
                opened[name] += 1
        elif name not in VOID and not found[3].endswith("/>"):
            node = child
            opened[name] += 1


def furniture(node: Node) -> bool:
    """Whether name, role, class or id say that an element isn't part of the article."""
    if node.name in FURNITURE:
        return True
    if not node.attributes.strip():
        return False
    for key, value in NAMES.findall(node.attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in FURNITURE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and not node.holder and any(_names_furniture(x, node.name in CONTAINERS) for x in value.split()):
            return True
    return False


def _names_furniture(token: str, container: bool) -> bool:
    """Whether a class or id names furniture: any of its words for a container, else only as a whole."""
    words = [w.lower() for w in WORDS.findall(token)]
    if not container:
        return len(words) == 1 and words[0] in FURNITURE_WORDS
    return bool(words) and words[0] not in LAYOUT and any(w in FURNITURE_WORDS for w in words)


def prepare(text: str) -> tuple[list[Node], list[Node]]:
    """A page's elements, parents before children, and the roots of its main text in page order.

    Roots are the outermost articles that aren't furniture; else the main elements; else the tree. Of
    several articles those with a page title (h1) are the text, if there are such; else those with a
    quarter of the longest one's letters or more, as what is shorter is a teaser or a reply.
    """
    root = parse(text)
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.children if type(x) is Node]
    for node in reversed(order):  # children first
        inner = [x for x in node.children if type(x) is Node]
        node.heading = node.name in HEADINGS or any(x.heading for x in inner)
        node.holder = any(x.holder or x.name in ("article", "main") and not furniture(x) for x in inner)
    shown = []
    for node in order:  # parents first
        up = node.parent
        node.dropped = up is not None and (up.dropped or node.name not in ("html", "body", "article", "main") and furniture(node))
        if not node.dropped:
            shown.append(node)
    roots = []
    for wanted in ("article", "main"):
        roots = [x for x in shown if x.name == wanted or wanted == "main" and re.search(r"""role\s*=\s*["']?main\b""", x.attributes)]
        if roots:
            break
    chosen = set(map(id, roots))
    for node in order:
        node.inside = id(node) in chosen or node.parent is not None and node.parent.inside
    roots = [x for x in roots if x.parent is None or not x.parent.inside]
    if len(roots) > 1 and roots[0].name == "article":
        roots = _articles(roots)
        chosen = set(map(id, roots))
        for node in order:
            node.inside = id(node) in chosen or node.parent is not None and node.parent.inside
    tops = set(map(id, roots))
    order.reverse()
    for node in order:
        whole = xxhash.xxh3_64(node.name.encode())
        for x in node.children:
            if type(x) is Node:
                whole.update(x.digest.to_bytes(8, "little"))
                node.chars += x.chars
                node.main |= x.main
            elif x and not x.isspace():
                whole.update(BLANK.sub(" ", x).strip().encode("utf-8", "replace") + b"\0")
                node.chars += len(x)
        node.digest = whole.intdigest()
        node.main |= id(node) in chosen
    order.reverse()
    return order, [x for x in _in_page_order(root) if id(x) in tops] if len(roots) > 1 else roots or [root]


def _articles(roots: list[Node]) -> list[Node]:
    """Of a page's outermost articles those that are its text, and not teasers or replies."""
    titled, chars = [], []
    for root in roots:
        n, title, stack = 0, False, [root]
        while stack:
            x = stack.pop()
            if type(x) is str:
                n += len(x) - x.count(" ")
            elif not x.dropped:
                title |= x.name == "h1"
                stack += x.children
        chars.append(n)
        if title:
            titled.append(root)
    return titled or [x for x, n in zip(roots, chars, strict=True) if 4 * n >= max(chars)]


def _in_page_order(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.children) if type(x) is Node]


def candidates(order: list[Node], roots: list[Node]) -> list[Node]:
    """Elements that may be template: not inline, not holding the main text or most of it.

    Within an article only containers count, not the paragraphs of which it consists.
    """
    most = sum(x.chars for x in roots) / 2
    bare = roots[0].name == ""
    out = []
    for x in order:
        if not x.chars or x.main or x.name in INLINE or x.name in ("", "html", "body", "head") or x.name in RAW:
            continue
        if x.inside and (x.chars > most or x.name not in ("div", "section", "aside", "ul", "ol", "table", "figure", "header", "footer", "nav", "form")):
            continue
        if bare and not x.dropped and x.chars > most:
            continue
        out.append(x)
    return out


def main_text(order: list[Node], roots: list[Node], template: set[int]) -> str:
    """Blocks of the main text, one a line, without template subtrees and furniture."""
    gone = {id(x) for x in candidates(order, roots) if x.digest in template}
    # the header of an article holds its title; any other header is the page's
    gone |= {id(x) for x in order if x.name == "header" and not (x.inside and x.heading)}
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for root in roots:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif type(x) is str:
                parts.append(x)
            elif x.name == "br":
                parts.append(" ")
            elif not x.dropped and id(x) not in gone:
                if x.name not in INLINE:
                    end()
                    stack.append(None)
                stack += reversed(x.children)
        end()
    return "\n".join(blocks)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, subtree, content = [], [], []
        for i, text in enumerate(batch.column(2)):
            order, roots = prepare(text.as_py() or "")
            found = {x.digest for x in candidates(order, roots)}
            page += [i] * len(found)
            subtree += found
            content += [xxhash.xxh3_64(b"".join(x.digest.to_bytes(8, "little") for x in roots)).intdigest()] * len(found)
        at = pa.array(page, pa.int64())
        signed = lambda x: pa.array(x, pa.uint64()).cast(pa.int64(), safe=False)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), signed(subtree), signed(content)], names=["page_id", "host", "subtree", "content"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, template in zip(batch.column(2), batch.column(3), strict=True):
            order, roots = prepare(text.as_py() or "")
            texts.append(main_text(order, roots, {x & 0xFFFFFFFFFFFFFFFF for x in template.as_py() or ()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """The host of an address in lower case; the empty text where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, min_pages: int = 8) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Every element's subtree is hashed over names and texts; hashes are counted per host over pages
    of different content, so that copies of a page count once. A subtree on at least ``min_pages``
    such pages is template and is deleted there; on hosts with more than 1,000 pages it takes as many
    again for every further power of ten, as chance repeats grow, so 32 pages of a million. What its name,
    role, class or id marks as menu, notice, advert, form, comment or the like goes everywhere, as
    hosts with few pages have no statistics; a class or id counts by any of its words on a container
    and only as a whole word on paragraphs and the like, and never on what holds the article. Where a page has an article (else a main element) only
    that is text; its paragraphs and any subtree of more than half of it are never template.

    Counts combine before the shuffle, and the join of a large host's pages with its template can
    be split. Null html gives the empty text, null addresses and such without a host are one
    host, and repeated rows all stay. An empty table gives no rows; other columns are not read.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), "html")
    # stored, so that every page is parsed once for its hashes and once for its text
    seen = cut(narrow.mapInArrow(_hashes, "page_id long, host string, subtree long, content long"))
    per_content = seen.select("host", "subtree", "content").distinct()
    hosts = per_content.groupBy("host", "content").agg(F.lit(1).alias("_one")).groupBy("host").agg(F.count("_one").alias("pages"))
    counted = per_content.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    template = counted.join(hosts, "host").where(F.col("n") >= F.greatest(F.lit(1.0), F.log10("pages") - 2) * min_pages).select("host", "subtree")
    found = seen.select("page_id", "host", "subtree").join(template, ["host", "subtree"]).groupBy("page_id", "host").agg(F.collect_set("subtree").alias("template"))
    found = found.select(F.col("page_id").alias("_page"), F.col("host").alias("_host"), "template")
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    joined = whole.join(found, F.col("page_id").eqNullSafe(F.col("_page")) & (host_of(F.col("url")) == F.col("_host")), "left")
    texts = joined.select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id long, url string, text string")
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
