"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math object iframe canvas audio video".split())
OFFSIDE = frozenset("nav header footer aside form button select textarea dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the first ends an open element of the second.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Words in class, id or role that mark matter beside the article. What says only that
#: a layout has such matter or has none ("with-sidebar", "no-sidebar") marks nothing.
ASIDE_WORDS = regex.compile(
    r"(?:^|[\s_-])(?<!(?:^|[\s_-])(?:no|without|with|has|hide)[_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|"
    r"breadcrumbs|sidebar|aside|footer|header|masthead|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|signup|login|"
    r"search|share|sharing|social|related|recommended|comment|comments|disqus|reply|replies|widget|pagination|pager|legal|copyright|"
    r"complementary|contentinfo|alert)(?:$|[\s_-]|\d)", regex.IGNORECASE)
SPACES = regex.compile(r"\s+")


class Node:
    __slots__ = ("tag", "aside", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, aside: bool, parent: Node | None) -> None:
        self.tag, self.aside, self.parent = tag, aside, parent
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class Tree(HTMLParser):
    """A tree of elements from any text; unclosed and stray tags are mended as browsers do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", False, None)
        self.nodes = [self.root]
        self.opened: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.nodes):
            return
        if tag in BLOCKS:
            self.shut("head")
        ended = ENDS.get(tag, frozenset())
        if tag in BLOCKS and self.in_paragraph():
            self.shut("p")
        if ended:
            node = self.at
            while node.tag in ended or node.tag not in BLOCKS and node is not self.root:
                if node.tag in ended:
                    self.shut(node.tag)
                    node = self.at
                else:
                    node = node.parent
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        aside = tag in HIDDEN or tag in OFFSIDE or bool(named and ASIDE_WORDS.search(named) and tag not in ("html", "body", "article", "main"))
        aside |= any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        node = Node(tag, aside, self.at)
        self.at.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def in_paragraph(self) -> bool:
        """Whether a p is open; a block inside it would have ended it."""
        node = self.at
        while node.tag not in BLOCKS and node is not self.root:
            node = node.parent
        return node.tag == "p"

    def shut(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        node = self.at
        while node.tag != tag:
            self.opened[node.tag] -= 1
            node = node.parent
        self.opened[tag] -= 1
        self.at = node.parent

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and tag not in ("html", "body"):
            self.shut(tag)

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def measure(tree: Tree) -> Node | None:
    """Count characters and tags bottom-up, without what stands beside the article, give each node its density; returns the body."""
    for node in reversed(tree.nodes):  # children come after their parents
        if node.tag in HIDDEN:
            continue
        for part in node.parts:
            if isinstance(part, str):
                node.chars += sum(map(len, part.split()))
            elif not part.aside:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    body = next((n for n in tree.nodes if n.tag == "body"), tree.root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(tree.nodes):
        if node.tag in HIDDEN:
            continue
        chars, tags, links, link_tags = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if chars:
            plain = chars - links
            base = math.log(chars * links / max(plain, 1) + share * chars + math.e)
            node.density = chars / tags * math.log1p(chars * tags / (max(links, 1) * link_tags)) / math.log1p(base)
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.aside)
    return body


def chosen(body: Node) -> list[Node | str]:
    """The subtree with the largest density sum, widened to its threshold ancestor, with its like beside it.

    The threshold is the smallest density on the path from that subtree up to below the body:
    the outermost element on the path, the body included, that is as dense as the threshold holds
    the article, whatever share of its text each part has. Where that is not the body, all
    beside it belongs to the article too but subtrees whose text is mostly links: sections may be
    thin and headings short. An article or main element on the path is taken as the page's own mark
    and ends the walk.
    """
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        for part in node.parts:
            if isinstance(part, Node) and not part.aside and part.chars:
                if part.total > best.total or best is body and part.total >= best.total:
                    best = part
                stack.append(part)
    path, node = [best], best
    while node is not body and node.parent is not None:
        node = node.parent
        path.append(node)
    marked = [n for n in path if n.tag in ("article", "main")]
    if marked:
        return [marked[-1]]
    threshold = min(n.density for n in path[:-1] or path)
    wide = [n for n in path if n.density >= threshold][-1]
    if wide is body:
        return [body]
    return [n for n in wide.parent.parts if isinstance(n, str) or n is wide or not n.aside and 2 * n.link_chars <= n.chars]


def blocks(parts: list[Node | str]) -> list[str]:
    """The texts of the blocks of subtrees in page order, without what stands beside the article."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := SPACES.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    todo: list[Node | str | None] = list(reversed(parts))
    while todo:
        part = todo.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif not part.aside or part.tag == "body":
            inside = list(reversed(part.parts))
            if part.tag in BLOCKS:
                end()
                todo.append(None)
            todo.extend(inside)
    end()
    return out


def main_text(html: str) -> str:
    """The article of one page; empty for a page without text."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    body = measure(tree)
    return "\n".join(blocks(chosen(body))) if body.chars else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, duplicates included.

    For every element: text density = characters per tag, weakened by the share of characters
    and tags inside links (composite text density). The sum of the densities of an element's
    children finds the article, and the least density on its path to the body says how far
    outward it goes: no further than an article or main element. Elements that are no article by name, class, id or role are left out
    (scripts, menus, forms, adverts, notices, comments and the like). A line break counts as white space.

    One pass without a shuffle, one page in memory at a time. A null page is empty; null ids and
    urls stay null; repeated rows give repeated rows; other columns are ignored. Trees are walked
    without recursion, so any depth is fine.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "") for html in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string())], schema=schema)

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(extracted, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
