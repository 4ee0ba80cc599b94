"""Main text of web pages with site template removal.

A first pass hashes the element subtrees of every page, by their text, and outside
the article also by their shape: tags, class names and place, with text reduced to
whether there is any.  Spark counts in how many different pages of a host, of a
section and at which place each hash occurs; a second pass deletes the subtrees
that significantly recur, drops the elements that are never article text, and
joins the blocks that are left.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectforge.llm.common import bare, materialize, small_batches

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody tfoot thead tr ul".split()
)
DROP = frozenset(
    "head script style title noscript template iframe object embed svg math canvas audio video map nav header footer "
    "aside form button input select textarea label fieldset dialog menu noembed noframes xmp".split()
)
CLOSES_P = BLOCK - {"option", "optgroup", "tbody", "tfoot", "thead", "tr", "caption", "legend", "body", "html"}
#: Start tag -> open elements that it ends, and what shields them.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notification popup modal overlay newsletter subscribe subscription signup login sidebar widget nav "
    "navbar navigation menu breadcrumb breadcrumbs topbar header masthead footer comment comments commentlist "
    "discussion disqus respond related recommended share sharing social pagination pager skip".split()
)

#: Whole class names or ids that are chrome inside the article too.
CERTAIN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored share sharing social comments commentlist disqus_thread newsletter pagination breadcrumbs".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements of the head; any other one ends it.
HEAD = frozenset("base head link meta noscript script style template title".split())
#: Containers that a shape is taken of.
SHAPED = frozenset("aside center details dialog dir div dl fieldset figure footer form header hgroup menu nav ol section table ul".split())
#: Never text, whatever is asked for.
MUTE = frozenset("head script style title noscript template iframe object embed svg math canvas audio video map textarea select noembed noframes xmp".split())
#: Dropped elements that may wrap a whole page.
WRAPS = frozenset("form fieldset dialog".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Node:
    """An element: its children are nodes and strings of text."""

    tag: str
    attrs: str = ""
    children: list = field(default_factory=list)
    digest: int = 0
    shape: int = 0
    size: int = 0
    frame: bool = False
    side: bool = False
    inside: bool = False
    titled: bool = False


class _Tree:
    """The open elements, and where among them those of each tag are."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.stack = [self.root]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def text(self, piece: str) -> None:
        if self.stack[-1].tag == "head" and piece.strip():
            self.cut(len(self.stack) - 1)
        self.stack[-1].children.append(piece)

    def open(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.where.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close the elements from a place on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The innermost open element of the tags; 0 for none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def end(self, tag: str) -> None:
        """An end tag; that of an inline element does not close a block inside it."""
        at = self.last((tag,))
        if at and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):
            self.cut(at)

    def imply(self, tags, shields) -> None:
        """Close the innermost of the tags, unless a shield is inside it."""
        at = self.last(tags)
        if at and at > self.last(shields):
            self.cut(at)

    def before(self, tag: str) -> None:
        """What a start tag ends."""
        if tag not in HEAD and self.where.get("head"):
            self.cut(self.where["head"][0])
        if tag in CLOSES_P:
            self.imply(("p",), ("button", "table", "article", "section", "div", "blockquote", "li", "dd"))
        if tag in SIBLINGS:
            self.imply(*SIBLINGS[tag])
        elif tag in ("article", "main"):
            if found := [self.where[t][0] for t in ("nav", "head", "ul", "header", "footer", "aside") if self.where.get(t)]:
                self.cut(min(found))


def _tag_end(page: str, at: int, quoted: bool) -> tuple[int, bool]:
    """Where a tag's ``>`` is, -1 for nowhere; and whether quotes still hide one.

    The first quote without an end in the page ends that for good: a scan that
    reaches the end of the page happens once, so parsing takes linear time.
    """
    pos = at
    while quoted:
        m = _STOP.search(page, pos)
        if m and m[0] == ">":
            return m.start(), True
        close = page.find(m[1], m.end()) if m else -1
        quoted = close >= 0
        pos = close + 1
    return page.find(">", at), False


def parse(page: str) -> Node:
    """A tree of the page; what is not closed is closed where HTML implies it.

    Every step goes on from where the last one ended.  Text that no ``>`` follows
    holds no tags.
    """
    tree = _Tree()
    at, size, quoted = 0, len(page), True
    while at < size:
        start = page.find("<", at)
        if start != at:
            tree.text(page[at : start if start >= 0 else size])
            if start < 0:
                break
            at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = _OPEN.match(page, at)
        if not m:
            end = page.find(">", at) if page[at + 1 : at + 2] in ("!", "?", "/") else at
            if end < 0:
                tree.text(page[at:].partition("<!--")[0])
                break
            if end == at:
                tree.text("<")
            at = end + 1
            continue
        end, quoted = _tag_end(page, m.end(), quoted) if not m[1] else (page.find(">", m.end()), quoted)
        if end < 0:
            tree.text(page[at:].partition("<!--")[0])
            break
        tag, attrs, at = m[2].lower(), page[m.end() : end], end + 1
        if m[1]:
            tree.end(tag)
            continue
        tree.before(tag)
        node = Node(tag, attrs)
        if tag in RAW:
            tree.stack[-1].children.append(node)
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else size
        elif tag in VOID or attrs.endswith("/"):
            tree.stack[-1].children.append(node)
        else:
            tree.open(node)
    return tree.root


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def hash_subtrees(root: Node) -> list[tuple[int, int]]:
    """Digest every block subtree with text or children; (place, digest) of each, place 0 for any.

    A digest covers tags and text, with white space folded, not attributes.  A
    place is the tags from the root, each numbered among its siblings of the tag.
    The page's own frame (html, head, body) is not listed.  Containers at the side
    of the article (see :func:`mark_frame`) have one more digest, of their place and
    shape: a run of children of one shape counts as one of them.
    """
    found: set[tuple[int, int]] = set()
    order, todo = [], [(root, 0, False)]
    while todo:
        node, place, shaped = todo.pop()
        # Shapes are those of containers at the side and of what is in them; no other one is looked at.
        shaped = shaped or node.side
        order.append((node, place, shaped))
        seen: dict[str, int] = {}
        for c in node.children:
            if type(c) is Node:
                seen[c.tag] = number = seen.get(c.tag, 0) + 1
                todo.append((c, _hash(f"{place}/{c.tag}/{number}"), shaped))
    shapes: dict[int, int] = {}
    for node, place, shaped in reversed(order):
        parts, shape = [node.tag], []
        for c in node.children:
            if type(c) is Node:
                parts.append(f"\x01{c.digest}")
                now = shapes.pop(id(c)) if shaped else 0
            elif text := " ".join(c.split()):
                parts.append(text)
                now = 0
            else:
                continue
            if not shape or shape[-1] != now:
                shape.append(now)
        node.digest = _hash("\x02".join(parts))
        if shaped:
            name = _CLASS.search(node.attrs) if node.attrs else None
            name = _DIGITS.sub("0", "".join(x or "" for x in name.groups())) if name else ""
            shapes[id(node)] = _hash(f"{node.tag}\x01{name}\x01{shape}")
        if len(parts) > 1 and node.tag in BLOCK and node.tag not in ("html", "body"):
            found |= {(0, node.digest), (place, node.digest)}
            if node.side:
                node.shape = _hash(f"{place}\x03{shapes[id(node)]}")
                found.add((0, node.shape))
    return sorted(found)


def mark_frame(root: Node) -> None:
    """Mark the elements that nothing may drop, and the containers at the side of the article.

    The frame is body, main and article, what holds a main or the longest article, and
    without either what holds most of the text.  The article is the longest one, or
    the main, or the innermost element that holds most of the text; containers neither
    in it nor in another article, nor of the frame, are at its side.  What an article
    holds, or main on a page without one, is marked as inside, and what holds a heading as titled.
    """
    order, todo = [], [(root, None)]
    while todo:
        node, parent = todo.pop()
        order.append((node, parent))
        todo += [(c, node) for c in node.children if type(c) is Node]
    for node, parent in reversed(order):
        node.size += sum(len("".join(c.split())) for c in node.children if type(c) is str)
        if parent and (node.tag not in DROP or node.tag in WRAPS):
            parent.size += node.size
    longest = max((n for n, _ in order if n.tag == "article"), key=lambda n: n.size, default=None)
    main = next((n for n, _ in order if n.tag == "main"), None)
    named, content = longest or main, longest or main or root
    for node, _ in order:
        if named is None and 2 * node.size > root.size and (node.tag not in DROP or node.tag in WRAPS):
            node.frame = True
            content = node
    for node, parent in reversed(order):
        node.frame |= node.tag in ("html", "body", "main", "article")
        node.titled |= node.tag in HEADINGS
        if parent:
            parent.titled |= node.titled
        if parent and (node is longest or node.tag == "main" or node.frame and node.tag not in ("article", "main")):
            parent.frame = True
    todo = [(root, False, False)]
    while todo:
        node, inside, held = todo.pop()
        inside = inside or node is content or node.tag in ("article", "main")
        node.side = not inside and not node.frame and node.tag in SHAPED
        node.inside = held
        held = held or node is longest or node.tag == "article" or longest is None and node.tag == "main"
        todo += [(c, inside, held) for c in node.children if type(c) is Node]


def _dropped(node: Node, lists: bool) -> bool:
    """Whether an element goes by its tag or attributes.

    Inside the article its own header stays if it has a heading, and names count only
    where they are whole and certain: ``related-work`` or ``share-price`` is a subject there.
    """
    if node.tag in MUTE:
        return True
    if node.frame or not lists:
        return False
    if node.tag in DROP and not (node.inside and node.tag == "header" and node.titled):
        return True
    if not node.attrs:
        return False
    for name, *values in _ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.strip() in ROLES:
            return True
        if name in ("class", "id") and not (CERTAIN.isdisjoint(value.split()) if node.inside else NAMES.isdisjoint(_NAME.findall(value))):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _template(node: Node, templates: frozenset[int]) -> bool:
    return node.digest in templates or node.side and node.shape in templates


def _roots(root: Node, tag: str, templates: frozenset[int]) -> list[Node]:
    """Outermost kept elements of one tag, in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if type(c) is Node and not _dropped(c, True) and not _template(c, templates)]
    return found


def _blocks(root: Node, templates: frozenset[int], lists: bool = True) -> list[str]:
    """Texts of the blocks below an element, in page order."""
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if inline:
            if text := " ".join(entities.unescape("".join(inline)).split()):
                blocks.append(text)
            inline.clear()

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif type(item) is str:
            inline.append(item)
        elif item.tag in ("br", "td", "th"):
            inline.append(" ")
            todo.extend(reversed(item.children))
        elif item is root or not _dropped(item, lists) and not _template(item, templates):
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(item.children))
    flush()
    return blocks


def main_text(page: str, templates: frozenset[int] = frozenset(), lists: bool = True) -> str:
    """The article's blocks, one line each; without an article or main, the body's.

    A page that the templates would leave without any text repeats another page's
    article; it is no template, and they do not apply.  Without ``lists`` the whole
    body counts and only templates go: this shows what they do alone.
    """
    root = parse(page)
    mark_frame(root)
    if templates:
        hash_subtrees(root)
    for known in (templates, frozenset()) if templates else (templates,):
        for tag in ("article", "main", "#root") if lists else ("#root",):
            roots = [root] if tag == "#root" else _roots(root, tag, known)
            if blocks := [b for r in roots for b in _blocks(r, known, lists)]:
                return "\n".join(blocks)
    return ""


def _hash_udf(html: Column) -> Column:
    def hashes(pages: pa.Array) -> pa.Array:
        found = []
        for p in pages.to_pylist():
            root = parse(p or "")
            mark_frame(root)
            found.append(hash_subtrees(root))
        rows = [[{"place": x, "digest": y} for x, y in f] for f in found]
        return pa.array(rows, pa.list_(pa.struct([("place", pa.int64()), ("digest", pa.int64())])))

    return F.arrow_udf(hashes, "array<struct<place:bigint,digest:bigint>>")(html)


def _text_udf(html: Column, templates: Column, lists: bool) -> Column:
    def texts(pages: pa.Array, sets: pa.Array) -> pa.Array:
        both = zip(pages.to_pylist(), sets.to_pylist(), strict=True)
        return pa.array([main_text(p or "", frozenset(t or ()), lists) for p, t in both], pa.string())

    return F.arrow_udf(texts, "string")(html, templates)


def page_host(url: Column) -> Column:
    """Lower-cased host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def page_section(url: Column) -> Column:
    """First folder of a URL's path; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def _lower_bound(part: Column, whole: Column, z: float = 1.96) -> Column:
    """Wilson's lower bound of a share."""
    part = F.least(part, whole)
    spread = z * F.sqrt(part * (whole - part) / whole + z * z / 4)
    return (part + z * z / 2 - spread) / (whole + z * z)


def site_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.5) -> DataFrame:
    """host and the digests of its template subtrees, all on ``min_pages`` distinct pages or more.

    A subtree is one if the lower bound of its share of the pages of the host, or of
    a section (first folder) of it, is ``min_share`` or more; or if that holds for its
    place on the pages of the host and all subtrees that recur there together, as
    when adverts rotate.  Pages of a host that are equal count once, all counts are
    exact.  A host has
    at most as many such digests as an average page has subtrees, times
    1 / ``min_share`` and its sections; those of a place are at most its pages / ``min_pages``.
    """
    p = pages.select("host", page_section(F.col("url")).alias("section"), "html", F.xxhash64("html").alias("page")).filter("html is not null")
    known = p.select("host", "section", "page").distinct()
    counts = known.groupBy("host").agg(F.count_distinct("page").alias("pages")).withColumn("unit", F.lit(""))
    sections = known.filter("section <> ''").groupBy("host", F.col("section").alias("unit")).agg(F.count("*").alias("pages"))
    counts = counts.unionByName(sections).filter(F.col("pages") >= min_pages)
    found = p.select("host", "section", "page", F.explode(_hash_udf(F.col("html"))).alias("s")).select("host", "section", "page", "s.*")
    units = F.when((F.col("place") == 0) & (F.col("section") != ""), F.array(F.lit(""), F.col("section"))).otherwise(F.array(F.lit("")))
    held = (
        found.withColumn("unit", F.explode(units))
        .select("host", "unit", "place", "digest", "page")
        .distinct()
        .groupBy("host", "unit", "place", "digest")
        .agg(F.count("*").alias("holders"))
        .filter(F.col("holders") >= min_pages)
    )
    held = materialize(held.join(counts, ["host", "unit"]), "page-subtrees")
    anywhere = held.filter("place = 0").filter(_lower_bound(F.col("holders"), F.col("pages")) >= min_share)
    placed = held.filter("place <> 0")
    places = placed.groupBy("host", "place").agg(F.sum("holders").alias("recurring"), F.max("pages").alias("all_pages"))
    places = places.filter(_lower_bound(F.col("recurring"), F.col("all_pages")) >= min_share)
    digests = anywhere.select("host", "digest").unionByName(placed.join(places, ["host", "place"]).select("host", "digest"))
    return materialize(digests.groupBy("host").agg(F.sort_array(F.collect_set("digest")).alias("templates")), "page-templates")


def extract_text(pages: DataFrame, min_pages: int = 5, min_share: float = 0.5, lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each page.

    A null page has an empty text; a null URL belongs to the host with an empty
    name; repeated rows each get their row; an empty table gives no rows; a page of
    any length and nesting is parsed whole, in time linear in its length; names of
    classes and ids are a matter outside the article, and inside it only whole names of
    adverts, comments, sharing and paging; columns beside page_id, url and html are left out.
    """
    p = bare(small_batches(pages), "page_id", "url", "html").select(
        "page_id", "url", F.col("html").cast("string").alias("html"), page_host(F.col("url")).alias("host")
    )
    known = site_templates(p, min_pages, min_share)
    text = _text_udf(F.col("html"), F.col("templates"), lists)
    return p.join(known, "host", "left").select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )
