"""Main text of web pages by a site style tree.

The DOMs of all pages of a host are merged: a node of the tree is a path of styles (tag, class and id), its contents are the
texts found below it and its presentations the sequences of child styles. The importance of a node combines the diversity of its
presentations with one minus the mean entropy of its contents over the host's distinct pages, both on a scale of 0 to 1:
what every page repeats has none, what one page has alone has all. Contents are counted once for each distinct page, so
copies of a page don't make its article look like a template. A host of one page says nothing of its nodes.

A page's main branch is found by importance: every text weighs its characters, those of unimportant nodes FLOOR of them, and
from the root the way goes down to the heaviest child as long as it outweighs the texts that stand in the node itself. What HTML
means by an element counts as the importance of its presentation: text of articles weighs ARTICLE times as much, navigation,
footers and what names itself by the contract's words nothing. Of the main branch the unimportant
branches are removed. Plain paragraphs and headings of an article element are never removed for being repeated, as different pages may carry
one article, nor is anything where most of the main branch would go.

Each page is parsed once; its texts and nodes are written, and the tree and the texts are made from them.

Defined results: null and empty pages, and pages without an article's text, give the empty text. Null URLs are a host of their own. Repeated
rows and ties are extracted alike, each by itself; of equally heavy branches the first counts. Very long and deeply nested pages are taken whole, in linear time. An empty table
gives an empty result. Extra columns are ignored.
"""


from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, staged, text_of
from .words import slices

#: Importance below which a node is unimportant, and weight of the presentations in it.
LEAST, PRESENTATION = 0.5, 0.1
#: Weights of a text's characters in unimportant nodes and in articles.
FLOOR, ARTICLE = 0.05, 8
#: Elements deeper than so many stand in the tree where the last of these does, as in browsers. Their texts stay.
DEPTH = 512
#: Parts into which the rows of one host are dealt.
SALTS = 16

# HTML's elements, by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg math select object canvas audio video".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = set("br td th img wbr".split()) - {"wbr"}
DROPPED_TAGS = set("head form menu dialog search button label fieldset legend optgroup option".split())
SIDE_TAGS = set("nav footer aside".split())
SIDE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: What the parts of a page that are no article are called in the contract, as names of classes and identifiers.
SIDE_NAMES = set("menu nav navbar navigation header footer sidebar notice cookie consent ad ads advert advertisement banner promo sponsored form comment comments".split())
ARTICLE_TAGS, ARTICLE_ROLES = {"article", "main"}, {"article", "main"}
#: Blocks that hold text rather than other blocks.
TEXTUAL = set("address blockquote caption center dd details dl dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr legend li ol p pre summary table tbody td tfoot th thead tr ul".split())
#: Elements that the start of another one closes, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


#: Flags of a node: it may hold other blocks, lies in an article, in a side branch, has a style of its own below an article, is the page's body.
HOLDS, INSIDE, SIDE, STYLED, BODY = 1, 2, 4, 8, 16


@dataclass(slots=True)
class Element:
    tag: str
    node: int
    dropped: bool


@dataclass
class Page:
    """Nodes, each after its parent: number in the tree, parent's place, flags, style. Texts in order: node and text."""

    ids: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)
    styles: list[str] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(next((x for x in m.group(2, 3, 4) if x is not None), "")))
    return found


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def parse(source: str) -> Page:
    """The nodes of a page and its blocks of text, without those of forms and of what isn't shown."""
    page, place = Page(), {}
    stack: list[Element] = []
    buffer: list[str] = []

    def node(parent: int, style: str, flags: int) -> int:
        key = parent, style, flags
        if key not in place:
            place[key] = len(page.ids)
            page.ids.append(_number(str(page.ids[parent]) if parent >= 0 else "", style))
            page.parents.append(parent)
            page.flags.append(flags)
            page.styles.append(style)
        return place[key]

    node(-1, "", HOLDS | BODY)

    def opened(tag: str, source: str) -> tuple[Element, bool]:
        """The element, and whether it is a side branch of its own."""
        parent = stack[-1] if stack else None
        above = parent.node if parent else 0
        had = page.flags[above]
        attributes = _attributes(source) if source and not source.isspace() else {}
        name = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        role = attributes.get("role", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        article = tag in ARTICLE_TAGS or role in ARTICLE_ROLES
        whole = article or tag in ("html", "body")
        names = {x.lower() for x in _NAMES.findall(name)} if name and not whole else set()
        side = tag in SIDE_TAGS or role in SIDE_ROLES or not names.isdisjoint(SIDE_NAMES) or tag == "header" and not had & INSIDE
        flags = had & (SIDE | INSIDE) | SIDE * side | INSIDE * article | HOLDS * (tag not in TEXTUAL) | BODY * (tag in ("html", "body"))
        flags |= STYLED * bool(had & INSIDE and not article and (name or had & STYLED))
        style = f"{tag}.{' '.join(sorted(name.split()))}" if name else tag
        here = node(above, style, flags) if len(stack) < DEPTH or (had ^ flags) & SIDE else above
        return Element(tag, here, bool(parent and parent.dropped) or tag in DROPPED_TAGS or hidden), side

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        top = stack[-1] if stack else None
        if text and not (top and top.dropped):
            page.nodes.append(top.node if top else 0)
            page.texts.append(text)

    at = 0
    while m := _TOKEN.search(source, at):
        if m.start() > at:
            buffer.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, rest = tag.lower(), bool(m[1] or m[4]), (m[3] or m[6] or "")
        block = tag in BLOCK
        if block:
            flush()
        elif tag in SPACED:
            buffer.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    if not block:
                        flush()
                    del stack[i:]
                    break
                if not block and stack[i].tag in BLOCK:
                    break  # an inline element doesn't end a block around it
            continue
        if tag in RAW:
            end = _CLOSING[tag].search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID:
            continue
        if block:
            if stack and stack[-1].tag == "p":
                stack.pop()
            if tag != "head" and any(x.tag == "head" for x in stack[:4]):
                while stack and stack.pop().tag != "head":
                    pass
            if tag in CLOSES:
                own, limit = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in own:
                        del stack[i:]
                        break
                    if stack[i].tag in limit:
                        break
            stack.append(opened(tag, rest)[0])
        elif rest and not rest.isspace():
            element, side = opened(tag, rest)
            if (element.dropped or side) and not (stack and stack[-1].dropped):
                flush()
                stack.append(element)  # an inline element matters only where it is removed
    buffer.append(source[at:])
    flush()
    return page


def main_places(page: Page, weak: set[int]) -> list[int]:
    """Places of the texts of the main branch. weak: numbers of unimportant nodes."""
    n = len(page.ids)
    low = np.zeros(n, dtype=bool)  # the node or one above it is unimportant
    for i in range(n):
        low[i] = page.ids[i] in weak or i > 0 and low[page.parents[i]]
    flags = np.array(page.flags)
    inside, side = flags & INSIDE > 0, flags & SIDE > 0
    own = np.zeros(n)  # weight of the texts that stand in the node itself or in its textual children
    for i, text in zip(page.nodes, page.texts, strict=True):
        own[i] += len(text)
    own *= np.where(low, FLOOR, 1.0) * np.where(inside, ARTICLE, 1.0) * ~side
    whole = own.copy()
    below: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        whole[page.parents[i]] += whole[i]
        below[page.parents[i]].append(i)
    at, way = 0, {0}
    while True:
        holds = [i for i in reversed(below[at]) if flags[i] & HOLDS]
        best = max(holds, key=lambda i: whole[i], default=None)
        if best is None or whole[best] <= whole[at] - sum(whole[i] for i in holds):
            break
        at = best
        way.add(at)
    # Texts directly in the nodes that were passed, below the page's body, belong to the branch, as its headings do.
    under = np.zeros(n, dtype=bool)
    under[at] = True
    for i in range(1, n):
        up = page.parents[i]
        under[i] |= under[up] or up in way and up != at and not flags[up] & BODY and not flags[i] & HOLDS
    found = [k for k, i in enumerate(page.nodes) if (under[i] or i in way and not flags[i] & BODY) and not side[i]]
    strong = [k for k in found if not low[page.nodes[k]] or inside[page.nodes[k]] and not flags[page.nodes[k]] & STYLED]
    size = lambda ks: sum(len(page.texts[k]) for k in ks)
    return strong if 2 * size(strong) >= size(found) else found


def main_text(page: Page, weak: set[int]) -> str:
    return "\n\n".join(page.texts[k] for k in main_places(page, weak))


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_PARSED = "host string, number long, ids array<long>, parents array<int>, flags array<int>, nodes array<int>, texts array<string>, shown array<long>"


def parsed(pages: DataFrame) -> DataFrame:
    """id, url and html of pages made to id, url and the columns of _PARSED. shown: numbers of each node's sequence of child styles."""
    ship(pages.sparkSession)
    schema = T.StructType([pages.schema["id"], pages.schema["url"], *T._parse_datatype_string(_PARSED).fields])
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column(3).to_pylist()):
                own = batch.slice(at, len(part))
                at += len(part)
                found = [parse(x) for x in part]
                shown = []
                for page in found:
                    children: list[list[str]] = [[] for _ in page.ids]
                    for i in range(1, len(page.ids)):
                        children[page.parents[i]].append(page.styles[i])
                    for i in page.nodes:
                        children[i].append("#text")
                    shown.append([_number(*x) for x in children])
                lists = [pa.array([getattr(x, name) for x in found], kind) for name, kind in (("ids", longs), ("parents", ints), ("flags", ints), ("nodes", ints), ("texts", pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array([_number(x) for x in part], pa.int64()), *lists, pa.array(shown, longs)], names=schema.names)

    return pages.select("id", "url", "host", "html").mapInArrow(run, schema)


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """pages: as made by parsed(). Returns host, node, importance of all nodes of hosts with several distinct pages."""
    schema = "host string, number long, node long, content long, child long, path array<long>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, paths = [], []
                for x in batch.slice(at, 256).to_pylist():
                    way: list[list[int]] = []
                    for i, up in zip(x["ids"], x["parents"], strict=True):
                        way.append([*(way[up] if up >= 0 else ()), i])
                    own = {(i, t) for i, t in zip(x["nodes"], x["texts"], strict=True)}
                    rows += [(x["host"], x["number"], x["ids"][i], _number(t), None) for i, t in own]
                    paths += [way[i] for i, _ in own]
                    rows += [(x["host"], x["number"], i, None, c) for i, c in zip(x["ids"], x["shown"], strict=True)]
                    paths += [None] * len(x["ids"])
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array(paths, pa.list_(pa.int64()))], names=["host", "number", "node", "content", "child", "path"])

    own = pages.select("host", "number", "ids", "parents", "nodes", "texts", "shown").mapInArrow(run, schema)
    rows = own.groupBy("host", "number", "node", "content", "child").agg(F.first("path").alias("path"))
    counts = staged(rows.groupBy("host", "node", "content", "child").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("path")), "style-counts")
    sizes = pages.select("host", "number").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # The rows of one host meet its size in parts.
    salt = F.pmod(F.xxhash64("node", "content", "child"), F.lit(SALTS)).cast("int")
    known = counts.withColumn("salt", salt).join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"])
    content = known.filter("content IS NOT NULL").groupBy("host", "node").agg(F.sum(1 - F.log("n") / F.log("m")).alias("sum"), F.count(F.lit(1)).alias("k"), F.first("path").alias("path"))
    content = content.select("host", F.explode("path").alias("node"), "sum", "k").groupBy("host", "node").agg((F.sum("sum") / F.sum("k")).alias("content"))
    shown = known.filter("child IS NOT NULL").groupBy("host", "node").agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log("n")).alias("logs"), F.max("m").alias("m"))
    diverse = F.greatest(F.lit(0.0), (F.log("seen") - F.col("logs") / F.col("seen")) / F.log("m"))
    shown = shown.select("host", "node", diverse.alias("diverse"))
    return content.join(shown, ["host", "node"]).select("host", "node", ((1 - PRESENTATION) * F.col("content") + PRESENTATION * F.col("diverse")).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of every page.

    The unimportant nodes of a host go along with its pages. A node is unimportant only if its contents are on m ** (1 - LEAST) pages or
    more, on the mean, so a host of m pages with k nodes each has at most k * m ** LEAST of them.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html")).withColumn("host", _host("url"))
    read = staged(parsed(rows), "style-pages")
    weak = style_tree(read).filter(F.col("importance") < LEAST).groupBy("host").agg(F.collect_list("node").alias("weak"))
    weak = staged(weak, "style-weak").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = read.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(SALTS)).cast("int"))
    joined = salted.join(weak, ["host", "salt"], "left").select("id", "url", "ids", "parents", "flags", "nodes", "texts", "weak")
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                columns = [own.column(i).to_pylist() for i in range(2, 8)]
                texts = [main_text(Page(ids, parents, flags, [], nodes, text), set(weak or ())) for ids, parents, flags, nodes, text, weak in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)
