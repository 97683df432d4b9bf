"""HTML extraction by wrapper induction over the pages of a host.

For each host one page is the reference. Every other page's DOM tree is aligned with the reference's by simple tree
matching (the greatest order-preserving match of children, level by level, exact for lists of every length). A reference node that
most pages have with the same text is template; where texts vary, it is a content slot, as are nodes without a
partner. What the host's pages have in an article or main element is content from the start, since a page's only
paragraph may well stand on all its host's pages: template nodes there are left out only if the host's other
article nodes vary. Elsewhere content is what varies. Menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, scripts and styles are never content (by element, role and class).

Within a block (paragraph, heading, item, cell ...) character references are decoded and white space becomes one
space; blocks are joined by an empty line. Pages without content, and null pages, give an empty text. Hosts of one or two pages have no
template. Repeated pages are extracted alike. A host with a large share of all pages costs no more per page:
the reference is broadcast if all references are small, and else joined with dealt keys.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import lookup_join, materialize

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</[a-zA-Z][^>]*>?|<[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Fixed values of the HTML standard: elements without content, with raw text, and those that begin a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("nav header footer aside form head menu dialog button select svg math object audio video canvas".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_CLASSES = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ARTICLE, PLAIN, NEVER = 0, 1, 2


class Node:
    __slots__ = ("tag", "key", "zone", "children", "blocks", "index", "size", "shape")

    def __init__(self, tag: str, key: str, zone: int):
        self.tag, self.key, self.zone, self.children, self.blocks, self.index = tag, key, zone, [], [], -1
        self.size, self.shape = 1, -1


def _zone(tag: str, attributes: str, above: int) -> int:
    if above == NEVER or tag in _NEVER:
        return NEVER
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if value in _ROLES:
                return NEVER
            if value == "main":
                return ARTICLE
        elif tag not in ("html", "body", "article", "main") or "comment" in value:
            words = re.split(r"[^a-z0-9]+", value)
            if not _CLASSES.isdisjoint(words) or "header" in words and ("page" in words or "site" in words or words == ["header"]):
                return NEVER
    return ARTICLE if above == ARTICLE or tag in ("article", "main") else PLAIN


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The element tree, and the text blocks in page order, each with its node."""
    root = Node("#root", "#root", PLAIN)
    stack, blocks, parts, opened = [root], [], [], Counter()

    def close(k: int) -> None:
        """Leave the elements from the k-th on."""
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    def innermost(tag: str) -> int:
        """Place of the last open element of this tag, 0 if there is none."""
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if opened[tag] else 0

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            if text := " ".join((_html.unescape(text) if "&" in text else text).split()):
                at = next(n for n in reversed(stack) if n.tag in _BLOCK or n is root)
                if stack[-1].zone != NEVER:
                    at.blocks.append(text)
                    blocks.append((at, text))

    position, size = 0, len(page)
    while position < size:
        m = _TOKEN.match(page, position)
        token, position = m[0], m.end()
        if token[0] != "<" or len(token) < 2:
            if stack[-1].zone != NEVER:
                parts.append(token)
            continue
        if not (name := _NAME.match(token)):
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if tag == "p" and not opened["p"]:
                flush()
            if k := innermost(tag):
                if any(n.tag in _BLOCK or n.zone != stack[k - 1].zone for n in stack[k:]):
                    flush()
                close(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            k = innermost("p")
            if k and all(n.tag not in ("td", "th", "button") for n in stack[k:]):  # a block ends an open paragraph
                close(k)
            if tag in _CLOSES and any(opened[t] for t in _CLOSES[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in _CLOSES[tag]:
                        close(i)
                        break
                    if stack[i].tag in _SCOPES.get(tag, ()):
                        break
        attributes = token[name.end() :]
        zone = _zone(tag, attributes, stack[-1].zone)
        if zone != stack[-1].zone:
            flush()
        node = Node(tag, tag, zone)
        stack[-1].children.append(node)
        if tag in _VOID or token.endswith("/>") and tag not in _BLOCK | _RAW:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, position)
            position = end.end() if end else size
            continue
        stack.append(node)
        opened[tag] += 1
    flush()
    return root, blocks


def number(node: Node, n: int = 0) -> int:
    """Give every node its index in document order."""
    todo = [node]
    while todo:
        x = todo.pop()
        x.index = n
        n += 1
        todo.extend(reversed(x.children))
    return n


def measure(root: Node, known: dict) -> None:
    """Give every node the number of its subtree's nodes and the id of its subtree's shape."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(x.children)
    for x in reversed(order):
        x.size = 1 + sum(c.size for c in x.children)
        x.shape = known.setdefault((x.key, *(c.shape for c in x.children)), len(known))


def _common(xs: list[Node], ys: list[Node]) -> int:
    """Children of equal shape in front: some greatest match pairs them, and it is the one that _partners finds."""
    return next((i for i, (x, y) in enumerate(zip(xs, ys, strict=False)) if x.shape != y.shape), min(len(xs), len(ys)))


def _kinds(ys: list[Node]) -> tuple[list[Node], np.ndarray]:
    """A node of each shape, and which of them each node is like."""
    first: dict[int, int] = {}
    at = np.array([first.setdefault(y.shape, len(first)) for y in ys])
    return list({y.shape: y for y in ys}.values()), at


def _below(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of the table of greatest matches of beginnings."""
    row = above.copy()
    np.maximum(above[1:], above[:-1] + weights, out=row[1:])
    return np.maximum.accumulate(row)


def _known(a: Node, b: Node, memo: dict) -> int | None:
    """Size of the greatest match of two trees, as far as it needs no table of children."""
    if a.shape == b.shape:
        return a.size
    if a.key != b.key:
        return 0
    if not a.children or not b.children:
        return 1
    return memo.get((a.shape, b.shape))


def _score(a: Node, b: Node, memo: dict) -> int:
    """Size of the greatest match of two trees: simple tree matching, from the leaves up, without recursion."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if _known(x, y, memo) is not None:
            todo.pop()
            continue
        k = _common(x.children, y.children)
        total, xs, ys = 1 + sum(c.size for c in x.children[:k]), x.children[k:], y.children[k:]
        if xs and ys:
            kinds, at = _kinds(ys)
            first = list({c.shape: c for c in xs}.values())
            if missing := [(p, q) for p in first for q in kinds if _known(p, q, memo) is None]:
                todo += missing
                continue
            row, weights = np.zeros(len(ys) + 1, dtype=np.int64), {}
            for c in xs:
                if c.shape not in weights:
                    if len(weights) >= 200:
                        weights.clear()
                    weights[c.shape] = np.array([_known(c, q, memo) for q in kinds])[at]
                row = _below(row, weights[c.shape])
            total += int(row[-1])
        memo[x.shape, y.shape] = total
    return _known(a, b, memo)


def _partners(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The pairs of the greatest match of two child lists. Of the table's rows every step-th is kept; those between are made again on the way back."""
    k = _common(xs, ys)
    out, xs, ys = list(zip(xs[:k], ys[:k], strict=True)), xs[k:], ys[k:]
    if not xs or not ys:
        return out
    kinds, at = _kinds(ys)
    weights: dict[int, np.ndarray] = {}

    def below(row: np.ndarray, x: Node) -> np.ndarray:
        if x.shape not in weights:
            if len(weights) >= 200:
                weights.clear()
            weights[x.shape] = np.array([_score(x, y, memo) for y in kinds])[at]
        return _below(row, weights[x.shape])

    step = math.isqrt(len(xs)) + 1
    row = np.zeros(len(ys) + 1, dtype=np.int64)
    kept = [row]
    for i, x in enumerate(xs, 1):
        row = below(row, x)
        if i % step == 0:
            kept.append(row)
    i, j, low, table = len(xs), len(ys), len(xs), []
    while i and j:
        if i <= low:
            low = (i - 1) // step * step
            table = [kept[low // step]]
            for x in xs[low:i]:
                table.append(below(table[-1], x))
        here, above = table[i - low], table[i - low - 1]
        if here[j] == above[j]:
            i -= 1
        elif here[j] == here[j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out


def align(page: Node, reference: Node) -> dict[int, Node]:
    """id of each of the page's nodes that has a partner: the reference's node."""
    memo: dict = {}
    shapes: dict = {}
    measure(page, shapes)
    measure(reference, shapes)
    out, todo = {}, [(page, reference)]
    while todo:
        a, b = todo.pop()
        out[id(a)] = b
        todo += _partners(a.children, b.children, memo)
    return out


_SCHEMA = [("_blocks", T.ArrayType(T.StringType())), ("_nodes", T.ArrayType(T.IntegerType())), ("_zones", T.ArrayType(T.IntegerType())), ("_same", T.ArrayType(T.BooleanType()))]


def _aligned(df: DataFrame) -> DataFrame:
    """df with its blocks: text, the reference's node (-1: none), zone, and whether the reference has the same text there."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in ("_html", "_reference")), *(T.StructField(n, t) for n, t in _SCHEMA)])
    arrow = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for page, text in zip(batch.column("_html"), batch.column("_reference"), strict=True):
                tree, blocks = parse(page.as_py() or "")
                text = text.as_py()
                partner: dict[int, Node] = {}
                if text is not None and blocks:
                    if text not in known:
                        if len(known) >= 200:
                            known.clear()
                        known[text] = parse(text)[0]
                        number(known[text])
                    partner = align(tree, known[text])
                nodes = [partner.get(id(n)) for n, _ in blocks]
                out[0].append([t for _, t in blocks])
                out[1].append([-1 if n is None else n.index for n in nodes])
                out[2].append([n.zone for n, _ in blocks])
                out[3].append([n is not None and t in n.blocks for n, (_, t) in zip(nodes, blocks, strict=True)])
            kept = batch.drop_columns(["_html", "_reference"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x, t) for x, t in zip(out, arrow, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)


def extract(
    pages: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text", constant: float = 0.8, least_pages: int = 3, reference_bytes: int = 32 << 20
) -> DataFrame:
    """pages without the html column, with the main text."""
    kept = [c for c in pages.columns if c not in (html_col, out)]
    host = F.regexp_extract(F.lower(F.coalesce(url_col, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    # The other columns travel as one struct, so that their names can't clash with those used here.
    rows = pages.select((F.struct(*kept) if kept else F.lit(0)).alias("_kept"), F.col(html_col).alias("_html"), host.alias("_host"))
    # The reference: of a middling length, then by hash, so that it doesn't depend on the order of the rows.
    rank = F.struct(F.abs(F.log2(F.length("_html") + 1.0) - 12).cast("int"), F.xxhash64("_html"))
    references = materialize(rows.where("_html is not null").groupBy("_host").agg(F.min_by("_html", rank).alias("_reference"), F.count("*").alias("_pages")), "references")
    shown = references.select("_host", F.when(F.col("_pages") > 2, F.col("_reference")).alias("_reference"))
    aligned = materialize(_aligned(lookup_join(rows, shown, "_host", F.octet_length("_host") + F.coalesce(F.octet_length("_reference"), F.lit(0)) + 64, reference_bytes)), "blocks")
    votes = (
        aligned.select("_host", F.explode_outer(F.array_distinct(F.arrays_zip("_nodes", "_same", "_zones"))).alias("v"))
        .where("v._nodes >= 0")
        .groupBy("_host", F.col("v._nodes").alias("node"), F.col("v._zones").alias("zone"))
        .agg(F.count("*").alias("n"), F.sum(F.col("v._same").cast("int")).alias("same"))
    )
    fixed = (F.col("n") >= least_pages) & (F.col("same") >= constant * F.col("n"))
    wrappers = votes.groupBy("_host").agg(
        F.collect_set(F.when(fixed, F.col("node"))).alias("_template"),
        (F.sum(F.when((F.col("zone") == ARTICLE) & fixed, F.col("n")).otherwise(0)) * 2 < F.sum(F.when(F.col("zone") == ARTICLE, F.col("n")).otherwise(0))).alias("_varies"),
    )
    joined = lookup_join(aligned, wrappers, "_host", F.octet_length("_host") + 4 * F.size("_template") + 64, reference_bytes)
    block = F.arrays_zip(F.col("_blocks").alias("text"), F.col("_nodes").alias("node"), F.col("_zones").alias("zone"))
    template = F.coalesce("_template", F.array().cast("array<int>"))
    is_fixed = lambda b: F.array_contains(template, b["node"])
    content = F.when(
        F.array_contains("_zones", ARTICLE), F.filter(block, lambda b: (b["zone"] == ARTICLE) & ~(F.coalesce("_varies", F.lit(False)) & is_fixed(b)))
    ).otherwise(F.filter(block, lambda b: (b["zone"] == PLAIN) & ~is_fixed(b)))
    done = joined.select("_kept", F.array_join(F.transform(content, lambda b: b["text"]), "\n\n").alias("_out"))
    return done.select(*(F.col("_kept")[c].alias(c) for c in kept), F.col("_out").alias(out))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
