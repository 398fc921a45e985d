"""Main-text extraction with a site style tree.

The DOMs of all pages of a host are merged: elements with the same path of tags
and classes are one style node. Over the pages that have a node, the entropy of
its contents and of its layouts (with the number of pages as base) gives its
importance; content that returns on page after page has an importance near 0,
content of one page only has 1. Low branches are cut from every page of the host:
nodes that are low together with every node under them, so no node goes that is
above a kept one. Content that is new on every page but no article, such as
comments and forms, has a high importance; so elements whose tag or class states
such a role are cut as well.

An <article> or <main> element, where a page has one, states where the article is:
its content counts for the nodes around it. Inside it the tree cuts only branches
with a class, id or role of their own: plain paragraphs that copies of an article
share are no boilerplate.

Defined results: a null html is empty, a null url belongs to the host ''; pages
without text get ''; a node on fewer than three pages has no entropy to speak of and
is kept; a page of which the tree would leave nothing (a copy) keeps what no role
rules out; repeated rows get equal rows and count as pages of their own; an empty
table gives no rows. Unclosed and stray tags are tolerated, cut-off markup at the end
is dropped, elements nested deeper than 512 become siblings, as in browsers.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
#: How many times quotes may lead a tag astray before the rest of a page is read without them.
ASTRAY = 64
RAW = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "svg")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote"}
ROLE_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "head"}
#: A class, id or role states a role when one of its words does and the others only say which or where.
ROLE_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices popup popups modal"
    " newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond replies reply disqus"
    " share sharing social toolbar pagination pager banner banners related recommended recommendations skip widget widgets overlay complementary contentinfo".split()
)
OTHER_WORDS = set(
    "site page main top bottom left right primary secondary global box bar block container wrapper wrap inner outer area section list item items row col column content body text link links"
    " button buttons icon icons form reader readers user users post posts article articles story stories slot unit zone panel group holder title heading count thread tree home mobile desktop"
    " sticky fixed dropdown toggle small large full mini policy message alert to the header and by on".split()
)
#: Roles of whole pages: inside an article these words say nothing.
PAGE_WORDS = {"header", "masthead", "topbar"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies"}
#: Elements that hold the article or the whole page; a class on them rules nothing out, but an article may be a comment.
WHOLE = {"html", "body", "main", "article", *HEADINGS}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W_0-9]+")
#: Whole attributes as browsers divide them: a name, and a value in quotes or up to the next space.
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+))?""")
#: Importance under which a branch goes, and the pages that a node must be on.
LEAST, PAGES = 0.25, 3
GAMMA, DEEPEST = 0.9, 512


@lru_cache(1 << 16)
def role_of(names: str) -> frozenset[str]:
    """The role words that the names (divided by spaces) state."""
    found: set[str] = set()
    for name in names.split():
        parts = {p.lower() for p in PARTS.findall(name) if not p.isdigit()}
        own = parts & (ROLE_WORDS | PAGE_WORDS)
        if own and parts <= ROLE_WORDS | PAGE_WORDS | OTHER_WORDS:
            found |= own
    return frozenset(found)


class Element:
    __slots__ = ("article", "block", "key", "named", "out", "parent", "tag")

    def __init__(self, tag: str, key: int, parent: Element | None, out: bool, article: bool, named: bool) -> None:
        self.tag, self.key, self.parent, self.out, self.article, self.named = tag, key, parent, out, article, named
        self.block = tag in BLOCK


class Block:
    """A block's text, its element, whether a role rules it out, whether it is in an article, and there in a branch with a name of its own."""

    __slots__ = ("article", "element", "named", "out", "text")

    def __init__(self, text: str, element: Element) -> None:
        self.text, self.element, self.out, self.article, self.named = text, element, element.out, element.article, element.named
        while not self.element.block and self.element.parent is not None:
            self.element = self.element.parent


def tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """Texts, and matches of TAG with the text before them; comments, declarations and raw elements are left out."""
    at, text_from, end, astray, last = 0, 0, len(page), 0, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            yield page[text_from:at], None
            at = text_from = close + 3 if close >= 0 else end
            continue
        nxt = page[at + 1 : at + 2]
        m = TAG.match(page, at) if astray < ASTRAY else None
        if m is None:
            if astray < ASTRAY and nxt.isalpha():
                astray += 1
            m = PLAIN_TAG.match(page, at)
        if m is None:
            if nxt and nxt in "!?/":
                yield page[text_from:at], None
                at = text_from = page.find(">", at) + 1 if last > at else end
            elif last < at and nxt.isascii() and nxt.isalpha() and page.find("<", at + 1) < 0:
                yield page[text_from:at], None  # markup cut off at the end
                at = text_from = end
            else:
                at += 1
            continue
        yield page[text_from:at], m
        at = text_from = m.end()
        tag = m[2].lower()
        if tag in RAW and not m[1] and not (tag == "svg" and m[3].endswith("/")):  # foreign elements may close themselves
            close = RAW[tag].search(page, at)
            at = text_from = close.end() if close else end
    if text_from < end:
        yield page[text_from:], None


def blocks(page: str) -> list[Block]:
    """Text blocks in order."""
    found: list[Block] = []
    stack = [Element("", 0, None, False, False, False)]
    opened: Counter = Counter()
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                found.append(Block(text, stack[-1]))

    def cut(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    for text, m in tokens(page):
        if text:
            parts.append(text)
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if any(e.block for e in stack[k:]):
                            flush()
                        cut(k)
                        break
                    if stack[k].block and tag not in BLOCK:
                        break  # a stray inline end tag ends no block
            continue
        if tag in RAW:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        cut(k)
                        break
                    if stack[k].tag in SCOPE:
                        break
            if tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSES[tag]:
                        cut(k)
                        break
                    if stack[k].tag in SCOPE:
                        break
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
        if len(stack) > DEEPEST:
            flush()
            cut(DEEPEST)
        over = stack[-1]
        names, hidden = "", False
        if m[3]:
            for name, value in ATTRIBUTE.findall(m[3]):
                name = name.lower()
                if name in ("class", "id", "role"):
                    names += " " + value.strip("\"'")
                elif name in ("hidden", "aria-hidden"):
                    hidden = hidden or value.strip("\"'").lower() != "false"
        article = over.article or tag in ("article", "main")
        roles = role_of(names) if names else frozenset()
        if tag in WHOLE:
            roles &= COMMENT_WORDS if tag == "article" else frozenset()
        elif over.article:
            roles -= PAGE_WORDS
        out = over.out or hidden or tag in ROLE_TAGS or bool(roles) or tag == "header" and not over.article
        key = xxhash.xxh64_intdigest(f"{over.key}>{tag}.{names}") >> 1 if tag in BLOCK else over.key
        named = over.article and (over.named or bool(names.strip()) and tag in BLOCK and tag not in HEADINGS)
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        stack.append(Element(tag, key, over, out, article, named))
        opened[tag] += 1
    flush()
    return found


def extract(page: str, low: set[int]) -> str:
    """The article's blocks, one a line."""
    own = [b for b in blocks(page) if not b.out]
    kept = [b for b in own if b.element.key not in low or b.article and not b.named]
    own = kept or own
    if any(b.article for b in own):
        own = [b for b in own if b.article]
    return "\n".join(b.text for b in own)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, above, pages, importance) of the style nodes of all hosts, from columns host and html.

    ``above`` is the path from the root to the node, itself included. A leaf node's content importance is 1 less the mean entropy of its texts: a text
    on k of m pages has entropy log_m k. A layout is the set of nodes under a node.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: Counter = Counter()

        def out() -> pa.RecordBatch:
            host, node, kind, what, above, n = zip(*[(*k, v) for k, v in rows.items()], strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(what, pa.int64()), pa.array([list(a) for a in above], pa.list_(pa.int64())), pa.array(n, pa.int64())],
                names=["host", "node", "kind", "what", "above", "n"],
            )

        for slab in C.slabs(batches, "html"):
            for host, page in zip(slab.column(0).to_pylist(), slab.column(1).to_pylist(), strict=True):
                seen, under = set(), {}
                paths: dict[int, tuple[int, ...]] = {}
                for block in blocks(page):
                    leaf = block.element
                    if leaf.parent is None:
                        continue
                    if leaf.key not in paths:  # a key stands for its whole path
                        path, e = [], leaf
                        while e.parent is not None:
                            if e.block:
                                path.append(e.key)
                            e = e.parent
                        paths[leaf.key] = tuple(reversed(path))
                    keys = paths[leaf.key]
                    seen.add((host, leaf.key, 0, xxhash.xxh64_intdigest(block.text) >> 1, keys))
                    if leaf.key in under:
                        continue
                    for k, node in enumerate(keys):
                        if node not in under:
                            under[node] = keys[: k + 1], set()
                        if k:
                            under[keys[k - 1]][1].add(node)
                for node, (above, children) in under.items():
                    seen.add((host, node, 1, xxhash.xxh64_intdigest(repr(sorted(children))) >> 1, above))
                rows.update(seen)
            if len(rows) > 200_000:
                yield out()
        if rows:
            yield out()

    rows = pages.mapInArrow(count, "host string, node long, kind int, what long, above array<long>, n long")
    rows = C.written(rows.groupBy("host", "node", "kind", "what", "above").agg(F.sum("n").alias("n")), "nodes")
    layout = rows.where("kind = 1").groupBy("host", "node", "above").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.count("*").alias("styles"))
    # entropy of layouts: -sum p log_m p, with p = n / m
    layout = layout.select("host", "node", "above", "m", "styles", F.when(F.col("m") > 1, (F.ln("m") - F.col("s") / F.col("m")) / F.ln("m")).otherwise(1.0).alias("node_imp"))
    leaf = rows.where("kind = 0").groupBy("host", "above").agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.ln("n")).alias("t"))
    leaf = leaf.select("host", F.explode("above").alias("node"), "texts", "t").groupBy("host", "node").agg(F.sum("texts").alias("texts"), F.sum("t").alias("t"))
    both = layout.join(leaf, ["host", "node"])
    content = F.when(F.col("m") > 1, 1 - F.least(F.col("t") / F.col("texts") / F.ln("m"), F.lit(1.0))).otherwise(1.0)
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    return both.select("host", "node", "above", F.col("m").alias("pages"), ((1 - weight) * F.col("node_imp") + weight * content).alias("importance"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST, min_pages: int = PAGES) -> DataFrame:
    """page_id, url and text for every row."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    tree = style_tree(pages.select("host", "html")).withColumn("high", (F.col("pages") < min_pages) | (F.col("importance") >= least))
    low = tree.select("host", F.explode("above").alias("node"), "high").groupBy("host", "node").agg(F.max("high").alias("high")).where("not high")
    low = C.written(low.groupBy("host").agg(F.collect_list("node").alias("low")), "low")
    small = low.agg(F.sum(F.size("low"))).first()[0] or 0
    joined = pages.join(F.broadcast(low) if small <= C.BROADCAST_ROWS else low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in C.slabs(batches, "html"):
            text = [extract(page, set(nodes or ())) for page, nodes in zip(slab.column(2).to_pylist(), slab.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([slab.column(0), slab.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(C.table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
