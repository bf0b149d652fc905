"""Main text of web pages by consensus of each host's pages.

Every page's containers are scored by how much of the page's running text they hold and how little
else. Pages vote for the generalised tag-and-class paths of their best containers; votes are summed by
host and path in Spark. Each page is then read again with the path its host has chosen.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import quoted, ship, table, written

#: Chosen paths are broadcast up to so many bytes; above, pages are joined with them by a shuffle.
BROADCAST_BYTES = 16 << 20
#: What the scores of a page's best containers count for, the first one's most.
VOTES = (1.0, 0.3, 0.1)
#: The chosen path must hold this share of a page's running text, or the page goes by its own best container.
MIN_COVER = 0.3
#: And this share of what that container holds, where the path's nodes are not inside it.
NEAR_COVER = 0.9

RAW = ("script", "style", "textarea", "title", "template", "iframe", "svg", "select", "canvas")
AWAY = {"nav", "footer", "aside", "form", "head", "button", "dialog", "menu", "header"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
#: Elements of running text: their names never set them apart.
RUNNING = set("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li p pre table tbody td tfoot th thead tr".split())
#: Elements that a new one of the same kind ends, where the writer did not.
ENDS_SELF = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Words in classes, ids and roles of what is not the article.
NOT_ARTICLE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebar\w*|comments?|commentlist|respond|replies|disqus|discussion|cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup\w*|modal\w*|newsletter\w*|subscribe\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|search\w*|footer\w*|footnav|masthead|topbar|contentinfo|complementary|skip|tagcloud|paywall|(?:site|page|top|global)[-_]?header|widget[-_]?area)(?:$|[^a-z])"
)
#: The same for words that are only so when they stand alone.
NOT_ARTICLE_ALONE = {"header", "side", "rail", "tags", "hidden", "overlay", "widget", "widgets", "banner"}
#: An article is set apart by these only.
NOT_THE_ARTICLE = re.compile(r"(?:^|[^a-z])(?:comments?|advert\w*|sponsor\w*|promo\w*|related\w*|teasers?)(?:$|[^a-z])")
#: Names that hold words of these lists but are parts of articles.
OF_ARTICLES = re.compile(r"(?:^|[^a-z])(?:related[-_]?works?|discussions?|search[-_](?:trees?|spaces?|methods?|strategy)|social[-_](?:aspects?|impacts?|sciences?)|comment(?:ary|aries)|table[-_]of[-_]contents)(?:$|[^a-z])")
#: What the element for browsers without scripts says of itself, rather than of the page; prose on the subject is longer.
NO_SCRIPTS = re.compile(r"(?:enable|activate|allow|turn\s+on|requires?|needs?|without|disabled|supports?|update|upgrade)\b.{0,80}\b(?:javascript|java\s*script|cookies|scripts|browser)|(?:javascript|cookies|browser)\b.{0,80}\b(?:enabled?|disabled|required|turned|off|support)", re.I | re.S)
NOTICE_CHARS = 240
#: Names that say how a page is laid out, not what their element holds.
LAYOUT = re.compile(r"^(?:has|no|with|without)[-_]|[-_](?:none|off|layout|wrap|wrapper)$")
#: Words of controls: an element with a longer name around one of these, and this much running text, is no control.
CONTROLS = re.compile(r"^(?:.*[^a-z])?(?:share\w*|sharing|social\w*|search\w*|login|signup|toolbar|menu\w*|nav|navigation|pager|skip)(?:[^a-z].*)?$")
PROSE_CHARS = 200
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*(?:>.*?(?:</(?P=raw)\s*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


@dataclass
class Node:
    tag: str
    path: str
    parent: int
    away: bool
    depth: int
    in_article: bool = False
    #: Why the element is set apart by itself: its tag, a name, a control's name, or for good; empty where it is not.
    why: str = ""


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", "", -1, False, 0)])
    #: node, text, characters in links
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _named_apart(value: str, whole_names: bool = False) -> str:
    """Why the words of a class, an id or a role set an element apart."""
    names = [x for x in value.split() if not OF_ARTICLES.search(x) and not LAYOUT.search(x)]
    bad = [x for x in names if (NOT_ARTICLE.fullmatch(x) if whole_names else NOT_ARTICLE.search(x)) or x in NOT_ARTICLE_ALONE]
    if not bad:
        return ""
    if any(NOT_THE_ARTICLE.search(x) for x in bad):
        return "for good"
    return "control" if all(CONTROLS.match(x) and not CONTROLS.sub("", x.strip("-_")) and re.search("[-_]", x) for x in bad) else "name"


def _label(tag: str, attrs: str, in_article: bool = False) -> tuple[str, str]:
    """The element's part of a path, without digits, and why its attributes set it apart from articles.

    Names of headings, paragraphs and other running text say nothing, sections go by whole class names
    only, and inside an article ids say nothing: there they name what the text is about.
    """
    if not attrs or attrs.isspace():
        return tag, ""
    names, whys = [], {""}
    for m in ATTR.finditer(attrs):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("class", "id"):
            names += re.sub(r"[0-9]+", "", value).split()
            if tag in RUNNING or (kind == "id" and (in_article or tag == "section")):
                continue
            if tag in ("article", "main"):
                value = " ".join(x for x in value.split() if not OF_ARTICLES.search(x))
                whys.add("for good" if NOT_THE_ARTICLE.search(value) else "")
            else:
                whys.add(_named_apart(value, tag == "section"))
        elif kind == "role":
            whys.add("name" if NOT_ARTICLE.search(value) or value == "dialog" else "")
        elif kind == "style":
            whys.add("for good" if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else "")
        elif kind == "hidden" or value == "true":
            whys.add("for good")
    return ".".join([tag, *sorted(set(names))]), next((w for w in ("for good", "name", "control") if w in whys), "")


def parse(source: str) -> Page:
    """The block elements of a page and its blocks of text; unclosed and cut-off tags are put up with."""
    page = Page()
    stack, text, linked, in_link = [0], [], 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole and not (len(whole) < NOTICE_CHARS and NO_SCRIPTS.search(whole) and any(page.nodes[k].tag == "noscript" for k in stack)):
                page.blocks.append((stack[-1], whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        plain = html.unescape(raw)
        text.append(plain)
        if in_link:
            linked += len(plain)

    at = 0
    for m in TAG.finditer(source):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m["end"] or m["end2"] else 1
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if page.nodes[stack[i]].tag == tag:
                    del stack[i:]
                    break
            continue
        in_link = 0 if tag != "li" else in_link
        if tag in VOID:
            continue
        if page.nodes[stack[-1]].tag == "p":  # a block ends a paragraph
            stack.pop()
        elif tag in ENDS_SELF and page.nodes[stack[-1]].tag == tag:
            stack.pop()
        top = page.nodes[stack[-1]]
        name, why = _label(tag, m["attrs"] or m["attrs2"] or "", top.in_article)
        if tag in ("html", "body"):
            why = ""
        elif not why and tag in AWAY and not (tag == "header" and (top.in_article or any(page.nodes[k].tag == "main" for k in stack))):
            why = "tag"
        page.nodes.append(Node(tag, f"{top.path}/{name}", stack[-1], bool(why), top.depth + 1, top.in_article or tag == "article", why))
        stack.append(len(page.nodes) - 1)
    if at < len(source):
        say(source[at:])
    flush()
    _set_apart(page)
    _keep_titles(page)
    return page


def _set_apart(page: Page) -> None:
    """Settle what is set apart: what its element or its name says, but for elements that hold the page's text.

    From the outside in, an element set apart by its tag or name is taken back where it has more running
    text than all that is left outside, and half of that within article or main, or where it is a form and no
    article is outside, or where nothing is left outside; and so is a control by name that has a paragraph's worth of text. What is
    hidden, and comments, adverts and teasers, stay apart.
    """
    nodes = page.nodes
    held, articles = [0] * len(nodes), [0] * len(nodes)
    plain, told = 0, False  # what is left outside, and whether some of it is in an article
    for node, text, linked in page.blocks:
        if 2 * linked > len(text):
            continue
        k, in_article = node, False
        while k >= 0:
            in_article = in_article or (nodes[k].tag in ("article", "main") and not nodes[k].why)
            held[k] += len(text)
            articles[k] += len(text) if in_article else 0
            if nodes[k].why:
                break
            k = nodes[k].parent
        plain += len(text) if k < 0 else 0
        told = told or (k < 0 and in_article)
    for i, node in enumerate(nodes):
        above = node.parent >= 0 and nodes[node.parent].away
        if not above and node.why in ("tag", "name", "control"):
            much = held[i] >= PROSE_CHARS
            whole = held[i] > plain and 2 * articles[i] > held[i]
            wrapper = node.tag == "form" or node.why != "tag"
            if whole or (wrapper and much and (plain == 0 or (node.tag == "form" and held[i] > plain and not told))) or (node.why == "control" and much):
                node.why = ""
                plain += held[i]
        node.away = above or bool(node.why)


def _keep_titles(page: Page) -> None:
    """A header inside an article with a first heading is part of the article."""
    for i, node in enumerate(page.nodes):
        if node.tag == "h1" and node.away:
            k, chain = node.parent, [i]
            while k > 0 and page.nodes[k].tag != "header":
                chain.append(k)
                k = page.nodes[k].parent
            if k > 0:
                up = page.nodes[k].parent
                inside = up
                while inside > 0 and page.nodes[inside].tag not in ("article", "main"):
                    inside = page.nodes[inside].parent
                if inside > 0 and not page.nodes[up].away and not NOT_ARTICLE.search(page.nodes[k].path.rpartition("/")[2].removeprefix("header")):
                    for x in chain:
                        page.nodes[x].away = False


def scores(page: Page, links: bool = False) -> list[tuple[float, float, int]]:
    """score, share of the page's running text, node for each container that holds any, best first."""
    good = [0.0] * len(page.nodes)
    all_text = [0.0] * len(page.nodes)
    for node, text, linked in page.blocks:
        size = len(text)
        running = 0 if page.nodes[node].away or (2 * linked > size and not links) or (links and page.nodes[node].tag == "li") else size
        k = node
        while k >= 0:
            good[k] += running
            all_text[k] += size
            k = page.nodes[k].parent
    total = good[0]
    if not total and not links:
        return scores(page, True)  # a page of links: those outside menus are its text
    if not total:
        return []
    out = []
    for i, node in enumerate(page.nodes):
        if good[i] and (node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote") or i == 0):
            cover = good[i] / total
            out.append((cover * cover * good[i] / all_text[i] * (1 + 0.01 * min(node.depth, 20)), cover, i))
    return sorted(out, key=lambda x: (-x[0], x[2]))


def _menus(page: Page) -> set[int]:
    """Lists that are links throughout, outside articles and without running text beside them."""
    lists: dict[int, bool] = {}
    beside = set()
    for node, text, linked in page.blocks:
        links = 2 * linked > len(text)
        if not links and not page.nodes[node].away:
            beside |= {node, page.nodes[node].parent}
        k = node
        while k >= 0 and page.nodes[k].tag not in ("ul", "ol"):
            k = page.nodes[k].parent
        if k >= 0:
            lists[k] = lists.get(k, True) and links
    return {k for k, links in lists.items() if links and not page.nodes[k].in_article and page.nodes[k].parent not in beside}


def text_under(page: Page, roots: set[int]) -> str:
    """The blocks below these nodes that are part of the article, a line each."""
    lines, menus = [], _menus(page)
    for node, text, linked in page.blocks:
        k, inside = node, False
        while k >= 0 and not inside:
            inside = k in roots
            k = page.nodes[k].parent
        in_menu = page.nodes[node].tag == "li" and page.nodes[node].parent in menus
        if inside and not page.nodes[node].away and not (in_menu and 2 * linked > len(text) and len(text) < 40):
            lines.append(text)
    return "\n".join(lines)


def extract(source: str | None, path: str | None) -> str:
    """The article's text by the host's path, or by the page's own best container where that does not fit."""
    page = parse(source or "")
    ranked = scores(page)
    if not ranked:
        return ""
    cover = {i: c for _, c, i in ranked}
    chosen = {i for i in cover if page.nodes[i].path == path} if path is not None else set()
    chosen = {i for i in chosen if not any(p in chosen for p in _ancestors(page, i))}
    held, own = sum(cover[i] for i in chosen), ranked[0][2]
    within = all(own == i or own in _ancestors(page, i) for i in chosen)
    if held < MIN_COVER or (not within and held < NEAR_COVER * cover[own]):
        chosen = {own}
    return text_under(page, chosen)


def _ancestors(page: Page, i: int) -> Iterator[int]:
    i = page.nodes[i].parent
    while i >= 0:
        yield i
        i = page.nodes[i].parent


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit("")))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with a column text (never null) in place of the page's source.

    A null or empty source has an empty text, and so has a page without running text; a very long one is
    read whole. Columns named text or like the source are replaced, all others stay. A null url, or
    one without a host, votes with the others of that kind. Repeated pages vote as often as they stand
    there. Paths with equal votes go by their order as strings.
    """
    ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    # Columns go by their places: the frame's own may have any names.
    held = [F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)]
    hosted = pages.select(*held, F.col(quoted(html_col)).alias("html"), host_of(F.col(quoted(url_col))).alias("host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(source or "")
                for weight, (score, _, node) in zip(VOTES, scores(page), strict=False):
                    key = host, page.nodes[node].path
                    sums[key] = sums.get(key, 0.0) + weight * score
            hosts, paths = zip(*sums, strict=True) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(sums.values()), pa.float64())], names=["host", "path", "votes"])

    votes = hosted.select("host", "html").mapInArrow(vote, "host string, path string, votes double")
    by_path = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    winners = by_path.groupBy("host").agg(F.max_by("path", F.struct(F.col("votes"), F.col("path"))).alias("path"))
    winners = written(winners, "host-paths").select(F.concat(F.col("host"), F.lit("")).alias("of"), "path")
    size = winners.agg(F.sum(F.octet_length("of") + F.coalesce(F.octet_length("path"), F.lit(0)) + 32)).first()[0] or 0
    chosen = hosted.join(F.broadcast(winners) if size <= broadcast_bytes else winners, F.col("host") == F.col("of"), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, sources, paths = batch.columns
            texts = [extract(s, p) for s, p in zip(sources.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], names=[*kept, "text"])

    out = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType(), False)])
    return chosen.select(*[f"k{i}" for i in range(len(kept))], "html", "path").mapInArrow(read, out)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
