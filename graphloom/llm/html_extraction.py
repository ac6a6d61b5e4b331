"""Operator 2, HTML extraction: site template removal.

Every element subtree of a page is hashed; Spark counts in how many different main
texts of a host a hash stands, so copies of a page count once. Subtrees that recur
in few_pages of them and in a small share of the host's are deleted wherever they
stand on the host, unless they are prose: articles quote and copy each
other. Prose goes as well if it recurs in a large share. What recurrence can't tell,
as on hosts of few pages, is left to kinds and names of elements and to blocks that
are mostly links.

The text blocks of what is left are the main text: those of articles, or of main;
on pages that mark neither, those of the block that holds most of the text beside
what was deleted.

Prose is what an article is made of: paragraphs, headings, lists' items, quotations
and table cells, text alone beside these, and blocks whose text is mostly in these and
outside of links. Inside an article (or main) element it is never a template, however
many pages quote it.

Templates are rows of host and hash. All are sent to the tasks if they are few; if not,
the hashes that each page holds are joined with them, and a page gets its own alone.

Reading a page takes time in proportion to its length, whatever it holds.

Defined results: a null or empty page has an empty text; a null or unreadable
url is a host of its own; repeated pages count once; broken markup
is read as browsers do as far as the text needs it (open elements end with
their parents, paragraphs end where a block begins, declarations that are none
are comments, and what isn't closed at the end of the page is left out); an empty table
gives an empty result; other columns are dropped, whatever their names. Ties go to the
block that stands first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
FURNITURE = frozenset(
    "head title script style noscript template nav aside footer form button select textarea datalist input iframe object svg canvas audio video map menu dialog marquee".split()
)
#: Elements whose text is a block of its own.
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Blocks that hold an article's own text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr tbody thead table caption figcaption".split())
#: A class or id says that an element is furniture if all its words are of these two sets and one at least of the first.
_NAMES = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|pager|pagination|paywall|popup|promo\w*|recommend\w*|related|reply|replies|respond|share|sharing|sidebar|signin|signup|skip|social|sponsor\w*|subscri\w*|tagcloud|toolbar|widgets?)"
)
_PARTS = re.compile(
    r"(?:\w|[\dx]+|js|wp|ui|site|page|global|main|primary|secondary|top|bottom|left|right|upper|lower|before|after|sticky|fixed|inline|mobile|desktop|post|posts|article|articles|entry|entries|content|contents|"
    r"story|stories|block|blocks|box|boxes|bar|list|lists|wrap|wrapper|container|area|section|inner|outer|row|col|column|columns|group|item|items|link|links|button|buttons|btn|icon|icons|form|title|text|body|head|"
    r"unit|units|slot|panel|module|region|zone|holder|overlay|message|policy|toggle|dropdown|tabs?|media|user|reader|readers|us|this|to|me|on|of|and|the|by|meta|info|has|no)"
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: A start tag of these ends an open element of those.
_ENDS = {t: ("p",) for t in BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "figcaption", "summary"}} | {
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"),
    "tbody": ("tr", "td", "th", "p", "thead", "tbody"), "tfoot": ("tr", "td", "th", "p", "thead", "tbody"), "option": ("option",), "body": ("head", "title"),
}
_SCOPES = {"p": ("table", "td", "th", "li", "article", "section", "div"), "li": ("ul", "ol"), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}


class Node:
    """An element. By hashed(): size and linked are its characters other than white space, in all and in links, prose those below it
    that are in prose and outside of links (the second: if all of it stood in prose); links, articles and headings count these
    elements below it. gone says that it is no main text."""

    __slots__ = ("articles", "attrs", "children", "gone", "hash", "headings", "linked", "links", "prose", "size", "tag")

    def __init__(self, tag: str, attrs: list) -> None:
        self.tag, self.attrs, self.children, self.hash, self.size, self.linked, self.gone = tag, attrs, [], 0, 0, 0, False
        self.prose, self.links, self.articles, self.headings = (0, 0), 0, 0, 0


#: Elements whose content is read as it stands, up to their end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_BETWEEN = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_VALUE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
#: Numbers of characters: zeros before them, and those beyond the last character.
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_BEYOND = re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?")


def characters(text: str) -> str:
    """text with its character references decoded, however long they are."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _BEYOND.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return unescape(text)


def tokens(html: str) -> Iterator[tuple[str, str, list]]:
    """("text", it, []), ("open", tag, attributes) and ("end", tag, []) of a page, in order.

    Each character is looked at a bounded number of times. As in browsers, what isn't closed at the end of a page (a tag, a
    comment, a script) is left out.
    """
    at = 0
    while True:
        here = html.find("<", at)
        if here < 0:
            yield "text", html[at:], []
            return
        tag = _TAG.match(html, here)
        if not tag:
            if html.startswith("<!--", here):
                end = _COMMENT_END.search(html, here + 2 if html.startswith(("<!-->", "<!--->"), here) else here + 4)
                yield "text", html[at:here], []
                if not end:
                    return
                at = end.end()
            elif html[here + 1 : here + 2] in ("!", "?", "/") and here + 2 < len(html):
                end = html.find(">", here)
                yield "text", html[at:here], []
                if end < 0:
                    return
                at = end + 1
            else:
                yield "text", html[at : here + 1], []
                at = here + 1
            continue
        yield "text", html[at:here], []
        at, attrs = tag.end(), []
        while True:
            at = _BETWEEN.match(html, at).end()
            if at >= len(html):
                return
            if html[at] == ">":
                at += 1
                break
            name = _NAME.match(html, at)
            at = name.end()
            equals = _EQUALS.match(html, at)
            value = ""
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return
                    value, at = html[at + 1 : end], end + 1
                else:
                    plain = _VALUE.match(html, at)
                    value, at = plain[0], plain.end()
            attrs.append((name[0].lower(), characters(value)))
        kind = tag[2].lower()
        if tag[1]:
            yield "end", kind, []
            continue
        yield "open", kind, attrs
        if kind in _RAW:
            end = _RAW[kind].search(html, at)
            if not end:
                return
            at = end.start()


class _Open:
    """The open elements, and where in their row those of each kind stand: nothing is walked but what is closed."""

    def __init__(self, root: Node) -> None:
        self.row, self.places = [root], {}

    def close(self, since: int) -> None:
        for node in self.row[since:]:
            self.places[node.tag].pop()
        del self.row[since:]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.row))
        self.row.append(node)

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1


def tree(html: str) -> Node:
    """The tree of a page; any text has one."""
    root = Node("html", [])
    opened = _Open(root)
    for kind, what, attrs in tokens(html):
        if kind == "text":
            if what:
                opened.row[-1].children.append(characters(what))
        elif kind == "end":
            since = opened.last(what)
            if since > 0:
                opened.close(since)
        elif what != "html":
            for other in _ENDS.get(what, ()):
                since = opened.last(other)
                if since > 0 and all(opened.last(s) < since for s in _SCOPES.get(other, ())):
                    opened.close(since)
            node = Node(what, attrs)
            opened.row[-1].children.append(node)
            if what not in VOID:
                opened.push(node)
    return root


def hashed(root: Node) -> list[Node]:
    """All blocks below root, each with the hash of its subtree (its tag, class and id, texts and children in order) and what Node counts."""
    found: list[Node] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, left = stack.pop()
        if not left:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if type(c) is Node)
            continue
        parts = [node.tag, *(f"{k}={v}" for k, v in node.attrs if k in ("class", "id", "href", "src"))]
        outside = inside = 0
        for c in node.children:
            if type(c) is Node:
                parts.append(f"\x01{c.hash}")
                node.size += c.size
                node.linked += c.linked
                node.links += c.links + (c.tag == "a")
                node.articles += c.articles + (c.tag in ("article", "main"))
                node.headings += c.headings + (c.tag in ("h1", "h2"))
                if c.tag != "a":
                    outside += c.prose[c.tag in PROSE]
                    inside += c.prose[1]
                else:
                    outside += c.prose[0]
                    inside += c.prose[0]
            elif words := c.split():
                parts.append(" ".join(words))
                size = sum(map(len, words))
                node.size += size
                inside += size
        node.prose = (outside, inside)
        if node.tag == "a":
            node.linked = node.size
        node.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "replace")) - (1 << 63)
        if node is not root and (node.tag in BLOCK or node.tag in FURNITURE) and node.children and node.tag not in ("body", "head", "article", "main"):
            found.append(node)
    return found


def named(name: str) -> frozenset:
    """The words by which a class or id says that its element is furniture: none, unless all its words do or say where it stands."""
    words = re.split(r"[_-]+", name)
    said = frozenset(w for w in words if _NAMES.fullmatch(w))
    return said if said and all(w in said or not w or _PARTS.fullmatch(w) for w in words) else frozenset()


def furniture(node: Node, in_article: bool, page: int) -> bool:
    """Whether an element is page furniture by its kind, its role or its names; page is the size of all of the page's text."""
    tag = node.tag
    if tag in FURNITURE or tag == "header" and not (in_article and node.headings):
        return True
    for k, v in node.attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v in _ROLES:
            return True
        if v and tag not in ("body", "main", "html") and k in ("class", "id"):
            said = frozenset().union(*map(named, v.lower().split()))
            if not said or node.articles or tag == "article" and not any("comment" in w for w in said):
                continue  # a wrapper named for what stands beside the article, or the article itself
            if "header" in said and in_article and node.headings:
                continue
            if 2 * node.size > page and holds_prose(node):
                continue  # it is most of the page, and prose
            return True
        if v and k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v.lower()):
            return True
    return False


def holds_prose(node: Node) -> bool:
    """Whether most of a node's text is in prose below it and outside of links."""
    return 2 * node.prose[0] > node.size


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or any(k == "role" and v == "main" or k == "itemprop" and v == "articleBody" for k, v in node.attrs)


def _judge(root: Node, templates: frozenset | set, everywhere: frozenset | set, kinds: bool = True) -> tuple[bool, int]:
    """Marks the elements that are no main text: templates first, then furniture and blocks of links.

    Returns whether there is an article or main left, and how many elements went as templates.
    """
    found, recurring = False, 0
    stack = [(root, False, False)]
    while stack:
        node, inside, beside = stack.pop()
        template = node.hash in templates and (not inside and node.hash in everywhere or not (_is_prose(node, beside) or holds_prose(node)))
        if template or kinds and (furniture(node, inside, root.size) or not inside and _links(node)):
            node.gone = True
            recurring += template
            continue
        main = _is_main(node)
        found |= main and node.size > 0
        children = [c for c in node.children if type(c) is Node]
        beside = any(c.tag in PROSE for c in children)
        stack.extend((c, inside or main, beside) for c in children)
    return found, recurring


def _is_prose(node: Node, beside: bool) -> bool:
    """Whether a node is prose by its kind, or text alone beside such."""
    return node.tag in PROSE or beside and not node.attrs and node.linked == 0 and not any(type(c) is Node and c.tag in BLOCK for c in node.children)


def _links(node: Node) -> bool:
    """Whether a block is a list of links."""
    return node.tag in BLOCK and 10 * node.linked > 6 * node.size and not node.articles and node.links > 1


def _container(root: Node) -> Node:
    """The block that holds the main text of a page without article or main: from the root down, the child that holds half of
    what is left or more, as long as something beside it is gone and it holds blocks of its own."""
    stack, order = [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if type(c) is Node and not c.gone)
    left = {}
    for node in reversed(order):
        left[id(node)] = sum(len("".join(c.split())) if type(c) is str else left.get(id(c), 0) for c in node.children)
    at = root
    while True:
        children = [c for c in at.children if type(c) is Node]
        blocks = [c for c in children if not c.gone and c.tag in BLOCK]
        best = max(blocks, key=lambda c: left[id(c)], default=None)
        if best is None or 2 * left[id(best)] < left[id(at)] or not any(type(c) is Node and c.tag in BLOCK for c in best.children):
            return at
        if at.tag not in ("html", "body") and not any(c.gone for c in children):
            return at
        if at.tag == "body" and not any(c.gone for c in children) and len(blocks) > 1:
            return at
        at = best


def main_text(root: Node, templates: frozenset | set = frozenset(), everywhere: frozenset | set = frozenset(), kinds: bool = True) -> str:
    """The text blocks of a page without templates and furniture, in page order, one to a line. hashed() must have seen the page."""
    return judged_text(root, templates, everywhere, kinds)[0]


def judged_text(root: Node, templates: frozenset | set = frozenset(), everywhere: frozenset | set = frozenset(), kinds: bool = True) -> tuple[str, int]:
    """main_text(), and how many elements went because they recur on their host.

    Templates that are everywhere go even if they are prose. Where there are articles their blocks are the text; else those of main; else those of the block that holds most.
    Without kinds, nothing but recurrence says what furniture is.
    """
    marked, recurring = _judge(root, templates, everywhere, kinds)
    top = root if marked else _container(root)
    blocks: list[tuple[bool, bool, str]] = []
    parts: list[str] = []
    at = [False, False]

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((at[0], at[1], text))
        parts.clear()

    # a stack of entering nodes, strings and leaving marks: pages may be nested deeper than Python's own stack
    stack: list = [(top, False, False)]
    while stack:
        node, article, main = stack.pop()
        if node is None:
            flush()
            at[:] = [article, main]
        elif type(node) is str:
            parts.append(node)
        elif node.gone or node.tag == "br":
            parts.append(" ")
        else:
            own = (article or node.tag == "article", main or _is_main(node))
            if node.tag in BLOCK:
                flush()
                at[:] = own
                stack.append((None, article, main))
            stack.extend((c, *own) for c in reversed(node.children))
    flush()
    for which in (0, 1):
        if any(b[which] for b in blocks):
            blocks = [b for b in blocks if b[which]]
            break
    return "\n".join(b[2] for b in blocks), recurring


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("host", F.coalesce(F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), F.lit("")))


def templates(
    pages: DataFrame, html: str = "html", min_share: float = 0.2, min_pages: int = 5, few_share: float = 0.001, few_pages: int = 3, kinds: bool = True
) -> DataFrame:
    """(host, hash, everywhere): the subtrees that stand in few_share of a host's main texts, and in few_pages at least; everywhere says those in min_share and min_pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                host, body = host.as_py(), 0
                if page.is_valid:
                    root = tree(page.as_py())
                    nodes = hashed(root)
                    body = xxhash.xxh64_intdigest(main_text(root, kinds=kinds).encode("utf-8", "replace")) - (1 << 63)
                    seen.update({(host, n.hash, body) for n in nodes})
                seen[host, None, body] += 1
            if seen:
                columns = [pa.array([k[i] for k in seen], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["host", "hash", "body"])

    counts = pages.select("host", html).mapInArrow(count, "host string, hash long, body long").distinct()
    counts = counts.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("bodies"))
    counts = written(counts.where((F.col("bodies") >= few_pages) | F.col("hash").isNull()), "html-subtrees")
    hosts = counts.where("hash is null").select("host", F.col("bodies").alias("_of"))
    most = (F.col("bodies") >= min_share * F.col("_of")) & (F.col("bodies") >= min_pages)
    often = counts.where("hash is not null").join(hosts, "host").where((F.col("bodies") >= few_share * F.col("_of")) & (F.col("bodies") > 1))
    return often.select("host", "hash", most.alias("everywhere"))


def _page_hash(page: str) -> int:
    return xxhash.xxh64_intdigest(page.encode("utf-8", "replace")) - (1 << 63)


def _own_templates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(host, page, known): the templates that each different page holds; no more of them than it has elements."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = set()
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                if page.is_valid:
                    html = page.as_py()
                    held.update((host.as_py(), _page_hash(html), n.hash) for n in hashed(tree(html)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "page", "hash"])

    held = rows.select("host", "html").mapInArrow(hold, "host string, page long, hash long").distinct()
    own = held.join(found, ["host", "hash"]).groupBy("host", "page")
    return own.agg(F.struct(F.collect_list("hash").alias("hashes"), F.collect_list(F.when(F.col("everywhere"), F.col("hash"))).alias("everywhere")).alias("known"))


def extract(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_share: float = 0.2,
    min_pages: int = 5,
    few_share: float = 0.001,
    few_pages: int = 3,
    broadcast_hashes: int = 1_000_000,
    kinds: bool = True,
) -> DataFrame:
    """(key, url, text, n_templates): the main text of each page, and how many of its elements went because they recur on its host."""
    rows = with_host(pages.select(key, F.col(url).alias("url"), F.col(html).alias("html")))
    found = written(templates(rows, "html", min_share, min_pages, few_share, few_pages, kinds), "html-templates")
    sent = pages.sparkSession.sparkContext.broadcast({})
    if found.count() <= broadcast_hashes:
        of: dict[str, tuple[set, set]] = {}
        for r in found.collect():
            hashes, everywhere = of.setdefault(r.host, (set(), set()))
            hashes.add(r.hash)
            if r.everywhere:
                everywhere.add(r.hash)
        sent = pages.sparkSession.sparkContext.broadcast(of)
        joined = rows.withColumn("known", F.lit(None).cast("struct<hashes: array<long>, everywhere: array<long>>"))
    else:

        def numbered_by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_page_hash(x.as_py()) if x.is_valid else 0 for x in batch.column(2)], pa.int64())], [*batch.schema.names, "page"])

        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(key, "url", "html", "host").schema)
        paged = rows.select(key, "url", "html", "host").mapInArrow(numbered_by_text, f"{columns}, page long")
        joined = paged.join(_own_templates(rows, found), ["host", "page"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for host, page, known in zip(*[batch.column(i) for i in range(2, 5)], strict=True):
                root = tree(page.as_py() or "")
                hashed(root)
                own = known.as_py()
                sets = (frozenset(own["hashes"]), frozenset(own["everywhere"])) if own else sent.value.get(host.as_py(), ())
                text, gone = judged_text(root, *(sets or (frozenset(), frozenset())), kinds)
                out.append(text)
                n.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(n, pa.int64())], [key, "url", "text", "n_templates"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.select(key, "url", "host", "html", "known").mapInArrow(texts, f"{key} {kind}, url string, text string, n_templates long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "n_templates")
