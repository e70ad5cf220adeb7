"""Main-text extraction with site style trees.

Pages of one host are merged into a style tree: its nodes are paths of tag and class from the root, kept as running
64-bit hashes. A node's importance is the greater of two entropies over the distinct pages that hold it: of its
presentation (the sequence of child tags) and of its content (hash of all text below it, so the whole branch counts),
both normalised by the number of pages. Text that is the same on page after page has an entropy near 0, text from a
small stock a low one. The own text of low nodes is removed from each page; a branch vanishes when all nodes in it are low,
so an important descendant keeps its place whatever is around it.

Inside article and main entropy removes nothing: what a page marks as its article stays, also where other pages carry the
same. Copies of an unmarked article look like boilerplate too; so a page that would be left with few words, and lose a long
block that is the same on all pages, keeps what is the same (LONG_BLOCK, FEW_WORDS).

All branches are in the tree, but entropy alone can't tell a menu that differs from page to page from an article. So tags,
roles and whole class names that can only be menus, adverts, notices, forms or comments mean importance 0 beforehand;
outside article and main some more names and ids count. Of the rest, the article is taken where the page marks one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.graph import hot_limit, join_counted
from lexmill.sources.tables import arrow_map, materialize

#: A node's text, outside article and main, is removed below this importance, if at least so many distinct pages of the
#: host hold the node; also if, going by its entropy, its content or shape is shared by so many pages each on average. (Pages
#: come in a few variants, as for print; text from a small stock recurs more often the more pages there are.)
LOW_IMPORTANCE, LEAST_PAGES, REPEATS = 0.2, 8, 5.0
#: Words of a block the same on all pages, at least twice those left, that bring such blocks back if fewer than so many words are left.
LONG_BLOCK, FEW_WORDS = 8, 25
#: Paths of low nodes of all hosts that may be broadcast (8 bytes each).
MOST_PATHS = 1_000_000

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|canvas|select|title"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics annotation".split()
)
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
DROP_TAGS = frozenset("nav footer header aside form head dialog button input select menu menuitem".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Whole class names, never parts of them, that name no content wherever they are; outside article and main also those of
#: OUTER_NAMES, and ids. Ids of sections and headings are made of their words and never count.
DROP_NAMES = re.compile(
    r"ads?|adverts?|advertisements?|advertising|ad-(?:banner|box|container|slot|unit|wrapper)|sponsored-(?:content|links|posts?)|cookies?-(?:banner|bar|consent|notice|popup)|(?:consent|gdpr)-(?:banner|bar|notice|popup)|"
    r"newsletter-(?:box|form|signup)|subscribe-(?:box|form)|(?:subscription|signup|login|search)-form|navbar|(?:main|primary|secondary|site|top|page|post)-(?:nav|navigation|menu)|nav-(?:bar|links|menu)|breadcrumbs?|"
    r"(?:left-|right-)?sidebars?|sidebar-(?:left|right)|related-(?:articles|links|posts|stories)|share-(?:bar|buttons|links)|sharing-buttons|social-(?:buttons|icons|links|share)|comments|comment-?list|comments?-(?:area|form|section)|"
    r"disqus_thread|(?:site|page)-footer|site-header|pagination|skip-links?",
    re.I,
)
OUTER_NAMES = re.compile(r"nav|navigation|menus?|pager|toolbar|aside|footer|masthead|banner|modal|popups?|newsletter|consent|gdpr|sponsor(?:ed|s)|comment|replies|disqus|widget-area|copyright-notice|legal-notice", re.I)
COMMENT_NAMES = re.compile(r"comments?|comment-(?:body|item|reply)|reply|replies", re.I)
_UNNAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6 span code pre".split())
# Possessive and without a way back: a quote counts only after an equals sign, and a tag that never ends takes the rest.
_INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>]){_INSIDE}>(?<=/>)|<(?P<raw>{RAW})(?=[\s/>]){_INSIDE}(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_INSIDE})(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


_MASK = (1 << 64) - 1


class Node:
    __slots__ = ("tag", "label", "parent", "children", "dropped", "path", "inner", "content")

    def __init__(self, tag: str, label: str, parent: Node | None, dropped: bool):
        self.tag, self.label, self.parent, self.children, self.dropped = tag, label, parent, [], dropped
        self.path, self.content = 0, 0
        self.inner = tag in ("article", "main") or (parent is not None and parent.inner)


def _element(tag: str, attrs: str, parent: Node) -> Node:
    label, dropped = tag, tag in DROP_TAGS
    if attrs and "=" in attrs:
        found = {}
        for m in _ATTR.finditer(attrs):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        if names:
            label = f"{tag}.{' '.join(names.split())}".replace("/", "|")
            classes, inner = found.get("class", "").split(), parent.inner
            named = classes if inner or tag == "section" else names.split()
            dropped = dropped or (tag not in _UNNAMED and any(DROP_NAMES.fullmatch(x) or (not inner and OUTER_NAMES.fullmatch(x)) for x in named))
            # an article that says so is a reader's comment
            dropped = dropped or (tag == "article" and any(COMMENT_NAMES.fullmatch(x) for x in classes))
        dropped = dropped or found.get("role", "").lower() in DROP_ROLES or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
    if not dropped and attrs and re.search(r"(?:^|\s)hidden(?:[\s/]|$)", attrs):
        dropped = True
    return Node(tag, label, parent, dropped)


def parse(html: str | None) -> Node:
    """A tolerant tree: unknown closers are skipped, paragraphs and list items close themselves, raw elements vanish."""
    root = Node("#root", "", None, False)
    at, open_tags = root, defaultdict(int)

    def close_to(node: Node) -> Node:
        nonlocal at
        while at is not node:
            open_tags[at.tag] -= 1
            at = at.parent
        open_tags[at.tag] -= 1
        at = at.parent
        return at

    for m in _PIECE.finditer(html or ""):
        if (text := m["text"]) is not None:
            at.children.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if open_tags[tag]:
                node = at
                while node.tag != tag:
                    node = node.parent
                close_to(node)
            elif tag in ("br", "p"):
                at.children.append(Node("br", "br", at, False))
            continue
        if tag in CLOSES_P and open_tags["p"]:
            node = at
            while node.tag != "p":
                node = node.parent
            close_to(node)
        elif tag in SCOPES:
            node, stop = at, SCOPES[tag]
            while node is not root and node.tag not in stop and node.tag not in SIBLINGS[tag]:
                node = node.parent
            if node.tag in SIBLINGS[tag]:
                close_to(node)
        node = _element(tag, m["attrs"], at)
        at.children.append(node)
        if tag not in VOID and not m[0].endswith("/>"):
            at = node
            open_tags[tag] += 1
    return root


def _number(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass"), seed), "little", signed=True)


def walk(root: Node) -> list[Node]:
    """All elements in page order, their paths set, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.path = _number(node.label, (node.parent.path if node.parent is not None else 0) & _MASK)
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def blocks(node: Node, gone: set[int] | frozenset[int] = frozenset(), lists: bool = True) -> list[str]:
    """Texts of the blocks below ``node`` in page order: references decoded, white space single, no empty ones."""
    out, run = [], []

    def flush() -> None:
        if run and (text := " ".join(entities.unescape("".join(run)).split())):
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif lists and x is not node and x.dropped:
            if x.tag not in INLINE:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            block = x.tag not in INLINE
            if block:
                flush()
                todo.append(None)
            if x.path in gone:
                todo += [c if not isinstance(c, str) else " " for c in reversed(x.children)]
            else:
                todo += reversed(x.children)
    flush()
    return out


def style_rows(html: str | None) -> list[tuple[int, int, int, bool]]:
    """(path, content hash, presentation hash, inside an article) of one page's style nodes; same-path elements are one node.

    content is 0 for a node without text below it. Linear in the page, however deep it is.
    """
    nodes = walk(parse(html))
    content, shape, inner = defaultdict(list), defaultdict(list), {}
    for node in reversed(nodes):
        parts = []
        for c in node.children:
            if not isinstance(c, str):
                parts.append(str(c.content) if c.content else "")
            elif not c.isspace():
                parts.append(" ".join(c.split()))
        text = "\n".join(filter(None, parts))
        node.content = _number(text) if text else 0
    for node in nodes:
        if node.content:
            content[node.path].append(node.content)
        shape[node.path] += [c.label for c in node.children if not isinstance(c, str)]
        inner[node.path] = node.inner
    return [(p, _number(" ".join(map(str, content[p]))) if content[p] else 0, _number(" ".join(dict.fromkeys(shape[p]))), inner[p]) for p in shape]


def page_host(url_col: str = "url"):
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, inner, pages, importance, has_text) of each style node; has_text is 1 if text lies below it on some page.

    Copies of a page count once. Counts are aggregated by content first and by node then, so a crowded host is no group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [(h.as_py(), c.as_py(), *r) for h, c, t in zip(*part.columns) for r in style_rows(t.as_py())]
                if rows:
                    types = (pa.string(), *[pa.int64()] * 4, pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["host", "page", "path", "content", "shape", "inner"])

    seen = pages.where(F.col(html_col).isNotNull()).select(page_host(url_col).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).cast("string"))
    rows = seen.transform(arrow_map, run, "host string, page long, path long, content long, shape long, inner boolean").distinct()
    by_content = rows.groupBy("host", "path", "inner", "content", "shape").agg(F.count("*").alias("n"))
    texts = by_content.groupBy("host", "path", "inner", "content").agg(F.sum("n").alias("n")).groupBy("host", "path", "inner")
    forms = by_content.groupBy("host", "path", "inner", "shape").agg(F.sum("n").alias("n")).groupBy("host", "path", "inner")
    n = F.col("n")
    entropy = lambda: F.when(F.sum("n") > 1, (F.log(F.sum("n")) - F.sum(n * F.log(n)) / F.sum("n")) / F.log(F.sum("n"))).otherwise(1.0)
    text = texts.agg(F.sum("n").alias("pages"), entropy().alias("content"), F.max((F.col("content") != 0).cast("int")).alias("has_text"))
    form = forms.agg(entropy().alias("presentation"))
    return text.join(form, ["host", "path", "inner"]).select("host", "path", "inner", "pages", F.greatest("content", "presentation").alias("importance"), "has_text")


def low_branches(trees: DataFrame) -> DataFrame:
    """(host, gone, same): hashes of the paths whose own text is removed on each host that has any; same: those alike on all pages."""
    shared = F.pow("pages", 1 - F.col("importance")) >= REPEATS
    low = trees.where(~F.col("inner") & ((F.col("importance") < LOW_IMPORTANCE) | shared) & (F.col("pages") >= LEAST_PAGES) & (F.col("has_text") == 1))
    return low.groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("gone"), F.array_sort(F.collect_set(F.when(F.col("importance") < 1e-9, F.col("path")))).alias("same"))


def main_text(html: str | None, gone: set[int] | frozenset[int] = frozenset(), lists: bool = True, same: set[int] | frozenset[int] = frozenset()) -> str:
    """The page's article: of the outermost article elements, else main ones, else the body, else the whole, the first that has text."""
    root = parse(html)
    tops: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    removed, inside = set(), set()
    for node in walk(root):
        above = node.parent
        if above is not None and id(above) in removed or (lists and node.dropped):
            removed.add(id(node))
        elif node.tag in tops and not (above is not None and (id(above), node.tag) in inside):
            tops[node.tag].append(node)
        for tag in tops:
            if node.tag == tag or (above is not None and (id(above), tag) in inside):
                inside.add((id(node), tag))
    for tag in ("article", "main", "body"):
        if tops[tag] and (found := [t for n in tops[tag] for t in _kept_blocks(n, gone, same, lists)]):
            return " ".join(found)
    return " ".join(_kept_blocks(root, gone, same, lists))


def _kept_blocks(node: Node, gone: set[int] | frozenset[int], same: set[int] | frozenset[int], lists: bool) -> list[str]:
    """The blocks without those of the paths in ``gone``, unless the page's own text seems to be among those in ``same``."""
    found = blocks(node, gone, lists)
    left = sum(len(t.split()) for t in found)
    if same and left < FEW_WORDS:
        whole = blocks(node, gone - same, lists)
        lost = Counter(whole) - Counter(found)
        if any((n := len(t.split())) >= LONG_BLOCK and n >= 2 * left for t in lost):
            return whole
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lists: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null or empty html gives an empty text. Null urls form one nameless host. Repeated rows stay and copies get equal
    texts. Other columns are ignored, whatever their names; an empty table stays empty; pages may be of any length and
    depth. Without ``lists`` the style trees alone decide what goes.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    gone = materialize(low_branches(materialize(style_trees(own), "style-trees")), "low-branches")
    paths = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    hosted, known = own.withColumn("host", page_host("url")), {}
    if paths <= MOST_PATHS:  # one table a task, not a list a page
        known = {r.host: (frozenset(r.gone), frozenset(r.same)) for r in gone.collect()}
        joined = hosted.withColumns({"gone": F.lit(None).cast("array<long>"), "same": F.lit(None).cast("array<long>")})
    else:
        sizes = hosted.groupBy("host").agg(F.count("*").alias("n")).join(gone, "host", "left")
        joined = join_counted(hosted, sizes, "host", hot_limit(hosted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = (known.get(h.as_py()) or (frozenset(g.as_py() or ()), frozenset(s.as_py() or ())) for h, g, s in zip(batch.column(3), batch.column(4), batch.column(5)))
            texts = [main_text(h.as_py(), g, lists, s) for h, (g, s) in zip(batch.column(2), low)]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lengths)], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "gone", "same").transform(arrow_map, run, "page_id long, url string, text string, n_chars long")
