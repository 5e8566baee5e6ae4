"""Main text of web pages through site style trees.

Every page is parsed into elements. The pages of a host merge into one style tree whose nodes are element
paths (tag and class, from the body down). For each node two diversities over its pages are taken, both
as entropies divided by the logarithm of the number of pages: of its presentation (the sequence of its
child elements) and of its content (a hash of all text in it). The greater of the two is the evidence for the
node; its importance is the mean of the evidence, weighed by the number of pages less one, and of a prior of 1,
weighed by `prior` pages. So a path that one page alone has keeps its prior, menus, notices and adverts that
repeat fall towards 0 page by page, and articles stay near 1. Branches of low importance are removed from each
page. Pages of a host are counted once for each html, so copies of a page say nothing about what repeats.

What varies from page to page and still is no article (navigation, forms, reader comments, rotating adverts) no
entropy can tell; there names decide: elements of HTML for it, and classes, ids or roles that are such a name.
A class that only contains such a name (related-work, comment-on-law) is a weaker sign: outside a marked article
it counts, inside one only if half of the host's pages have the path, as a template's part does. Headings are
judged by what they stand in alone. Where a page marks its article (article, main), only that is kept, and
inside it a branch goes only if it is nearly constant over the host. Where the tree would leave nothing of a
page, names alone decide for it.

Scale: counts of a hot host combine before the shuffle; a page gets back only those of its own paths that go,
so no row carries a host's tree.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; unclosed and
stray tags are accepted; repeated rows are extracted each; whole pages are read, of any size and any depth
(no step is recursive, and a path is a hash of 64 bits). A page is scanned once: a `<` without `>` after it is text, and
after a quote that never closes tags end at the first `>`.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

#: What may follow a `<`. A quote opens a value only after `=`, as in HTML, so that stray ones spoil nothing.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=/][^\s=/]*+)(?:\s*+=\s*+(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'][^\s]*+)))?", re.S)
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}}
#: Names of what is no part of an article.
NO_TEXT = frozenset("head script style noscript template textarea title iframe svg math object canvas audio video select button input".split())
NOISE = frozenset("nav footer form menu dialog".split())
NOISE_WORDS = frozenset("ad ads adv advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr modal nav navbar navigation newsletter pager pagination popup promo promoted respond share sharing sidebar signup social sponsor sponsored subscribe".split())
#: The same outside a marked article; inside one they may be part of it.
LIKELY = frozenset("aside header".split())
LIKELY_WORDS = frozenset("banner header menu notice related toolbar widget".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN, PART, NAMED = 0, 1, 2


class Node:
    """noise: NAMED for what is no part of an article by its name, PART where a name is a sign only and the host's pages must tell."""

    __slots__ = ("tag", "parent", "children", "path", "noise", "main", "within")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        from xxhash import xxh3_64_intdigest

        self.tag, self.parent, self.children = tag, parent, []
        self.within = parent is not None and (parent.within or parent.main)
        label, names, hidden = "", "", False
        if attributes and ("=" in attributes or "hidden" in attributes):
            found: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            label = " ".join(sorted(found.get("class", "").lower().split()))
            names = f"{label} {found.get('id', '').lower()} {found.get('role', '').lower()}"
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        words = names.split()
        self.main = tag in MAIN or "main" in words
        self.noise = PLAIN
        if tag in NO_TEXT or tag in NOISE or hidden:
            self.noise = NAMED
        elif tag in LIKELY:
            self.noise = PART if self.within else NAMED
        elif words and tag not in HEADINGS:
            if not NOISE_WORDS.isdisjoint(words):
                self.noise = NAMED
            elif not LIKELY_WORDS.isdisjoint(words):
                self.noise = PART if self.within else NAMED
            elif not (NOISE_WORDS | LIKELY_WORDS).isdisjoint(re.split(r"[^a-z0-9]+", names)):
                self.noise = PART
        above = parent.path if parent else 0
        self.path = xxh3_64_intdigest(f"{above}/{tag}.{label}".encode("utf-8", "surrogatepass")) >> 1

    def goes(self) -> bool:
        """By its name alone."""
        return self.noise == NAMED or self.noise == PART and not self.within


def parse(source: str) -> Node:
    """The tree; children are nodes and strings (undecoded)."""
    root = Node("html", "", None)
    here, at = root, 0
    open_ = Counter({"html": 1})  # of elements from here up, so that no search goes up in vain

    def close(n: Node) -> Node:
        """The parent of n; all from here up to n are closed."""
        x = here
        while x is not n.parent:
            open_[x.tag] -= 1
            x = x.parent
        return n.parent

    last, tags, text = source.rfind(">"), _TAG, 0
    while True:
        start = source.find("<", at)
        if start < 0:
            if text < len(source):
                here.children.append(source[text:])
            return root
        m = _OTHER.match(source, start) if source[start + 1 : start + 2] in ("!", "?", "/") else None
        tag = None
        if m is None and start < last:
            m = tags.match(source, start)
            if m is None and tags is _TAG and _PLAIN_TAG.match(source, start):
                # a quote that never closes: from here on quotes mean nothing, so that no text is read twice
                tags = _PLAIN_TAG
                m = tags.match(source, start)
            tag = m and m[2]
        if m is None:
            at = start + 1
            continue
        if start > text:
            here.children.append(source[text:start])
        at = text = m.end()
        if tag is None:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            n = here if open_[tag] else None
            while n and n.tag != tag:
                n = n.parent
            if n and n.parent:
                here = close(n)
            elif tag in ("p", "br"):
                here.children.append(Node(tag, "", here))
            continue
        if tag in ("html", "body") and here is root and tag == "html":
            continue
        if tag in CLOSES_P and open_["p"]:
            n = here
            while n and n.tag not in ("p", "td", "th", "li", "div", "article", "section", "main", "table", "button"):
                n = n.parent
            if n and n.tag == "p" and n.parent:
                here = close(n)
        if tag in SIBLING and any(open_[x] for x in SIBLING[tag]):
            n, top = here, None
            while n and n.tag not in STOPS[tag]:
                if n.tag in SIBLING[tag]:
                    top = n
                n = n.parent
            if top and top.parent:
                here = close(top)
        node = Node(tag, m[3], here)
        here.children.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = len(source) if end is None else end.start()
            if at > text:
                node.children.append(source[text:at])
            text = at
            here = node
            open_[tag] += 1
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
            open_[tag] += 1


def style_nodes(source: str | None) -> dict[int, tuple[int, int]]:
    """path -> (presentation, content) hashes of the page's block elements that hold text; elements of one path count together.

    One pass down for the order of the elements, one up: the content of an element is a hash of its children's.
    """
    from xxhash import xxh3_64_intdigest

    def of(x: list) -> int:
        return xxh3_64_intdigest(repr(x).encode()) >> 1

    order, stack = [], [parse(source or "")]
    while stack:
        n = stack.pop()
        if n.tag not in NO_TEXT:
            order.append(n)
            stack += reversed([c for c in n.children if not isinstance(c, str)])
    content: dict[int, int] = {}  # by element, none where there is no text
    for n in reversed(order):
        own = []
        for c in n.children:
            if isinstance(c, str):
                if text := " ".join(c.split()):
                    own.append(xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
            elif (h := content.get(id(c))) is not None:
                own.append(h)
        if own:
            content[id(n)] = own[0] if len(own) == 1 else of(own)
    parts: dict[int, tuple[list, list]] = {}
    for n in order:
        if n.tag in BLOCK and id(n) in content:
            shape, texts = parts.setdefault(n.path, ([], []))
            shape.append([k.path for k in n.children if not isinstance(k, str) and k.tag in BLOCK])
            texts.append(content[id(n)])
    return {path: (of(shape), of(texts)) for path, (shape, texts) in parts.items()}


def text_of(source: str | None, low: set[int], constant: set[int], template: set[int]) -> str:
    """The page's main text; low: paths of low importance, constant: those nearly constant over the host, template: those of half of its pages."""
    if not source:
        return ""
    root = parse(source)
    chosen = _outermost_mains(root)
    for tree in (True, False):  # names alone where the tree leaves nothing
        blocks: list[list[str]] = [[]]
        for n in chosen or [root]:
            _gather(n, blocks, (constant if chosen else low) if tree else set(), low if tree else set(), template if tree else set(), bool(chosen))
            blocks.append([])
        lines = [x for b in blocks if (x := " ".join(_html.unescape("".join(b)).split()))]
        if lines:
            break
    return "\n".join(lines)


def _outermost_mains(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.goes():
            continue
        if x.main:
            out.append(x)
        else:
            stack += [c for c in reversed(x.children) if not isinstance(c, str)]
    return out


def _gather(n: Node, blocks: list[list[str]], gone: set[int], low: set[int], template: set[int], inside: bool) -> None:
    """Pieces of text by block, in page order, without the branches that go."""
    todo: list = [(n, False)]
    while todo:
        x, closing = todo.pop()
        if isinstance(x, str):
            blocks[-1].append(x)
            continue
        if closing:
            blocks.append([])
            continue
        if x is not n and (x.goes() or x.noise == PART and (x.path in template or x.path in low) or x.path in gone and (not inside or x.tag in ("div", "section", "ul", "ol", "table", "figure"))):
            continue
        if x.tag == "br":
            blocks[-1].append(" ")
            continue
        if x.tag in BLOCK:
            blocks.append([])
            todo.append((x, True))
        todo += [(c, False) for c in reversed(x.children)]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def nodes(pages: DataFrame) -> DataFrame:
    """(host, page, path, shape, content) of a table (host, page, html): the style nodes of each different page."""

    def run(c):
        out = {"host": [], "page": [], "path": [], "shape": [], "content": []}
        for host, page, source in zip(c["host"], c["page"], c["html"]):
            for path, (shape, content) in style_nodes(source).items():
                for name, v in zip(out, (host, page, path, shape, content)):
                    out[name].append(v)
        return out

    return map_batches(pages.select("host", "page", "html"), run, "host string, page bigint, path bigint, shape bigint, content bigint").distinct()


def style_tree(found: DataFrame, prior: float = 2.0) -> DataFrame:
    """(host, path, pages, share, importance) of nodes(); share: of the host's pages that have the path."""
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("shape").alias("h")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("h")))).alias("x")
    n = found.select("host", "path", kinds).groupBy("host", "path", "x.kind", "x.h").agg(F.count(F.lit(1)).alias("n"))
    each = n.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(0.0)
    tree = each.groupBy("host", "path").agg(F.max("m").alias("pages"), F.max(entropy).alias("evidence"))
    all_ = found.groupBy("host", "page").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    seen = F.col("pages") - 1
    return tree.join(all_, "host").select("host", "path", "pages", (F.col("pages") / F.col("all")).alias("share"), ((seen * F.col("evidence") + prior) / (seen + prior)).alias("importance"))


def extract(pages: DataFrame, low: float = 0.55, constant: float = 0.2) -> DataFrame:
    """(page_id, url, text) of each row of pages."""
    from .suffix_dedup import _unpack

    page = F.shiftrightunsigned(F.xxhash64(F.coalesce("html", F.lit(""))), 1)
    hosted = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), page.alias("page"), "html")
    found = stored(nodes(hosted), "style-nodes")
    marked = style_tree(found).where((F.col("importance") < low) | ((F.col("pages") > 1) & (F.col("share") >= 0.5)))
    own = found.select("host", "page", "path").join(stored(marked, "style-tree"), ["host", "path"])
    gone = stored(own.groupBy("host", "page").agg(F.collect_list(F.struct("path", "importance", "share")).alias("marked")), "page-paths")

    def pack(c):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        return {n: c[n] for n in ("page_id", "url", "host", "page")} | {"z": [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in c["html"]]}

    ready = map_batches(hosted, pack, "page_id bigint, url string, host string, page bigint, z binary").join(gone, ["host", "page"], "left")

    def run(c):
        texts = []
        for z, paths in zip(c["z"], c["marked"]):
            paths = paths or []
            sets = ({x["path"] for x in paths if x["importance"] < low}, {x["path"] for x in paths if x["importance"] < constant}, {x["path"] for x in paths if x["share"] >= 0.5})
            texts.append(text_of(_unpack(z).decode("utf-8", "surrogatepass"), *sets))
        return {"page_id": c["page_id"], "url": c["url"], "text": texts}

    return map_batches(ready.select("page_id", "url", "z", "marked"), run, "page_id bigint, url string, text string")


def op7(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
