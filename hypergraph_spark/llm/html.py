"""HTML extraction by site style trees: same-host DOMs merge, and branches of low importance go."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import arrow_rows, hidden, materialize
from hypergraph_spark.llm.urls import url_host

# Element names and landmark roles of the HTML and ARIA standards.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "option", "fieldset", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog"}
MARKED = {"article", "main"}
P_ENDERS = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"table", "ul", "ol", "dl", "select", "article", "main", "section", "div", "body"}
#: Whole class and id names of the parts that are no article; a prior that a page's own text can overrule. Fixed values.
NAMED = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "cookie", "cookies", "cookie-notice", "cookie-banner", "consent", "popup", "sidebar", "breadcrumb", "breadcrumbs", "nav", "navbar", "menu", "footer", "site-header", "site-footer", "share", "social", "newsletter", "related", "comment", "comments", "comment-list", "reader-comments", "disqus"}
#: Style paths name so many levels; what lies deeper counts as part of the last. Texts are not affected.
MAX_DEPTH = 32
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=\"'][^\s/>=]*)?(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d{3,}")  # numbers of pages or posts, not of styles
#: The hosts' lists of unimportant nodes are broadcast up to this size, joined with salted hosts beyond.
BROADCAST_BYTES = 8 << 20
SALTS = 64


class _Element:
    __slots__ = ("area", "gone", "inline", "kids", "named", "path", "tag", "under")

    def __init__(self, tag: str, path: tuple[str, ...], gone: bool, named: bool, area: bool, inline: bool, under: int):
        self.tag, self.path, self.gone, self.named, self.area, self.inline = tag, path, gone, named, area, inline
        self.under = under  # the stack's depth of the nearest block element, its own included
        self.kids: list[str] = []


class Block:
    """A text block: style path, text, whether its branch is marked as the article, named as a part that is none, and only links."""

    __slots__ = ("area", "links", "named", "path", "text")

    def __init__(self, path: str, text: str, area: bool, named: bool, links: bool):
        self.path, self.text, self.area, self.named, self.links = path, text, area, named, links


def _tag(page: str, pos: int, last: dict[str, int]) -> tuple[dict[str, str], bool, int]:
    """(attributes, self-closing, end) of the tag whose name ends at pos; every character is read once.

    A quote that never closes ends with the tag's next `>`.
    """
    attrs: dict[str, str] = {}
    n = len(page)
    while pos < n:
        if page[pos] == ">":
            return attrs, page[pos - 1] == "/", pos + 1
        m = _ATTR.match(page, pos)
        pos = m.end()
        if not m[2]:
            if not m[1] and pos < n and page[pos] in "\"'=":
                pos += 1  # a stray quote or sign
            elif m[1]:
                attrs.setdefault(m[1].lower(), "")
            continue
        quote = page[pos : pos + 1]
        if quote and quote in "\"'":
            if pos >= last[quote]:
                pos += 1
                continue
            end = page.index(quote, pos + 1)
            value, pos = page[pos + 1 : end], end + 1
        else:
            v = _BARE.match(page, pos)
            value, pos = v[0], v.end()
        if m[1]:
            attrs.setdefault(m[1].lower(), value)
    return attrs, False, n


def read_page(page: str) -> tuple[list[Block], dict[tuple[str, ...], list[str]]]:
    """(text blocks in page order, child sequences by style path) of a page, in one pass over it.

    Text is decoded and its white space folded; script-like and hidden elements are left out. Unclosed and stray tags
    are handled as browsers do in the common cases. The child sequence of a style path is what its elements hold, runs
    of equal children once, blocks of the article's kind only.
    """
    root = _Element("#", ("#",), False, False, False, False, 0)
    stack, opened = [root], Counter()
    out: list[Block] = []
    styles: dict[tuple[str, ...], list[str]] = {}
    held: list[str] = []
    plain = [False]  # whether the held text has words outside links
    links = 0
    skipped_end: set[str] = set()
    last = {q: page.rfind(q) for q in "\"'>"}

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            top = stack[stack[-1].under]
            if text and not top.gone:
                out.append(Block("/".join(top.path), text, top.area, top.named, not plain[0]))
        plain[0] = False

    def close(depth: int) -> None:
        """Closes all elements from the stack's depth on."""
        nonlocal links
        while len(stack) > depth:
            x = stack[-1]
            if not x.inline:
                flush()
                if not x.gone and x.kids:
                    styles.setdefault(x.path, []).append(" ".join(x.kids))
            stack.pop()
            opened[x.tag] -= 1
            links -= x.tag == "a"

    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            if not stack[-1].gone:
                words = page[pos:at]
                held.append(words)
                if not links and not words.isspace():
                    plain[0] = True
            pos = at
            continue
        if page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
            continue
        if page[pos + 1 : pos + 2] in ("!", "?") or page[pos + 1 : pos + 3] == "</":
            end = page.find(">", pos)
            pos = n if end < 0 else end + 1
            continue
        closing = page[pos + 1 : pos + 2] == "/"
        m = _NAME.match(page, pos + 1 + closing)
        if m is None or pos > last[">"]:  # no tag: a sign of the text
            if not stack[-1].gone:
                held.append("<")
                plain[0] = plain[0] or not links
            pos += 1
            continue
        tag = m[0].lower()
        attrs, alone, pos = _tag(page, m.end(), last)
        if closing:
            if tag == "br":
                flush()
            elif opened[tag]:
                depth = len(stack) - 1
                # A closing inline tag does not reach across a block.
                while stack[depth].tag != tag and not (tag in INLINE and not stack[depth].inline):
                    depth -= 1
                if stack[depth].tag == tag:
                    close(depth)
            continue
        if tag in P_ENDERS and opened["p"]:
            if stack[stack[-1].under].tag == "p":
                close(stack[-1].under)
        elif tag in SAME_ENDS and any(opened[t] for t in SAME_ENDS[tag]):
            depth = len(stack) - 1
            while depth and stack[depth].tag not in SCOPE and stack[depth].tag not in SAME_ENDS[tag]:
                depth -= 1
            while depth > 1 and stack[depth].tag in SAME_ENDS[tag] and stack[depth - 1].tag in SAME_ENDS[tag]:
                depth -= 1
            if depth and stack[depth].tag in SAME_ENDS[tag]:
                close(depth)
        up = stack[-1]
        if tag == "br":
            flush()
            continue
        if tag in RAW:
            end = None if tag in skipped_end else _RAW_END[tag].search(page, pos)
            if end is None:
                skipped_end.add(tag)
                if tag in ("script", "style"):
                    pos = n
            else:
                pos = end.end()
            continue
        if tag in VOID or alone and tag not in INLINE:
            if tag not in INLINE:
                flush()
            continue
        if alone:
            continue
        classes = attrs.get("class", "").split()
        role = attrs.get("role", "").strip().lower()
        area = up.area or tag in MARKED or role in MARKED or attrs.get("itemprop") == "articleBody"
        gone = up.gone or tag in NEVER or role in ROLES or tag == "header" and not area or attrs.get("aria-hidden") == "true" or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        named = up.named or tag not in ("body", "html") and any(c.lower() in NAMED for c in [*classes, attrs.get("id", "")])
        inline = tag in INLINE and not gone and not (named and not up.named)
        if not inline:
            flush()
            label = _DIGITS.sub("0", ".".join([tag, *classes, *([role] if role else [])])).replace("/", "|")
            path = up.path if inline or len(up.path) > MAX_DEPTH else (*up.path, label)
            if not gone and (not up.kids or up.kids[-1] != label):
                up.kids.append(label)
        else:
            path = up.path
        stack.append(_Element(tag, path, gone, named, area, inline, up.under if inline else len(stack)))
        opened[tag] += 1
        links += tag == "a"
    close(1)
    flush()
    return out, styles


def candidates(blocks: list[Block]) -> list[Block]:
    """The blocks that may be the article, before the style tree is asked.

    If the page marks an article or main part with blocks, those are it; otherwise blocks that are links only go. Then
    named parts go, unless they hold more than is left.
    """
    if any(b.area for b in blocks):
        blocks = [b for b in blocks if b.area]
    else:
        blocks = [b for b in blocks if not b.links]
    kept = [b for b in blocks if not b.named]
    return kept if 2 * sum(len(b.text) for b in kept) >= sum(len(b.text) for b in blocks) else blocks


def _digest(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


_NODES = "array<struct<path:string,style:boolean,content:long,mass:long>>"
_BLOCKS = "array<struct<path:string,text:string>>"


def read_pages(pages: DataFrame, names: list[str], html_col: str, url_col: str) -> DataFrame:
    """names, __host, __page (a digest of the candidates), __nodes (what the page adds to its host's tree), __blocks."""
    host = F.coalesce(url_host(F.col(url_col)), F.lit(""))
    src = pages.select(*names, host.alias("__host"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    kinds = pa.list_(pa.struct([("path", pa.string()), ("style", pa.bool_()), ("content", pa.int64()), ("mass", pa.int64())]))
    texts = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, nodes, found = [], [], []
            for page in batch.column(batch.num_columns - 1).to_pylist():
                blocks, styles = read_page(page)
                blocks = candidates(blocks)
                own: dict[tuple[str, bool, int], int] = {}
                shown = set()
                for b in blocks:
                    key = (b.path, False, _digest(b.text))
                    own[key] = own.get(key, 0) + len(b.text)
                    shown.update(tuple(b.path.split("/")[:i]) for i in range(1, b.path.count("/") + 2))
                # Every node that holds text has one child sequence, so these rows count its pages.
                for path in shown:
                    own["/".join(path), True, _digest("\n".join(sorted(set(styles.get(path, ())))))] = 0
                nodes.append([{"path": k[0], "style": k[1], "content": k[2], "mass": v} for k, v in own.items()])
                made.append(_digest("\n".join(f"{b.path}\t{b.text}" for b in blocks)))
                found.append([{"path": b.path, "text": b.text} for b in blocks])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.int64()), pa.array(nodes, kinds), pa.array(found, texts)], names=[*names, "__host", "__page", "__nodes", "__blocks"])

    types = "".join(f"`{c}` {t}, " for c, t in src.select(*names).dtypes)
    with arrow_rows(pages.sparkSession):
        return materialize(src.mapInArrow(run, f"{types}__host string, __page long, __nodes {_NODES}, __blocks {_BLOCKS}"), "pages")


def style_tree(read: DataFrame, enough: int = 8, decay: float = 0.9) -> DataFrame:
    """The merged style trees of read_pages' rows: (host, path, pages, importance) of every style node.

    A style node is a path of element labels (tag, classes, role) below a host. Pages of a host with the same candidate
    text count once, so that copies do not make each other's text unimportant.

    * Content: of a node's text blocks, one that stands on k of the node's m pages has entropy log k / log m; the
      node's own importance is the mean of 1 - entropy, by occurrence: 1 where all differ, 0 where all are alike.
    * Presentation: of a node's child sequences, the entropy of their distribution over the m pages, to the base of m.
    * Branches: with l child sequences, importance = (1 - decay^(l-1)) presentation + decay^(l-1) * the mean importance
      of the node's own text and its children, by text length.

    A node on fewer than `enough` pages is measured to the base of `enough`, as few pages prove little. Everything is
    sums by node, combined before each shuffle, so a host with a third of all pages spreads by page and by block; the
    recursion is written out over each node's ancestors, at most MAX_DEPTH.
    """
    pages = read.groupBy("__host", "__page").agg(F.first("__nodes").alias("nodes"))
    each = pages.select(F.col("__host").alias("host"), F.explode("nodes").alias("x")).select("host", "x.*")
    seen = each.groupBy("host", "path", "style", "content").agg(F.count(F.lit(1)).alias("k"), F.sum("mass").alias("mass"))
    style, k = F.col("style"), F.col("k")
    by = seen.groupBy("host", "path").agg(
        F.sum(F.when(style, k)).alias("pages"), F.sum(style.cast("int")).alias("l"), F.sum(F.when(style, k * F.log(k))).alias("spread"),
        F.sum(F.when(~style, k)).alias("n"), F.sum(F.when(~style, k * F.log(k))).alias("alike"), F.sum("mass").cast("double").alias("mass"),
    )
    base = F.log(F.greatest(F.col("pages"), F.lit(enough)))
    content = 1 - F.least(F.coalesce(F.col("alike") / F.col("n") / base, F.lit(0.0)), F.lit(1.0))
    presented = (F.log("pages") - F.col("spread") / F.col("pages")) / base
    node = materialize(by.select("host", "path", "pages", "mass", content.alias("content"), presented.alias("presented"), F.pow(F.lit(decay), F.col("l") - 1).alias("stay")), "style-nodes")
    # With s the stay, importance(E) * mass(E) is a sum over the nodes D of E's branch: D's own text times all s from E
    # down to D, and D's presentation times 1 - s(D) times all s from E down to above D.
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ups = node.select("host", F.col("path").alias("below"), "mass", "content", "presented", F.posexplode(chain).alias("depth", "path")).join(node.select("host", "path", "stay"), ["host", "path"])
    line = F.sort_array(F.collect_list(F.struct("depth", "path", "stay"))).alias("line")
    lines = ups.groupBy("host", "below", "mass", "content", "presented").agg(line)
    product = lambda a, b: F.aggregate(F.slice("line", a + 1, b - a), F.lit(1.0), lambda x, y: x * y["stay"])
    own = F.transform("line", lambda x: F.struct(x["path"].alias("path"), product(x["depth"], F.size("line")).alias("text"), product(x["depth"], F.size("line") - 1).alias("shown")))
    adds = materialize(lines.select("host", "below", "mass", "content", "presented", F.element_at("line", -1)["stay"].alias("last"), F.explode(own).alias("x")).select("host", "below", "mass", "content", "presented", "last", "x.path", "x.text", "x.shown"), "style-lines")
    total = adds.groupBy("host", "path").agg(F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("content") * F.col("text")).alias("texts"))
    shown = adds.where((F.col("presented") > 0) & (F.col("last") < 1)).join(total.select("host", F.col("path").alias("below"), F.col("mass").alias("branch")), ["host", "below"])
    gains = shown.groupBy("host", "path").agg(F.sum(F.col("branch") * F.col("presented") * (1 - F.col("last")) * F.col("shown")).alias("gain"))
    out = total.join(gains, ["host", "path"], "left").join(node.select("host", "path", "pages"), ["host", "path"])
    importance = (F.col("texts") + F.coalesce("gain", F.lit(0.0))) / F.greatest(F.col("mass"), F.lit(1.0))
    return out.select("host", "path", "pages", F.least(importance, F.lit(1.0)).alias("importance"))


def extract_text(pages: DataFrame, least: float = 0.2, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] | None = None) -> DataFrame:
    """pages (the columns `keep`, all if None) with text (the main text, empty if none) and n_chars (its code points).

    1. Every page is read once, into blocks with their style paths. Elements and roles that the standards reserve for
       menus, headers, footers, sidebars, forms and notices go, and so do parts named so by a whole class or id (see
       candidates); a marked article or main part is where the text is looked for first.
    2. The blocks of each host merge into its style tree (see style_tree). Every branch less important than `least` is
       removed from all its pages, inside a marked article as well.

    White space folds to one space inside a block; blocks are joined by \\n in page order. A null page is empty; a null
    url has the host ''. A page of which the tree would leave nothing keeps its candidates. Repeated rows stay; extra
    columns too (text and n_chars are replaced); an empty table gives an empty result.
    """
    # A url or html column of the name of a result is read, but not kept.
    made = ("text", "n_chars")
    shown = [c for c in (keep or pages.columns) if c not in made]
    inner, own = hidden(pages, (html_col, url_col))
    names = [inner.columns[own.index(c)] for c in shown]
    pages = inner
    read = read_pages(pages, names, html_col, url_col)
    tree = style_tree(read).where(F.col("importance") < least).select("host", "path")
    # Only unimportant nodes are sent back, as one list a host: bounded by its templates, not by its pages.
    low = materialize(tree.groupBy(F.col("host").alias("__of")).agg(F.collect_list(F.concat("path", F.lit("/"))).alias("__low")), "style-tree")
    size = low.agg(F.coalesce(F.sum(F.octet_length("__of") + F.octet_length(F.array_join("__low", ","))), F.lit(0))).first()[0]
    df = read.select(*names, "__host", "__page", "__blocks")
    if size <= BROADCAST_BYTES:
        df = df.join(F.broadcast(low), F.col("__host") == F.col("__of"), "left")
    else:
        # A host's pages are spread over SALTS tasks, its list sent to each.
        low = low.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.join(low, (F.col("__host") == F.col("__of")) & (F.pmod(F.col("__page"), F.lit(SALTS)) == F.col("__s")), "left")
    stays = F.filter("__blocks", lambda b: ~F.exists("__low", lambda x: F.startswith(F.concat(b["path"], F.lit("/")), x)))
    kept = F.when(F.col("__low").isNull() | (F.size(stays) == 0), F.col("__blocks")).otherwise(stays)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return df.select(*names, text.alias("__text")).select(*names, "__text", F.length("__text").cast("long")).toDF(*shown, *made)


def main_text(page: str) -> str:
    """The candidates of one page, without its host's tree."""
    return "\n".join(b.text for b in candidates(read_page(page)[0]))
