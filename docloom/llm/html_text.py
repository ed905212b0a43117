"""Main text of web pages by a site style tree.

The pages of a host are laid over each other: a node of the tree is a path of tags with their styles
(classes and ids). The importance of a node is the mean of two entropies, each by logarithm to the number
of pages that have it: of its presentation - the sequences of child styles that it has on the host's pages -
and of its content; a node without child elements has the second alone. It is near 0 where all pages show the
same, near 1 where each has its own. Branches of low importance are cut from each page, and the blocks left
make the text. What one site's pages can't tell (adverts and comments differ from page to page) is a prior
of the style: an element whose names all say furniture is cut, unless it holds most of the page's text.
Only counts for (host, node, content or presentation) are gathered, so a host with any share of the pages
is no burden.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_join
from .url_filter import host_and_path

#: A node counts as the host's furniture if that many pages and that share of them have it, with less entropy.
LEAST_PAGES, LEAST_SHARE, ENTROPY = 8, 0.5, 0.25
#: Low-importance nodes are sent to all tasks while they are no more than this; beyond, pages are joined by host, common hosts staying where they are.
SENT = 100_000

# HTML's element kinds, and names that styles give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "option", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt"}
NONE = frozenset("nav footer aside script style noscript template iframe button select textarea svg canvas object audio video dialog menu head title".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus respond reply replies widget toolbar pagination pager login search form topbar copyright skip".split())
#: Names that may stand beside those, and those that hold whatever share of the text lies under them.
BESIDE = frozenset("a area bar bars block blocks body bottom box boxes btn button buttons center col column columns container content footer fixed group header home index inner item items large left link links list lists main media middle outer page panel post posts right row section site slot small top unit units user users view web wrap wrapper zone 1 2 3 4 5 6 7 8 9".split())
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo comment comments disqus respond reply replies cookie cookies consent gdpr newsletter popup modal breadcrumb breadcrumbs".split())
LINE = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dt dd pre blockquote figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    if not raw.strip(" /\n\t\r"):
        return {}
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def _hidden(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Is the element never part of an article?"""
    if tag in NONE or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    return "hidden" in attributes or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""))) or attributes.get("role", "").lower() in ROLES - {"form"}


def _prior(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """What the element's style says: 0 nothing, 1 furniture unless it holds most of the text, 2 furniture.

    Each name of a class or id must say it, or stand beside one that does: `share-box` does, `share-price` doesn't.
    """
    if tag == "form" or attributes.get("role", "").lower() == "form":
        return 1
    if not attributes or tag in LINE or tag in ("main", "body", "html"):
        return 0
    found = 0
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        for words in ({w for w in SPLIT.split(name) if w}, {w for w in SPLIT.split(name.lower()) if w}):
            words = {w.lower() for w in words}
            if words <= WORDS | BESIDE and (said := words & WORDS or (words & {"header"} if not inside else set())):
                found = max(found, 2 if said & ALWAYS else 1 if tag != "article" else 0)
    return found


class Page:
    """The blocks of a page in order: (text, in an article, in a main element, the styled nodes it lies in). shapes: the child styles of each node."""

    def __init__(self, source: str | None):
        found: list[tuple[str, bool, bool, tuple[str, ...], tuple[int, ...]]] = []
        self.shapes: dict[str, list[str]] = {}
        self.read(source or "", found)
        # Elements of a doubtful style stay if they hold most of the text.
        held, total = {}, sum(len(b[0]) for b in found)
        for text, *_, doubts in found:
            for d in doubts:
                held[d] = held.get(d, 0) + len(text)
        self.blocks = [b[:4] for b in found if all(d > 0 and 2 * held[d] > total for d in b[4])]
        articles, mains = any(b[1] for b in self.blocks), any(b[2] for b in self.blocks)
        self.chosen = [b for b in self.blocks if (b[1] if articles else b[2] if mains else True)]
        self.whole = not articles and not mains

    def read(self, source: str, blocks: list) -> None:
        # An open element: (tag, dropped, articles, mains, path, nodes, doubts, child styles); a doubt is a number, negative for good.
        stack: list[tuple] = [("", False, 0, 0, "", (), (), [])]
        doubt = 0
        held: list[str] = []

        def flush():
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    _, _, articles, mains, _, nodes, doubts, _ = stack[-1]
                    blocks.append((text, articles > 0, mains > 0, nodes, doubts))

        def close(to: int):
            if any(x[0] in BLOCK for x in stack[to:]):
                flush()
            for x in stack[to:]:
                if x[5] and x[5][-1] == x[4]:
                    self.shapes.setdefault(x[4], []).append(" ".join(x[7]))
            del stack[to:]

        at, end = 0, len(source)
        while at < end:
            found = TOKEN.search(source, at)
            stop = found.start() if found else end
            if stop > at and not stack[-1][1]:
                held.append(source[at:stop])
            if not found:
                break
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag = tag.lower()
            if found[1] or found[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in ("table", "article", "main", "body") and tag not in BLOCK:
                        break
                if tag in ("td", "th"):
                    held.append(" ")
                continue
            if tag == "br":
                held.append("\n")
                continue
            if tag in RAW:
                over = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(source, at)
                at = over.end() if over else end
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                peers = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, (tag,))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in peers:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            attributes = _attributes(found[3] if found[2] else found[6])
            _, dropped, articles, mains, path, nodes, doubts, children = stack[-1]
            style = ".".join(x for x in (tag, attributes.get("class", ""), attributes.get("id", "")) if x)
            path = f"{path}/{style}" if tag in BLOCK else path
            if not dropped:
                children.append(style)
                dropped = _hidden(tag, attributes, articles > 0 or mains > 0)
                if prior := _prior(tag, attributes, articles > 0 or mains > 0):
                    doubt += 1
                    doubts = (*doubts, doubt if prior == 1 else -doubt)
                if tag in BLOCK and tag not in ("body", "html", "article", "main") and (not (articles or mains) or style != tag):
                    nodes = (*nodes, path)
            firm = not dropped and not any(d < 0 for d in doubts)
            articles, mains = articles + (tag == "article" and firm), mains + ((tag == "main" or attributes.get("role") == "main") and firm)
            if tag in ("td", "th"):
                held.append(" ")
            if not (found[3] or found[6] or "").endswith("/") or tag in BLOCK:
                stack.append((tag, dropped, articles, mains, path, nodes, doubts, []))
        close(1)
        flush()

    def nodes(self) -> dict[str, str]:
        """What each node of the tree holds on this page."""
        out: dict[str, list[str]] = {}
        for text, _, _, nodes in self.chosen:
            for node in dict.fromkeys(nodes):
                out.setdefault(node, []).append(text)
        return {k: "\n".join(v) for k, v in out.items()}

    def text(self, low: frozenset[str] | set[str] = frozenset()) -> str:
        return "\n".join(t for t, _, _, nodes in self.chosen if not low or low.isdisjoint(nodes))


def low_importance(pages: DataFrame) -> DataFrame:
    """(host, path) of the nodes of low importance, of which copies of a page count once. pages: (host, html)."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        code = lambda text: xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)
        for batch in batches:
            rows = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = Page(source)
                whole = code("\0".join(c[0] for c in page.chosen))
                rows.append((host, whole, None, 0, 0, False))
                for path, text in page.nodes().items():
                    shape = page.shapes.get(path, [])
                    rows.append((host, whole, path, code(text), code("\0".join(shape)), any(shape)))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "page", "path", "content", "shape", "inner"])

    each = pages.select("host", "html").mapInArrow(run, "host string, page bigint, path string, content bigint, shape bigint, inner boolean").distinct()
    counts = cut(each.groupBy("host", "path", "content", "shape").agg(F.count("*").alias("n"), F.max("inner").alias("inner")), "nodes")
    total = counts.where("path is null").select("host", F.col("n").alias("pages"))
    n = F.sum("n")
    both = counts.where("path is not null")

    def spread(what: str) -> DataFrame:
        """Entropy of a node's contents or presentations, to the base of its pages."""
        rows = both.groupBy("host", "path", what).agg(n.alias("n"), F.max("inner").alias("inner"))
        entropy = (F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n)
        return rows.groupBy("host", "path").agg(n.alias("m"), F.max("inner").alias("inner"), F.when(n > 1, entropy).otherwise(F.lit(1.0)).alias(what))

    node = spread("content").join(spread("shape").select("host", "path", "shape"), ["host", "path"])
    importance = F.when(F.col("inner"), (F.col("content") + F.col("shape")) / 2).otherwise(F.col("content"))
    low = (F.col("m") >= LEAST_PAGES) & (F.col("m") >= LEAST_SHARE * F.col("pages")) & (importance < ENTROPY)
    return node.join(total, "host").where(low).select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html).

    A null html is empty and gives an empty text; pages without a host share one tree; repeated rows
    stay; a very long html is read whole; an empty table gives no rows; other columns are not looked at.
    """
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    low = cut(low_importance(rows), "low")
    sent: dict[str, set[str]] | None = None
    if low.limit(SENT + 1).count() <= SENT:
        sent = {}
        for r in low.collect():
            sent.setdefault(r["host"], set()).add(r["path"])
    else:
        paths = cut(low.groupBy("host").agg(F.collect_set("path").alias("paths")), "paths")
        rows = heavy_join(rows, paths, "host").unionByName(rows.join(paths, "host", "left_anti").withColumn("paths", F.lit(None).cast("array<string>")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cuts = [sent.get(h, frozenset()) for h in batch.column("host").to_pylist()] if sent is not None else [frozenset(p or ()) for p in batch.column("paths").to_pylist()]
            text = [Page(source).text(low) for source, low in zip(batch.column("html").to_pylist(), cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    out = rows.mapInArrow(run, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
