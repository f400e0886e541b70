"""Main text of web pages by the style trees of their sites.

All distinct pages of a host are merged into one tree of styles: a node is a path of tags with
their classes.  An inner node's presentation importance is the entropy of the sequences of
children that it shows on the host's pages; a content node's importance is what the entropies
of its texts over the pages leave: a text that every page repeats tells nothing, one that a
single page has tells all.  A node's composite importance weighs its own presentation with the
content of all nodes below it, by the number of its styles; on hosts of few pages it is drawn
towards full importance.  A branch of low importance goes from each page as a whole.  Tags are
a prior: inside an article or main element a branch has to be less important to go, and outside
one, on pages that have one, more important to stay.  Branches that their tags or names give
away as menus, headers, footers, sidebars, notices, adverts, forms or comments go anyway.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapatch.llm import common

#: A branch goes if its importance is below LOW divided by its weight: inside of an article, outside on pages that have one, or on pages that have none.
LOW, INSIDE, OUTSIDE = 0.3, 1.5, 0.7
#: What each style of a node leaves to the content below it, and pages of full importance that every node begins with.
GAMMA, PRIOR = 0.9, 4
#: Bytes of low nodes up to which they are broadcast.
BROADCAST = 8 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*)[^>]*+>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+[^>]*+)>?", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset(("br", "option", "optgroup", "body", "html", "head"))
_OFF = frozenset("nav aside form footer menu dialog button select head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side-?bar|aside|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|header|site-header|page-header|comments?|comment-\w+|repl(?:y|ies)|disqus|respond|social|share|sharing|related|recommend\w*|widget|toolbar|search|pagination|pager|skip-link|form)(?:$|[\s_-]|\d)",
    re.I,
)
#: Kinds of blocks: given away by tag or name; open; inside an article.
DROPPED, OPEN, ARTICLE = 0, 1, 2


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, kind) of the blocks of a page in order, from whatever markup there is."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, dropped, in an article
    text: list[str] = []
    pos, size = 0, len(page)

    def flush():
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                _, path, dropped, inside = stack[-1] if stack else ("", "", False, False)
                out.append((path, joined, DROPPED if dropped else ARTICLE if inside else OPEN))

    def place(at: int):
        flush()
        del stack[at:]

    while pos < size:
        m = _TOKEN.search(page, pos)
        if not m:
            text.append(page[pos:])
            break
        if m.start() > pos:
            text.append(page[pos : m.start()])
        pos = m.end()
        if m[1]:
            tag = m[1].lower()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at >= 0:
                if tag in _BLOCK:
                    place(at)
                else:  # an inline element: what is open within stays open
                    del stack[at]
            elif tag in _BLOCK:
                flush()
        elif m[2]:
            tag = m[2].lower()
            if tag in _RAW:
                end = _RAW[tag].search(page, pos)
                pos = end.end() if end else size
                continue
            if tag in _BLOCK:
                flush()
            if tag in _VOID:
                continue
            if tag in _CLOSES_P:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)
                if at >= 0 and not any(s[0] in _BLOCK for s in stack[at + 1 :]):
                    place(at)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in (tag, "ul", "ol", "dl", "table")), -1)
                if at >= 0 and stack[at][0] == tag:
                    place(at)
            names, role, hidden = "", "", False
            if m[3] and not m[3].isspace():
                for key, a, b, c in _ATTR.findall(m[3]):
                    value, key = a or b or c, key.lower()
                    if key in ("class", "id"):
                        names = f"{names} {value}".strip()
                    elif key == "role":
                        role = value.lower()
                    elif key == "style":
                        hidden = hidden or "display:none" in value.replace(" ", "").lower()
                    elif key == "aria-hidden":
                        hidden = hidden or value == "true"
                hidden = hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", m[3]))
            main = tag in ("article", "main") or role in ("main", "article")
            _, path, dropped, inside = stack[-1] if stack else ("", "", False, False)
            off = tag in _OFF or role in _ROLES or hidden or bool(names and _NAMES.search(names) and tag not in ("body", "html")) or tag == "header" and not inside
            if main and dropped and not off:  # a menu or advert that was never closed
                at = next(i for i, s in enumerate(stack) if s[2])
                place(at)
                _, path, dropped, inside = stack[-1] if stack else ("", "", False, False)
            if tag in _BLOCK or off:
                path = f"{path}/{tag}" + (f".{'.'.join(sorted(names.lower().split()))}" if names else "")
                if len(path) > 400:  # deep trees: the end of the path and its check sum
                    path = f"…{zlib.crc32(path.encode()):08x}{path[-200:]}"
            stack.append((tag, path, dropped or off, inside or main))
    flush()
    return out


def host(url: str) -> Column:
    """Host of a column of URLs in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def branches(path: str) -> list[str]:
    """The nodes from the root down to a path, itself last."""
    at = [i for i, c in enumerate(path) if c == "/"][1:]
    return [*(path[:i] for i in at), path]


def styles(found: list[tuple[str, str, int]]) -> list[tuple[str, int, int]]:
    """(path, kind, feature) of a page's blocks: each text of a content node (CONTENT), that the node is there (PRESENT), and each inner node's sequence of children (SHOWN); a branch of several blocks in a row is one child."""
    texts: set[tuple[str, int]] = set()
    below: dict[str, int] = {}
    before: list[str] = []
    for path, text, _ in found:
        nodes_ = branches(path)
        texts.add((path, zlib.crc32(text.encode("utf-8", "surrogatepass"))))
        new = False
        for k in range(1, len(nodes_)):
            new = new or k == len(nodes_) - 1 or before[: k + 1] != nodes_[: k + 1]
            if new:
                below[nodes_[k - 1]] = zlib.crc32(nodes_[k][len(nodes_[k - 1]) :].encode(), below.get(nodes_[k - 1], 0))
        before = nodes_
    return [*((p, CONTENT, h) for p, h in texts), *((p, PRESENT, 0) for p in {p for p, _ in texts}), *((p, SHOWN, h) for p, h in below.items())]


CONTENT, PRESENT, SHOWN = range(3)


def nodes(pages: DataFrame, html: str, url: str) -> DataFrame:
    """(host, path, kind, h, page): what each page shows of the nodes of its host's tree; page is a hash of the page."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for site, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sign = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                out += [(site, p, k, h, sign) for p, k, h in styles([b for b in blocks(page or "") if b[2]])]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "path", "kind", "h", "page"])

    return pages.select(host(url).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(run, "host string, path string, kind int, h long, page long")


def style_tree(found: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every node of the hosts' trees, from what their distinct pages show.

    Entropies are relative to the logarithm of the node's pages m. A text on k of them has the entropy ln k / ln m and
    leaves the rest as importance; content is the mean over all texts below the node. Presentation is the entropy of
    the node's sequences of children, l of them: importance is (1 - GAMMA ** l) of it and GAMMA ** l of content, then
    the mean with PRIOR pages of importance 1.
    """
    k = found.distinct().groupBy("host", "path", "kind", "h").agg(F.count("*").cast("double").alias("k"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0.0))
    x, log = F.col("k"), F.col("k") * F.ln("k")
    each = k.groupBy("host", "path").agg(of(CONTENT, x).alias("n"), of(CONTENT, log).alias("a"), of(PRESENT, x).alias("leaf"), of(SHOWN, x).alias("inner"), of(SHOWN, log).alias("b"), of(SHOWN, F.lit(1.0)).alias("l"))
    m, inner = F.col("leaf"), F.col("inner")
    told = F.col("n") - F.when(m > 1, F.col("a") / F.ln(m)).otherwise(0.0)
    shown = F.when(inner > 1, 1 - F.col("b") / (inner * F.ln(inner))).otherwise(1.0)
    each = each.select("host", "path", "n", told.alias("told"), F.greatest(m, inner).alias("m"), shown.alias("shown"), "l")
    # the content of a node is that of all below it
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = each.where("n > 0").select("host", "n", "told", F.explode(up).alias("path")).groupBy("host", "path").agg((F.sum("told") / F.sum("n")).alias("content"))
    own = F.pow(F.lit(GAMMA), F.col("l"))
    blend = (1 - own) * F.col("shown") + own * F.coalesce("content", F.lit(1.0))
    return each.join(below, ["host", "path"], "left").select("host", "path", F.col("m").cast("long").alias("pages"), ((F.col("m") * blend + PRIOR) / (F.col("m") + PRIOR)).alias("importance"))


def chosen(found: list[tuple[str, str, int]], importance: dict[str, float]) -> list[str]:
    """Texts of the blocks that stay: those of no branch that goes; of all that were not given away, if none would stay."""
    article = any(kind == ARTICLE for _, _, kind in found)
    free, kept = [], []
    for path, text, kind in found:
        if kind:
            free.append(text)
            least = min((importance.get(p, 1.0) for p in branches(path)), default=1.0) if importance else 1.0
            if least * (INSIDE if kind == ARTICLE else OUTSIDE if article else 1.0) >= LOW:
                kept.append(text)
    return kept or free


def extracted(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The text is that of all blocks that neither tag or name give away nor the host's style tree finds unimportant
    (unless none would be left: then only the former go). A null or empty page has an empty text; null URLs share the
    empty host; repeated rows repeat, and count once in the tree. Low nodes are broadcast if they are few, and joined
    by host otherwise.
    """
    common.small_batches(pages.sparkSession)
    low = style_tree(nodes(pages, html, url)).where(F.col("importance") < LOW / OUTSIDE)
    # one row for each host: the nodes of its tree that may go
    low = common.written(low.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("low")), "site-low")
    size = low.agg(F.sum(F.length("host") + F.size("low") * 16 + F.length(F.concat_ws("", F.col("low.path"))) + 32)).first()[0] or 0
    low = F.broadcast(low) if size <= BROADCAST else low.hint("shuffle_merge")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            known: dict[str, dict] = {}
            out = []
            for name, page, nodes_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if name not in known:
                    known[name] = {x["path"]: x["importance"] for x in nodes_.as_py() or ()}
                out.append(" ".join(chosen(blocks(page or ""), known[name])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    met = rows.withColumn("host", host("url")).join(low, "host", "left").select("page_id", "url", "host", "html", "low")
    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
