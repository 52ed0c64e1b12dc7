"""Main text of pages by site style trees.

The DOMs of a host are merged by the path of tags and classes. For each node of the merged tree two entropies are
taken over the articles whose pages have it: of its presentation (the sequence of its children) and of its content (how
widely each of its texts is shared). A branch that looks alike and reads alike all over a site has a low importance and
is removed from each page, next to what HTML itself names as no part of the article: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments. Article elements that hold little of a page's text are cards of
other stories, and the text around them stays. Pages that hold the same article count once, so copies of an
article do not make it boilerplate. A host with few articles tells nothing by entropy, so there the names alone decide.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Names of HTML elements, by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes, and the elements that it does not look beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements and roles that are no part of an article.
ASIDE = frozenset("nav footer aside form menu dialog button select head search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of which the class names and ids consist that say the same, next to words that say nothing by themselves.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar "
    "widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments "
    "commentlist reply replies respond disqus pagination pager toolbar".split()
)
PLAIN_WORDS = frozenset(
    "site main page top bottom left right primary secondary global box bar list item items container wrapper wrap inner outer block area section slot unit zone panel form button buttons "
    "link links icon icons media post posts article articles story stories user users reader readers thread js is the and in of".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of an article that names alone do not take out of it: data, and lists unless they are made of links.
DATA, LISTS = frozenset("table caption thead tbody tfoot tr td th figure figcaption pre blockquote".split()), frozenset("ul ol dl".split())
#: Words of classes of the lines in an article's header that are no part of its text.
BYLINE_WORDS = frozenset("byline author authors meta date time published updated timestamp credit credits dateline tags tag category categories kicker share sharing social".split())
#: Article elements are the article where they hold this share of the text that is left of the page; fewer are cards of others.
ARTICLE_SHARE = 1 / 3
#: Never judged by entropy: the frame of a page and the plain blocks of its text.
FRAME = frozenset("html body main article p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*)>?|[!?][^>]*>?)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


@dataclass
class Node:
    """An element of a page: its place in the merged tree (a hash of the labels above and its own), its depth, whether
    entropy may remove it, and whether HTML names it as no part of the article.
    """

    parent: int
    tag: str
    path: int
    depth: int
    judged: bool
    aside: bool
    heading_only: bool
    article: int
    maybe: bool = False  # a list that its names alone mark: no part of the article if it is made of links
    byline: bool = False
    text: int = 0  # characters of its own blocks, and of links in them
    linked: int = 0
    children: list[str] = field(default_factory=list)


def _names(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Classes and id without digits, whether attributes mark no part of the article, whether names do, whether names mark a header, and a byline."""
    if not attributes.strip():
        return "", False, False, False, False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    label = entities.unescape(f"{found.get('class', '')} {found.get('id', '')}")
    tokens = [{w.lower() for w in _WORD.findall(x)} for x in label.split()]
    said = set().union(*tokens)
    named = any(x & ASIDE_WORDS and x <= ASIDE_WORDS | PLAIN_WORDS for x in tokens)
    framed = tag in {"html", "body", "main"}
    aside = not framed and found.get("role", "").lower() in ASIDE_ROLES
    style = found.get("style", "").replace(" ", "").lower()
    aside |= re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes) is not None or found.get("aria-hidden") == "true" or "display:none" in style
    return ".".join(sorted(set(re.sub(r"\d+", "", label).split()))), aside, named and not framed, "header" in said, bool(said & BYLINE_WORDS)


def read(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements of a page and its blocks (element, text). White space in a block is one blank; blocks are not empty.

    Tags left open are closed where HTML says so: a block closes an open paragraph, an item the item before it.
    """
    nodes = [Node(-1, "", 0, 0, False, False, False, -1)]
    held: dict[str, int] = {}  # open elements by tag
    stack, blocks, buffer = [0], [], []
    linked = 0  # characters of links in the buffer

    def flush(at: int) -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((at, text))
                nodes[at].text += len(text)
                nodes[at].linked += min(linked, len(text))
        linked = 0

    def close(depth: int) -> None:
        """Leave the elements from this depth of the stack on."""
        if any(nodes[i].tag in BLOCKS for i in stack[depth:]):
            flush(place())
        for i in stack[depth:]:
            held[nodes[i].tag] -= 1
        del stack[depth:]

    def place() -> int:
        """The element that a text belongs to: the nearest block, or what stands apart in it."""
        for i in reversed(stack):
            if nodes[i].tag in BLOCKS or nodes[i].aside != nodes[nodes[i].parent].aside or i == 0:
                return i
        return 0

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
            linked += (m.start() - at) * bool(held.get("a"))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            inline = tag not in BLOCKS
            for depth in range(len(stack) - 1 if held.get(tag) else 0, 0, -1):
                have = nodes[stack[depth]].tag
                if have == tag:
                    close(depth)
                    break
                if inline and have in BLOCKS:
                    break
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in BLOCKS:
            for depth in range(len(stack) - 1 if held.get("p") else 0, 0, -1):
                have = nodes[stack[depth]].tag
                if have == "p":
                    close(depth)
                    break
                if have in {"table", "td", "th", "caption", "button"}:
                    break
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                outer = None
                for depth in range(len(stack) - 1 if any(held.get(x) for x in ends) else 0, 0, -1):
                    have = nodes[stack[depth]].tag
                    if have in bounds:
                        break
                    if have in ends:
                        outer = depth
                if outer is not None:
                    close(outer)
            flush(place())
        if tag in VOID:
            continue
        names, aside, named, header, byline = _names(tag, m[3])
        up = nodes[stack[-1]]
        article = up.article
        maybe = named and article > 0 and tag in LISTS
        aside = aside or tag in ASIDE or up.aside or (named and not maybe and not (article > 0 and tag in DATA))
        heading_only = up.heading_only
        if (tag == "header" or header) and tag not in {"html", "body", "article", "main"}:
            if article < 0:
                aside = True
            else:
                heading_only = True
        if tag in {"article", "main"} and not aside:
            article = len(nodes)
        label = f"{tag}.{names}" if names else tag
        if aside and not up.aside and tag not in BLOCKS:
            flush(place())
        if not up.children or up.children[-1] != label:
            up.children.append(label)
        if not m[3].endswith("/"):
            judged = label not in FRAME and tag not in {"html", "body", "main", "article"}
            nodes.append(Node(stack[-1], tag, _below(up.path, label), up.depth + 1, judged, aside, heading_only, article, maybe, byline))
            stack.append(len(nodes) - 1)
            held[tag] = held.get(tag, 0) + 1
    flush(place())
    return nodes, blocks


@lru_cache(maxsize=1 << 16)
def _below(path: int, label: str) -> int:
    return _hash(f"{path}>{label}")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def features(pages: DataFrame) -> DataFrame:
    """host, path, parent, depth, judged, kind, feature, pages: how many articles of a host have pages with a node that has
    a presentation (kind 0) or a text (1).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, page in zip(batch["url"], batch["html"], strict=True):
                nodes, blocks = read(page or "")
                article = _hash(_article(nodes, blocks, frozenset()))
                own = {(n.path, nodes[n.parent].path, n.depth, n.judged, 0, _hash(" ".join(n.children))) for n in nodes[1:]}
                own |= {(nodes[i].path, nodes[nodes[i].parent].path, nodes[i].depth, nodes[i].judged, 1, _hash(text)) for i, text in blocks if i}
                host = host_of(url)
                out += [(host, *x, article) for x in own]
            kinds = {"path": "int64", "parent": "int64", "depth": "int32", "judged": "bool", "kind": "int8", "feature": "int64", "article": "int64"}
            yield pd.DataFrame(out, columns=["host", *kinds]).astype(kinds)

    rows = pages.select("url", "html").mapInPandas(run, "host string, path long, parent long, depth int, judged boolean, kind byte, feature long, article long")
    keys = ["host", "path", "parent", "depth", "judged", "kind", "feature"]
    return rows.dropDuplicates([*keys, "article"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))


def importance(counted: DataFrame, least_pages: int = 8, decay: float = 0.9) -> DataFrame:
    """host, path, judged, pages, importance of the nodes that pages of least_pages articles of a host have.

    Presentation: entropy of the children sequences over articles, to base m, the number of articles. Content: 1 less the
    mean, over its texts, of the entropy of the articles that share a text. A branch mixes its own presentation with the
    mean importance of its texts and children, weighted by articles. Branches without text are left out.
    """
    n = F.col("pages").cast("double")
    nodes = (
        counted.groupBy("host", "path", "parent", "depth", "judged")
        .agg(
            F.sum(F.when(F.col("kind") == 0, n)).alias("m"),
            F.sum(F.when(F.col("kind") == 0, n * F.log(n))).alias("nlogn"),
            F.sum(F.when(F.col("kind") == 1, n)).alias("texts"),
            F.sum(F.when(F.col("kind") == 1, n * F.log(n))).alias("shared"),
        )
        .where(F.col("m") >= least_pages)
    )

    def tree(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["depth", "path"], ascending=[False, True])
        children: dict[int, list[tuple[float, float]]] = {}
        out = []
        for host, path, parent, judged, m, nlogn, texts, shared in frame[["host", "path", "parent", "judged", "m", "nlogn", "texts", "shared"]].itertuples(index=False):
            base = np.log(m)
            look = min(max((base - nlogn / m) / base, 0.0), 1.0)
            below = children.pop(path, [])
            if texts and texts > 0:
                below.append((texts, max(1 - shared / texts / base, 0.0)))
            if not below:  # no text in the branch, so nothing to judge
                continue
            inner = sum(w * x for w, x in below) / sum(w for w, _ in below)
            value = (1 - decay) * look + decay * inner
            out.append((host, path, judged, int(m), value))
            children.setdefault(parent, []).append((m, value))
        return pd.DataFrame(out, columns=["host", "path", "judged", "pages", "importance"])

    # rows of a host here are the nodes of its template, not its pages
    return nodes.groupBy("host").applyInPandas(tree, "host string, path long, judged boolean, pages long, importance double")


def main_text(page: str | None, low: frozenset[int] | set[int]) -> str:
    """Blocks of the article in page order, joined by two line ends.

    The article is all article elements where these hold a third of the text or more, else the main element, else the body; of
    it go the branches that are named as no part of it and those whose paths are in low, unless a kept heading of the
    first level is inside. Names alone take no tables, figures or quotations out of an article, and lists only if half of
    them is links. Of an article's header, headings stay, and paragraphs whose classes name no byline.
    """
    return _article(*read(page or ""), low)


def _article(nodes: list[Node], blocks: list[tuple[int, str]], low: frozenset[int] | set[int]) -> str:
    titled = set()
    for i, _ in blocks:
        if nodes[i].tag == "h1" and not nodes[i].aside:
            while i > 0 and i not in titled:
                titled.add(i)
                i = nodes[i].parent
    lost, inside = [False] * len(nodes), [False] * len(nodes)
    text, linked = [n.text for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        text[nodes[i].parent] += text[i]
        linked[nodes[i].parent] += linked[i]
    for i, node in enumerate(nodes[1:], 1):
        lost[i] = lost[node.parent] or node.aside or (node.path in low and i not in titled) or (node.maybe and 2 * linked[i] >= text[i])
        inside[i] = inside[node.parent] or node.tag == "article"

    def told(i: int) -> bool:
        return not nodes[i].heading_only or nodes[i].tag in HEADINGS or (nodes[i].tag == "p" and not nodes[i].byline)

    kept = [(i, t) for i, t in blocks if not lost[i] and told(i)]
    whole = sum(len(t) for _, t in kept)
    for within in (lambda i: inside[i], lambda i: nodes[i].article > 0 and not inside[i]):
        own = [(i, t) for i, t in kept if within(i)]
        if own and sum(len(t) for _, t in own) >= ARTICLE_SHARE * whole:
            kept = own
            break
    return "\n\n".join(t for _, t in kept)


#: Paths to remove, of all hosts, up to which they are broadcast; beyond, pages join them by host and one of SALTS numbers.
FEW_PATHS, SALTS = 200_000, 32


def extract(pages: DataFrame, threshold: float = 0.2, least_pages: int = 8) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages; text is "" where nothing is left.

    Null html is the empty page. Pages without a host, or with a null url, form one host. Rows that repeat come back as
    often. Other columns are not read; an empty table gives no rows. Elements may be nested to any depth. Hosts whose pages
    hold fewer than least_pages different articles are judged by names alone.
    """
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    nodes = materialise(importance(features(base), least_pages), "style-tree").where(F.col("judged") & (F.col("importance") < threshold))
    low = nodes.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_set("path")).alias("low"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    paged = base.withColumn("_host", host)
    if nodes.count() <= FEW_PATHS:
        joined = paged.join(F.broadcast(low), "_host", "left")
    else:  # a host may have any number of pages, so its pages are dealt over salts
        salted = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = paged.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")
    joined = joined.select("page_id", "url", "html", "low")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[tuple, frozenset] = {}
            texts = []
            for page, paths in zip(batch["html"], batch["low"], strict=True):
                key = () if paths is None else tuple(paths)
                texts.append(main_text(page, known.setdefault(key, frozenset(key))))
            yield batch[["page_id", "url"]].assign(page_id=batch["page_id"].astype("Int64"), text=texts, n_chars=[len(t) for t in texts])

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
