"""Operator 8, main text of pages by site style trees.

The pages of a host are merged into one tree: a node is a path of elements with their classes and ids, written as a number
made of its parent's and its own name (so deep pages cost no more than their elements), and knows in how many pages it stands, which child sequences (presentation) and which own texts (content) it has there, and how often.
Importance of a node = (1 - 0.9**l) * presentation + 0.9**l * content, for l presentations, each term an entropy over
pages divided by its maximum: 1 where pages differ, 0 where they repeat. At nodes of low importance the own texts that
repeat are removed, each by its content; what other pages or the elements below hold stays.

Two things bound what entropy can say. Menus, adverts or footers may differ from page to page, so elements whose kind or
class names such a part have importance 0 from the start. A class or id names one only by a whole token of such words
(`sidebar`, `ad-slot`, but not `has-sidebar` or `ad-free`); where that would leave a page without any of its article and
main elements, names don't count on the elements around them. And a host may repeat one article, so a text inside the main
element is removed only if another node there is important, weighted by its share of the host's pages; a page of which
nothing would be left keeps all. For hosts with fewer than `MIN_PAGES` pages with a node only the first rule applies.

Distribution: (host, node, presentation, content) counts are added up per task before they are shuffled and spread over
all their keys; a hot host is never gathered. Only removed texts (node and content hash), as lists per host, are joined to the pages: by
broadcast up to `BROADCAST_NODES` of them, else by a join on the host that Spark can split.

Defined results: null and empty html give an empty text; so does a page that is all menu; broken and cut-off markup is
read as far as it goes; a null url is a host of its own; null ids are kept; repeated rows count as further pages; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, cut_lineage, read
from calibrium.llm.urls import host_and_path

DECAY, LOW, HIGH, MIN_PAGES = 0.9, 0.2, 0.5, 8
BROADCAST_NODES = 200_000
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements, roles and words of classes and ids that name parts beside the main text.
ASIDE_TAGS = frozenset("head nav aside footer form script style noscript template iframe button select textarea input object embed svg canvas dialog menu title".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription
    adsbygoogle sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead topbar comment comments commentlist reply replies respond disqus share sharing
    social related recommended recommendations toolbar login signup search pagination pager skip disclaimer""".split()
)
#: Parts of the main element's discussion, and lists of other articles: around an article they still name what is beside.
AROUND_OTHERS = frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations".split())
COMMENTS = frozenset("comment comments reply".split())
#: Words that stand beside such a word in one token without changing what it names.
COMPANIONS = frozenset(
    """area bar bars block blocks body bottom box boxes btn button buttons center col column container content desktop fixed form global group holder icon icons inner inline item items label
    left link links list lists main message messages mobile module outer page panel post posts primary right row rows secondary section sections site slot slots small sticky text title top
    unit units wrap wrapper wrappers zone reader readers user users visitor visitors thread threads law info""".split()
)
NAME, ROOT = 60, -1
_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(>|\Z)|[!?][^>]*(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_MAIN = re.compile(r"<(?:article|main)\b", re.I)
_MAIN_NAME = re.compile(r"(?:article|main)(?=[.#]|\Z)")


@lru_cache(50_000)
def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether a token of a class or id names a part beside the main text, one around other articles, a comment."""
    found = [False, False, False]
    for token in value.split():
        words = {w for w in _WORDS.findall(token) if len(w) > 1} - COMPANIONS
        for k, names in enumerate((ASIDE_NAMES, AROUND_OTHERS, COMMENTS)):
            found[k] |= bool(words) and words <= ASIDE_NAMES and not words.isdisjoint(names)
    return tuple(found)


def _signature(tag: str, attributes: str, around: bool = False) -> tuple[str, bool]:
    """The name of an element in the style tree, and whether it is a part beside the main text. around: it holds what would be main."""
    beside, name = tag in ASIDE_TAGS, tag
    if "=" in attributes:
        for key, *values in _NAMED.findall(attributes):
            value, key = "".join(values).lower(), key.lower()
            if key == "role":
                beside |= value.strip() in ASIDE_ROLES
            else:
                aside, others, comment = _named(value)
                beside |= tag not in ("html", "body", "article", "main") and (others if around else aside) or tag == "article" and comment
                shown = ("." if key == "class" else "#") + re.sub(r"\d+", "0", " ".join(value.split()))
                name += shown if len(shown) <= NAME else f"{shown[: NAME - 17]}~{xxhash.xxh3_64_hexdigest(shown)}"
    return name, beside


def walk(page: str | None) -> Iterator[tuple[str, int, bool, bool, object]]:
    """("open" | "text" | "block" | "blank", node, inside the main element, beside the main text, what) in page order.

    A node is a number made of its parent's number and its name, so it tells the whole path and costs the same at any
    depth; what is the text, or at "open" the parent's number and the name."""
    if not page:
        return
    around: frozenset = frozenset()
    if _MAIN.search(page):
        lost = False
        for kind, _, main, _, what in _walk(page):
            if kind == "open" and main:
                break
            lost |= kind == "open" and _MAIN_NAME.match(what[1]) is not None
        else:
            if lost:
                found: set[int] = set()
                for _ in _walk(page, None, found):
                    pass
                around = frozenset(found)
    yield from _walk(page, around)


def _walk(page: str, around: frozenset | None = frozenset(), found: set | None = None) -> Iterator[tuple[str, int, bool, bool, object]]:
    """walk, with the places of elements whose names don't count (None: of all); found gets the places around main elements."""
    stack = [("", ROOT, False, False, 0)]  # tag, node, main, beside, place
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            yield "text", stack[-1][1], stack[-1][2], stack[-1][3], text
        if not m:
            return
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag not in INLINE:
                yield "block", ROOT, False, False, ""
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if not m[5]:
            return  # cut off within a tag
        if tag == "br":
            yield "blank", ROOT, False, False, ""
            continue
        for closed in CLOSES.get(tag, ("p",) if tag in BLOCKS else ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == closed:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS and stack[k][0] != "p" or stack[k][0] in ("td", "th", "table", "body"):
                    break
        if tag not in INLINE:
            yield "block", ROOT, False, False, ""
        name, beside = _signature(tag, m[4], around is None or m.start() in around)
        _, parent, main, within, _ = stack[-1]
        if tag == "header" and main:
            beside = False  # the head of an article, with its title
        elif tag == "header":
            beside = True
        beside |= within
        if found is not None and tag in ("article", "main") and not main and not beside:
            found.update(x[4] for x in stack[1:])
        main = main or (tag in ("article", "main") and not beside)
        node = xxhash.xxh3_64_intdigest(f"{parent}/{name}") >> 1
        yield "open", node, main, beside, (parent, name)
        if tag in VOID or m[4].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else len(page)
            continue
        stack.append((tag, node, main, beside, m.start()))


def _own(texts: list[str]) -> int:
    """The content hash of a node's own texts in a page; -1 without any."""
    own = " ".join("".join(texts).split())
    return xxhash.xxh3_64_intdigest(own) >> 1 if own else -1


def main_text(page: str | None, removed: frozenset = frozenset()) -> str:
    """The text of the blocks of no beside branch: of the main elements, else of the whole page. removed: (node, content)
    of own texts that go; if nothing would be left, all stay."""
    gone: set[int] = set()
    if removed:
        texts: dict[int, list[str]] = {}
        nodes = {node for node, _ in removed}
        for kind, path, _, beside, what in walk(page):
            if kind == "text" and not beside and path in nodes:
                texts.setdefault(path, []).append(what)
        gone = {path for path, own in texts.items() if (path, _own(own)) in removed}
    text = _block_text(page, gone)
    return text if text or not gone else _block_text(page, set())


def _block_text(page: str | None, gone: set[int]) -> str:
    main_blocks: list[str] = []
    all_blocks: list[str] = []
    now: list[tuple[bool, str]] = []

    def close() -> None:
        for blocks, wanted in ((main_blocks, True), (all_blocks, False)):
            text = " ".join(entities.unescape("".join(t for m, t in now if m or not wanted)).split())
            if text:
                blocks.append(text)
        now.clear()

    has_main = False
    for kind, path, main, beside, what in walk(page):
        if kind == "text":
            if not beside and path not in gone:
                now.append((main, what))
        elif kind == "block":
            if now:
                close()
        elif kind == "blank":
            now.append((True, " "))
        else:
            has_main |= main
    if now:
        close()
    return " ".join(main_blocks if has_main else all_blocks)


def styles(page: str | None) -> dict[int, tuple[int, int, bool]]:
    """Per node that isn't beside the main text: hashes of its child sequences and own texts, and whether it is in main."""
    children: dict[int, list[str]] = {}
    texts: dict[int, list[str]] = {}
    inside: dict[int, bool] = {}
    for kind, path, main, beside, what in walk(page):
        if beside:
            continue
        if kind == "open":
            inside[path] = inside.get(path, False) or main
            children.setdefault(what[0], []).append(what[1])
        elif kind == "text" and path != ROOT:
            texts.setdefault(path, []).append(what)
    out = {}
    for path, main in inside.items():
        sequence = [x for k, x in enumerate(children.get(path, [])) if k == 0 or x != children[path][k - 1]]
        out[path] = (xxhash.xxh3_64_intdigest("\0".join(sequence)) >> 1, _own(texts.get(path, [])), main)
    return out


def importance(pages: DataFrame) -> DataFrame:
    """host, node, main, texts, n_pages, importance, and the contents (content, n) that repeat. pages: host, html."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows():
            keys = list(found)
            columns = list(zip(*keys)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([found[k] for k in keys], pa.int64())], names=["host", "node", "main", "style", "content", "n"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for node, (style, content, main) in styles(page).items():
                    found[(host, node, main, style, content)] += 1
            if len(found) > 50_000:
                yield rows()
                found.clear()
        yield rows()

    counted = pages.mapInArrow(count, "host string, node long, main boolean, style long, content long, n long")
    counted = counted.groupBy("host", "node", "style", "content").agg(F.sum("n").alias("n"), F.max("main").alias("main"))
    by_style = counted.groupBy("host", "node", "style").agg(F.sum("n").alias("n"))
    by_content = counted.groupBy("host", "node", "content").agg(F.sum("n").alias("n"), F.max("main").alias("main"))
    spread = lambda total, logs: F.when(total > 1, F.greatest(F.lit(0.0), (F.log(total) - logs / total) / F.log(total))).otherwise(1.0)
    logs = F.sum(F.col("n") * F.log("n")).alias("logs")
    presentation = by_style.groupBy("host", "node").agg(F.sum("n").alias("n_pages"), F.count("*").alias("l"), logs).select("host", "node", "n_pages", "l", spread(F.col("n_pages"), F.col("logs")).alias("presentation"))
    repeats = F.when((F.col("content") != -1) & (F.col("n") >= MIN_PAGES // 2), F.struct("content", "n"))
    content = by_content.groupBy("host", "node").agg(F.sum("n").alias("m"), F.max("main").alias("main"), F.max(F.when(F.col("content") != -1, 1).otherwise(0)).alias("texts"), F.collect_list(repeats).alias("repeats"), logs).select("host", "node", "main", "texts", "repeats", spread(F.col("m"), F.col("logs")).alias("content"))
    decay = F.pow(F.lit(DECAY), F.col("l"))
    both = (1 - decay) * F.col("presentation") + decay * F.col("content")
    return presentation.join(content, ["host", "node"]).select("host", "node", "main", "texts", "repeats", "n_pages", both.alias("importance"))


def removed_nodes(pages: DataFrame) -> DataFrame:
    """host, nodes (node, content): the own texts that are repeated over a host's pages.

    A content repeats if it stands on `MIN_PAGES` pages, or on half of them where that is less.
    """
    nodes = importance(pages).where("texts = 1")
    tops = nodes.where("main").groupBy("host").agg(F.max(F.when(F.col("n_pages") >= MIN_PAGES, F.col("importance") * F.col("n_pages"))).alias("weight"), F.max("n_pages").alias("most"))
    tops = tops.select("host", (F.col("weight") / F.col("most")).alias("top"))
    low = nodes.where((F.col("importance") < LOW) & (F.col("n_pages") >= MIN_PAGES)).join(tops, "host", "left")
    low = low.where(~F.col("main") | (F.col("top") >= HIGH))
    texts = low.select("host", "node", "n_pages", F.explode("repeats").alias("x")).where(F.col("x.n") >= F.least(F.lit(MIN_PAGES), F.col("n_pages") / 2))
    return texts.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("node", "x.content"))).alias("nodes"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)
    host, _ = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    removed = cut_lineage(removed_nodes(rows.select("host", "html")))
    size = removed.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(removed) if size <= BROADCAST_NODES else removed, "host", "left").select("page_id", "url", "html", "nodes")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, frozenset((x["node"], x["content"]) for x in nodes or ())) for page, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


def op8_site_style_tree(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))
