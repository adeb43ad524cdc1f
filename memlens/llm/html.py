"""Main text of web pages by nearest-URL page differencing, guided by the page's own structure.

Every page becomes text lines (blocks).  Pages of one host stand in path order, pages with equal lines as one; each is paired
with the neighbour whose path shares the longer prefix, their lines are aligned by longest common subsequence, and shared
lines are deleted: menus, headers and footers repeat from page to page, the article does not.

Differencing covers all lines outside a declared article.  Two things it cannot know come from the structure: lines in
elements that declare themselves to be furniture (nav, footer, aside, forms, advert and comment boxes, ...) go even when
they differ from page to page, and lines inside the page's article element stay even when a neighbour has them, for
pages often carry the same article.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens.llm.common import list_column
from memlens.session import cut

# Element names, and words in class, id or role that mark furniture.
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "title", "select", "object"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
BLOCKS = set("""address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "head"}
BOXES = r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|nav\w*|menu|breadcrumbs?|footer|toolbar|comments?|replies|respond|disqus|login|signup|pagination|pager|hidden"
MARKED = re.compile(rf"(?:^|[\s_-])(?:{BOXES}|banner|side|header|masthead|share|social|related|recommend\w*|widget|skip)(?:$|[\s_-])", re.I)
MARKED_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{BOXES})(?:$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)(?:[_-](?:body|content|text))?(?:$|\s)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
BLANKS = re.compile(r"\s+")
PLAIN, KEPT, DROPPED = 0, 1, 2


def _state(name: str, attributes: str, above: int) -> int:
    """What the lines inside an element are: PLAIN, KEPT (in the article) or DROPPED."""
    if above == DROPPED or name in FURNITURE:
        return DROPPED
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if name not in ("html", "body", "article", "main") and ((MARKED_INSIDE if above == KEPT else MARKED).search(names) or found.get("role", "").lower() in ROLES):
        return DROPPED
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return DROPPED
    if name == "header" and above != KEPT:
        return DROPPED
    if name == "article" or found.get("itemprop") == "articleBody" or name in ("div", "section") and ARTICLE.search(names):
        return KEPT
    return above


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, state) of every text block in page order.  Unclosed elements end with the block that encloses them."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    state = at = 0
    line_state = PLAIN

    def flush() -> None:
        if held:
            text = BLANKS.sub(" ", "".join(held)).strip()
            if text:
                out.append((text, line_state))
            held.clear()

    def say(text: str) -> None:
        nonlocal line_state
        if state == DROPPED and held and line_state != DROPPED or held and line_state == DROPPED and state != DROPPED:
            flush()
        line_state = state
        held.append(text)

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            say(entities.unescape(page[at:]))
            break
        if m.start() > at:
            say(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[0] == "<":
            say("<")
            continue
        if m[1] is not None:
            say(m[1])
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in BLOCKS:
            flush()
        if m[2]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                state = stack[-1][1] if stack else PLAIN
            continue
        if name in VOID or m[4].rstrip().endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page) if name in ("script", "style", "textarea", "title") else at
            continue
        if name in CLOSES_P:  # an open paragraph or list item ends here, with the inline elements in it
            ends = {"p"} | ({name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCKS:
                    break
            state = stack[-1][1] if stack else PLAIN
        state = _state(name, m[4], state)
        stack.append((name, state))
    flush()
    return out


def _line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def shared_lines(own: np.ndarray, other: np.ndarray) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    Common heads and tails first; the rest by matches in order, longest rising run of places (Hunt and Szymanski).
    """
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(len(other) - tail - 1, head - 1, -1):
        places.setdefault(int(other[j]), []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(head, len(own) - tail):
        for j in places.get(int(own[i]), ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    middle = []
    link = chains[-1] if chains else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(own) - tail, len(own))]


def kept_text(lines: list[tuple[str, int]], other: np.ndarray | None) -> str:
    """The lines that stay, joined."""
    open_places = [i for i, (_, s) in enumerate(lines) if s != KEPT]
    gone: set[int] = set()
    if other is not None and len(other) and open_places:
        own = np.array([_line_hash(lines[i][0]) for i in open_places], np.int64)
        gone = {open_places[k] for k in shared_lines(own, other)}
    return "\n".join(text for i, (text, s) in enumerate(lines) if s == KEPT or s == PLAIN and i not in gone)


def _lines(page: str | None, articles: bool) -> list[tuple[str, int]]:
    found = lines_of(page or "")
    return found if articles else [(t, PLAIN if s == KEPT else s) for t, s in found]


def _open_lines(articles: bool):
    """Hashes of each page's lines outside a declared article, and one of all its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [_lines(page, articles) for page in batch.column(2).to_pylist()]
            rows = [np.array([_line_hash(t) for t, s in lines if s != KEPT], np.int64) for lines in pages]
            whole = [_line_hash("\n".join(t for t, _ in lines)) for lines in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_column(rows, pa.int64()), pa.array(whole, pa.int64())], ["page", "url", "hashes", "lines"])

    return run


def _extract(articles: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, page in enumerate(batch.column(2).to_pylist()):
                other = batch.column(3)[i]
                texts.append(kept_text(_lines(page, articles), other.values.to_numpy() if other.is_valid else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page", "url", "text"])

    return run


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", "")


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(page, other): each page's neighbour in path order within its host, the one whose path shares the longer prefix.

    ``pages`` has page, host and path.  Rows are dealt by range, so a host with a third of all pages is spread over many
    tasks; neighbours inside a range come from a window, those across a border from the ranges' first and last rows.
    """
    dealt = cut(pages.repartitionByRange("host", "path", "page").withColumn("part", F.spark_partition_id()))
    order = W.partitionBy("part").orderBy("host", "path", "page")
    row = F.struct("host", "path", "page")
    near = dealt.select("part", row.alias("me"), F.lag(row).over(order).alias("before"), F.lead(row).over(order).alias("after"))
    borders = dealt.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    across = W.partitionBy(F.lit(0)).orderBy("part")  # two rows a partition
    borders = borders.select("part", F.lag("high").over(across).alias("prior"), F.lead("low").over(across).alias("next"))
    joined = near.join(borders, "part").select("me", F.coalesce("before", "prior").alias("before"), F.coalesce("after", "next").alias("after"))

    def shared(other: str) -> Column:  # length of the common path prefix, -1 on another host
        pairs = F.zip_with(F.split("me.path", ""), F.split(f"{other}.path", ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
        first = F.array_position(pairs, F.lit(False).cast("boolean"))
        length = F.when(first > 0, first - 1).otherwise(F.size(pairs))
        return F.when(F.col(f"{other}.host") == F.col("me.host"), length).otherwise(-1)

    best = F.when((shared("before") >= shared("after")) & (shared("before") >= 0), F.col("before.page")).when(shared("after") >= 0, F.col("after.page"))
    return joined.select(F.col("me.page").alias("page"), best.alias("other")).where("other IS NOT NULL")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", articles: bool = True) -> DataFrame:
    """(key, url, text) of every row; the module's text has the method.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
    page order by a line feed; empty blocks vanish.  Null or empty html gives an empty text.  A page alone on its host, or
    with a null id, is judged by its structure only; a null url is a host of its own.  Pages of a host with the same lines
    are one page while neighbours are sought, so copies are compared with a page that differs.  Rows with one id
    share a neighbour (that of the smallest url).  An empty table gives an empty result.  With ``articles=False`` article
    elements are not known and differencing decides their lines too.
    """
    source = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    open_lines = source.where("page IS NOT NULL").mapInArrow(_open_lines(articles), "page long, url string, hashes array<long>, lines long").where(F.size("hashes") > 0)
    unique = open_lines.groupBy("page").agg(F.min(F.struct(F.coalesce("url", F.lit("")).alias("url"), "lines", "hashes")).alias("p")).select("page", "p.*")
    unique = cut(unique.select("page", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), "lines", "hashes"))
    kinds = unique.groupBy("host", "lines").agg(F.min(F.struct("path", "page")).alias("first")).select("host", "lines", "first.path", "first.page")
    near = nearest_pages(kinds.select("page", "host", "path")).withColumnRenamed("page", "first")
    other = near.join(unique.select(F.col("page").alias("other"), "hashes"), "other").select("first", "hashes")
    hashes = (unique.select("page", "host", "lines").join(kinds.select("host", "lines", F.col("page").alias("first")), ["host", "lines"])
              .join(other, "first").select("page", "hashes"))
    joined = source.join(hashes, "page", "left").select("page", "url", "html", "hashes")
    return joined.mapInArrow(_extract(articles), "page long, url string, text string").withColumnRenamed("page", key).withColumnRenamed("url", url)
