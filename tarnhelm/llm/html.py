"""Main text of web pages by nearest-URL page differencing.

A page is read into text blocks in page order. Elements that never hold the main text (menus,
site headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) are left
out by their tag, role or class. Every page is compared with its nearest page: within the host,
pages are sorted by path and each is paired with the neighbour whose path shares more with its own
(no other path of the host shares more); all blocks of both are aligned by longest common
subsequence, and shared ones are deleted. Sorted paths are cut into ranges, and each range is
handed the rows next to its ends, so the pairing does not depend on size.

If a page marks its article, the article's blocks are the text, and those that its markup vouches
for stay even if they are shared: copies and repeated passages under neighbouring paths are main
text. Differencing decides the others: blocks in elements whose class or id names another part of
the page beside a state or layout (``comments-open``, ``with-sidebar``), and all blocks of a page
that marks no article.

Null or empty html gives an empty text. A null url belongs to no host. Pages of equal host and
path are variants of one page and never each other's neighbour; a page without a neighbour keeps
all its blocks. Repeated rows get equal answers. An empty table gives no rows. Whole pages are
read. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.llm.common import keep, table

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s\"'=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in (
    "script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset(
    "nav footer aside form menu dialog head button fieldset label object audio video canvas".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar "
    "toolbar status alertdialog".split())
#: Words in a class or id that name other parts of a page than its text.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner sidebar comment comments commentlist reply replies respond disqus cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended breadcrumb breadcrumbs menu nav navbar "
    "navigation footer masthead toolbar pagination pager widget search paywall skip teaser "
    "topbar sitenav".split())
HEADS = frozenset("header masthead topbar".split())
#: Words beside them by which a class tells a state or a layout, and may stand on main text.
STATES = frozenset(
    "with without has have no not is open opened closed enabled disabled allowed on off free "
    "layout page template single left right".split())
SPACES = re.compile(r"\s+")
LINK = re.compile(r"(?:[a-zA-Z][\w+.\-]*:)?//([^/?#]*)([^?#]*)")


def left_out(name: str, attrs: str, inside: bool) -> int:
    """2 for an element that holds another part of the page than its text, 1 if it may, 0 if not."""
    if name in SKIP or (name == "header" and not inside):
        return 2
    if not attrs or name in ("body", "html", "main"):
        return 0
    unsure = 0
    for key, *values in ATTR.findall(attrs):
        key = key.lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = max(values, key=len).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return 2
        if key == "role" and value in ROLES:
            return 2
        if key in ("class", "id"):
            for token in value.split():
                words = set(re.split(r"[^a-z0-9]+", token))
                if words & PARTS or (not inside and words & HEADS):
                    if not words & STATES:
                        return 2
                    unsure = 1
    return unsure


def marks_text(name: str, attrs: str) -> int:
    """2 for an article, 1 for a main element, 0 for others."""
    if name == "article":
        return 2
    if attrs and re.search(r"itemprop\s*=\s*[\"']?articleBody", attrs, re.I):
        return 2
    return int(name == "main" or bool(attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I)))


def all_blocks(page: str) -> list[tuple[int, bool, str]]:
    """Text blocks in page order, each after how it is marked and whether that is unsure."""
    found: list[tuple[int, bool, str]] = []
    line: list[str] = []
    # Open elements that are marked or unsure, and those of the same tags inside them: tag, best
    # level so far, whether unsure, depth of the tag.
    marked: list[tuple[str, int, bool, int]] = []
    skip, depth = "", 0
    within: dict[str, int] = {}  # open elements in the one that is left out
    at, n = 0, len(page)

    def close() -> None:
        if line:
            text = SPACES.sub(" ", "".join(line)).strip()
            line.clear()
            if text:
                found.append((*(marked[-1][1:3] if marked else (0, False)), text))

    def say(text: str) -> None:
        if text and not skip:
            line.append(entities.unescape(text) if "&" in text else text)

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m["cdata"]:
            say(m["cdata"])
        if m["name"] is None:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if m["end"]:
            if skip:
                if name == skip:
                    depth -= 1
                elif within.get(name):
                    within[name] -= 1
                elif any(name == x[0] and x[3] == 1 for x in marked) or name in ("body", "html"):
                    depth = 0  # the enclosing element ends
                if depth:
                    continue
                skip = ""
            if name in BLOCK:
                close()
            for i in range(len(marked) - 1, -1, -1):
                if marked[i][0] == name:
                    *state, open_ = marked[i]
                    marked[i:] = [(*state, open_ - 1)] if open_ > 1 else []
                    break
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else n
            continue
        if skip:
            if skip == "head" and name == "body":
                skip = ""
            elif skip in ("p", "li") and name in BLOCK and (skip == "p" or name == "li"):
                skip = ""  # its end tag was left out
            else:
                depth += name == skip
                within[name] = within.get(name, 0) + 1
                continue
        if name in BLOCK:
            close()
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        if marked and marked[-1][0] == "p" and name in BLOCK:
            marked.pop()  # its end tag was left out
        best, unsure = marked[-1][1:3] if marked else (0, False)
        out = left_out(name, attrs, best > 0)
        if out == 2:
            skip, depth, within = name, 1, {}
            continue
        level = marks_text(name, attrs)
        if level or out:
            marked.append((name, max(best, level), not level, 1))
        elif marked and marked[-1][0] == name:
            *state, open_ = marked[-1]
            marked[-1] = (*state, open_ + 1)
        elif any(name == x[0] for x in marked):
            marked.append((name, best, unsure, 1))
    close()
    return found


def main_blocks(found: list[tuple[int, bool, str]]) -> tuple[list[str], bool]:
    """The blocks that are marked best, and whether they are marked at all."""
    best = max((k for k, *_ in found), default=0)
    return [t for k, _, t in found if k == best], best > 0


def blocks_of(page: str) -> tuple[list[str], bool]:
    """Text blocks in page order, and whether the page marks its article (then only its own)."""
    return main_blocks(all_blocks(page))


#: What is known of a block before it is differenced.
OTHER, ASKED, SURE = range(3)


def kinds_of(found: list[tuple[int, bool, str]]) -> bytes:
    """For each block: not of the text, of the text if no other page has it, or of the text."""
    best = max((k for k, *_ in found), default=0)
    return bytes(
        OTHER if k < best else SURE if best and not unsure else ASKED for k, unsure, _ in found)


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a url, without its query, fragment and ending."""
    m = LINK.match(url or "")
    if m is None:
        return "", ""
    return m[1].lower(), re.sub(r"(/index)?(\.html?)?/?$", "", m[2])


def line_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions of ``own`` in a longest common subsequence with ``other``.

    Rows of the table are integers with a bit per line of ``other``; a cleared bit marks a step.
    """
    places: dict[int, int] = {}
    for j, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row, rows = full, []
    for x in own:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, out = len(own), len(other), set()
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        out.add(i)
        j -= 1
    return out


def read_pages(pages: DataFrame, texts: bool) -> DataFrame:
    """(host, path, hashes) of (page_id, url, html), the hashes of all blocks of the page.

    With ``texts`` also page_id, url, the kinds of the blocks and the lines of those that are not
    OTHER.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, kinds, lines, hashes = [], [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = all_blocks(page.as_py() or "")
                where.append(address(url))
                hashes.append([line_hash(x) for *_, x in found])
                if texts:
                    kinds.append(kinds_of(found))
                    lines.append([x for k, (*_, x) in zip(kinds[-1], found, strict=True) if k])
            columns = [*[pa.array([w[i] for w in where], pa.string()) for i in range(2)],
                       pa.array(hashes, pa.list_(pa.int64()))]
            names = ["host", "path", "hashes"]
            columns += [batch.column(0)]
            names += ["page_id"]
            if texts:
                columns += [batch.column(1), pa.array(kinds, pa.binary()),
                            pa.array(lines, pa.list_(pa.string()))]
                names += ["url", "kinds", "lines"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", url string, kinds binary, lines array<string>" if texts else ""
    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(
        run, "host string, path string, hashes array<bigint>, page_id bigint" + more)


def nearest(read: DataFrame) -> DataFrame:
    """(host, path, peer_path, peer): each page's nearest page by path and its line hashes."""
    paths = read.where("host <> ''").groupBy("host", "path").agg(
        F.min_by("hashes", F.struct("page_id", "hashes")).alias("hashes"))
    paths = keep(paths.repartitionByRange("host", "path").withColumn("_range", F.spark_partition_id()))
    row = F.struct("host", "path", "hashes")
    ends = keep(paths.groupBy("_range").agg(F.min(row).alias("first"), F.max(row).alias("last")))
    by = W.orderBy("_range")  # a row for each range
    handed = ends.select(
        "_range", F.array(F.lag("last").over(by), F.lead("first").over(by)).alias("e"),
    ).select("_range", F.explode("e").alias("e")).where("e IS NOT NULL")
    rows = paths.withColumn("_own", F.lit(True)).unionByName(
        handed.select("e.*", "_range", F.lit(False).alias("_own")))
    w = W.partitionBy("_range").orderBy("host", "path")

    def beside(x):
        return F.when(x["host"] == F.col("host"), x)

    rows = rows.withColumns({"_before": F.lag(row).over(w), "_after": F.lead(row).over(w)}).where(
        "_own").withColumns({"_before": beside(F.col("_before")), "_after": beside(F.col("_after"))})

    def alike(x):
        """How many leading characters two paths share."""
        a, b = F.split(F.col("path"), ""), F.split(x["path"], "")
        same = F.zip_with(a, b, lambda p, q: p.eqNullSafe(q))
        return F.coalesce(F.array_position(same, False), F.lit(0))

    before, after = F.col("_before"), F.col("_after")
    peer = F.when(before.isNull() | (alike(after) > alike(before)), after).otherwise(before)
    return rows.withColumn("_peer", peer).where("_peer IS NOT NULL").select(
        "host", "path", F.col("_peer.path").alias("peer_path"), F.col("_peer.hashes").alias("peer"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, peer_path, n_shared) of (page_id, url, html).

    ``n_shared`` counts the blocks, of the text or not, that the nearest page has too. Pages are
    read twice, since their hashes alone are a small part of what their texts would take to store.
    """
    peers = nearest(read_pages(pages, texts=False))
    rows = read_pages(pages, texts=True).join(peers, ["host", "path"], "left")

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for lines, kinds, hashes, peer in zip(
                *[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True
            ):
                gone = shared_lines(hashes, peer) if peer else set()
                own = [i for i, k in enumerate(kinds) if k]
                texts.append("\n".join(
                    x for i, x in zip(own, lines, strict=True) if kinds[i] == SURE or i not in gone))
                counts.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(6),
                 pa.array(np.array(counts, np.int32))],
                ["page_id", "url", "text", "peer_path", "n_shared"])

    return rows.select(
        "page_id", "url", "lines", "kinds", "hashes", "peer", "peer_path").mapInArrow(
        subtract, "page_id bigint, url string, text string, peer_path string, n_shared int").select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"),
        "peer_path", "n_shared")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
