"""Main text of web pages: lines shared with the nearest URLs of the host go, the rest stays."""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import lookup
from .common import as_texts, stored

TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)"
                 r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)",
                 re.S)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe object title textarea canvas".split())
BOILERPLATE = frozenset("head nav footer aside form button select dialog menu header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody tfoot thead tr ul".split())
#: Elements whose end may be left out, or that only mark words.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option b i u em strong a small font code html body".split())
#: The open elements that the start of another ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tr": {"tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
        "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
NO_PARAGRAPH = BLOCKS - frozenset("li dt dd tr thead tbody tfoot caption option legend figcaption summary body".split())
#: Elements whose class or id may name furniture: never headings, the article and main part, or words in a line.
NAMED = frozenset("div section ul ol dl li dt dd table tr td p figure fieldset center span aside".split())
#: Whole names of classes and ids; a number behind them does not count.
FURNITURE = frozenset(
    "nav navbar navigation menu masthead site-header page-header footer site-footer page-footer sidebar side-bar ad ads "
    "advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies cookie-banner "
    "cookie-notice cookie-bar consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "search search-box search-form share sharing share-buttons social social-links social-media related related-posts "
    "related-articles recommended recommendations comment comments comment-list replies disqus disqus-thread breadcrumb "
    "breadcrumbs pagination pager widget toolbar copyright disclaimer skip-link".split())
#: Last or first parts of names, as in top-menu and ad-slot.
LAST_PART = frozenset("nav navbar navigation menu sidebar footer breadcrumb breadcrumbs pagination comments".split())
FIRST_PART = frozenset("ad ads advert cookie newsletter".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())

#: What the containers say about a line.
OPEN, MAIN, ARTICLE, AWAY = 0, 1, 2, 3
#: A shared line inside an article is furniture if, with 95 % certainty, at least this part of the pages on
#: its host share it (lower end of Wilson's interval, which few pages do not reach).
FURNITURE_SHARE, CERTAINTY = 0.5, 1.959964


def names_furniture(names: str) -> bool:
    """Whether one of the names in a class or id attribute is one of furniture, as a whole."""
    for name in names.split():
        name = re.sub(r"-?\d+$", "", name.replace("_", "-"))
        parts = name.split("-")
        if name in FURNITURE or len(parts) > 1 and (parts[-1] in LAST_PART or parts[0] in FIRST_PART):
            return True
    return False


def container_state(name: str, attributes: str, outer: int) -> int:
    """State inside an element that starts where the state is ``outer``."""
    if outer == AWAY:
        return AWAY
    if name in BOILERPLATE and not (name == "header" and outer == ARTICLE):
        return AWAY
    state = ARTICLE if name == "article" else max(outer, MAIN) if name == "main" else outer
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"' ").lower()
            if key in ("class", "id") and name in NAMED and not (key == "id" and name == "p") and names_furniture(value):
                return AWAY
            if key == "role":
                if value in ROLES:
                    return AWAY
                state = max(state, {"main": MAIN, "article": ARTICLE}.get(value, state))
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return AWAY
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return AWAY
    return state


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """The text lines (one per block, white space as one blank) and the state of each."""
    lines, states, words = [], [], []
    stack: list[tuple[str, int]] = []
    state, at = OPEN, 0

    def leave(k: int):
        """Ends the open element number k and all inside it."""
        nonlocal state
        if state != stack[k][1] or any(name in BLOCKS for name, _ in stack[k:]):
            close_line()
        state = stack[k][1]
        del stack[k:]

    def close_line():
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            lines.append(text)
            states.append(state)

    while True:
        tag = TAG.search(page, at)
        words.append(page[at:tag.start()] if tag else page[at:])
        if not tag:
            close_line()
            return lines, states
        at, name = tag.end(), (tag.group(2) or "").lower()
        if not name:
            continue
        closing = tag.group(1) == "/"
        if name in BLOCKS:
            close_line()
        elif name in ("br", "td", "th"):
            words.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
            continue
        ended = ENDS.get(name, ())
        lowest = None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] not in LOOSE:
                break
            if stack[k][0] in ended or stack[k][0] == "p" and name in NO_PARAGRAPH:
                lowest = k
        if lowest is not None:
            leave(lowest)
        attributes = tag.group(3)
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?:[\s/>]|$)", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        inner = container_state(name, attributes, state)
        if name not in LOOSE or inner != state:
            if inner != state:
                close_line()
            stack.append((name, state))
            state = inner


def settled(states: list[int]) -> np.ndarray:
    """Per line: what its container says beside the comparison with other pages.

    1: inside the article (or else the main part), kept unless the whole host has it; -1: in a menu, footer
    and the like, gone even if no other page has it; 0: gone if a neighbour has it.
    """
    s = np.array(states, np.int8)
    out = np.where(s == AWAY, -1, 0).astype(np.int8)
    for inside in (ARTICLE, MAIN):
        if (s == inside).any():
            out[s == inside] = 1
            break
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of the two lists.

    The table of lengths is worked out a row of bits at a time: bit j of a row is 0 where the length rises at
    j. Of n lines the work is n rows of n bits. Only every so many rows are kept; the rows between two of
    them are worked out again on the way back, so a page of 40,000 lines needs some MB.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    rows, columns = a[head:len(a) - tail], b[head:len(b) - tail]
    size = len(columns)
    full = (1 << size) - 1
    places: dict[int, int] = {}
    for j, line in enumerate(columns):
        places[line] = places.get(line, 0) | 1 << j

    def below(bits: int, line: int) -> int:
        match = bits & places.get(line, 0)
        return ((bits + match) | (bits - match)) & full

    step = max(1, math.isqrt(len(rows)))
    bits, kept = full, []
    for i, line in enumerate(rows):
        if i % step == 0:
            kept.append(bits)
        bits = below(bits, line)
    middle: list[int] = []
    column = size
    for block in range(len(kept) - 1, -1, -1):
        # table[r] is the row above line ``first + r``.
        first = block * step
        table = [kept[block]]
        for line in rows[first:first + step]:
            table.append(below(table[-1], line))
        row = len(table) - 1
        while row and column:
            if table[row] >> (column - 1) & 1:
                column -= 1
            else:
                row -= 1
                if table[row] >> (column - 1) & 1:
                    column -= 1
                    middle.append(head + first + row)
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def line_column(page: Column) -> Column:
    @F.arrow_udf("hashes array<long>, verdicts array<tinyint>")
    def line_hashes(pages: pa.Array) -> pa.Array:
        import xxhash

        hashes, verdicts = [], []
        for page in as_texts(pages):
            lines, states = page_lines(page)
            hashes.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in lines])
            verdicts.append(settled(states).tolist())
        return pa.StructArray.from_arrays(
            [pa.array(hashes, pa.list_(pa.int64())), pa.array(verdicts, pa.list_(pa.int8()))],
            ["hashes", "verdicts"])
    return line_hashes(page)


def shared_column(own: Column, before: Column, after: Column) -> Column:
    """Numbers of the lines that the page has in common with either neighbour."""
    @F.arrow_udf("array<int>")
    def shared(own: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        out = []
        for mine, *others in zip(own.to_pylist(), before.to_pylist(), after.to_pylist()):
            found: set[int] = set()
            for other in others:
                if other is not None:
                    found.update(common_lines(mine, other))
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.int32()))
    return shared(own, before, after)


def furniture_inside(lines: list[int], verdict: list[int], found: list[int], common: frozenset) -> list[int]:
    """Those of the shared lines inside the article that are furniture of the host.

    Where they would be half of the article or more, the host has versions of one article rather than furniture.
    """
    inside = [k for k in found if verdict[k] == 1 and lines[k] in common]
    return inside if 2 * len(inside) < sum(v == 1 for v in verdict) else []


def gone_column(hashes: Column, verdicts: Column, shared: Column, furniture: Column) -> Column:
    """Numbers of the shared lines that go: the open ones, and those inside that are furniture of the host."""
    @F.arrow_udf("array<int>")
    def gone(hashes: pa.Array, verdicts: pa.Array, shared: pa.Array, furniture: pa.Array) -> pa.Array:
        out = []
        for lines, verdict, found, common in zip(hashes.to_pylist(), verdicts.to_pylist(), shared.to_pylist(),
                                                 furniture.to_pylist()):
            found = found or []
            inside = furniture_inside(lines, verdict, found, frozenset(common or ()))
            out.append(sorted([k for k in found if verdict[k] == 0] + inside))
        return pa.array(out, pa.list_(pa.int32()))
    return gone(hashes, verdicts, shared, furniture)


def text_column(page: Column, gone: Column) -> Column:
    @F.arrow_udf("string")
    def texts(pages: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for page, numbers in zip(as_texts(pages), gone.to_pylist()):
            lines, states = page_lines(page)
            verdict = settled(states)
            if numbers:
                verdict[numbers] = -1
            out.append("\n".join(t for t, v in zip(lines, verdict) if v >= 0))
        return pa.array(out, pa.string())
    return texts(page, gone)


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (lower case) and path without query, fragment, last slash or file ending."""
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    path = F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1)
    return host, F.regexp_replace(path, r"(\.[A-Za-z]{1,5})?/?$", "")


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``place``: 0, 1, 2 ... in the order of host, path and list, without a global window."""
    sorted_rows = stored(
        rows.repartitionByRange("host", "path", "list")
        .sortWithinPartitions("host", "path", "list")
        .withColumn("at", F.monotonically_increasing_id()), "by-url")
    part = F.shiftright("at", 33)
    # One row per partition of the sort: the number of tasks, not of pages.
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    if not before:
        return sorted_rows.withColumn("place", F.col("at"))
    first = rows.sparkSession.createDataFrame(before, "part long, before long")
    return (sorted_rows.withColumn("part", part).join(F.broadcast(first), "part")
            .withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before"))


def certain_share(n: Column, pages: Column) -> Column:
    """Lower end of Wilson's interval for the share of pages that have a line, n of ``pages`` seen."""
    share, z2 = n / pages, CERTAINTY ** 2
    return (share + z2 / (2 * pages) - CERTAINTY * F.sqrt(share * (1 - share) / pages + z2 / (4 * pages * pages))) / (1 + z2 / pages)


def _furniture(found: DataFrame, placed: DataFrame) -> DataFrame:
    """For each host the hashes of the shared lines that most of its pages have, as ``furniture``."""
    pages = placed.groupBy("host").agg(F.count("*").alias("pages"))
    counted = (found.select("host", F.explode(F.expr("array_distinct(transform(shared, k -> hashes[k]))")).alias("line"))
               .groupBy("host", "line").agg(F.count("*").alias("n"))
               .where(F.col("n") >= 2))
    # Most pages of the host have each of these lines, so there are no more of them than in two pages.
    return (lookup(counted, pages, ["host"], spread="line")
            .where(certain_share(F.col("n"), F.col("pages")) >= FURNITURE_SHARE)
            .groupBy("host").agg(F.collect_list("line").alias("furniture")))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (lines joined by a line feed).

    Pages are sorted by host and path; each is compared with the pages before and after it on its
    host. Text lines (one per block) are aligned by a longest common subsequence, and lines that a page
    shares with a neighbour are deleted. Containers then correct single lines: a shared line inside an
    article (or else a main part) stays, since articles may quote one another, unless most pages of
    the host certainly share it and such lines are less than half of the article; lines in menus, headers, footers, sidebars,
    notices, adverts, forms and reader comments go, since the page next door may lack them. Other lines
    that no neighbour has stay. Pages of a host with the same lines, which say nothing about what is
    furniture, are one page at the smallest of their paths, and what is found there holds for all of them.

    A null or empty page has the text "". Null urls form one host. Rows with the same id, url and
    html get the same text. Other columns are neither read nor returned; an empty table gives an
    empty table. A very long page is aligned as a whole, in memory for its own lines. Equal paths on a host
    are ordered by a hash of their lines. A hot host is spread over the tasks of the sort; the comparison
    is an equi-join.
    """
    host, path = url_parts(url_col)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k1"),
           F.xxhash64(F.col(url_col)).alias("k2"), F.xxhash64(F.col(html_col)).alias("k3")]
    # ``list`` names the list of lines; two hashes of it are compared wherever lists meet.
    lines = [F.xxhash64("l.hashes").alias("list"), F.xxhash64(F.lit(1), "l.hashes").alias("list2")]
    parsed = stored(pages.select(*key, host.alias("host"), path.alias("path"),
                                 line_column(F.col(html_col)).alias("l"))
                    .select("k1", "k2", "k3", "host", "path", *lines, "l.*"), "parsed")
    lists = parsed.groupBy("host", "list", "list2").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"))
    placed = stored(_numbered(lists), "placed")
    side = placed.select("place", F.col("host").alias("host2"), F.col("hashes").alias("other"))
    near = placed
    for name, step in (("before", -1), ("after", 1)):
        moved = side.withColumn("place", F.col("place") - step)
        near = (near.join(moved, "place", "left")
                .withColumn(name, F.when(F.col("host") == F.col("host2"), F.col("other")))
                .drop("host2", "other"))
    found = stored(near.select("host", "list", "list2", "hashes",
                               shared_column(F.col("hashes"), F.col("before"), F.col("after")).alias("shared"))
                   .where(F.size("shared") > 0), "shared")
    found = lookup(found, _furniture(found, placed), ["host"], spread="list").drop("hashes")
    # Stored, so that the plan of the last join knows its bytes: often it is small and no page moves.
    gone = stored(lookup(parsed.drop("path"), found, ["host", "list", "list2"], spread="k1")
                  .where("shared is not null")
                  .select("k1", "k2", "k3", gone_column(F.col("hashes"), F.col("verdicts"), F.col("shared"),
                                                        F.col("furniture")).alias("gone"))
                  .where(F.size("gone") > 0).dropDuplicates(["k1", "k2", "k3"]), "gone")
    rows = pages.select(F.col(id_col).alias("own_id"), F.col(url_col).alias("own_url"),
                        F.col(html_col).alias("own_html"), *key)
    return (rows.join(gone, ["k1", "k2", "k3"], "left")
            .select(F.col("own_id").alias(id_col), F.col("own_url").alias(url_col),
                    text_column(F.col("own_html"), F.col("gone")).alias("text")))
