"""Main text of web pages: nearest-URL page differencing, and the page's own marks.

A page is read into blocks.  Pages of a host are ordered by URL path (over all its folders); the blocks of every page are
aligned with those of the page before and after it by a longest common subsequence, and shared blocks are deleted, unless a
neighbour shares over nine tenths of the page's text, which makes it a copy rather than a template.  What differencing can't know from
two neighbours (a menu or advert that no other page repeats) goes by the page's own marks: menus, headers, footers,
sidebars, forms, scripts, adverts, notices, reader comments and hidden parts.

Where a page marks its article, blocks inside are kept though neighbours share them: they are quoted passages or copies of an
article.  If it marks both a main part and articles in it, the one with more text that no neighbour shares is the article
(so a teaser in a card doesn't stand for the page).  Inside an article a class name leaves an element out only as a whole
(``comments``, ``ad-box``), not by one of its words (``related-work``, ``menu-items``).

A host of many pages is split by ranges of the ordered path, and the pages on both sides of a border are given to each other,
so every page has its true neighbours whatever the size of host or table.  A range begins at pages whose hash says so, one in
``max(RANGE_ROWS, pages / RANGES)``, so there are about ``RANGES`` borders at most, and only their addresses are collected.

Defined cases: null html is empty and gives an empty text; pages with null urls are one host; equal URLs are ordered by
page_id and blocks; repeated rows are extracted each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, at least, and ranges that hosts are split into, about, at most.
RANGE_ROWS, RANGES = 16, 10_000
#: A neighbour that shares more than this part of a page's characters is a copy.
COPY_SHARE = 0.9

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
_attribute = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_split = re.compile(r"[^a-z0-9]+")
# element names and attribute words: fixed values
RAW = frozenset("script style textarea title xmp noscript template iframe noframes svg math object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption head".split())
SPACED = frozenset("br td th option img".split())
SELF_CLOSING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
SCOPES = frozenset("div article section main body table ul ol dl blockquote aside nav header footer form fieldset td th figure".split())
LEFT_OUT = frozenset("nav aside footer form menu dialog button".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset("ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond disqus share sharing social related recommended recommendations widget toolbar pagination pager login signup copyright".split())
#: Words that may stand beside them in a name that leaves an element of an article out.
PART_WORDS = frozenset("area bar block box button buttons container form inner links list section slot thread wrap wrapper".split())
OUTSIDE_ONLY = frozenset(["header", "masthead"])
BODY_WORDS = (("article", "body"), ("article", "content"), ("post", "content"), ("post", "body"), ("entry", "content"), ("story", "body"), ("main", "content"))


def _kind(tag: str, attributes: str, level: int) -> tuple[bool, int]:
    """Whether an element is left out; 2 for an article, 1 for a main part, else 0."""
    if tag in LEFT_OUT or (tag == "header" and level < 2):
        return True, 0
    inside = {"article": 2, "main": 1}.get(tag, 0)
    if not attributes.strip(" /") or tag in ("html", "body"):
        return False, inside
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)}
    role = found.get("role", "").lower()
    if role in LEFT_OUT_ROLES or re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|/|$|=)", _attribute.sub(" ", attributes)):
        return True, 0
    for name in (found.get("class", "").lower(), found.get("id", "").lower()):
        for one in name.split():
            words = [w for w in _split.split(one) if w]
            named = LEFT_OUT_WORDS.intersection(words)
            if any(all(w in words for w in pair) for pair in BODY_WORDS) or found.get("itemprop", "").lower() == "articlebody":
                inside = max(inside, 2)
            elif (named and (level < 2 or all(w in named or w in PART_WORDS for w in words))) or (OUTSIDE_ONLY.intersection(words) and level < 2):
                return True, 0
    return False, max(inside, 1 if role == "main" else 0)


def blocks(html: str) -> list[tuple[str, int]]:
    """The text blocks, each with 2 in an article, 1 in a main part, 0 elsewhere, and -1 if a mark leaves it out."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []
    text: tuple[list[str], list[str]] = ([], [])  # what is shown, and what is left out
    hidden = level = 0

    def flush() -> None:
        for part, at in zip(text, (level, -1), strict=True):
            if part:
                if line := " ".join(unescape("".join(part)).split()):
                    out.append((line, at))
                part.clear()

    def pop(n: int) -> None:
        nonlocal hidden, level
        for _, left_out, _ in stack[n:]:
            hidden -= left_out
        del stack[n:]
        level = max((s[2] for s in stack), default=0)

    at, end = 0, len(html)
    while at < end:
        m = _token.search(html, at)
        if not m:
            text[hidden > 0].append(html[at:])
            break
        if m.start() > at:
            text[hidden > 0].append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCKS:
            flush()
        elif tag in SPACED:
            text[hidden > 0].append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if close is None and tag not in ("script", "style", "textarea", "title"):
                continue
            at = end if close is None else close.start()
            continue
        if tag in VOID:
            continue
        if same := SELF_CLOSING.get(tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in ("article", "main") and hidden:  # an unclosed menu or header does not swallow the article
            first = next(i for i, s in enumerate(stack) if s[1])
            if stack[first][0] in ("nav", "header", "menu"):
                pop(first)
        left_out, inside = _kind(tag, attributes, level)
        if left_out and not hidden and tag not in BLOCKS:
            text[0].append(" ")
        stack.append((tag, left_out, inside))
        hidden += left_out
        level = max(level, inside)
    flush()
    return out


#: Rows of bits are kept for alignments of up to this many pairs of lines; larger ones are halved.
HELD_BITS = 1 << 28


def _bit_rows(x: list, y: list) -> Iterator[int]:
    """For each beginning of ``x``, the bits that are zero where the longest common subsequence with ``y`` grows."""
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    yield row
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(x: list, y: list) -> list[int]:
    """The length of the longest common subsequence of ``x`` and each beginning of ``y``."""
    *_, row = _bit_rows(x, y)
    out = [0]
    for c in reversed(f"{row:0{len(y)}b}" if y else ""):
        out.append(out[-1] + (c == "0"))
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    found: set[int] = set()
    todo = [(list(enumerate(a)), b)]
    while todo:
        pairs, y = todo.pop()
        start = 0
        while start < len(pairs) and start < len(y) and pairs[start][1] == y[start]:
            start += 1
        end = 0
        while end < len(pairs) - start and end < len(y) - start and pairs[-1 - end][1] == y[-1 - end]:
            end += 1
        found.update(i for i, _ in pairs[:start])
        found.update(i for i, _ in pairs[len(pairs) - end :])
        either = {v for _, v in pairs[start : len(pairs) - end]}.intersection(y[start : len(y) - end])
        pairs = [(i, v) for i, v in pairs[start : len(pairs) - end] if v in either]
        y = [v for v in y[start : len(y) - end] if v in either]
        if not pairs:
            continue
        x = [v for _, v in pairs]
        if len(x) * len(y) > HELD_BITS and len(x) > 1:
            half = len(x) // 2
            sums = [m + n for m, n in zip(_lengths(x[:half], y), reversed(_lengths(x[half:][::-1], y[::-1])), strict=True)]
            at = sums.index(max(sums))
            todo += [(pairs[:half], y[:at]), (pairs[half:], y[at:])]
            continue
        rows = list(_bit_rows(x, y))
        length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
        i, j = len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                found.add(pairs[i - 1][0])
                i, j = i - 1, j - 1
            elif length(i - 1, j) >= length(i, j - 1):
                i -= 1
            else:
                j -= 1
    return found


def shared_lines(lines: list[str], hashes: list[int], neighbours: list[list[int]]) -> set[int]:
    """Places of the lines that a neighbour shares, in order; none with a neighbour that is a copy of the page."""
    shared: set[int] = set()
    size = sum(map(len, lines))
    for other in neighbours:
        same = common_lines(hashes, other)
        if sum(len(lines[i]) for i in same) <= COPY_SHARE * size:
            shared |= same
    return shared


def main_text(lines: list[str], levels: list[int], hashes: list[int], neighbours: list[list[int]]) -> str:
    """The blocks that neither a mark leaves out nor a neighbour shares, and of a marked article all that no mark leaves out."""
    shared = shared_lines(lines, hashes, neighbours)
    own = {v: sum(len(x) for i, x in enumerate(lines) if levels[i] == v and i not in shared) for v in (1, 2)}
    best = max(levels, default=0)
    if best == 2 and own[1] > own[2]:
        best = 1
    protected = best == 2
    return "\n".join(x for i, (x, v) in enumerate(zip(lines, levels, strict=True)) if v == max(best, 0) and (protected or i not in shared))


_PARSED = "page_id long, url string, host string, path string, part int, lines array<string>, levels array<int>, hashes array<long>"


def addressed(pages: DataFrame) -> DataFrame:
    """Adds host and path, in lower case, without scheme, query and fragment."""
    plain = F.lower(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", ""))
    return pages.select("*", F.substring_index(plain, "/", 1).alias("host"), F.regexp_replace(plain, "^[^/]*", "").alias("path"))


class Ranges:
    """The part of its host that a page is in: the number of borders that are not after it."""

    def __init__(self, borders: list[tuple]):
        self.of: dict[str, list] = {}
        for host, *key in borders:
            self.of.setdefault(host, []).append(self.key(*key))
        for keys in self.of.values():
            keys.sort()

    @staticmethod
    def key(path: str, url: str | None, page_id: int | None) -> tuple:
        return path.encode(), url is not None, (url or "").encode(), page_id is not None, page_id or 0

    def part(self, host: str, path: str, url: str | None, page_id: int | None) -> int:
        from bisect import bisect_right

        keys = self.of.get(host)
        return bisect_right(keys, self.key(path, url, page_id)) if keys else 0


def parsed(pages: DataFrame, ranges: Ranges) -> DataFrame:
    """page_id, url, host, path, part, lines, levels, hashes of (page_id, url, html, host, path)."""
    import pyarrow as pa

    shared = pages.sparkSession.sparkContext.broadcast(ranges)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own = shared.value
        for batch in batches:
            page_id, url, html, host, path = (c.to_pylist() for c in batch.columns)
            found = [blocks(h or "") for h in html]
            parts = [own.part(*k) for k in zip(host, path, url, page_id, strict=True)]
            hashes = [[xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63 for x, _ in f] for f in found]
            columns = [
                pa.array(parts, pa.int32()), pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string())),
                pa.array([[v for _, v in f] for f in found], pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), *columns], [f.split()[0] for f in _PARSED.split(", ")])

    return pages.select("page_id", "url", "html", "host", "path").mapInArrow(read, _PARSED)


def _borders(rows: DataFrame, keys: list[tuple], ranges: Ranges) -> DataFrame:
    """host, part, border_before (the blocks of the last page of the part before), border_after (of the first page of the next)."""
    import pyarrow as pa

    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            parts = [own.part(h, *k) for h, *k in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.int32()), *batch.columns[1:]], ["host", "part", "path", "url", "page_id"])

    key = F.struct("path", "url", "page_id")
    hosts = F.broadcast(spark.createDataFrame(sorted({(k[0],) for k in keys}), "host string"))
    narrow = rows.select("host", "path", "url", "page_id").join(hosts, "host")
    ends = narrow.mapInArrow(place, "host string, part int, path string, url string, page_id long").groupBy("host", "part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = ends.select("host", F.explode(F.array("first", "last")).alias("k")).select("host", "k.*").distinct()
    same = [rows[c].eqNullSafe(ends[c]) for c in ("host", "path", "url", "page_id")]
    pages = rows.join(F.broadcast(ends), same[0] & same[1] & same[2] & same[3], "left_semi")
    blocks_of = F.struct("path", "url", "page_id", "hashes")
    found = parsed(pages, ranges).groupBy("host", "part").agg(F.min(blocks_of).alias("first"), F.max(blocks_of).alias("last"))
    before = found.select("host", (F.col("part") + 1).alias("part"), F.col("last.hashes").alias("border_before"))
    after = found.select("host", (F.col("part") - 1).alias("part"), F.col("first.hashes").alias("border_after"))
    return before.join(after, ["host", "part"], "full_outer")


def extract(pages: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """page_id, url, text, n_chars.  ``range_rows``: pages of a range, at least; the texts don't depend on it."""
    import pyarrow as pa

    rows = addressed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    wide = max(range_rows, pages.count() // RANGES)
    names = ("host", "path", "url", "page_id")
    borders = [tuple(r) for r in rows.select(*names).filter(F.pmod(F.xxhash64(*names), F.lit(wide)) == 0).distinct().collect()]  # about RANGES addresses at most
    ranges = Ranges(borders)
    order = Window.partitionBy("host", "part").orderBy("path", "url", "page_id", "hashes")
    rows_by_part = parsed(rows, ranges).select("*", F.lag("hashes").over(order).alias("before"), F.lead("hashes").over(order).alias("after"))
    if borders:
        rows_by_part = rows_by_part.join(_borders(rows, borders, ranges), ["host", "part"], "left").withColumns({
            "before": F.coalesce("before", "border_before"), "after": F.coalesce("after", "border_after"),
        })

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(lines, levels, hashes, [x for x in near if x]) for lines, levels, hashes, *near in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = rows_by_part.select("page_id", "url", "lines", "levels", "hashes", "before", "after").mapInArrow(difference, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
