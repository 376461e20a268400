"""Main text of web pages by differencing with the page of the nearest URL.

Pages are put in the order of host and path, and each is paired with the neighbour of
the same host whose path shares the longer beginning. The blocks of text of both
pages are aligned by their longest common subsequence; what they share is the site's
frame. Shared blocks are deleted, unless the page marks them as its article, or the
pages are copies of each other (most of the text is shared). Blocks inside elements
that never hold the article (menus, forms, adverts, comments, ...) are deleted too,
and where a page marks an article, so is all outside of it.

The order is cut into ranges, so a host may spread over many tasks. The first and the last
page of each range are put off, with the page beside them, and finished together
once the ranges are done: two pages for each range, read in order by one task. The result
does not depend on the ranges. Pages are compressed one by one for the shuffle.

Defined cases: pages of any length are read whole, and their alignment takes linear memory;
of two neighbours whose paths share an equally long beginning, the earlier one counts; a null html is an empty page with an empty text; a null or malformed
url belongs to the host of that text; pages with the same url are neighbours, and
repeated rows are copies; a page without neighbour on its host keeps its shared
blocks; only id, url and html are read; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import keep

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|svg|iframe|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
                   r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S | re.I)
# Fixed values of the markup language: elements that end a block of text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
FRAME = frozenset("nav header footer aside form button label menu dialog head fieldset".split())
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(("p", "li", "dt", "dd", "option", "tr", "td", "th"))
ROLE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
FRAME_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|breadcrumbs?|header|footer|cookies?|consent|notices?|popup|modal|newsletter"
                        r"|subscribe|share|social|related|recommend\w*|comments?|respond|replies|disqus|login|search|widget|copyright|legal|pagination|pager)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
BITS = 1 << 28  # of the rows kept by one alignment


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article, in a frame element) of each block of a page, in order."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, article inside, frame inside
    at = 0

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, *(stack[-1][1:] if stack else (False, False))))

    for m in TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if m.group(2):
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if found is not None:
                # an end tag does not reach past the section that it stands in
                wall = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in FRAME or stack[k][0] in ARTICLE), -1)
                if found >= wall:
                    del stack[found:]
        elif name not in VOID and not m.group(4).endswith("/"):
            if name in CLOSED_BY_BLOCK and stack and stack[-1][0] == name:
                stack.pop()
            article, frame = stack[-1][1:] if stack else (False, False)
            frame = frame or name in FRAME and not (name == "header" and article) or any(FRAME_NAME.search("".join(g)) for g in ROLE.findall(m.group(4))) and name not in ("html", "body", *ARTICLE)
            stack.append((name, article or name in ARTICLE, frame))
    parts.append(html[at:])
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    in_both = set(a) & set(b)
    x, y = [i for i, s in enumerate(a) if s in in_both], [j for j, s in enumerate(b) if s in in_both]
    low = 0
    while low < min(len(x), len(y)) and a[x[low]] == b[y[low]]:
        low += 1
    high = 0
    while high < min(len(x), len(y)) - low and a[x[-1 - high]] == b[y[-1 - high]]:
        high += 1
    middle = x[low:len(x) - high]
    found = common_places([a[i] for i in middle], [b[j] for j in y[low:len(y) - high]])
    return {*x[:low], *(x[len(x) - high:] if high else ()), *(middle[i] for i in found)}


def bit_rows(x: list, y: list):
    """After each entry of ``y``: bits that are zero where the common length grows along ``x``."""
    at: dict = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
        yield row


def lengths(row: int, n: int) -> list[int]:
    """Common length of each beginning of ``x``."""
    return [0, *accumulate(1 - (row >> i & 1) for i in range(n))]


def common_places(x: list, y: list) -> list[int]:
    """Places in ``x`` of a longest common subsequence with ``y``, ascending.

    The bit rows of all of ``y`` are kept and walked back; where they would pass ``BITS``, ``y`` is
    halved and ``x`` cut where the two halves share most, so memory stays linear.
    """
    if not x or not y:
        return []
    if len(x) * len(y) > BITS and len(y) > 1:
        half, n, row, back = len(y) // 2, len(x), 0, 0
        for row in bit_rows(x, y[:half]):
            pass
        for back in bit_rows(x[::-1], y[:half - 1:-1]):
            pass
        ahead, behind = lengths(row, n), lengths(back, n)
        cut = max(range(n + 1), key=lambda i: ahead[i] + behind[n - i])
        return common_places(x[:cut], y[:half]) + [cut + i for i in common_places(x[cut:], y[half:])]
    rows = [(1 << len(x)) - 1, *bit_rows(x, y)]
    out, i, j = [], len(x) - 1, len(y)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1  # the length does not grow here
        elif not rows[j - 1] >> i & 1:
            j -= 1  # it grew here before this entry
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def main_text(page: list[tuple[str, bool, bool]], other: list[tuple[str, bool, bool]] | None) -> str:
    """Text of a page after differencing with another."""
    lines = [t for t, _, _ in page]
    shared = shared_lines(lines, [t for t, _, _ in other]) if other else set()
    copies = 2 * sum(len(lines[i]) for i in shared) > sum(map(len, lines))
    marked = any(article and not frame for _, article, frame in page)
    kept = [text for i, (text, article, frame) in enumerate(page) if not frame and (article or not marked) and (article or copies or i not in shared)]
    return "\n".join(kept)


def alike(a: str, b: str) -> int:
    """Length of the common beginning of two paths."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def deflated(batches):
    """The rows with their third column compressed page by page, for the shuffle."""
    for batch in batches:
        for low in range(0, len(batch), 256):
            rows = batch.slice(low, 256)
            packed = [zlib.compress(x.as_buffer(), 1) for x in rows.column(2).cast(pa.large_binary())]
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(packed, pa.binary()), rows.column(3), rows.column(4)], names=["k", "u", "h", "host", "path"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) for each page."""
    host = F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.|m\.)?([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("h"),
                        F.lower(host).alias("host"), path.alias("path"))
    small = rows.mapInArrow(deflated, "k long, u string, h binary, host string, path string")
    ordered = small.repartitionByRange("host", "path", "k").sortWithinPartitions("host", "path", "k", "u")
    side = "struct<h: string, host: string, path: string>"
    schema = f"k long, u string, text string, part int, last boolean, own {side}, inner {side}"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pages = (page for batch in batches for low in range(0, len(batch), 256) for page in read(batch.slice(low, 256)))
        out, held, count = [], [], 0
        for page in pages:  # ``held`` has the pages before, at most two
            if len(held) == 2:
                out.append(done(*held, page))
            elif held:
                out.append(put_off(held[0], part, False, page))
            held, count = [*held[-1:], page], count + 1
            if len(out) >= 256:
                yield table(out)
                out = []
        if held:
            out.append(put_off(held[-1], part, True, held[0] if count > 1 else None))
        if out:
            yield table(out)

    def read(batch):
        rows = ((k, u, zlib.decompress(h).decode(), site, p) for k, u, h, site, p in zip(*batch.to_pydict().values()))
        return [(*row, blocks(row[2])) for row in rows]

    def done(before, now, after):
        near = [x for x in (before, after) if x is not None and x[3] == now[3]]
        other = max(near, key=lambda x: alike(x[4], now[4]), default=None)
        return now[0], now[1], main_text(now[5], other and other[5]), None, None, None, None

    def put_off(page, part, last, inner):
        parts = lambda x: x and dict(zip(("h", "host", "path"), x[2:5]))
        return page[0], page[1], None, part, last, parts(page), parts(inner)

    def table(out):
        names = ["k", "u", "text", "part", "last", "own", "inner"]
        three = pa.struct([(c, pa.string()) for c in ("h", "host", "path")])
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), three, three]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def finish(batches):
        """The pages at the ends of the ranges, in order: the neighbour outside is the row beside."""
        full = lambda k, u, x: x and (k, u, x["h"], x["host"], x["path"], blocks(x["h"]))
        before = now = None
        for batch in batches:
            for row in batch.to_pylist():
                after = (full(row["k"], row["u"], row["own"]), row["last"], full(None, None, row["inner"]))
                if now is not None:
                    yield table([ends(before, now, after)])
                before, now = now, after
        if now is not None:
            yield table([ends(before, now, None)])

    def ends(before, now, after):
        page, last, inner = now
        if inner is None:  # the only page of its range
            return done(before and before[0], page, after and after[0])
        return done(inner, page, after and after[0]) if last else done(before and before[0], page, inner)

    found = keep(ordered.mapInArrow(run, schema), "pages")
    edges = found.where("text IS NULL").repartition(1).sortWithinPartitions("part", "last").mapInArrow(finish, schema)
    return found.where("text IS NOT NULL").unionByName(edges).select(F.col("k").alias(key), F.col("u").alias(url), "text")
