"""Main text of web pages: nearest-URL page differencing over lines.

Pages are ordered by host and the segments of their URL paths; each is paired with the nearer of its
two neighbours there, the text lines of both (menus and footers included) are aligned by a longest
common subsequence, and lines that both have are template: they are deleted. Differencing cannot see
what only one page has, such as its advert, so lines in elements that are no article whatever they say
are marked while the page is read and go as well. Lines inside an ``article`` or ``main`` are never
deleted for being shared: two articles may quote the same passage, and copies of one article under two
addresses of a host would delete each other.
"""

from __future__ import annotations

import html as refs
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..memo import memo
from .words import each, text_batches

#: Elements (fixed values): without content; with raw text; never article; that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = frozenset("head nav footer aside form button select option dialog svg canvas audio video object menu".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Whole class names, ids and roles that mark what is no article (fixed values).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices newsletter subscribe subscription signup popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager sidebar sidebars footer header masthead toolbar share sharing social related recommended recommendations comment "
    "comments commentlist respond disqus reply replies widget widgets search login alert complementary contentinfo".split()
)
#: What a line stands in: an element that is never article, none of note, an ``article`` or ``main``.
NEVER_LINE, OTHER, CONTENT = 0, 1, 2
#: A whole tag with its quoted attributes, and one up to the next bracket where a quote is left open.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


@memo
def _marked(attributes: str) -> bool:
    for name, a, b, c in NAMES.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name in ("class", "id", "role") and not MARKS.isdisjoint(value.split()):
            return True
    return False


@memo
def _hidden(attributes: str) -> bool:
    return any(name.lower() == "hidden" or (name.lower() == "aria-hidden" and (a or b or c).lower() == "true") for name, a, b, c in NAMES.findall(attributes))


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value) of a page in order: text, cdata, open, close; in time linear in its length.

    A quote that is never closed ends with the tag's bracket, in this tag and all that follow; a bracket that
    no other closes is text, and so is one that begins no tag. What a raw element holds is passed over.
    """
    at, end, quoted = 0, len(source), True
    last = source.rfind(">")
    while at < end:
        if source[at] != "<":
            stop = source.find("<", at)
            stop = end if stop < 0 else stop
            yield "text", "", source[at:stop]
            at = stop
            continue
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if source.startswith("<![CDATA[", at):
            stop = source.find("]]>", at)
            yield "cdata", "", source[at + 9 : end if stop < 0 else stop]
            at = end if stop < 0 else stop + 3
            continue
        m = None
        if at < last:
            if source[at + 1] in "!?":
                at = source.find(">", at) + 1
                continue
            m = TAG.match(source, at) if quoted else None
            if not m and (m := PLAIN_TAG.match(source, at)):
                quoted = False
        if not m:
            yield "text", "", "<"
            at += 1
            continue
        at = m.end()
        slash, name, attributes = m.groups()
        name = name.lower()
        if slash:
            yield "close", name, ""
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/") or name in ("script", "style"):
                stop = _end_of(name).search(source, at)
                at = stop.end() if stop else end
            yield "raw", name, ""
            continue
        yield "open", name, attributes


@memo
def _end_of(raw: str):
    return re.compile(rf"</{raw}\s*>", re.I)


def all_lines(page: str | None) -> tuple[bytes, list[str]]:
    """(kinds, lines): the text of every block in order, character references decoded, white space turned into one space.

    An ``article`` or ``main`` that is not marked itself is CONTENT even in a marked element, though not
    in a hidden one or in one that is never article.
    """
    stack: list[tuple[str, bool, bool, bool]] = []  # name, no article, in article, no article whatever it holds
    held: dict[str, int] = {}
    kinds, lines, text = bytearray(), [], []
    never = content = False

    def flush():
        nonlocal text
        if text:
            line = " ".join(refs.unescape("".join(text)).split())
            if line:
                kinds.append(NEVER_LINE if never else CONTENT if content else OTHER)
                lines.append(line)
            text = []

    for kind, name, value in tokens(page or ""):
        if kind in ("text", "cdata"):
            text.append(value if kind == "text" else refs.escape(value))
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK or name in NEVER:
            flush()
        if name in VOID or kind == "raw":
            continue
        if kind == "close":
            if not held.get(name):
                continue
            flush()
            while True:
                out = stack.pop()[0]
                held[out] -= 1
                if out == name:
                    break
        else:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                held[stack.pop()[0]] -= 1
            if value.rstrip().endswith("/"):
                continue
            shut = (bool(stack) and stack[-1][3]) or name in NEVER
            own = False
            if value.strip() and name not in ("html", "body"):
                own = _marked(value)
                shut = shut or (name not in ("article", "main") and _hidden(value))
            if name in ("article", "main"):
                out = shut or (never and own)
            else:
                out = shut or never or own or (name == "header" and not content)
            inside = content or (name in ("article", "main") and not out)
            if (out, inside) != (never, content):
                flush()
            stack.append((name, out, inside, shut))
            held[name] = held.get(name, 0) + 1
        never, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    flush()
    return bytes(kinds), lines


def lines_of(page: str | None) -> tuple[bytes, list[str]]:
    """(kinds, lines) that may be main text without a partner: those in an ``article`` or ``main`` if there are any, else all unmarked ones."""
    kinds, lines = all_lines(page)
    best = max(kinds, default=OTHER)
    kept = [x for k, x in zip(kinds, lines, strict=True) if k == best and k != NEVER_LINE]
    return bytes([best]) * len(kept), kept


def _rows(a: list[int], b: list[int], reverse: bool = False) -> list[int]:
    """For each item of ``a`` the row of the LCS table with ``b`` as bits: bit j is zero where the length grows at j."""
    where: dict[int, int] = {}
    if reverse:
        a, b = a[::-1], b[::-1]
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        out.append(row)
    return out


#: Bits of LCS rows that are kept at once; a larger pair is halved, in linear memory.
TABLE_BITS = 1 << 26


def _align(a: list[int], b: list[int], at: int, out: set[int]) -> None:
    """Adds to ``out`` the positions in ``a``, counted from ``at``, of a longest common subsequence with ``b``."""
    jobs = [(a, b, at)]
    while jobs:
        a, b, at = jobs.pop()
        lead = 0
        while lead < len(a) and lead < len(b) and a[lead] == b[lead]:
            out.add(at + lead)
            lead += 1
        a, b, at = a[lead:], b[lead:], at + lead
        while a and b and a[-1] == b[-1]:
            out.add(at + len(a) - 1)
            a, b = a[:-1], b[:-1]
        if not a or not b:
            continue
        if len(a) == 1:
            if a[0] in b:
                out.add(at)
            continue
        if len(a) * len(b) > TABLE_BITS:
            half = len(a) // 2
            one, two = _rows(a[:half], b)[-1], _rows(a[half:], b, reverse=True)[-1]
            m = len(b)
            ahead = [0]
            for j in range(m):
                ahead.append(ahead[-1] + 1 - (one >> j & 1))
            best, behind, cut = ahead[m], 0, m
            for j in range(m - 1, -1, -1):
                behind += 1 - (two >> (m - 1 - j) & 1)
                if ahead[j] + behind > best:
                    best, cut = ahead[j] + behind, j
            jobs += [(a[:half], b[:cut], at), (a[half:], b[cut:], at + half)]
            continue
        rows = _rows(a, b)
        j = len(b)
        length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count() if i >= 0 else 0
        i, n = len(a) - 1, length(len(a) - 1, len(b))
        while n:
            if length(i - 1, j) == n:
                i -= 1
                continue
            out.add(at + i)  # the row grows here: a[i] is matched by its last place in b that begins this length
            n -= 1
            j -= 1
            while a[i] != b[j] or length(i - 1, j) != n:
                j -= 1
            i -= 1


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``; rows of the table are whole numbers of len(b) bits."""
    both = set(a) & set(b)
    number = {x: i for i, x in enumerate(sorted(both))}
    place = [i for i, x in enumerate(a) if x in both]
    found: set[int] = set()
    _align([number[a[i]] for i in place], [number[x] for x in b if x in both], 0, found)
    return {place[i] for i in found}


#: Share of a page's unmarked characters that a partner must share to count as a copy of it, not as a neighbour.
COPY = 0.9


def main_text(kinds: bytes, lines: list[str], others: list[list[str]]) -> str:
    """What is left of a page.

    Lines outside ``article`` and ``main`` that the page shares with its partner are deleted; of the rest,
    marked lines go, and unmarked ones too if the page has an ``article`` or ``main``. ``others``: lines of
    the candidates, nearest first; a copy of the page is passed over.
    """
    content = CONTENT in kinds
    weight = sum(len(x) for k, x in zip(kinds, lines, strict=True) if k)
    gone: set[int] = set()
    for other in others:
        shared = shared_lines(lines, other)
        if weight and sum(len(lines[i]) for i in shared if kinds[i]) >= COPY * weight:
            continue
        gone = shared
        break
    keep = CONTENT if content else OTHER
    return "\n".join(x for i, (k, x) in enumerate(zip(kinds, lines, strict=True)) if k == keep and (k == CONTENT or i not in gone))


def apart(a: list[str], b: list[str]) -> int:
    """Steps from one URL path to another over their common beginning, by whole segments."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return len(a) + len(b) - 2 * n


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text (lines joined by one newline) and n_chars of every page.

    Null and empty pages have an empty text. Within a host, pages stand in the order of their paths'
    segments, so the nearest path is the one before or the one after; of two as near, the earlier. Pages
    without a neighbour of their host are paired with none. Repeated rows stay. A page with a null url
    belongs to the empty host. An empty table gives no rows. Only lines are shuffled, by ranges of (host,
    segments, id, url), so a host of any size is spread over tasks; the first and last page of each range
    go to the adjoining ranges too, so the text of a page does not depend on how the ranges fall.
    """
    from .url_filter import host_of, path_of

    text_batches(pages.sparkSession)
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    url = F.col(url_col)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "segments", "id", "url"]
    fields = f"host string, segments array<string>, id {kind}, url string, kinds binary, lines array<string>, slot int, away boolean"
    read_in = pages.select(host_of(url).alias("host"), F.split(path_of(url), "/").alias("segments"), F.col(id_col).alias("id"), url.alias("url"), F.col(html_col).alias("html"))
    ranges = read_in.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("part"))
    ends = ranges.agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).collect()  # one row for each range
    rank = lambda key: tuple((x is not None, x if x is not None else 0) for x in key)
    firsts, lasts = (sorted(rank(r[c]) for r in ends) for c in ("first", "last"))

    def read(batches: Iterator) -> Iterator:
        from bisect import bisect_right

        import pyarrow as pa

        for b in batches:
            found = [all_lines(x) for x in each(b.column(4))]
            row, slot, away = [], [], []
            for i, key in enumerate(zip(*(each(c) for c in b.columns[:4]), strict=True)):
                key = rank(key)
                at = max(0, bisect_right(firsts, key) - 1)
                to = [(at, False)]
                if key == firsts[at] and at:
                    to.append((at - 1, True))
                if key == lasts[at] and at + 1 < len(firsts):
                    to.append((at + 1, True))
                for k, other in to:
                    row.append(i), slot.append(k), away.append(other)
            whole = pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([k for k, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.string()))], names=[*order, "kinds", "lines"]
            ).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(slot, pa.int32()), pa.array(away, pa.bool_())], names=[*whole.schema.names, "slot", "away"])

    def pair(batches: Iterator) -> Iterator:
        import pyarrow as pa

        before = now = None

        def settle(a, x, z):
            near = sorted(((apart(x[1] or [], y[1] or []), k, y) for k, y in enumerate((a, z)) if y and y[0] == x[0]), key=lambda p: p[:2])
            text = main_text(x[4], x[5], [y[5] for _, _, y in near])
            return x[2], x[3], text, len(text)

        def pack(rows):
            ids, urls, texts, sizes = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["id", "url", "text", "n_chars"])

        id_type = None
        for b in batches:
            id_type, done = b.schema.field(2).type, []
            for row in zip(*(each(c) for c in b.columns), strict=True):
                if now and not now[7]:
                    done.append(settle(before, now, row))
                before, now = now, row
            if done:
                yield pack(done)
        if now and not now[7]:
            yield pack([settle(before, now, None)])

    ranged = read_in.mapInArrow(read, fields).repartitionById(max(1, len(firsts)), F.col("slot")).sortWithinPartitions(*order, "lines")
    return ranged.mapInArrow(pair, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
