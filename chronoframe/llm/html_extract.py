"""Main text of web pages by differencing each page with the page of the nearest URL.

Pages are sorted by host and URL path, so that the nearest URL of a page is one of its two
neighbours: the one with the longer common path on the same host. The text lines of both
(one for each block of the page) are aligned by a longest common subsequence, and lines
that the page shares with its neighbour are deleted as the site's own.

Differencing alone errs both ways: menus and footers that vary from page to page are not
shared, and passages that articles quote are. So markup has the last word where it is clear:
lines inside the page's article (else its main element) are kept though shared, and all others of such a
page deleted, unless the article is the smaller part of the text, as a teaser is; lines in
menus, headers, footers, sidebars, notices, adverts, forms and comments are deleted though
not shared. Differencing decides on all lines that markup leaves open.

Names of classes and ids mark boilerplate only as far as that leaves the page a text. A neighbour that has a page's
longest open line is a copy of the page and says nothing about it; the other neighbour is taken then.

Scale: one shuffle by ranges of (host, path, id), in which a host of any size spans many
partitions, and a pass over each sorted range that holds three pages at a time. The pages at the ranges' ends
are given to the ranges beside them too, so the ranges don't show in the result. What decides the ranges are
at most ``SAMPLED`` keys for each of them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, small, table
from .url_filter import host_and_path

#: Keys that are looked at for each range.
SAMPLED = 20
#: Cells of an alignment that are held at once.
CELLS = 1 << 26

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
DROPPED = RAW | frozenset("head noscript template object svg math canvas audio video nav header footer aside form button select option datalist label menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is no part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Beside these, a mark says what a wrapper has or has not, not what it is.
MODIFIERS = frozenset("has have with without no not hide hidden show open closed is on off active collapsed page layout".split())
_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")

MAIN, OPEN, BOILERPLATE = 2, 1, 0


def _is_marked(attributes: str) -> tuple[bool, bool, bool]:
    """(is boilerplate, is boilerplate by its name, is the main element) by an element's attributes."""
    drop = named = main = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c).lower()
        if name in ("class", "id"):
            for words in map(_WORD.findall, value.split()):
                named |= not MARKS.isdisjoint(words) and MODIFIERS.isdisjoint(words)
        elif name == "role":
            drop |= value.strip() in ROLES
            main |= value.strip() == "main"
        elif name == "hidden":
            drop = True
        elif name == "style":
            drop |= "display:none" in value.replace(" ", "")
    return drop, named, main


def text_lines(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order: (text, MAIN, OPEN or BOILERPLATE); blocks without text are left out.

    Character references are decoded; white space is one space. Broken and truncated markup
    is read as far as it goes: an end tag closes what is open inside its element, one that
    fits no open element is ignored. Time is in proportion to the page's length.
    """
    page = page or ""
    lines: list[tuple[str, tuple]] = []
    parts: list[str] = []
    none = (False, False, False, False)
    # tag; dropped, dropped by a name, in an article, in a main element
    stack: list[tuple[str, tuple]] = []
    opened: Counter = Counter()
    state = none

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, state))
        parts.clear()

    at, n, find, last = 0, len(page), _TAG.search, page.rfind(">")
    lower = None
    while at < n:
        m = find(page, at) if at <= last else None
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[A-Za-z/!?][^>]*\Z", rest)  # a tag that the page's end cuts off
            parts.append(html.unescape(rest[: cut.start()] if cut else rest))
            break
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag in BLOCKS:
                flush()
            if opened[tag]:
                while stack:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top in BLOCKS:
                        flush()
                    state = stack[-1][1] if stack else none
                    if top == tag:
                        break
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        attributes = m[3] or m[6] or ""
        drop, named, main = _is_marked(attributes) if attributes.strip() else (False, False, False)
        if tag in ("html", "body"):
            drop = named = False
        named &= tag not in ("article", "main")
        state = (state[0] or drop or tag in DROPPED, state[1] or named, state[2] or tag == "article", state[3] or main or tag == "main")
        if tag in RAW and not attributes.rstrip().endswith("/"):
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at)
            at = n if end < 0 else end
            if len(lower) != n:  # a character whose lower case is longer
                found = re.compile(f"</{tag}", re.I).search(page, m.end())
                at = found.start() if found else n
        stack.append((tag, state))
        opened[tag] += 1
    flush()
    size = lambda wanted: sum(len(t) for t, s in lines if wanted(s))
    # names are left aside where they would leave nothing, or drop an article that is most of the page
    shown = size(lambda s: not s[0])
    lifted = not size(lambda s: not s[0] and not s[1]) or 2 * size(lambda s: not s[0] and s[1] and (s[2] or s[3])) >= shown
    flags = [(t, s[0] or s[1] and not lifted, s[2], s[3]) for t, s in lines]
    rest = sum(len(f[0]) for f in flags if not f[1])
    inner = next((k for k in (2, 3) if 0 < rest <= 2 * sum(len(f[0]) for f in flags if f[k] and not f[1])), 0)
    return [(f[0], BOILERPLATE if f[1] else OPEN if not inner else MAIN if f[inner] else BOILERPLATE) for f in flags]


def _alignment(a: list, b: list) -> list[np.ndarray]:
    """For each beginning of ``a``, the empty one too, its longest common subsequences with all beginnings of ``b``, a bit for each:
    0 where one more line of ``b`` makes it longer (bit-parallel, after Hyyro)."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    yield v
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    for v in _alignment(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared_lines(mine: list, other: list) -> set[int]:
    """The places in ``mine`` that a longest common subsequence with ``other`` takes.

    Work is the product of the lengths, 64 cells at a time; alignments of more than ``CELLS`` are halved (Hirschberg), so
    memory is bounded also where one line fills both pages.
    """
    found: set[int] = set()
    parts = [(0, len(mine), 0, len(other))]
    while parts:
        i, j, k, m = parts.pop()
        while i < j and k < m and mine[i] == other[k]:
            found.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and mine[j - 1] == other[m - 1]:
            j, m = j - 1, m - 1
            found.add(j)
        if i == j or k == m:
            continue
        a, b = mine[i:j], other[k:m]
        if len(a) * len(b) > CELLS and len(a) > 1:
            half = len(a) // 2
            cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
            parts += [(i, i + half, k, k + cut), (i + half, j, k + cut, m)]
            continue
        rows = list(_alignment(a, b))
        x, y = len(a), len(b)
        while x and y:
            if rows[x] >> (y - 1) & 1:
                y -= 1
            elif rows[x - 1] >> (y - 1) & 1:
                x, y = x - 1, y - 1
                found.add(i + x)
            else:
                x -= 1
    return found


def main_text(lines: list[tuple[str, int]], *others: list[tuple[str, int]]) -> str:
    """What remains of a page's lines beside those of the nearest of ``others`` that is no copy of it; others are given nearest first."""
    longest = max((t for t, k in lines if k == OPEN), key=len, default=None)
    for other in others:
        if other and longest is not None and longest not in {t for t, _ in other}:
            shared = shared_lines([hash(t) for t, _ in lines], [hash(t) for t, _ in other])
            lines = [(t, k) for i, (t, k) in enumerate(lines) if k != OPEN or i not in shared]
            break
    return " ".join(t for t, k in lines if k != BOILERPLATE)


def _nearness(a: tuple[str, str], b: tuple[str, str]) -> int:
    """Common characters of two paths on one host; -1 for different hosts."""
    if a[0] != b[0]:
        return -1
    n = 0
    for x, y in zip(a[1], b[1], strict=False):
        if x != y:
            break
        n += 1
    return n


def _ranges(keys: DataFrame, n: int) -> list:
    """At most n - 1 keys, ascending, that cut ``keys`` (key) into ranges of about equal numbers of rows."""
    some = keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLED * n)
    found = [r.key for r in some.distinct().orderBy("key").collect()]
    step = max(1, -(-len(found) // n))
    return found[step::step]


def _sortable(key) -> tuple:
    """A key as Spark orders it: text by its bytes, no id first."""
    return key["host"], key["path"], key["id"] is not None, key["id"] or ""


def _range_of(key: Column, cuts: list) -> Column:
    """In which of the ranges a key is: how many cuts are no greater."""
    ends = [_sortable(c) for c in cuts]

    @F.pandas_udf("int")
    def place(keys: pd.DataFrame) -> pd.Series:
        return pd.Series([bisect_right(ends, (h, p, i is not None, i or "")) for h, p, i in zip(keys["host"], keys["path"], keys["id"], strict=True)], dtype="int32")

    return place(key) if cuts else F.lit(0)


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """Returns page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text. Pages with a null url, or one without ``://``,
    are of one nameless host. Pages of one url are in the order of their ids as text, rows with one url and id in the order of their html's hash; as copies, they
    delete nothing. Of two neighbours that are equally near the one before is taken. An empty table gives
    none. Further columns are left aside.
    """
    host, path = host_and_path(F.col("url"))
    key = F.struct(host.alias("host"), path.alias("path"), F.col("page_id").cast("string").alias("id")).alias("key")
    # several ranges a partition, so that dealing them by a hash is even; partitions grow with the table
    n = ranges or 4 * max(shuffle_partitions(pages.sparkSession), pages.rdd.getNumPartitions())
    keys = pages.select(key)
    cuts = _ranges(keys, n)
    whole = pages.select("page_id", "url", "html", key, F.xxhash64("html").alias("hash")).withColumn("part", _range_of(F.col("key"), cuts))
    ends = keys.withColumn("part", _range_of(F.col("key"), cuts)).groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    seen = {r.part: r for r in ends.collect()}  # one row a range
    order = sorted(seen)
    beside = [(seen[p]["last"], q, False) for p, q in zip(order, order[1:], strict=False)] + [(seen[q]["first"], p, True) for p, q in zip(order, order[1:], strict=False)]
    rows = whole.withColumn("guest", F.lit(False))
    if beside:
        kind = keys.schema["key"].dataType.simpleString()
        wanted = pages.sparkSession.createDataFrame(beside, f"_key {kind}, to int, after boolean")
        met = whole.join(F.broadcast(wanted), whole.key.eqNullSafe(wanted._key))  # two keys a range
        # of rows with one key the first or the last in the order of the sort
        guests = met.groupBy("to", "after").agg(F.first("key").alias("key"), *[F.struct(F.min_by(c, "hash").alias("a"), F.max_by(c, "hash").alias("b")).alias(c) for c in ("page_id", "url", "html")], F.min("hash").alias("low"), F.max("hash").alias("high"))
        pick = lambda c: F.when(F.col("after"), F.col(f"{c}.a")).otherwise(F.col(f"{c}.b")).alias(c)
        guests = guests.select(*[pick(c) for c in ("page_id", "url", "html")], "key", F.when(F.col("after"), F.col("low")).otherwise(F.col("high")).alias("hash"), F.col("to").alias("part"), F.lit(True).alias("guest"))
        rows = rows.unionByName(guests)
    ordered = rows.repartition(max(1, n // 4), "part").sortWithinPartitions("part", "key", "hash", "guest")
    ordered = ordered.select("page_id", "url", "html", F.col("key.host").alias("host"), F.col("key.path").alias("path"), "part", "guest")
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, urls, texts = [], [], []
        id_arrow = None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
            ids.clear(), urls.clear(), texts.clear()
            return batch

        def judge(before, page, after) -> None:
            if page[4]:
                return
            near = [(_nearness(page[2], o[2]), -i, o) for i, o in enumerate((before, after)) if o is not None and o[5] == page[5]]
            near = sorted((x for x in near if x[0] >= 0), key=lambda x: x[:2], reverse=True)
            ids.append(page[0]), urls.append(page[1])
            texts.append(main_text(page[3], *(x[2][3] for x in near)))

        before = page = None
        for batch in small(batches):
            id_arrow = batch.schema.field("page_id").type
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "host", "path", "guest", "part")]
            for i in range(batch.num_rows):
                page_id, url, source, h, p, guest, part = (c[i].as_py() for c in columns)
                after = (page_id, url, (h, p), text_lines(source), guest, part)
                if page is not None:
                    judge(before, page, after)
                before, page = page, after
            if ids:
                yield out()
        if page is not None:
            judge(before, page, None)
            if ids:
                yield out()

    return ordered.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
