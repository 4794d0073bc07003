"""Main text of web pages by differencing each page with the page of the nearest URL.

A page is read into text lines, one for each block of its markup; end tags that HTML lets out are implied.  Pages of a
host with equal lines are one page with the least of their paths, and all of them get its result.  The different pages of a
host are put in the order of their URL paths.  Neighbours that are near copies (shared lines with NEAR of the characters of the
shorter page, which is at least half as long; that says nothing about either) make a run, and a page has two neighbours to
learn from, the nearest page before and after its run; its partner is the one of these whose path shares the longer beginning
with its own (the earlier one on a tie).  A longest common subsequence aligns the lines of two pages, and lines shared with
the partner, wherever they stand, are deleted as part of the host's template; in an article or main element
only those shared with both neighbours, as a passage that one other page quotes is no template.

A check by elements follows: of the lines that are left, those in elements that are never content
(menus, forms, adverts, ...) are deleted, but never an article or main element, nor the rest
of an element that holds one.

Different pages are dealt by ranges of (host, path, id, digest) found from these keys alone, so that a
host of any size is spread over tasks; only hashes and lengths of lines travel for that.  What
lies beyond a range follows from its neighbours' first and last pages and those next to their outer runs, four pages a range
whatever the runs' length.  Texts travel once, to the join with the shared positions.

Defined results: null html is the empty page; a null url, or one without "://", has an empty
host and path (and no partner); a null id is kept; repeated rows stay and get one
text; a page whose host has only copies and near copies of it has no partner; other columns of the input are ignored.
"""
from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from base64 import b64encode
from collections.abc import Iterator
from html.parser import HTMLParser
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Elements that end a line when they open or close.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table "
    "tbody td template tfoot th thead title tr ul".split()
)
#: Elements whose text is never part of an article.
NEVER = frozenset(
    "head title script style noscript template iframe object svg canvas audio video nav aside footer form button select textarea label fieldset menu dialog map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
#: Words of class, id and role that mark such an element.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination footer masthead toolbar comment comments respond reply replies disqus share sharing social related recommended search contentinfo "
    "complementary dialog form hidden skip".split()
)
SPLIT = str.maketrans("-_:", "   ")
#: Start tags that end an open element: (tags, what they end, what shields it).
_TABLE, _CELLS = frozenset(["table"]), frozenset("td th".split())
IMPLIED = [
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu dir".split())),
    (frozenset("dt dd".split()), frozenset("dt dd".split()), frozenset(["dl"])),
    (frozenset(["option"]), frozenset(["option"]), frozenset("select datalist".split())),
    (frozenset(["optgroup"]), frozenset("option optgroup".split()), frozenset(["select"])),
    (_CELLS, _CELLS, _TABLE | {"tr"}),
    (frozenset(["tr"]), _CELLS | {"tr"}, _TABLE),
    (frozenset("thead tbody tfoot".split()), _CELLS | frozenset("tr thead tbody tfoot".split()), _TABLE),
    (frozenset(["body"]), frozenset(["head"]), frozenset()),
    (frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
               "li dt dd main menu nav ol p pre search section table ul".split()), frozenset(["p"]), frozenset("button caption html object td template th".split())),
]
KEY = ["host", "path", "order", "digest"]
NEAR = 0.8  # share of the shorter page's characters
OFTEN = 64  # places of a line from which their bits are kept
HALF = 0.5  # a near copy's least share of the longer page's characters


class _Element:
    """An open element; `spared` once an article or main element has opened in it."""

    __slots__ = ("tag", "around", "spared")

    def __init__(self, tag: str, around: tuple):
        self.tag, self.around, self.spared = tag, around, False


class _Reader(HTMLParser):
    """Lines of a page with their kind: 0 in an element that is never content, 2 article, 1 all others."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.places: dict[str, list[int]] = {}  # of the open elements of a tag
        # 1 or 2, and the innermost listed element; once that one is spared, so are those around it
        self.state: tuple[int, _Element | None] = (1, None)
        self.parts, self.found = [], []

    def _line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.found.append((text, self.state))

    @property
    def lines(self) -> list[tuple[str, int]]:
        return [(text, kind if listed is None or listed.spared else 0) for text, (kind, listed) in self.found]

    def _listed(self, tag: str, attrs: list) -> bool:
        if tag in NEVER or tag == "header" and self.state == (1, None):
            return True
        return any(
            name == "hidden" or name in ("class", "id", "role") and value and tag not in ("html", "body") and not MARKS.isdisjoint(value.lower().translate(SPLIT).split())
            for name, value in attrs
        )

    def _innermost(self, tags: frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        if self.open[k].around != self.state or any(e.tag in BLOCKS for e in self.open[k:]):
            self._line()
        self.state = self.open[k].around
        for e in reversed(self.open[k:]):
            self.places[e.tag].pop()
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self._line()
        for tags, ended, shields in IMPLIED:
            if tag in tags:
                while (k := self._innermost(ended)) > self._innermost(shields):
                    self._close(k)
        if tag in VOID:
            return
        element, state = _Element(tag, self.state), self.state
        if tag in CONTENT:
            for e in reversed(self.open):
                if e.spared:
                    break
                e.spared = True
            state = (2, None)
        elif self._listed(tag, attrs):
            state = (state[0], element)
        if state != self.state:
            self._line()
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(element)
        self.state = state

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._line()
        if self.places.get(tag):
            self._close(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def page_lines(html: str) -> list[tuple[str, int]]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._line()
    return reader.lines


def shared_lines(a: list, b: list) -> set[int]:
    """Positions of `a` in a longest common subsequence with `b`.

    Bit-parallel: a state has a bit for each line of `b`.  States are kept for every root-th line of `a` and made anew
    for one such block at a time on the way back, so memory grows with len(a) ** 0.5 * len(b) bits.
    """
    lead = len(commonprefix([a, b]))
    tail = len(commonprefix([a[lead:][::-1], b[lead:][::-1]]))
    out = {*range(lead), *range(len(a) - tail, len(a))}
    a, b = a[lead:len(a) - tail], b[lead:len(b) - tail]
    if not a or not b:
        return out
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    often = {x: sum(1 << j for j in places) for x, places in where.items() if len(places) > OFTEN}
    full = (1 << len(b)) - 1

    def states(v: int, lines: list) -> Iterator[int]:
        for x in lines:
            mask = often.get(x)
            if mask is None:
                mask = 0
                for j in where.get(x, ()):
                    mask |= 1 << j
            u = v & mask
            if u:
                v = (v + u | v - u) & full
            yield v

    step = math.isqrt(len(a)) + 1
    kept = [full, *itertools.islice(states(full, a), step - 1, None, step)]
    i, j = len(a), len(b)
    while i and j:
        base = (i - 1) // step * step
        block = [kept[base // step], *states(kept[base // step], a[base:i])]
        while i > base and j:
            bit = 1 << (j - 1)
            if block[i - base] & bit:
                j -= 1
            elif not block[i - base - 1] & bit:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.add(lead + i)
    return out


def url_host(url: str | Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one or for null."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.coalesce(F.when(F.instr(c, "://") > 0, F.regexp_extract(c, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: str | Column) -> Column:
    """After the host up to "?", "#" or the end."""
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.when(F.instr(c, "://") > 0, F.regexp_extract(c, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


class _Page:
    """A different page of a host: hashes and lengths of its lines."""

    __slots__ = ("host", "path", "id", "lines", "sizes", "total", "weight")

    def __init__(self, row):
        self.host, self.path, self.id = row.host, row.path, row.id
        self.lines, self.sizes = [int(x) for x in row.lines], [int(x) for x in row.sizes]
        self.total, self.weight = sum(self.sizes), {}
        for x, n in zip(self.lines, self.sizes, strict=True):
            self.weight[x] = self.weight.get(x, 0) + n


def near(a: _Page, b: _Page) -> bool:
    """Whether shared lines hold NEAR of the characters of the shorter page, and that one isn't much shorter."""
    if min(a.total, b.total) < HALF * max(a.total, b.total):
        return False
    least = NEAR * min(a.total, b.total)
    small, large = sorted((a.weight, b.weight), key=len)
    if sum(min(n, large.get(x, 0)) for x, n in small.items()) < least:
        return False
    return sum(a.sizes[i] for i in shared_lines(a.lines, b.lines)) >= least


def _linked(a: _Page, b: _Page) -> bool:
    """Whether neighbours are of one run."""
    return a.host == b.host and near(a, b)


def _before(pages: list[_Page], known: _Page | None) -> list[_Page | None]:
    """For each page the one before its run, if it is of the same host; known: that of the first run, beyond the range."""
    out, own = [], known
    for i, p in enumerate(pages):
        if i and not _linked(pages[i - 1], p):
            own = pages[i - 1]
        out.append(own if own is not None and own.host == p.host else None)
    return out


def _partner(page: _Page, before: _Page | None, after: _Page | None) -> _Page | None:
    best, most = None, -1
    for other in (before, after):
        if other is not None:
            common = len(commonprefix([page.path, other.path]))
            if common > most:
                best, most = other, common
    return best


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _digest(host: str, lines: list[tuple[str, int]]) -> str:
    return b64encode(hashlib.blake2b("\n".join([host, *[f"{kind}{text}" for text, kind in lines]]).encode("utf-8", "surrogatepass"), digest_size=12).digest()).decode()


def _lows(keys: DataFrame) -> list[tuple]:
    """Smallest key of each range, in order; as many as there are shuffle partitions."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keys.repartitionByRange(n, *KEY).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*KEY)).alias("low")).collect()
    return sorted(tuple(r["low"]) for r in found)


def _pages_of(frame: pd.DataFrame) -> list[_Page]:
    return [_Page(row) for row in frame.sort_values(KEY, kind="stable").itertuples(index=False)]


def _edges(frame: pd.DataFrame) -> pd.DataFrame:
    """Of each side of a range its outermost page (k = 0) and the one next to that page's run, if it is in the range (k = 1)."""
    pages, found = _pages_of(frame), []
    for side, line in (("first", pages), ("last", pages[::-1])):
        end = next((k for k in range(1, len(line)) if not _linked(line[k - 1], line[k])), len(line))
        found += [(int(frame["range"].iloc[0]), side, k, p.host, p.path, p.id, p.lines, p.sizes) for k, p in enumerate([line[0], *line[end:end + 1]])]
    return pd.DataFrame(found, columns=["range", "side", "k", "host", "path", "id", "lines", "sizes"])


def _known(edges: dict[tuple[int, str], list[_Page]], ranges: list[int], near_side: str, far_side: str) -> dict[int, _Page | None]:
    """For each range in order, the page before the run of its first page; sides as seen from the range behind."""
    out: dict[int, _Page | None] = {}
    for r, earlier in zip(ranges, [None, *ranges], strict=False):
        if earlier is None:
            out[r] = None
        elif not _linked(edges[earlier, far_side][0], edges[r, near_side][0]):
            out[r] = edges[earlier, far_side][0]
        else:  # the run goes on in the earlier range: the page before it there, or that range's own one
            out[r] = edges[earlier, far_side][1] if len(edges[earlier, far_side]) > 1 else out[earlier]
    return out


def _pairs(classes: DataFrame) -> DataFrame:
    """digest, mask (whether a line is shared with the partner) and partner of each different page that has one."""
    lows = _lows(classes.select(*KEY))

    @F.pandas_udf("int")
    def range_of(host: pd.Series, path: pd.Series, order: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([max(0, bisect.bisect_right(lows, key) - 1) for key in zip(host, path, order, digest, strict=True)], dtype="int32")

    dealt = classes.withColumn("range", range_of(*KEY))
    edges: dict[tuple[int, str], list[_Page]] = {}
    # at most four rows for each range
    rows = dealt.groupBy("range").applyInPandas(_edges, "range int, side string, k int, host string, path string, id string, lines array<long>, sizes array<int>").collect()
    for row in sorted(rows, key=lambda r: (r["range"], r["side"], r["k"])):
        edges.setdefault((row["range"], row["side"]), []).append(_Page(row))
    ranges = sorted({r for r, _ in edges})
    before, after = _known(edges, ranges, "first", "last"), _known(edges, ranges[::-1], "last", "first")

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(KEY, kind="stable")
        pages, r = _pages_of(frame), int(frame["range"].iloc[0])
        out = []
        for page, digest, kinds, a, b in zip(pages, frame["digest"], frame["kinds"], _before(pages, before[r]), reversed(_before(pages[::-1], after[r])), strict=True):
            partner = _partner(page, a, b)
            if partner:
                shared = shared_lines(page.lines, partner.lines)
                other = b if partner is a else a
                article = {i for i in shared if kinds[i] == 2}
                if article:
                    shared -= article - shared_lines(page.lines, other.lines) if other else article
                out.append((digest, [i in shared for i in range(len(page.lines))], partner.id))
        return pd.DataFrame(out, columns=["digest", "mask", "partner"])

    return dealt.groupBy("range").applyInPandas(pair, "digest string, mask array<boolean>, partner string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page, and lines, shared_lines, partner."""
    id_type = pages.schema[id_col].dataType
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"),
        url_host(F.col(url_col).cast("string")).alias("host"), url_path(F.col(url_col).cast("string")).alias("path"),
    )

    @F.pandas_udf("struct<digest:string,lines:array<long>,sizes:array<int>,kinds:array<int>>")
    def outline(host: pd.Series, html: pd.Series) -> pd.DataFrame:
        read = [page_lines(h or "") for h in html]
        return pd.DataFrame({"digest": map(_digest, host, read), "lines": [[_hash(t) for t, _ in x] for x in read], "sizes": [[len(t) for t, _ in x] for x in read], "kinds": [[k for _, k in x] for x in read]})

    @F.pandas_udf("struct<digest:string,texts:array<string>>")
    def read(host: pd.Series, html: pd.Series) -> pd.DataFrame:
        found = [page_lines(h or "") for h in html]  # lines that the check deletes become null
        return pd.DataFrame({"digest": [_digest(a, x) for a, x in zip(host, found, strict=True)], "texts": [[t if kind else None for t, kind in x] for x in found]})

    order = F.coalesce(F.col("id").cast("string"), F.lit(""))
    outlines = rows.where("host <> ''").select("host", "path", order.alias("order"), F.col("id").cast("string").alias("id"), outline("host", "html").alias("o")).select("host", "path", "order", "id", "o.*")
    first = F.min(F.struct("path", "order", "id", "lines", "sizes", "kinds"))
    classes = outlines.groupBy("host", "digest").agg(first.alias("f")).select("host", "digest", "f.*")
    pairs = _pairs(materialise(classes, "page-lines"))

    full = rows.select("id", "url", read("host", "html").alias("r")).select("id", "url", "r.*")
    joined = full.join(pairs, "digest", "left").withColumn("mask", F.coalesce("mask", F.transform("texts", lambda _: F.lit(False))))
    own = F.filter(F.arrays_zip("texts", "mask"), lambda x: x["texts"].isNotNull() & ~x["mask"])
    made = joined.withColumn("text", F.array_join(F.transform(own, lambda x: x["texts"]), "\n"))
    return made.select(
        F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"), F.size("texts").cast("long").alias("lines"),
        F.size(F.filter("mask", lambda x: x)).cast("long").alias("shared_lines"), F.col("partner").cast(id_type).alias("partner"),
    )
