"""Size-aware heavy-light Jaccard join over word n-gram sets.

Two sets link when 100 * |common| >= 80 * |union| (as parameters), that is when they share
c(a, b) = ceil(t (a + b) / (1 + t)) elements.  Documents with the same set are one class.

* Light sets (size up to a boundary) enumerate their subsets of the fixed size c(a, b) for each
  size of a light partner.  A subset is keyed by the sum of the hashes of its elements, so the
  subsets come from the few elements left out.  Sets under one key share c(a, b) elements:
  the smallest set there is linked with every other one, without a check of the texts.
* Heavy sets (and the light ones that a heavy one can link with) are found by scanning inverted
  lists of the elements in which a linked pair must meet: the first n - ceil(t n) + 1 in a common
  order, rarest first.  Frequencies come from a count table of fixed size over all documents.
* The boundary is the largest size up to which enumerating costs no more rows than scanning,
  from the sizes of all classes.

The sets of a list are ranked by the number of lists that they share, and the first one leads; a set is checked
against the leader it meets in most lists, then, as long as they are not in one component, against other
leaders.  Only sets of different components that still share a list are paired, where they meet early enough in both, and in
blocks of at most `split` sets a side; and whatever the pair, only sets sharing enough
of their list elements for a link to be possible are compared on whole texts.  No link between different components is lost, so the
components are exact.

No list is one task.  The count table is never below an element's true count, so a list that it gives at most `split`
sets is short; the rows of any other list, and of all subset keys, are dealt out by set, counted exactly per key (added up in
each task first), dropped if the key has one set only, and dealt into parts with a leader each if there are more
than `split`.  The table has a counter for some 512 words of the corpus, up to MOST_COUNTERS (64 MB); in a corpus beyond that more
lists take the exact count, with the same result.

Defined results: words are maximal runs without ASCII white space, A-Z lower-cased; a text with
fewer than `words` words has its whole sequence as only element; without words or with null
text the set is empty and links with nothing; rows with a null id give (null, size, null) and
link with nothing; a repeated row is the same document (one output row for each input row);
other columns of the input are ignored.  Sets are told apart by a 64-bit hash.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, materialise_by, text_or_empty
from .components import components

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], dtype=np.uint64)
LEAST_COUNTERS, MOST_COUNTERS, CHUNKS = 1 << 16, 1 << 24, 64  # the count table, and the rows it travels in
FAN_IN = 64  # count rows added up by one task
SPREAD = (1 << 31) - 2  # part numbers of rows that are dealt out by set
PIECE, LONG = 1 << 18, 256  # bytes hashed at a time, and of the longest word hashed by its bytes' values
LIGHT_MOST = 32  # sizes looked at for the boundary
LEADERS = 5  # sets of a list that others are checked against one by one


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_WHITE = b" \t\n\v\f\r"


def _tables() -> tuple[np.ndarray, ...]:
    """(value of a byte: A-Z as a-z, white space 0; is it white; powers of an odd number; powers of its inverse modulo 2 ** 64)."""
    values = _mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIERS[0])
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    white = np.zeros(256, dtype=bool)
    white[list(_WHITE)] = True
    values[white] = 0
    base = int(_MULTIPLIERS[1]) | 1
    powers = [np.cumprod(np.append(np.uint64(1), np.full(PIECE, x % (1 << 64), dtype=np.uint64))) for x in (base, pow(base, -1, 1 << 64))]
    return values, white, *powers


_VALUE, _IS_WHITE, _POWER, _INVERSE = _tables()


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of at most PIECE bytes, cut at white space; a longer word is a piece by itself."""
    at = 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(c, at + 1, at + PIECE) for c in _WHITE)
        if cut < 0:
            later = [k for k in (raw.find(c, at + PIECE) for c in _WHITE) if k >= 0]
            cut = min(later) if later else len(raw)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order: a polynomial in its bytes' values, xxh3 for words of over LONG bytes."""
    out = []
    for piece in _pieces(raw):
        if len(piece) > PIECE:
            out.append(np.array([xxhash.xxh3_64_intdigest(piece.lower().strip())], dtype=np.uint64))
            continue
        data = np.frombuffer(piece, dtype=np.uint8)
        white = _IS_WHITE[data]
        starts = np.flatnonzero(white[:-1] > white[1:]) + 1
        if len(data) and not white[0]:
            starts = np.append(0, starts)
        if not len(starts):
            continue
        h = np.add.reduceat(_VALUE[data] * _POWER[:len(data)], starts) * _INVERSE[starts]
        if (far := np.flatnonzero(np.diff(starts, append=len(data)) > LONG)).size:
            for k in far:
                word = piece[starts[k]:starts[k + 1] if k + 1 < len(starts) else len(data)].strip()
                if len(word) > LONG:
                    h[k] = xxhash.xxh3_64_intdigest(word.lower())
        out.append(h)
    return _mix(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text."""
    h = word_hashes(text.encode("utf-8", "replace"))
    n = len(h)
    if not n:
        return h
    width = min(words, n)
    grams = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        grams += h[k:n - width + 1 + k] * _MULTIPLIERS[k % 8] * np.uint64(2 * (k // 8) + 1)
    grams = np.sort(_mix(grams + np.uint64(width)))
    return grams[np.append(True, grams[1:] != grams[:-1])]


def signature(s: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Rule:
    """The link rule 100 |common| >= percent |union| in integers."""

    def __init__(self, percent: int = 80):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent = percent

    def common(self, a: int, b: int) -> int:
        """Elements that sets of sizes a and b must share."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def fits(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b)

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def subsets(self, n: int, boundary: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, elements left out) for each size of a light partner."""
        out = []
        for m in range(1, boundary + 1):
            if self.fits(n, m) and (c := self.common(n, m)) <= min(n, m):
                out.append((min(n, m), max(n, m), n - c))
        return out

    def light_rows(self, n: int, boundary: int) -> int:
        return sum(math.comb(n, left) for *_, left in self.subsets(n, boundary))


def _counters(docs: DataFrame) -> int:
    """Size of the count table: a power of two, a counter for some 512 words of the corpus (six bytes each), within bounds."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(1 << (total // (6 * 512)).bit_length(), LEAST_COUNTERS), MOST_COUNTERS)


def _counter_of(s: np.ndarray, counters: int) -> np.ndarray:
    return (s >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _first_pass(docs: DataFrame, words: int, counters: int) -> DataFrame:
    """(id, n, sig) of every document, and the counts of every task in CHUNKS rows."""
    id_type = docs.schema["id"].dataType
    step = counters // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, dtype=np.int32)
        task = TaskContext.get().partitionId()
        for batch in _slices(batches, 1024):
            n, sig, waiting, size = [], [], [], 0
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                sig.append(signature(s))
                waiting.append(s)
                size += len(s)
                if size > 500_000:
                    _count(counts, waiting)
                    size = 0
            _count(counts, waiting)
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int32()), pa.array(sig, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["id", "n", "sig", "task", "chunk", "counts"])
        parts = [counts[c * step:(c + 1) * step].tobytes() for c in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, batch_id_type), pa.nulls(CHUNKS, pa.int32()), pa.nulls(CHUNKS, pa.int64()), pa.array([task] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["id", "n", "sig", "task", "chunk", "counts"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_id_type = to_arrow_type(id_type)
    return docs.mapInArrow(run, f"id {id_type.simpleString()}, n int, sig long, task int, chunk int, counts binary")


def _count(counts: np.ndarray, waiting: list[np.ndarray]) -> None:
    """Add the elements of some sets and forget them."""
    if waiting:
        places, new = np.unique(_counter_of(np.concatenate(waiting), len(counts)), return_counts=True)
        counts[places] += new.astype(np.int32)
        waiting.clear()


def _count_table(rows: DataFrame, counters: int) -> np.ndarray:
    """The summed counts, FAN_IN rows at a time; `counters` numbers reach the driver.  Counts end at the largest 32-bit number."""

    def add(group):
        total = sum(np.frombuffer(c, dtype=np.int32).astype(np.int64) for c in group["counts"])
        return group.iloc[:1].assign(counts=[np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()])

    some = rows.where("chunk is not null").select("chunk", "task", "counts")
    tasks = (some.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        some = some.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("chunk", "task").applyInPandas(add, "chunk int, task int, counts binary")
        tasks = -(-tasks // FAN_IN)
    out = np.zeros(counters, dtype=np.int32)
    step = counters // CHUNKS
    for r in some.toLocalIterator():
        out[r["chunk"] * step:(r["chunk"] + 1) * step] = np.frombuffer(r["counts"], dtype=np.int32)
    return out


def boundary_by_cost(rule: Rule, sizes: dict[int, int], scan: float = 2.0) -> int:
    """The largest light size; a scanned list element costs `scan` rows, as lists are read and checked later."""
    best = 0
    for b in range(1, LIGHT_MOST + 1):
        light = sum(sizes.get(n, 0) * rule.light_rows(n, b) for n in range(1, b + 1))
        heavy = sum(sizes.get(n, 0) * rule.prefix(n) * scan for n in range(1, b + 1))
        if light <= heavy:
            best = b
    return best


def _second_pass(docs: DataFrame, words: int, rule: Rule, boundary: int, table, split: int) -> DataFrame:
    """Rows (key, part, sig, n, light): subset keys of light sets (light: the smaller size of the subset's
    pair), list elements of the others (light: -1 less the place among the list elements).  Part 0 is
    a list of at most `split` sets; other rows have a part by their set."""
    least_heavy = -(-rule.percent * (boundary + 1) // 100)

    def light(s: np.ndarray) -> list[tuple[int, int]]:
        total, values, n, out = int(s.sum(dtype=np.uint64)), s.tolist(), len(s), []
        for a, b, left in rule.subsets(n, boundary):
            salt = (a * 1000003 + b) * 0x9E3779B97F4A7C15
            for gone in combinations(values, left):
                key = (total - sum(gone) ^ salt) & 0xFFFFFFFFFFFFFFFF
                out.append((key, a))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = table.value, set()
        for batch in _slices(batches, 1024):
            keys, parts, sigs, sizes, lights = [], [], [], [], []

            def flush():
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (keys, parts, sigs, sizes, lights)], names=["key", "part", "sig", "n", "light"])
                for x in (keys, parts, sigs, sizes, lights):
                    x.clear()
                return out

            waiting = 0
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                n = len(s)
                sig = signature(s)
                if not n or sig in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sig)
                found = []
                if n <= boundary:
                    subset = light(s)
                    found.append((np.array([k for k, _ in subset], dtype=np.uint64).view(np.int64), np.full(len(subset), 1 + sig % SPREAD, dtype=np.int32), np.array([a for _, a in subset], dtype=np.int32)))
                if n >= least_heavy:
                    count = counts[_counter_of(s, len(counts))]
                    first = np.argsort(count, kind="stable")[:rule.prefix(n)]
                    part = np.where(count[first] > split, 1 + sig % SPREAD, 0).astype(np.int32)
                    found.append((s[first].view(np.int64), part, -1 - np.arange(len(first), dtype=np.int32)))
                for key, part, small in found:
                    m = len(key)
                    keys.append(key)
                    parts.append(part)
                    sigs.append(np.full(m, sig, dtype=np.int64))
                    sizes.append(np.full(m, n, dtype=np.int32))
                    lights.append(small)
                    waiting += m
                if waiting > 200_000:
                    yield flush()
                    waiting = 0
            if waiting:
                yield flush()

    return docs.mapInArrow(run, "key long, part int, sig long, n int, light int")


def _jaccard_links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets link, compared on whole texts."""
    both = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in _slices(batches):
            keep = []
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if last != b:
                    last, other = b, shingle_set(y, words)
                one = shingle_set(x, words)
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, split: int = 4096, counters: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row; `counters` (a power of two from CHUNKS on) sets the size of the count table."""
    rule = Rule(percent)
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    counters = counters or _counters(source)
    first = materialise(_first_pass(source, words, counters), "sets")
    sets = first.where("chunk is null").select("id", "n", "sig")
    table = spark.sparkContext.broadcast(_count_table(first, counters))
    classes = sets.where("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    boundary = boundary_by_cost(rule, sizes)

    lists = shared_lists(_second_pass(source.where("id is not null"), words, rule, boundary, table, split), split)

    light = lists.where("light > 0 and smallest.n = light and sig != smallest.sig").select(F.col("sig").alias("a"), F.col("smallest.sig").alias("b"))
    heavy = lists.where("light < 0").select("key", "part", "sig", "n", (-1 - F.col("light")).alias("place"))
    # a set that shares many of its elements is the likeliest to link with others: it leads its lists
    weight = heavy.groupBy("sig").agg(F.count("*").alias("weight"))
    own = Window.partitionBy("key", "part").orderBy(F.desc("weight"), "sig")
    ranked = heavy.join(weight, "sig").withColumns({"rank": F.row_number().over(own), "leader": F.first(F.struct("sig", "n")).over(own)})
    heavy = materialise(ranked, "ranked")
    elements = materialise(heavy.groupBy("sig").agg(F.first("n").alias("n"), F.collect_set("key").alias("keys")), "elements")
    texts = _texts(source.where("id is not null"), elements.select("sig"), words)

    parts = heavy.where("part > 0 and rank = 1")
    between = parts.withColumn("leader", F.first(F.struct("sig", "n")).over(Window.partitionBy("key").orderBy(F.desc("weight"), "sig")))
    led = heavy.select(F.col("sig").alias("a"), F.col("leader.sig").alias("b")).union(between.select("sig", "leader.sig")).where("a != b")
    met = materialise(_possible(led.groupBy("a", "b").agg(F.count("*").alias("lists")), elements, percent), "met")
    best = met.groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b"))
    roots = components(light.union(_jaccard_links(best, texts, words, percent)))

    leaders = heavy.where(F.col("rank").between(2, LEADERS)).select("key", "part", F.col("sig").alias("b"))
    star = heavy.select("key", "part", F.col("sig").alias("a")).join(leaders, ["key", "part"]).where("a != b").select("a", "b")
    apart = _apart(star.union(met.select("a", "b")).distinct().join(best, ["a", "b"], "left_anti"), roots)
    roots = components(roots.union(_jaccard_links(_possible(apart, elements, percent), texts, words, percent)))

    rooted = heavy.select("key", "sig", "n", "place").join(roots.withColumnRenamed("v", "sig"), "sig", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "sig")), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("sets")).where("lo != hi")
    # the sets of a list in blocks, each block against each
    left = rooted.join(mixed.select("key", F.ceil(F.col("sets") / split).cast("int").alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x, y = (left.select("key", F.col("block").alias(f"block_{side}"), every.alias(f"block_{other}"), *[F.col(c).alias(f"{c}_{side}") for c in ("sig", "n", "place", "root")]) for side, other in ("ab", "ba"))
    least = _least_common(F.col("n_a"), F.col("n_b"), percent)
    early = (F.col("place_a") <= _prefix(F.col("n_a"), percent) - least) & (F.col("place_b") <= _prefix(F.col("n_b"), percent) - least)
    pairs = x.join(y, ["key", "block_a", "block_b"]).where((F.col("sig_a") < F.col("sig_b")) & (F.col("root_a") != F.col("root_b")) & early & _near(F.col("n_a"), F.col("n_b"), percent))
    pairs = pairs.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")).distinct()
    roots = components(roots.union(_jaccard_links(_possible(pairs, elements, percent), texts, words, percent))).withColumnRenamed("v", "sig")
    named = classes.join(roots, "sig", "left").select("sig", "id", F.coalesce("root", "sig").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = named.join(smallest, "root").select("sig", "component_id")
    result = sets.join(of_class, "sig", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return result.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))


def shared_lists(rows: DataFrame, split: int) -> DataFrame:
    """The different rows (key, part, sig, n, light, smallest) of keys with two sets or more, in parts of some `split` sets.

    The rows of part 0 are whole lists already; the others are counted per key first.  `smallest` is the smallest
    set (n, sig) under a subset key."""
    listed = Window.partitionBy("key", "part", "kind")
    rows = rows.withColumn("kind", F.greatest("light", F.lit(0))).withColumns({"lo": F.min("sig").over(listed), "hi": F.max("sig").over(listed)})
    # the same set from several tasks; its rows are in one partition by now
    once = rows.where("part > 0 or lo != hi").select("key", "part", "kind", "sig", "n", "light").distinct()
    lists = materialise(once, "lists")
    dealt = lists.where("part > 0")
    counted = dealt.groupBy("key", "kind").agg(F.count("*").alias("sets"), F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.min(F.struct("n", "sig")).alias("smallest")).where("lo != hi")
    dealt = dealt.join(counted, ["key", "kind"])
    part = F.when((F.col("sets") > split) & (F.col("kind") == 0), 1 + F.pmod(F.xxhash64("sig"), F.ceil(F.col("sets") / split))).otherwise(0).cast("int")
    dealt = dealt.select("key", part.alias("part"), "sig", "n", "light", "smallest")
    short = lists.where("part = 0").select("key", "part", "sig", "n", "light", F.lit(None).cast("struct<n:int,sig:bigint>").alias("smallest"))
    return short.union(dealt)


def _texts(source: DataFrame, live: DataFrame, words: int) -> DataFrame:
    """One text for each set in a list (any of its documents': they have the same elements), dealt out by set.

    The texts travel once: the table is bucketed by set, so that no later join with it moves them again."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in _slices(batches):
            sigs = [signature(s) if len(s := shingle_set(t, words)) else None for t in batch.column("text").to_pylist()]
            first = []
            for sig in sigs:
                first.append(sig is not None and sig not in seen)
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sig)
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), batch.column("text")], names=["sig", "text"]).filter(pa.array(first, pa.bool_()))

    found = source.select("text").mapInArrow(named, "sig long, text string")
    return materialise_by(found.join(live, "sig", "left_semi").dropDuplicates(["sig"]), "texts", "sig")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that few texts are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _near(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow a link."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _prefix(n: Column, percent: int) -> Column:
    """List elements of a set of n."""
    return n - F.ceil(percent * n / F.lit(100)) + 1


def _least_common(n: Column, m: Column, percent: int) -> Column:
    """List elements that linked sets have in common at least.

    All common elements up to the earlier one of the two last list elements are list elements of both,
    and after it only the rest of that set is left.  So the first common one is no later
    than this number of places before the end of either set's list elements."""
    needed = F.ceil(percent * (n + m) / F.lit(100 + percent))
    rest = F.greatest(n - _prefix(n, percent), m - _prefix(m, percent))
    return F.greatest(needed - rest, F.lit(1))


def _possible(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ...) with sizes and common list elements that allow a link."""
    x, y = (elements.select(*[F.col(c).alias(f"{c}_{side}") for c in ("sig", "n", "keys")]) for side in "ab")
    both = pairs.join(x, F.col("a") == F.col("sig_a")).join(y, F.col("b") == F.col("sig_b"))
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    return both.where(_near(F.col("n_a"), F.col("n_b"), percent) & (common >= _least_common(F.col("n_a"), F.col("n_b"), percent))).select(*pairs.columns)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) not yet in one component."""
    ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
