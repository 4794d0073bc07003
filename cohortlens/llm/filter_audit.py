"""How filters of a corpus overlap: what each removes in every order of applying them.

Texts are measured by a table-driven transducer over their UTF-8 bytes.  CLASS gives the class of a
byte, NEXT the state after it (between words or in one) and ACTION what a byte does in a state: begin or end a
word, count a code point, a capital, a symbol.  Every entry of NEXT depends on the class alone, so
the states of a whole piece of bytes are one lookup shifted by a byte, and the actions another.  A long text
goes through in pieces of PIECE bytes; the state and the start of an open word pass on to the next.
The spans of the words go into a hash table of byte strings, which compares the bytes wherever hashes
agree, so the number of distinct words is exact.

Every row becomes its measures, the digest of its text and a bit for each filter that it fails.
Copies are found by the smallest id of each digest, from rows added up per digest before the
shuffle.  What is left to combine are counts for each set of failed filters within a part (a source): at most
2^k rows a part, which give all k! orders.

Defined results: words are maximal runs without ASCII white space, case-sensitive; a null text is the empty
text; a row with a null id is nobody's copy and has no label; rows with the same id and text are no copies of
each other (no smaller id); several labels of an id count as 1 if one of them is; a null part is the empty
string; an empty table gives no rows; other columns are ignored.  A stray byte that is no UTF-8 counts
as part of the code point before it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

PIECE = 1 << 20
GAP, WORD = 0, 1
WHITE, CAPITAL, SYMBOL, OTHER, LEAD, TAIL = range(6)
BEGINS, ENDS, POINT, UPPER, MARK = 1, 2, 4, 8, 16

#: Characters counted as symbols.
SYMBOLS = b"#$%&*|"

CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = WHITE
CLASS[ord("A"):ord("Z") + 1] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[0x80:0xC0] = TAIL
CLASS[0xC0:] = LEAD

NEXT = np.array([[GAP, WORD, WORD, WORD, WORD, WORD]] * 2, dtype=np.uint8)
ACTION = np.array([
    [POINT, BEGINS | POINT | UPPER, BEGINS | POINT | MARK, BEGINS | POINT, BEGINS | POINT, BEGINS],
    [ENDS | POINT, POINT | UPPER, POINT | MARK, POINT, POINT, 0],
], dtype=np.uint8)
_STEP = ACTION.ravel()
_COUNTED = [(_STEP & action > 0).astype(np.int64) for action in (BEGINS, POINT, UPPER, MARK)]


def measure_text(raw: bytes, piece: int = PIECE) -> tuple[int, int, int, int, int]:
    """(words, distinct words, code points, capitals, symbols) of UTF-8 bytes."""
    steps = np.zeros(_STEP.size, dtype=np.int64)
    table: set[bytes] = set()
    state, opened = GAP, []
    for at in range(0, len(raw), piece):
        classes = CLASS[np.frombuffer(raw, dtype=np.uint8, count=min(piece, len(raw) - at), offset=at)]
        states = np.empty_like(classes)
        states[0] = state
        states[1:] = NEXT[GAP][classes[:-1]]
        state = int(NEXT[GAP][classes[-1]])
        step = states * np.uint8(ACTION.shape[1]) + classes
        steps += np.bincount(step, minlength=_STEP.size)
        action = _STEP[step]
        begins = opened + (np.flatnonzero(action & BEGINS) + at).tolist()
        ends = (np.flatnonzero(action & ENDS) + at).tolist()
        table.update(map(raw.__getitem__, map(slice, begins, ends)))
        opened = begins[len(ends):]
    table.update(raw[start:] for start in opened)
    words, points, capitals, symbols = (int(steps @ counted) for counted in _COUNTED)
    return words, len(table), points, capitals, symbols


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, digest, n_words, n_distinct, n_points, n_capitals, n_symbols) of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, measures = [], []
            for value in batch.column("raw"):
                raw = value.as_py()
                digests.append(hashlib.sha256(raw).digest())
                measures.append(measure_text(raw))
            columns = np.array(measures, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), *[pa.array(c) for c in columns]],
                names=["id", "part", "digest", "n_words", "n_distinct", "n_points", "n_capitals", "n_symbols"])

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {id_type}, part string, digest binary, n_words long, n_distinct long, n_points long, n_capitals long, n_symbols long")


def rules(least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> dict[str, Column]:
    """The failure conditions on measures, by letter."""
    return {
        "A": F.col("n_words") < least_words,
        "B": 100 * F.col("n_distinct") < distinct_percent * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > capital_percent * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }


def failures(measured: DataFrame, labels: DataFrame, conditions: dict[str, Column], copies: str, id_col: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): rows, rows of quality 1 and rows of toxic 1 for each set of failed filters."""
    bits = _bits([*conditions, copies])
    fails = sum((F.when(c, F.lit(bits[f])).otherwise(0) for f, c in conditions.items()), F.lit(0))
    rows = measured.groupBy("id", "part", "digest", fails.alias("fails")).agg(F.count("*").alias("n"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    # rows of a text are added up in each task before they meet, however many copies there are
    named = F.col("id").isNotNull()
    groups = materialise(rows.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(named, F.struct("id", "n"))).alias("first"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("unnamed")), "audit-texts")
    least = groups.groupBy("digest").agg(F.min("first.id").alias("least"))
    groups = groups.join(least, "digest")
    fresh = F.coalesce(F.when(F.col("first.id") == F.col("least"), F.col("first.n")), F.lit(0)) + F.col("unnamed")
    split = F.array(F.struct(F.col("fails"), fresh.alias("n")), F.struct((F.col("fails") + bits[copies]).alias("fails"), (F.col("n") - fresh).alias("n")))
    counted = groups.select("part", "good", "toxic", F.explode(split).alias("s")).where("s.n > 0")
    return counted.groupBy("part", F.col("s.fails").alias("fails")).agg(
        F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))


def _bits(letters: list[str]) -> dict[str, int]:
    if len(letters) > 6 or len(set(letters)) < len(letters) or any(len(f) != 1 for f in letters):
        raise ValueError("at most six filters, each with a letter of its own")
    return {f: 1 << k for k, f in enumerate(sorted(letters))}


def interactions(counts: DataFrame, letters: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from `failures`.

    A step is known by its filter and the set of those before it, so sums are made for k 2^(k-1)
    pairs a part, and the k! orders only look them up.  The table of orders has k k! rows (k is at most 6).
    """
    bits = _bits(letters)
    k = len(bits)
    steps = [(f, sum(before)) for f in bits.values() for size in range(k) for before in combinations([b for b in bits.values() if b != f], size)]
    pairs = counts.withColumn("pair", F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before")) for f, b in steps])))
    own, earlier = F.col("fails").bitwiseAND(F.col("pair.filter")) > 0, F.col("fails").bitwiseAND(F.col("pair.before")) > 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    removed = own & ~earlier
    sums = pairs.groupBy("part", F.col("pair.filter").alias("filter"), F.col("pair.before").alias("before")).agg(
        total(~own & ~earlier).alias("kept"), total(removed).alias("removed"), total(own & earlier).alias("redundant"),
        total(F.col("fails") == F.col("pair.filter")).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"))
    spark = counts.sparkSession
    # each set of filters before f comes before it in |set|! (k - 1 - |set|)! orders
    weights = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), F.bit_count("before") + 1)
    shapley = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * weights).alias("shapley"))
    orders = [("".join(order), s + 1, bits[f], sum(bits[e] for e in order[:s])) for order in permutations(sorted(letters)) for s, f in enumerate(order)]
    order_table = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter int, before int"))
    result = sums.join(shapley, ["part", "filter"]).join(order_table, ["filter", "before"])
    return result.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The rows of `interactions` for the filters `conditions` (failure conditions on measures) and copies of earlier texts."""
    conditions = rules() if conditions is None else conditions
    counts = failures(measure(docs, id_col, text_col, part_col), labels, conditions, copies, id_col)
    return interactions(counts, [*conditions, copies])
