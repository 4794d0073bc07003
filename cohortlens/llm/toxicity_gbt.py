"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features per whole text (`NAMES`): densities of a fixed and of a learned lexicon, hits
close to a second-person word, capitals, punctuation, and hits of either lexicon that only
appear once obfuscation (look-alike digits, signs and letters of other scripts, single
letters with separators) is undone.

Learning uses at most about `sample` labelled rows outside the held-out fold, chosen by a
hash of the id (a documented bound: the broadcast id list, the lexicon, the trees and the
calibration stay bounded on any corpus).  The sample is dealt into three parts by another hash:
lexicon (every word and word beginning whose document frequency among label 1 is
significantly high, so inflected and compound forms are found too), trees, and
calibration; if a part lacks one of the classes, all three use every row.  Scoring reads
every document in one pass without a shuffle.

Defined results: a null or empty text is scored as the empty text; a null id is never
learned from and has held_out null; repeated rows are scored one by one, and of repeated
labels the largest counts; with no labelled row of one of the classes every score is the
share of label 1 among the rows learned from (0 with none).
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialise, text_or_empty

#: Insults and slurs-free abuse words known beforehand (fixed values).
FIXED_LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown "
    "imbecile filth filthy vermin jerk creep coward freak ugly useless hateful brainless repulsive "
    "idiote imbécile crétin abruti débile ordure dummkopf trottel arschloch abschaum widerlich wertlos "
    "idiota imbécil estúpido estúpida basura escoria asqueroso inútil".split()
)
#: Words that address the reader (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted tú tus ustedes".split())

_WORD = re.compile(r"\w+")
#: Signs and letters of other scripts that stand for Latin letters, in pairs (fixed values).
_SIGNS, _LATIN = "013457@$!|" "аеорсухіѕјԁӏ" "οανικρτυ", "oieastasii" "aeopcyxisjdl" "oavikptu"
_LOOKALIKE = str.maketrans(_SIGNS, _LATIN)
_HIDDEN = re.compile("[0-9" + re.escape(_SIGNS) + "]")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w){2,}(?!\w)")
NEAR = 5
STEMS = range(4, 8)  # lengths of the word beginnings in a learned lexicon


def _forms(word: str) -> list[str]:
    """The lexicon entries that a word matches: itself, closed by a blank, and its beginnings."""
    return [word + " ", *(word[:k] for k in STEMS if k <= len(word))]


def undone(lower: str) -> list[str]:
    """Words of a lower-case text that stand there only once look-alikes and separators are undone."""
    out = []
    if _HIDDEN.search(lower):
        for chunk in lower.split():
            if _HIDDEN.search(chunk):
                seen = set(_WORD.findall(chunk))
                out += [w for w in _WORD.findall(chunk.strip(".,;:?!\"'()").translate(_LOOKALIKE)) if w not in seen]
    out += ["".join(c for c in run if c.isalnum()) for run in _SPACED.findall(lower)]
    return out


def _sketch(text: str) -> int:
    """Least hash of five words in a row: most near copies of a text share it."""
    words = _WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i:i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))), default=0)


NAMES = (
    "fixed_density", "fixed_hits", "fixed_distinct", "learned_density", "learned_hits", "near_second_person",
    "hidden_hits", "hidden_density", "capital_words", "exclamations", "punctuation", "log_words",
)


def toxic_stats(text: str, learned: frozenset[str]) -> list[float]:
    lower = text.lower()
    tokens = _WORD.findall(lower)
    n = max(len(tokens), 1)
    kinds = set(tokens)
    fixed = FIXED_LEXICON & kinds
    extra = {w for w in kinds if not learned.isdisjoint(_forms(w))} if learned else set()
    fixed_hits = extra_hits = near = 0
    if fixed or extra:
        count = Counter(tokens)
        fixed_hits = sum(count[w] for w in fixed)
        extra_hits = sum(count[w] for w in extra)
        if SECOND_PERSON & kinds:
            both = fixed | extra
            near = sum(not SECOND_PERSON.isdisjoint(tokens[max(0, i - NEAR):i + NEAR + 1]) for i, w in enumerate(tokens) if w in both)
    hidden = sum(w in FIXED_LEXICON or not learned.isdisjoint(_forms(w)) for w in undone(lower))
    size = max(len(text), 1)
    return [
        100.0 * fixed_hits / n, math.log1p(fixed_hits), float(len(fixed)), 100.0 * extra_hits / n, math.log1p(extra_hits),
        100.0 * near / n, float(hidden), 100.0 * hidden / n,
        sum(map(str.isupper, text.split())) / n, 100.0 * text.count("!") / size,
        100.0 * sum(map(text.count, ".,;:?'\"-")) / size, math.log1p(len(tokens)),
    ]


@dataclass
class Toxicity:
    share: float
    lexicon: frozenset[str] = frozenset()
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """`docs` with column `out` (double, 0 to 1); every other column is kept as it is."""
        if self.trees is None:
            return docs.withColumn(out, F.lit(float(self.share)))
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out]).alias("_row"), stats_column(text_or_empty(text_col), self.lexicon).alias("_stats"))
        margins = _margin(self.trees, rows)
        curved = self.curve.transform(margins)
        return curved.select("_row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))).alias(out))


def stats_column(text, learned: frozenset[str]):
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([toxic_stats(t, learned) for t in texts])

    return stats(text)


def _margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = trees.transform(rows.withColumn("_x", array_to_vector("_stats")))
    return scored.withColumn("_margin", vector_to_array("rawPrediction")[1])


def learn_lexicon(rows: DataFrame, odds: float = 15.0, chance: float = 1e-3) -> frozenset[str]:
    """Words and beginnings whose document frequency in label-1 texts is too high for chance, all of them.

    Near copies count once: of the texts of one sketch and label the least stands for all, so the vocabulary
    of one group of copies isn't learned.  With share p of label 1, an entry in n texts, c of them of label 1, is
    taken if it is `odds` times likelier there and the Chernoff bound exp(-n KL(c / n, p)) on seeing so many is at
    most `chance` divided by the number of entries tested.
    """

    @F.pandas_udf("long")
    def sketch(texts: pd.Series) -> pd.Series:
        return texts.map(_sketch).astype("int64")

    rows = materialise(rows.groupBy("y", sketch("text").alias("sketch")).agg(F.min("text").alias("text")).select("text", "y"), "toxic-distinct")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                lower = text.lower()
                found[y].update({f for w in {*_WORD.findall(lower), *undone(lower)} for f in _forms(w)})
            if len(found[0]) + len(found[1]) > 500_000:
                yield frame(found)
                found[0].clear()
                found[1].clear()
        yield frame(found)

    def frame(found: tuple[Counter, Counter]) -> pd.DataFrame:
        words = list(found[0].keys() | found[1].keys())
        return pd.DataFrame({"word": pd.Series(words, dtype=object), "c0": [found[0][w] for w in words], "c1": [found[1][w] for w in words]})

    totals = rows.agg(F.count("y").alias("n"), F.sum("y").alias("n1")).first()
    p = totals["n1"] / totals["n"]
    counts = rows.select("text", "y").mapInPandas(count, "word string, c0 long, c1 long").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    counts = materialise(counts, "toxic-words")
    q, n = F.expr("c1 / (c0 + c1)"), F.expr("c0 + c1")
    surprise = n * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    likelier = (F.col("c1") > 0) & (q > p) & (F.col("c1") >= odds * F.col("c0") * p / (1 - p))
    best = counts.where(likelier).where(surprise >= math.log(max(counts.count(), 1) / chance))
    # bounded by the words of the sample
    return frozenset(r["word"] for r in best.select("word").collect())


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, held_out: int = 2, sample: int = 20_000,
    trees: int = 15, depth: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> Toxicity:
    usable = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
        .where(crc_fold("_id", folds) != held_out)
    )
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < (1 << 20) * sample // n)
    # at most about `sample` ids: a bounded broadcast
    picked = docs.select(F.col(id_col).alias("_key"), text_or_empty(text_col).alias("text")).join(F.broadcast(usable), F.col("_key") == F.col("_id"))
    picked = materialise(picked.select("text", "y", F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(5)).cast("int").alias("part")), "toxic-sample")
    totals = picked.agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    share = totals["n1"] / totals["n"] if totals["n"] else 0.0
    if share in (0.0, 1.0):
        return Toxicity(share)
    there = {(r["part"], r["y"]) for r in picked.select("part", "y").distinct().collect()}
    dealt = all(any((k, y) in there for k in parts) for parts in ((0, 1), (2, 3), (4,)) for y in (0, 1))
    of = lambda df, *k: df.where(F.col("part").isin(*k)) if dealt else df
    lexicon = learn_lexicon(of(picked, 0, 1))
    rows = materialise(picked.select("y", "part", stats_column(F.col("text"), lexicon).alias("_stats")).repartition(4), "toxic-stats")
    model = GBTClassifier(labelCol="y", featuresCol="_x", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1)
    fitted = model.fit(of(rows, 2, 3).select(F.col("y").cast("double").alias("y"), array_to_vector("_stats").alias("_x")))
    margins = _margin(fitted, of(rows, 4)).select(F.col("y").cast("double").alias("y"), "_margin")
    curve = IsotonicRegression(labelCol="y", featuresCol="_margin", predictionCol="_score").fit(margins)
    return Toxicity(share, lexicon, fitted, curve)
