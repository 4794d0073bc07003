import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import quality_qda, toxicity_gbt
from cohortlens.llm.common import table
from cohortlens.llm.queries import QUERIES
from cohortlens.llm.text_stats import NAMES, text_stats
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def auc(rows):
    s = np.array([r["score"] for r in rows])
    y = np.array([r["y"] for r in rows]) == 1
    diff = s[y][:, None] - s[~y][None, :]
    return ((diff > 0) + 0.5 * (diff == 0)).mean()


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least"), [("op3_quality_qda", "quality", 5, 0, 0.93), ("op4_toxicity_gbt", "toxic", 4, 2, 0.75)])
def test_held_out_accuracy(spark, name, label, folds, fold, least):
    got = QUERIES[name](spark, SF).cache()
    assert got.count() == table(spark, SF, "documents").count()
    assert got.where("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.3 as int)").count() == 0
    for r in got.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
    labels = table(spark, SF, "labels").select("doc_id", F.col(label).alias("y"))
    assert auc(got.where("held_out").join(labels, "doc_id").collect()) >= least
    got.unpersist()


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a", "x" * 200_000, "word " * 50_000, "\ud800", "日本 é!"])
def test_statistics_are_finite(text):
    assert len(text_stats(text)) == len(NAMES) and np.isfinite(text_stats(text)).all()
    if text != "\ud800":
        assert np.isfinite(toxicity_gbt.toxic_stats(text, frozenset({"word "}))).all()


def learnable(documents, spark, bad):
    """400 documents, every fourth bad(k); labels of ids below 300, some odd ones among them."""
    rows = [(k, bad(k) if k % 4 == 0 else prose(k, 30 + k % 50)) for k in range(400)] + [(None, "no id"), (1000, None), (1001, ""), (3, prose(3, 33))]
    labels = [(k, int(k % 4 != 0), int(k % 4 == 0)) for k in range(300)] + [(None, 1, 1), (5, None, None), (7, 9, 9), (2, 1, 0), (99_999, 0, 1)]
    return documents(rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_junk(documents, spark):
    docs, labels = learnable(documents, spark, lambda k: "$$$ ### " * (5 + k % 40))
    stats = quality_qda.document_stats(docs)
    model = quality_qda.fit(quality_qda.labelled(stats, labels, "quality", 5, 0))
    rows = stats.select("doc_id", quality_qda.score_column(model, F.col("stats")).alias("score")).collect()
    assert len(rows) == 404
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in rows if r["doc_id"] is not None and 300 <= r["doc_id"] < 400)


def test_factors_give_the_log_density():
    r = np.random.default_rng(0)
    cov = np.cov(r.normal(size=(50, 3)).T) + np.eye(3)
    low = np.linalg.inv(np.linalg.cholesky(cov))
    x = r.normal(size=(4, 3))
    assert np.allclose(((x @ low.T) ** 2).sum(axis=1), np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x))


def test_toxicity_on_insults(documents, spark):
    docs, labels = learnable(documents, spark, lambda k: prose(k, 30) + " you zzgrok" + "abc"[k % 3] + " zzgrokk " + prose(k + 1, 9))
    model = toxicity_gbt.fit(docs, labels)
    scored = model.score(docs, out="toxic_score")
    assert scored.columns == [*docs.columns, "toxic_score"]
    rows = scored.select("doc_id", F.col("toxic_score").alias("score")).collect()
    assert len(rows) == 404
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in rows if r["doc_id"] is not None and 300 <= r["doc_id"] < 400)


def test_hidden_insults_count():
    at = toxicity_gbt.NAMES.index("hidden_hits")
    assert toxicity_gbt.toxic_stats("such an 1d10t, what a m0r0n and i.d.i.o.t here", frozenset())[at] == 3
    assert toxicity_gbt.toxic_stats("in 2010 it cost 35 euro", frozenset())[at] == 0


def test_look_alikes_of_other_scripts_and_learned_entries_count():
    at = toxicity_gbt.NAMES.index("hidden_hits")
    assert toxicity_gbt.toxic_stats("du іdiоt und ѕtupid", frozenset())[at] == 2
    assert toxicity_gbt.toxic_stats("a zzgr0k and z.z.g.r.o.k, not zzgrok", frozenset({"zzgrok "}))[at] == 2
    assert toxicity_gbt.toxic_stats("Привет, как дела", frozenset())[at] == 0


def plain_features(text, learned):
    """The definition of the features, one token at a time."""
    low = text.lower()
    tokens = re.findall(r"\w+", low)
    bad = lambda w: any(w + " " == e or (e[-1] != " " and w.startswith(e)) for e in learned)
    is_fixed, is_learned = [w in toxicity_gbt.FIXED_LEXICON for w in tokens], [bad(w) for w in tokens]
    near = sum(
        (f or e) and any(tokens[j] in toxicity_gbt.SECOND_PERSON for j in range(len(tokens)) if abs(i - j) <= 5)
        for i, (f, e) in enumerate(zip(is_fixed, is_learned))
    )
    n, size = max(len(tokens), 1), max(len(text), 1)
    hidden = 0
    for chunk in low.split():
        for w in re.findall(r"\w+", "".join(dict(zip("013457@$!|", "oieastasii")).get(c, c) for c in chunk.strip(".,;:?!\"'()"))):
            hidden += w not in re.findall(r"\w+", chunk) and (w in toxicity_gbt.FIXED_LEXICON or bad(w))
    f, e = sum(is_fixed), sum(is_learned)
    return [
        100 * f / n, math.log1p(f), len({w for w, x in zip(tokens, is_fixed) if x}), 100 * e / n, math.log1p(e), 100 * near / n, hidden, 100 * hidden / n,
        sum(w.isupper() for w in text.split()) / n, 100 * text.count("!") / size, 100 * sum(c in ".,;:?'\"-" for c in text) / size, math.log1p(len(tokens)),
    ]


def test_features_equal_the_plain_definition():
    words = ["idiot", "m0ron", "scum!", "you", "Sie", "zzgrok", "zzgrokking", "river", "STONE", "du", "tr@sh,", "2010", "cloud's", "(zzgr0k)", "über-cool"]
    learned = frozenset({"zzgr", "zzgrok ", "cloud "})
    for seed in range(200):
        r = random.Random(seed)
        text = " ".join(r.choice(words) for _ in range(r.randrange(60)))
        assert toxicity_gbt.toxic_stats(text, learned) == pytest.approx(plain_features(text, learned)), text


def test_lexicon_is_every_significant_entry(spark):
    r = random.Random(5)
    base = [(prose(k, 12) + (" zzgrok" if k % 3 == 0 and k % 12 else "") + (" vexil" if k % 6 == 0 else ""), int(k % 3 == 0)) for k in range(180)]
    copies = [("copied phrase about quorbit " + "and nothing more than this " * 4, 1)] * 80  # one group: its words aren't learned
    rows = base + copies
    r.shuffle(rows)
    got = toxicity_gbt.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    texts = sorted(set(rows))
    p = sum(y for _, y in texts) / len(texts)
    count = [Counter(), Counter()]
    for text, y in texts:
        count[y].update({f for w in set(text.split()) for f in [w + " ", *(w[:k] for k in range(4, 8) if k <= len(w))]})
    entries = set(count[0]) | set(count[1])
    want = set()
    for w in entries:
        c, n = count[1][w], count[0][w] + count[1][w]
        q = c / n
        kl = (q * math.log(q / p) if q else 0) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
        if q > p and c >= 15 * count[0][w] * p / (1 - p) and math.exp(-n * kl) <= 1e-3 / len(entries):
            want.add(w)
    assert got == want and {"zzgrok ", "vexil "} <= got and "quorbit " not in got


def test_scores_are_the_curve_over_the_sum_of_the_trees(documents, spark):
    docs, labels = learnable(documents, spark, lambda k: prose(k, 30) + (" you zzgrok " if k % 8 else " you fool ") + prose(k + 1, 9))
    model = toxicity_gbt.fit(docs, labels)
    stats = docs.select("doc_id", "text").collect()
    rows = {r["text"]: r["score"] for r in model.score(docs).select("text", "score").collect()}
    x, y = list(model.curve.boundaries), list(model.curve.predictions)
    from pyspark.ml.linalg import Vectors

    for row in stats[::7]:
        v = Vectors.dense(toxicity_gbt.toxic_stats(row["text"] or "", model.lexicon))
        total = sum(w * t.predict(v) for w, t in zip(model.trees.treeWeights, model.trees.trees))
        assert rows[row["text"]] == pytest.approx(float(np.clip(np.interp(total, x, y), 0, 1)), abs=1e-9)


def test_quality_equals_two_plain_gaussians(spark):
    r = np.random.default_rng(3)
    d = len(NAMES)
    mix = r.normal(size=(2, d, d))
    y = (np.arange(600) % 3 == 0).astype(int)
    x = np.array([r.normal(size=d) @ mix[k] + 0.7 * k for k in y])
    model = quality_qda.fit(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "y int, stats array<double>"))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = ((y == 0).sum() * covs[0] + (y == 1).sum() * covs[1]) / len(y)
    dens = []
    for k in (0, 1):
        c = 0.9 * covs[k] + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.trace(c) / d * np.eye(d)
        away = z - z[y == k].mean(axis=0)
        dens.append(np.log((y == k).sum()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away))
    margin = np.arcsinh(dens[1] - dens[0])
    assert np.allclose(model.margin(x), margin, atol=1e-6)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.slope * margin + model.offset))), atol=1e-6)
    binned = (np.floor(margin / 0.04) + 0.5) * 0.04  # calibration: the log-likelihood has no slope at the fitted point
    off = 1 / (1 + np.exp(-(model.slope * binned + model.offset))) - y
    assert abs(off.sum() + 1e-3 * model.offset) < 1e-3 and abs((off * binned).sum() + 1e-3 * model.slope) < 1e-3


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (6, 1, 1)]])
def test_without_both_classes(documents, spark, labels):
    docs = documents([(k, prose(k, 20)) for k in range(8)])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = quality_qda.document_stats(docs)
    model = quality_qda.fit(quality_qda.labelled(stats, known, "quality", 5, 0))
    assert {r[0] for r in stats.select(quality_qda.score_column(model, F.col("stats"))).collect()} == {1.0 if labels else 0.5}
    assert {r["score"] for r in toxicity_gbt.fit(docs, known).score(docs).collect()} == {1.0 if labels else 0.0}


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([])
    stats = quality_qda.document_stats(docs)
    model = quality_qda.fit(quality_qda.labelled(stats, none, "quality", 5, 0))
    assert stats.select(quality_qda.score_column(model, F.col("stats"))).count() == 0
    assert toxicity_gbt.fit(docs, none).score(docs).count() == 0
