"""Model training, metrics and batch scoring with Spark ML (O-78, O-85 … O-93).

Splits are deterministic functions of the key hash (no driver-side sampling);
the stratified split ranks rows inside each class with the two-level prefix
count from `ranks` (no single-task window per class).  Cross-validation uses
a hash-derived fold column.
"""
from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trees as block_trees
from .clean import observed_only
from .fill import ExactFill
from .foldsums import linear_folds, one_vs_rest_auc
from .ranks import prefix_sums

SEED = 42
TEST_PCT = 20
FOLDS = 5
MIN_ROWS = 30
MIN_PER_CLASS = 5
SMALL_ROWS, ROWS_A_PART = 50_000, 10_000


def _hash_pct(key: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(100))


def split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """80/20 split by key hash: stable across runs and retries."""
    h = _hash_pct(key)
    return df.filter(h >= TEST_PCT), df.filter(h < TEST_PCT)


def stratified_split(df: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Exact per-class 80/20: rows ordered by (hash, key) inside each class; the
    position inside the class and the class size come from one grouped prefix
    count (rows without a label take no part)."""
    h = F.xxhash64(F.col(key), F.lit(SEED))
    d = df.filter(F.col(label).isNotNull()).withColumn("__h", h)
    j = prefix_sums(d, [label, "__h", key], {"__pos": F.lit(1).cast("bigint")}, groups=[label], with_totals=True)
    n_test = F.round(F.col("__pos_total") * (TEST_PCT / 100.0))
    tagged = j.withColumn("__test", F.col("__pos") <= n_test)
    cols = df.columns
    return tagged.filter(~F.col("__test")).select(*cols), tagged.filter(F.col("__test")).select(*cols)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Training rows in parts for all cores (a table of one row group is one task, however many trees are grown); up
    to SMALL_ROWS rows stay as they are.  No more parts than a few for each core: every part sends its own sums of all nodes."""
    if rows <= SMALL_ROWS:
        return df
    return df.repartition(min(-(-rows // ROWS_A_PART), 3 * df.sparkSession.sparkContext.defaultParallelism))


def in_blocks(train: DataFrame, stages, numeric, categorical, label: str, rows: int, folds: int = 0, binary: bool = False):
    """The cells that the trees of a large training part are grown on; None up to SMALL_ROWS rows, where Spark's trees are."""
    if rows <= SMALL_ROWS:
        return None
    return block_trees.cells(Pipeline(stages=stages).fit(train), train, numeric, categorical, label, rows, folds, binary)


def preprocessor(numeric, categorical, scale: bool = True, impute: bool = False):
    """O-86: standardised numerics, one-hot categoricals; unseen levels → all-zero vector; with `impute`, missing
    inputs get the exact medians and modes of the rows that the pipeline is fitted on."""
    stages = []
    num_in = list(numeric)
    if impute:
        stages.append(ExactFill(numbers=num_in, texts=list(categorical)))
    cat_vec = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__oh", dropLast=True, handleInvalid="keep"))
        cat_vec.append(f"{c}__oh")
    if num_in:
        stages.append(VectorAssembler(inputCols=num_in, outputCol="__num", handleInvalid="keep"))
        if scale:
            stages.append(StandardScaler(inputCol="__num", outputCol="__nums", withMean=True, withStd=True))
    inputs = ([("__nums" if scale else "__num")] if num_in else []) + cat_vec
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def _reg_candidates(label: str, trees: int = 300, depth: int = 8, rounds: int = 100):
    return [
        ("linear", LinearRegression(labelCol=label, featuresCol="features")),
        ("random_forest", RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=trees,
                                                maxDepth=depth, featureSubsetStrategy="all", seed=SEED)),
        ("gradient_boosting", GBTRegressor(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=3,
                                           stepSize=0.1, seed=SEED)),
    ]


def _metrics_rows(task: str, variant: str, model: str, metrics: dict) -> list[tuple]:
    return [(task, variant, model, k, float(v) if v is not None else None) for k, v in metrics.items()]


def _reg_metrics(pred: DataFrame, label: str) -> dict:
    e = RegressionEvaluator(labelCol=label, predictionCol="prediction")
    scored = pred.select(label, "prediction").persist(StorageLevel.MEMORY_AND_DISK)  # a forest predicts each row once, not once a metric
    found = {m: e.setMetricName(m).evaluate(scored) for m in ("r2", "mae", "rmse")}
    scored.unpersist()
    return found


def train_regression(df: DataFrame, key: str, label: str, numeric, categorical, variant: str,
                     trees: int = 300, depth: int = 8, folds: int = FOLDS, rounds: int = 100):
    """O-87: three candidates, hash split, k-fold CV on the training part (the linear one from fold sums),
    best by test R² (first wins ties).  Returns (best PipelineModel, metrics frame)."""
    spark = df.sparkSession
    data = observed_only(df).dropna(subset=[label])
    train, test = split(data, key)
    n = data.count()
    train, test = spread(train, n * (100 - TEST_PCT) // 100), spread(test, n * TEST_PCT // 100)
    train = train.withColumn("__fold", F.pmod(F.xxhash64(F.col(key), F.lit(SEED + 1)), F.lit(folds)).cast("int"))
    # iterative fitters scan the training part many times: keep it in executor memory/disk
    train, test = train.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
    cells = in_blocks(train, preprocessor(numeric, categorical), numeric, categorical, label, n * (100 - TEST_PCT) // 100, folds)
    def run(candidate):
        name, est = candidate
        pipe = Pipeline(stages=preprocessor(numeric, categorical) + [est])
        if name == "linear":  # its folds follow from one aggregate
            model = pipe.fit(train)
            m = _reg_metrics(model.transform(test), label)
            fit = linear_folds(train, label, numeric, categorical, F.col("__fold"), folds, F.lit(False))
            m["cv_r2_mean"], m["cv_r2_std"] = fit.cv_r2
            return name, m, model
        if cells is not None:
            model, cv = block_trees.fit(cells, est)
        else:
            model, cv = _fit_with_folds(pipe, train, folds, RegressionEvaluator(labelCol=label, metricName="r2"))
        m = _reg_metrics(model.transform(test), label)
        m["cv_r2_mean"], m["cv_r2_std"] = float(np.mean(cv)), float(np.std(cv))
        return name, m, model

    rows, best = [], None
    # candidates are independent Spark jobs: submit them concurrently, keep the listed order
    for name, m, model in _concurrently(run, _reg_candidates(label, trees, depth, rounds)):
        rows += _metrics_rows("regression", variant, name, m)
        if best is None or m["r2"] > best[1]:
            best = (name, m["r2"], model)
    baseline = naive_baseline(train, test, label)
    rows += [("regression", variant, r[2], "improvement_pct", 100.0 * (baseline["mae"] - r[4]) / baseline["mae"])
             for r in rows if r[3] == "mae" and baseline["mae"]]
    rows += _metrics_rows("regression", variant, "mean_baseline", baseline)
    if cells is not None:
        cells.unpersist()
    train.unpersist()
    test.unpersist()
    rows.append(("regression", variant, best[0], "is_best", 1.0))
    schema = "task string, variant string, model string, metric string, value double"
    return best[2], spark.createDataFrame(rows, schema)


def _fit_with_folds(pipe: Pipeline, train: DataFrame, folds: int, evaluator) -> tuple:
    """(model of the whole training part, the metric of each fold by a model of the others).

    There is nothing to choose between, so the whole part isn't left waiting for the folds as in `CrossValidator`:
    boosting is a chain of small jobs, and a second chain after the first took as long again."""
    def fit(fold):
        if fold is None:
            return pipe.fit(train)
        own, others = train.filter(F.col("__fold") == fold), train.filter(F.col("__fold") != fold)
        for part, rows in (("validation", own), ("training", others)):
            if rows.isEmpty():
                raise ValueError(f"the {part} data of fold {fold} is empty")
        return evaluator.evaluate(pipe.fit(others).transform(own))

    model, *metrics = _concurrently(fit, [None, *range(folds)])
    return model, metrics


def _concurrently(fn, items):
    """Run independent fits on driver threads (each submits its own Spark jobs);
    results come back in input order, so tie rules stay deterministic."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    with ThreadPoolExecutor(max_workers=len(items)) as ex:
        return list(ex.map(fn, items))


def naive_baseline(train: DataFrame, test: DataFrame, label: str) -> dict:
    """O-90: predict the training mean; MAE/RMSE on the test part."""
    m = train.agg(F.avg(label)).first()[0]
    r = test.agg(F.avg(F.abs(F.col(label) - F.lit(m))).alias("mae"),
                 F.sqrt(F.avg(F.pow(F.col(label) - F.lit(m), 2))).alias("rmse")).first()
    return {"mae": r["mae"], "rmse": r["rmse"]}


def binary_metrics(pred: DataFrame, label: str) -> dict:
    """O-89: accuracy, precision, recall, F1 of the positive class (0 when undefined), ROC-AUC."""
    y, p = F.col(label).cast("int"), F.col("prediction").cast("int")
    r = pred.agg(F.count(F.lit(1)).alias("n"), F.count_if((y == 1) & (p == 1)).alias("tp"),
                 F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
                 F.count_if(y == p).alias("ok")).first()
    prec = r["tp"] / (r["tp"] + r["fp"]) if r["tp"] + r["fp"] else 0.0
    rec = r["tp"] / (r["tp"] + r["fn"]) if r["tp"] + r["fn"] else 0.0
    f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                        metricName="areaUnderROC").evaluate(pred)
    return {"accuracy": r["ok"] / r["n"] if r["n"] else 0.0, "precision": prec, "recall": rec, "f1": f1, "roc_auc": auc}


def weighted_auc(pred: DataFrame, label: str) -> float | None:
    """ROC-AUC of the positive class for two labels, else one class against the rest weighted by
    class size; NULL when a class of the model isn't in the rows (the curve is undefined)."""
    first = pred.select("probability").first()
    if first is None:
        return None
    k = len(first["probability"])
    classes = [1] if k == 2 else list(range(k))
    scored = pred.select(F.col(label).cast("int").alias("y"), vector_to_array("probability").alias("p"))
    if k == 2:
        scored = scored.withColumn("p", F.array(F.get("p", F.lit(1))))
    areas = one_vs_rest_auc(scored, "y", "p", classes).collect()
    if any(r["auc"] is None for r in areas):
        return None
    return sum(r["auc"] * r["n"] for r in areas) / sum(r["n"] for r in areas)


def train_classifier(df: DataFrame, key: str, label: str, numeric, categorical, trees: int = 300, depth: int = 8,
                     folds: int = FOLDS, rounds: int = 100):
    """O-88: logistic regression (L2 with the 1/n scaling of C = 1), random
    forest, gradient boosting; exact stratified split; best by test F1."""
    spark = df.sparkSession
    data = observed_only(df).dropna(subset=[label]).withColumn(label, F.col(label).cast("double"))
    train, test = stratified_split(data, key, label)
    n = data.count()
    train, test = spread(train, n * (100 - TEST_PCT) // 100), spread(test, n * TEST_PCT // 100)
    train, test = train.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
    n_train = train.count()
    cands = [
        ("logistic", LogisticRegression(labelCol=label, regParam=1.0 / max(1, n_train), elasticNetParam=0.0,
                                        standardization=False, maxIter=200)),
        ("random_forest", RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth,
                                                 featureSubsetStrategy="sqrt", seed=SEED)),
        ("gradient_boosting", GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=3, stepSize=0.1, seed=SEED)),
    ]
    train = train.withColumn("__fold", F.pmod(F.xxhash64(F.col(key), F.lit(SEED + 1)), F.lit(folds)).cast("int"))
    cells = in_blocks(train, preprocessor(numeric, categorical), numeric, categorical, label, n_train, folds, binary=True)
    def run(candidate):
        name, est = candidate
        pipe = Pipeline(stages=preprocessor(numeric, categorical) + [est])
        positive_f1 = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)
        if cells is not None and name != "logistic":
            model, cv = block_trees.fit(cells, est)
        else:
            model, cv = _fit_with_folds(pipe, train, folds, positive_f1)
        m = binary_metrics(model.transform(test), label)
        m["cv_f1_mean"], m["cv_f1_std"] = float(np.mean(cv)), float(np.std(cv))
        return name, m, model

    rows, best = [], None
    for name, m, model in _concurrently(run, cands):
        rows += _metrics_rows("classification", "pass", name, m)
        if best is None or m["f1"] > best[1]:
            best = (name, m["f1"], model)
    rows.append(("classification", "pass", best[0], "is_best", 1.0))
    if cells is not None:
        cells.unpersist()
    train.unpersist()
    test.unpersist()
    return best[2], spark.createDataFrame(rows, "task string, variant string, model string, metric string, value double")


def feature_importance(model, top_n: int = 15) -> list[tuple[str, float]]:
    """O-85: impurity importances (trees) or |coefficients| (linear), with names
    from the assembled vector's metadata; top-n by value."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        vals = abs(last.coefficients.toArray())
    else:
        raise ValueError("model exposes no importances")
    names = _feature_names(model, len(vals))
    pairs = sorted(zip(names, map(float, vals)), key=lambda t: (-t[1], t[0]))
    return pairs[:top_n]


def _feature_names(model, n: int) -> list[str]:
    """Numeric inputs first, then one slot per known level of each category
    (one-hot with the invalid slot dropped keeps one slot per known level)."""
    nums, cats = [], []
    for st in model.stages:
        cls = type(st).__name__
        if cls == "VectorAssembler" and st.getOutputCol() == "__num":
            nums = list(st.getInputCols())
        if cls == "StringIndexerModel":
            cats += [f"{st.getInputCol()}={lv}" for lv in st.labels]
    names = nums + cats
    if len(names) < n:
        names += [f"f{i}" for i in range(len(names), n)]
    return names[:n]


def score(model, df: DataFrame, lo: float = 0.0, hi: float = 20.0, prob: bool = False) -> DataFrame:
    """O-78: batch scoring; predictions clamped and rounded to 2 dp (half-even);
    the positive-class probability for classifiers."""
    t = model.transform(df)
    out = t.withColumn("predicted", F.bround(F.least(F.greatest(F.col("prediction"), F.lit(lo)), F.lit(hi)), 2))
    if prob:
        out = out.withColumn("pass_probability", vector_to_array("probability")[1])
    return out


def train_generic(df: DataFrame, key: str, target: str, features, trees: int = 200, depth: int = 6):
    """O-92: target type decides the task; null targets dropped; median/mode fill
    of features; >= 30 rows; classification needs >= 2 classes and >= 5 per class;
    weighted metrics; best by R² / weighted F1."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    d = observed_only(df).dropna(subset=[target]).select(*dict.fromkeys([key, target, *features]))  # no other column is shuffled or kept
    n = d.count()
    if n < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} rows with a target, have {n}")
    numeric = [c for c in features if isinstance(types[c], T.NumericType)]
    text = [c for c in features if c not in numeric]
    # all rows with a target give the fill; as a stage it stays with the returned model
    stages = [ExactFill(numbers=numeric, texts=text).fit(d), *preprocessor(numeric, text, scale=True)]
    rows = []
    if isinstance(types[target], T.NumericType):
        d = d.withColumn(target, F.col(target).cast("double"))
        train, test = split(d, key)
        train, test = spread(train, n * (100 - TEST_PCT) // 100), spread(test, n * TEST_PCT // 100)
        train, test = train.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
        cells = in_blocks(train, stages, numeric, text, target, n * (100 - TEST_PCT) // 100)
        best = None
        for name, est in _reg_candidates(target, trees, depth)[:2]:  # linear and forest
            if cells is not None and name != "linear":
                m = block_trees.fit(cells, est)[0]
                cells.unpersist()
            else:
                m = Pipeline(stages=stages + [est]).fit(train)
            met = _reg_metrics(m.transform(test), target)
            rows += _metrics_rows("regression", target, name, met)
            if best is None or met["r2"] > best[1]:
                best = (name, met["r2"], m)
    else:
        counts = d.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(
            F.count(F.lit(1)).alias("k"), F.min("n").alias("m")).first()
        if counts["k"] < 2 or counts["m"] < MIN_PER_CLASS:
            raise ValueError("need at least 2 classes with at least 5 rows each")
        d = StringIndexer(inputCol=target, outputCol="__label", stringOrderType="alphabetAsc").fit(d).transform(d)
        train, test = stratified_split(d, key, "__label")
        train, test = spread(train, n * (100 - TEST_PCT) // 100), spread(test, n * TEST_PCT // 100)
        train, test = train.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
        best = None
        cands = [("logistic", LogisticRegression(labelCol="__label", maxIter=200)),
                 ("random_forest", RandomForestClassifier(labelCol="__label", numTrees=trees, maxDepth=depth,
                                                          seed=SEED))]
        for name, est in cands:
            m = Pipeline(stages=stages + [est]).fit(train)
            p = m.transform(test)
            ev = MulticlassClassificationEvaluator(labelCol="__label")
            met = {k: ev.setMetricName(k).evaluate(p)
                   for k in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}
            met["roc_auc"] = weighted_auc(p, "__label")
            rows += _metrics_rows("classification", target, name, met)
            if best is None or met["f1"] > best[1]:
                best = (name, met["f1"], m)
    train.unpersist()
    test.unpersist()
    rows.append(("generic", target, best[0], "is_best", 1.0))
    return best[2], spark.createDataFrame(rows, "task string, variant string, model string, metric string, value double")


def score_with_rejects(model, df: DataFrame, required, lo: float = 0.0, hi: float = 20.0):
    """O-93: rows missing any required input are not scored but returned in a
    reject table with the missing field names; the rest are scored."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    tagged = df.withColumn("__missing", missing)
    ok = tagged.filter(F.size("__missing") == 0).drop("__missing")
    rejected = tagged.filter(F.size("__missing") > 0).withColumn("missing", F.array_join("__missing", ",")) \
        .drop("__missing")
    return score(model, ok, lo, hi), rejected
