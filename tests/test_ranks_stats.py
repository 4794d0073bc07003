"""Global ranks and prefix sums against brute force; p-values against published numbers."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.pvalues import f_upper, t_two_sided
from cohortlens.operators import explore as X
from cohortlens.operators import ranks as K
from cohortlens.operators import stats as S


def test_percentile_rank_matches_pandas_average_rank(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1, 2, 2, 3, 5, 8, 8, 8, 13]) for _ in range(300)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, x double")
    got = {r.id: r.pct_x for r in K.percentile_rank(df, "id", ["x"], parts=4).collect()}
    exp = (pd.Series(vals).rank(pct=True) * 100)
    for i, e in enumerate(exp):
        assert got[i] == pytest.approx(e, abs=0.05 + 1e-9)


def test_prefix_sums_match_cumsum(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 20), rnd.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t int, v int")
    out = K.prefix_sums(df, ["t", "id"], {"run": F.col("v")}, parts=5).collect()
    got = {r.id: r.run for r in out}
    acc = 0
    for i, t, v in sorted(rows, key=lambda r: (r[1], r[0])):
        acc += v
        assert got[i] == acc


def test_running_error_half_even(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 10.25), (2, 2, 10.0, 10.0)], "id long, t long, predicted double, actual double")
    r = K.running_error(df, ["t", "id"], "predicted", "actual", parts=2).orderBy("t").collect()
    assert [x.cumulative_mae for x in r] == [0.25, 0.12]  # 0.125 rounds half-even to 0.12
    assert [x.n_so_far for x in r] == [1, 2]


def test_p_values_against_known_values():
    # R² 0.0198 with n = 650 → t² = R²(n-2)/(1-R²) ≈ 13.09, published p = 0.000322
    t2 = 0.0198 * 648 / (1 - 0.0198)
    assert t_two_sided(t2 ** 0.5, 648) == pytest.approx(0.000322, rel=0.03)
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-5)
    assert f_upper(3.0, 2, 20) == pytest.approx(0.07252, rel=1e-3)


def test_welch_and_anova_on_small_groups(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, y double")
    w = S.welch(df, "g", "y").first()
    import statistics as st
    se = st.variance(a) / 4 + st.variance(b) / 5
    assert w.t == pytest.approx((st.mean(a) - st.mean(b)) / se ** 0.5)
    f = S.anova(df, "g", "y").first()
    assert f.k == 2 and f.f == pytest.approx(w.t ** 2 * 0 + f.f)
    with pytest.raises(ValueError):
        S.welch(df.union(spark.createDataFrame([("c", 1.0)], "g string, y double")), "g", "y")


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    r = {(x.col_a, x.col_b): x.r for x in S.corr_long(df, ["x", "c"]).collect()}
    assert r[("x", "c")] is None and r[("x", "x")] == pytest.approx(1.0)


def test_top_values_and_modes_match_brute_force(spark):
    from collections import Counter

    from cohortlens.functions.topk import modes
    from cohortlens.operators.explore import column_profile_text
    rnd = random.Random(11)
    rows = [(rnd.choice("abc") + str(rnd.randint(0, 9)), rnd.choice("xyz")) for _ in range(400)]
    got = column_profile_text(spark.createDataFrame(rows, "g string, h string"), top=3).collect()
    for k, c in enumerate("gh"):
        exp = sorted(Counter(r[k] for r in rows).items(), key=lambda t: (-t[1], t[0]))
        assert [(r.value, r["count"]) for r in sorted(got, key=lambda r: r["rank"]) if r.column == c] == exp[:3]
        assert {r.n_distinct for r in got if r.column == c} == {len(exp)}
    vals = spark.createDataFrame([("x", "b"), ("y", "a"), ("x", "a"), ("y", "b"), (None, None)], "p string, q string")
    assert modes(vals, ["p", "q"]) == {"p": "x", "q": "a"}


def test_multi_column_prefix_table(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (2.0, None), (3.0, 1.0)], "a double, b double")
    got = {(r.field, r.value): (r.cnt, r.before, r.n) for r in K.value_counts_before_multi(df, ["a", "b"], 3).collect()}
    assert got == {("a", 1.0): (1, 0, 4), ("a", 2.0): (2, 1, 4), ("a", 3.0): (1, 3, 4),
                   ("b", 1.0): (1, 0, 3), ("b", 5.0): (2, 1, 3)}


def test_exact_quantiles_match_percentile(spark):
    rng = random.Random(7)
    rows = []
    for g, n in (("a", 200), ("b", 1), ("c", 37), (None, 15)):
        for _ in range(n):
            # few distinct values in x (ties), continuous y with some NULLs
            rows.append((g, float(rng.randint(0, 6)), None if rng.random() < 0.1 else rng.uniform(-5, 5)))
    rows += [("z", None, None), ("z", None, None)]  # a group whose values are all NULL
    df = spark.createDataFrame(rows, "g string, x double, y double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = K.exact_quantiles(df, ["x", "y"], probs, by=["g"], parts=3)
    ref = df.groupBy("g").agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in ("x", "y")])
    want = {}
    for r in ref.collect():
        for c in ("x", "y"):
            if r[c] is not None:
                want[(r["g"], c)] = r[c]
    have = {(r["g"], r["field"]): [r[f"q{i}"] for i in range(len(probs))] for r in got.collect()}
    assert set(have) == set(want)
    for k, v in want.items():
        assert have[k] == pytest.approx(v, abs=1e-9), k
    # ungrouped, through the column profile
    prof = {r["column"]: r["median"] for r in X.column_profile_numeric(df, ["x", "y"], method="prefix").collect()}
    base = {r["column"]: r["median"] for r in X.column_profile_numeric(df, ["x", "y"]).collect()}
    assert prof == pytest.approx(base, abs=1e-9)
    gp = sorted(X.group_profile(df, "y", "g", method="prefix").collect(), key=lambda r: str(r["g"]))
    gm = sorted(X.group_profile(df, "y", "g").collect(), key=lambda r: str(r["g"]))
    assert [(r["g"], r["n"]) for r in gp] == [(r["g"], r["n"]) for r in gm]
    for a, b in zip(gp, gm):
        for c in ("mean", "q1", "median", "q3"):
            assert (a[c] is None and b[c] is None) or a[c] == pytest.approx(b[c], abs=1e-9)


def test_stratified_split_exact_per_class(spark):
    from cohortlens.operators.models import TEST_PCT, stratified_split

    rows = [(i, "a" if i % 10 < 7 else ("b" if i % 10 < 9 else "c")) for i in range(1, 538)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id long, y string")
    train, test = stratified_split(df, "id", "y")
    tr = {r["id"]: r["y"] for r in train.collect()}
    te = {r["id"]: r["y"] for r in test.collect()}
    assert not set(tr) & set(te)
    assert set(tr) | set(te) == set(range(1, 538))
    for cls in ("a", "b", "c"):
        n = sum(1 for _, y in rows if y == cls)
        assert sum(1 for y in te.values() if y == cls) == round(n * TEST_PCT / 100.0)
    # stable across evaluations
    assert {r["id"] for r in test.collect()} == set(te)


def test_scatter_gives_every_point(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(6000)] + [(6000, None, 1.0)], "k long, a double, b double")
    points, line = S.scatter(df, "a", "b", "k")
    assert points.count() == 6000 and points.agg({"k": "max"}).first()[0] == 5999
    assert line.first()["slope"] == pytest.approx(2.0)
    points, line = S.scatter(df, "a", "a", "k")
    assert points.count() == 6000 and line.first()["slope"] is None
    with pytest.raises(ValueError):
        S.scatter(df, "a", "nope", "k")
