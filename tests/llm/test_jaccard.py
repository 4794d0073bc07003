import itertools
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import jaccard_join as J
from cohortlens.llm.common import table
from cohortlens.llm.components import components
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def brute(rows, words=5, percent=80):
    """(id, size, component) for rows of distinct ids by comparing all sets."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {(i, len(s), find(i)) for i, s in sets}


def changed(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10_000))
    return " ".join(w)


def corpus():
    r = random.Random(2)
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two three"), (906, "one two  three"), (907, "a b c d e"), (908, "a b c d e f")]
    rows += [(i, prose(i, 4 + i % 30)) for i in range(60)]  # many small sets
    rows += [(100 + i, " ".join(prose(i, 12).split()[:12 - i % 3])) for i in range(40)]  # near copies among small sets
    base = prose(77, 400)
    rows += [(200 + i, changed(base, r, 1 + i % 9)) for i in range(50)]  # a large group, chained
    chain = prose(78, 300).split()
    rows += [(300 + i, " ".join(chain[6 * i:6 * i + 150])) for i in range(20)]  # each near the next only
    passage = prose(79, 70)
    rows += [(400 + i, prose(1000 + i, 200) + " " + passage + " " + prose(2000 + i, 150)) for i in range(30)]  # a common passage, no copies
    rows += [(500 + i, base) for i in range(10)] + [(600, prose(5, 6000)), (601, prose(5, 6000).upper())]
    return rows


@pytest.mark.parametrize(("percent", "split"), [(80, 4096), (80, 8), (60, 4096)])
def test_components_equal_brute_force(documents, percent, split):
    rows = corpus()
    got = J.jaccard_components(documents(rows, extra=True), percent=percent, split=split).collect()
    assert {tuple(r) for r in got} == brute(rows, percent=percent) and len(got) == len(rows)


def test_given_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in J.jaccard_components(docs).collect()} == brute(rows)


def test_null_ids_repeats_and_empty_table(documents):
    t = prose(1, 60)
    got = sorted(map(tuple, J.jaccard_components(documents([(None, t), (5, t), (5, t), (7, t + " end"), (8, prose(9, 60)), (5, "other words")])).collect()), key=str)
    assert got == sorted([(None, 56, None), (5, 56, 5), (5, 56, 5), (7, 57, 5), (8, 56, 8), (5, 1, 5)], key=str)
    assert J.jaccard_components(documents([])).count() == 0


def test_rule_and_boundary():
    rule = J.Rule(80)
    assert all(rule.common(a, b) == min(k for k in range(1, a + b) if 100 * k >= 80 * (a + b - k)) for a in range(1, 30) for b in range(1, 30))
    assert J.boundary_by_cost(rule, {3: 10, 40: 10}) >= 3 and J.boundary_by_cost(rule, {14: 1000}) < 14


def test_components(spark):
    r = random.Random(1)
    for links in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(r.randrange(300), r.randrange(300)) for _ in range(200)]):
        root = {v: v for e in links for v in e}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            p, q = sorted((find(a), find(b)))
            root[q] = p
        got = {x["v"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {v: find(v) for e in links for v in e if e[0] != e[1]}


def test_coarse_counts_change_no_list(spark, documents):
    """Lists of one set go and long lists are cut by their true length, whatever the count table says."""
    docs = documents(corpus()).selectExpr("doc_id AS id", "coalesce(text, '') AS text")
    rule, found = J.Rule(80), {}
    for counters, split in ((64, 4), (64, 10 ** 6)):
        table = spark.sparkContext.broadcast(J._count_table(J._first_pass(docs, 5, counters), counters))
        lists = J.shared_lists(J._second_pass(docs, 5, rule, 5, table, split), split).distinct()
        found[split] = lists.select("key", "sig", "light").collect()
        largest = lists.where("light < 0").groupBy("key", "part").count().agg(F.max("count")).first()[0]
        assert split > 4 or largest <= 16  # parts of some `split` sets
    assert sorted(found[4]) == sorted(found[10 ** 6])


@pytest.mark.parametrize("counters", [64, 1 << 16])
def test_components_do_not_depend_on_the_count_table(documents, counters):
    rows = corpus()
    got = J.jaccard_components(documents(rows), split=4, counters=counters).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_many_small_sets_under_one_subset(documents):
    rows = [(i, f"click here to see the price of item {i}") for i in range(300)] + [(1000 + i, f"q{i} click here to see the price of item") for i in range(20)]
    got = J.jaccard_components(documents(rows), split=4).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_counts_are_added_in_a_tree(spark, documents, monkeypatch):
    monkeypatch.setattr(J, "FAN_IN", 2)
    docs = documents([(i, prose(i, 50)) for i in range(40)]).repartition(9).selectExpr("doc_id AS id", "text")
    total = J._count_table(J._first_pass(docs, 5, 128), 128)
    assert total.sum() == sum(len(J.shingle_set(prose(i, 50))) for i in range(40)) and len(total) == 128


def test_word_hashes_of_pieces_and_long_words(monkeypatch):
    raw = b" \n".join([b"Word", b"x" * 300, b"word", b"\xc3\xa9t\xc3\xa9", b"X" * 300, b"y" * 5000, b"a"] * 9)
    whole = J.word_hashes(raw)
    monkeypatch.setattr(J, "PIECE", 400)
    assert (J.word_hashes(raw) == whole).all() and len(whole) == len(raw.split())
    assert whole[0] == whole[2] and whole[1] == whole[4] and len(set(whole[:7].tolist())) == 5


def test_texts_are_dealt_out_once(spark, documents):
    """The table of texts is bucketed by set: comparing pairs moves pairs, and the texts of one side only."""
    rows = [(i, prose(i, 40)) for i in range(30)] + [(100 + i, prose(i, 40).upper()) for i in range(30)]
    docs = documents(rows).selectExpr("doc_id AS id", "text")
    sigs = [J.signature(J.shingle_set(t)) for _, t in rows[:20]]
    texts = J._texts(docs, spark.createDataFrame([(s,) for s in sigs], "sig long"), 5)
    assert sorted(r["sig"] for r in texts.collect()) == sorted(sigs)  # a text for each set asked for, none twice
    assert all(J.signature(J.shingle_set(r["text"])) == r["sig"] for r in texts.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_texts")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.createDataFrame([(sigs[0], sigs[1]), (sigs[2], sigs[3])], "a long, b long")
        plan = pairs.join(texts.withColumnRenamed("sig", "a"), "a")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
        assert J._jaccard_links(pairs, texts, 5, 80).collect() == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
