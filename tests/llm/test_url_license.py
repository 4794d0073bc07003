import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import license_scan as L
from cohortlens.llm import url_filter as U
from cohortlens.llm.queries import URL_RULES
from tests.llm.conftest import prose

PAGES = "page_id long, url string, html string, id string, score string, gram string, ruled string, rows int"


def judged(spark, urls, **kw):
    df = spark.createDataFrame([(i, u, None, "x", "x", "x", "x", 1) for i, u in urls], PAGES).withColumn("z", F.lit("x")).withColumn("u", F.lit("x"))
    return U.judge(df, URL_RULES, **kw)


RULED = [
    ("http://example.com/en/1", "example.com/en/"), ("http://x.EXAMPLE.com/en/1", "example.com/en/"), ("http://a.www.example.com/en/1", "www.example.com/en/"),
    ("http://www.example.com/de/1", "com/"), ("http://notexample.com/en/", "com/"), ("http://a.com", None), ("http://a.com?x", None), ("http://com/", "com/"),
    ("http://a.net/es/1?q", "net/es/"), ("http://a.net/fr/", "net/fr/"), ("http://a.net/fr", None), ("http://a.net:80/fr/", None), ("com/x", None), (None, None),
]


def test_rules(spark):
    got = {r["page_id"]: r for r in judged(spark, [(k, u) for k, (u, _) in enumerate(RULED)]).collect()}
    assert len(got) == len(RULED)
    for k, (_, rule) in enumerate(RULED):
        assert got[k]["rule"] == rule and got[k]["verdict"] in ("allow", "block")
        assert rule is None or got[k]["verdict"] == ("block" if rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")


def test_very_long_urls(spark):
    urls = [f"http://a{i}.{'com' if i % 2 else 'net/es'}/{'ab' * 150}{i}" for i in range(12)] + ["http://b.org/" + "ab" * 150, "http://c.org/" + "x" * 20_000]
    got = {r["page_id"]: r["score"] for r in judged(spark, list(enumerate(urls))).collect()}
    assert all(math.isfinite(got[k]) for k in (12, 13)) and len(got) == 14


def plain_scores(urls, support):
    """Witten-Bell interpolated log-likelihood differences, straight from the definition."""
    def characters(u):
        return "\x02" * 3 + (u or "").split("://", 1)[-1].lower()

    def verdict(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.name)).verdict if fit else None

    lengths = [0, 1, 2, 3, 4]  # of contexts
    while lengths[-1] < 400:
        lengths.append(lengths[-1] * 2)
    counts, holders, seen = {v: Counter() for v in ("allow", "block")}, {}, set()
    for u in urls:
        v, s = verdict(u), characters(u)
        if v:
            seen |= set(s[3:])
            for i in range(3, len(s)):
                for n in lengths:
                    if i >= n:
                        counts[v][n, s[i - n:i + 1]] += 1
                        # each place of a different URL counts
                        holders.setdefault((n, s[i - n:i]), set()).add((s, i))
    after = {v: {} for v in counts}
    for v in counts:
        for (n, gram), c in counts[v].items():
            after[v].setdefault((n, gram[:-1]), []).append(c)

    def p(v, s, i):
        out = 1 / (len(seen) + 1)
        for n in lengths:
            if i < n or n > 3 and len(holders.get((n, s[i - n:i]), ())) < support:
                break
            context = after[v].get((n, s[i - n:i]), [])
            if context:
                out = (counts[v][n, s[i - n:i + 1]] + len(context) * out) / (sum(context) + len(context))
        return out

    def score(u):
        s = characters(u)
        return sum(math.log(p("allow", s, i) / p("block", s, i)) for i in range(3, len(s))) / max(len(s) - 3, 1)

    return {u: (verdict(u), score(u)) for u in urls}


@pytest.mark.parametrize("support", [1, 3, 10 ** 6])
def test_scores_equal_the_definition(spark, support):
    r = random.Random(4)
    urls = [f"http://{r.choice(['shop', 'blog', 'free-bets'])}.{r.choice(['a', 'b9', 'example'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr'])}/{r.randrange(99)}" for _ in range(60)] + ["http://", "x", "ÄÖ://É", "http://食.com/あ/1?q=2", "http://水.net/es/い#2", "http://食.org/あ/1", "http://水.org/い/2", "http://n.com/" + "long/" * 60, "http://n.org/" + "long/" * 70, "HTTP://N.com/" + "long/" * 65]
    want = plain_scores([*urls, urls[0]], support)
    got = judged(spark, list(enumerate([*urls, urls[0], None])), support=support).collect()
    assert len(got) == len(urls) + 2
    for row in got[:]:
        u = ([*urls, urls[0], None])[row["page_id"]]
        if u is not None:
            ruled, score = want[u]
            assert (row["score"] is None) == (ruled is not None)
            assert ruled is not None or row["score"] == pytest.approx(score, abs=1e-9)
    kanji = {r["page_id"]: r["score"] for r in got}
    assert kanji[urls.index("http://食.org/あ/1")] > kanji[urls.index("http://水.org/い/2")]
    open_ = sorted(((r["score"], r["verdict"]) for r in got if r["score"] is not None))
    assert [v for _, v in open_] == sorted((v for _, v in open_), reverse=True)  # one limit: block below, allow above


def test_no_rows_and_no_rules(spark):
    assert judged(spark, []).count() == 0
    r = judged(spark, [(None, "http://a.org/x"), (None, "http://a.org/x")]).collect()
    assert [(x["page_id"], x["rule"], x["verdict"], x["score"]) for x in r] == [(None, None, "allow", 0.0)] * 2


def shingles(text, width):
    import regex

    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
    return w, [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]


def test_every_template_is_found_in_long_texts(documents):
    rows = [(k, prose(k, 50 + 13 * k) + "\n" + t.upper() + "\n" + prose(k + 99, 40)) for k, (*_, t) in enumerate(L.TEMPLATES)] + [(50, prose(50, 3000))]
    got = {(r["doc_id"], r["license"], r["variant"]): r for r in L.scan(documents(rows, extra=True)).collect()}
    for k, (name, variant, t) in enumerate(L.TEMPLATES):
        r = got[k, name, variant]
        words = shingles(t, 1)[0]
        start = len(shingles(prose(k, 50 + 13 * k), 1)[0])
        assert (r["containment"], r["first_word"], r["n_words"]) == (1.0, start, len(words))
    assert not any(k == 50 for k, *_ in got)


def test_containment_of_80_percent(documents):
    name, variant, t = L.TEMPLATES[3]
    words = t.split()
    rows = []
    for k in range(12):  # replace words at distances that break 0 to 11 groups of shingles
        w = list(words)
        for j in range(k):
            w[2 + 5 * j] = f"other{j}"
        rows.append((k, prose(k, 30) + " " + " ".join(w) + " " + prose(k, 25)))
    template = set(shingles(t, 5)[1])
    want = {k for k, x in rows if 100 * len(template & set(shingles(x, 5)[1])) >= 80 * len(template)}
    got = {r["doc_id"] for r in L.scan(documents(rows)).where(f"license = '{name}' and variant = '{variant}'").collect()}
    assert got == want and 0 < len(want) < 12


def test_odd_rows(documents):
    line = "Released under the MIT License."
    got = L.scan(documents([(1, None), (2, ""), (3, line), (3, line), (None, line), (4, line + " x " + line), (5, "the MIT license"), (6, "w " * 30_000 + line)])).collect()
    assert sorted((str(r["doc_id"]), r["first_word"]) for r in got) == [("3", 0), ("4", 0), ("4", 6), ("6", 30_000), ("None", 0)]
    assert L.scan(documents([])).count() == 0


def licenses(documents, lines):
    found = {}
    for r in L.scan(documents(list(enumerate(lines))), L.FAMILIES).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    return [found.get(k, set()) for k in range(len(lines))]


def test_versions_and_variants_are_told_apart(documents):
    notice = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    lines = {
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
        "This program " + notice.format("Affero General Public License", 3): {"AGPL-3.0"},
        "This program " + notice.format("Lesser General Public License", 3): {"LGPL-3.0"},
        "This library " + notice.format("Lesser General Public License", "2.1"): {"LGPL-2.1"},
        "This program " + notice.format("General Public License", 2): {"GPL-2.0"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0"},
        "Licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0"},
        "This work is licensed under the GNU General Public License, version 9.": set(),
    }
    assert licenses(documents, list(lines)) == list(lines.values())


def test_usual_families_are_covered(documents):
    whole = [(name, text) for name, variant, text in L.FAMILIES if variant in ("whole", "text", "disclaimer")]
    assert {"ISC", "Unlicense", "CC0-1.0", "EPL-2.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause"} <= {name for name, *_ in L.FAMILIES}
    for (name, _), got in zip(whole, licenses(documents, [text for _, text in whole]), strict=True):
        assert name in got


def test_matches_of_rows_without_id_stay_apart(documents):
    line = "Released under the MIT License."
    got = L.scan(documents([(None, line), (None, "some words before it. " + line), (None, "nothing"), (7, line), (7, line)])).collect()
    assert sorted((r["doc_id"] or 0, r["first_word"]) for r in got if r["license"] == "MIT") == [(0, 0), (0, 4), (7, 0)]


def test_context_sums_need_no_join(spark):
    level = spark.createDataFrame([("ab", 3, 0, 2, 0.5, 0.5), ("ac", 1, 2, 1, 0.5, 0.5), ("bd", 9, 9, 1, 0.5, 0.5)], "key string, allow long, block long, urls long, allow_p double, block_p double")
    found = U._smoothed(level, support=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {r["key"]: (round(r["allow_p"], 9), round(r["block_p"], 9)) for r in found.collect()}
    assert got == {"ab": (round(4 / 6, 9), round(0.5 / 3, 9)), "ac": (round(2 / 6, 9), round(2.5 / 3, 9))}
