import random

from cohortlens.llm import page_diff as P

SCHEMA = "page_id long, url string, html string, id string, host string, range int, ghost string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", 1, "x") for i, u, h in rows], SCHEMA)


def texts(spark, rows, **kw):
    return {r["page_id"]: r["text"] for r in P.extract(pages(spark, rows), **kw).collect()}


def test_elements_that_are_never_content():
    html = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav>
    <div class="cookie-notice">We use</div><div class="ad">Buy</div><article><header><h1>Head &amp; more</h1></header><p>One <b>two</b><br>three<p>Four&nbsp;&copy; &am
    <aside>Side</aside><form>Mail <input></form><section id="comments"><p>First!</p></section><div>Last</div></article><footer>F</footer></body></html>"""
    kept = [t for t, kind in P.page_lines(html) if kind == 2]
    assert kept == ["Head & more", "One two three", "Four © &am", "Last"]
    assert [t for t, kind in P.page_lines(html) if kind == 1] == []


def test_longest_common_subsequence():
    r = random.Random(0)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = P.shared_lines(a, b)
        rest = iter(b)
        assert len(got) == table[-1][-1] and all(a[i] in rest for i in sorted(got))


def plain(*lines):
    return "".join(f"<div>{x}</div>" for x in lines)


def test_template_lines_go_and_own_lines_stay(spark):
    rows = [
        (1, "http://a.com/x/1", plain("Top", "own one", "Bottom")),
        (2, "http://a.com/x/2", plain("Top", "own two", "Bottom")),
        (3, "http://a.com/y/3?q=1", plain("Other", "own three", "Bottom")),
        (4, "http://b.com/x/1", plain("Top", "alone", "Bottom")),
        (5, "http://A.com/x/1", plain("Top", "own one", "Bottom")),  # a copy: never a partner of page 1
        (6, "http://c.com/1", "<article><p>Same</p></article>"), (7, "http://c.com/2", "<article><p>Same</p><p>More</p></article>"),
    ]
    got = texts(spark, rows)
    assert got[2] == "own two" and got[4] == "Top\nalone\nBottom"
    assert got[1] == got[5] == "own one"
    assert (got[6], got[7]) == ("Same", "Same\nMore")


def test_results_do_not_depend_on_ranges(spark):
    rows = [(i, f"http://h{i % 2}.org/p/{i:03d}", plain("Top", f"line {i}", f"part {i // 4}", "End")) for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = texts(spark, rows)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert texts(spark, rows) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(t.startswith("line") for t in one.values())


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (None, "http://a/", "<p>x"), (3, "http://a/b", "a" * 100_000), (3, "http://a/b", "a" * 100_000), (4, "http://", "<article><p>&lt;b&gt; &#8364;")]
    got = P.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "" and by[1]["n_chars"] == 0 and by[None]["text"] == "x" and by[4]["text"] == "<b> €" and by[3]["n_chars"] == 100_000
    assert P.extract(pages(spark, [])).count() == 0


def test_url_parts(spark):
    urls = [("HTTP://User@A.Com:80/P/q?x#y", "user@a.com:80", "/P/q"), ("x://h?/a", "h", ""), ("a://b://c", "b:", "//c"), ("//h/p", "", ""), (None, "", ""), ("s://ÄB/é\n?z", "Äb", "/é\n"), ("s://h#/a", "h", "")]
    df = spark.createDataFrame([(u,) for u, *_ in urls], "url string")
    assert [tuple(r) for r in df.select(P.url_host("url"), P.url_path("url")).collect()] == [(h, p) for _, h, p in urls]


def test_differencing_decides_on_all_lines(spark):
    body = lambda n: f"<article><p>Read more on our site</p><p>own text {n}</p></article><nav>Menu</nav><div>Terms</div>"
    got = P.extract(pages(spark, [(k, f"http://a.com/x/{k}", body(k)) for k in (1, 2, 3)])).collect()
    assert {r["page_id"]: (r["text"], r["lines"], r["shared_lines"]) for r in got if r["page_id"] == 2} == {2: ("own text 2", 4, 3)}
    # the first and the last page of a host have one neighbour: not enough to delete a line of an article
    assert {r["page_id"]: (r["text"], r["shared_lines"]) for r in got if r["page_id"] != 2} == {k: (f"Read more on our site\nown text {k}", 2) for k in (1, 3)}


def test_marks_never_delete_an_article():
    html = '<div class="comments widget">Around<article class="post social"><p>Body</p><div class="share">Share</div></article><nav>Menu</nav></div><div class="widget">Box</div><form><main>In a form</main></form><head><div>x'
    assert [t for t, kind in P.page_lines(html) if kind] == ["Around", "Body", "In a form"]


def test_copies_get_one_text(spark):
    one, two = plain("Top", "own one", "Bottom"), plain("Top", "own two", "Bottom")
    rows = [(k, f"http://a.com/x/{k}", one) for k in range(1, 6)] + [(6, "http://a.com/x/6", two), (7, "http://a.com/z", one), (8, "http://a.com/x/1", one)]
    got = texts(spark, rows)
    assert got == {k: "own two" if k == 6 else "own one" for k in range(1, 9)}


def test_near_copies_are_looked_past(spark):
    body = [f"a sentence of the body, number {i}" for i in range(12)]
    rows = [(k, f"http://a.com/x/{k:02d}", plain("Top", *body, f"seen {k}", "Bottom")) for k in range(30)]
    rows += [(k, f"http://b.com/x/{k:02d}", plain("Top", *body, f"seen {k}", "Bottom")) for k in range(30, 33)]
    rows += [(90, "http://a.com/x/90", plain("Top", "something else of some length", "Bottom")), (91, "http://a.com/a", plain("Top", "of a third kind", "End"))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = texts(spark, rows)
            assert all(got[k] == "\n".join([*body, f"seen {k}"]) for k in range(30))
            assert all(got[k] == "\n".join(["Top", *body, f"seen {k}", "Bottom"]) for k in range(30, 33))
            assert got[90] == "something else of some length" and got[91] == "of a third kind\nEnd"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_end_tags_may_be_left_out():
    kept = lambda html: [t for t, kind in P.page_lines(html) if kind]
    assert kept('<article><h1>T</h1><p class="notice">n<p>Body one<p>Body two</article>') == ["T", "Body one", "Body two"]
    assert kept('<ul><li class="widget">Box<li>Real item<ul><li>inner</ul>tail</ul>') == ["Real item", "inner", "tail"]
    assert kept('<dl><dt class="ad">a<dd>b<dt>c</dl><p hidden>x<div>y</div>') == ["b", "c", "y"]
    assert kept('<table><tr class="promo"><td>a<td>b<tr><td class="ad">c<td>d<table><tr><td>e</table>f</table>g') == ["d", "e", "f", "g"]
    assert kept('<head><title>t</title><body><p class="ad">x<button><p>in</button>') == []
    assert kept('<p class="ad">x<b>y<h2>Head</h2>z') == ["Head", "z"]


def test_deep_and_unmatched_markup_is_read_in_linear_time():
    import time

    n = 30_000
    for html in ("<p>a</x>" * n, "<nav>" * n + "a", "<div>" * n + "<article></article>" * n, "<p><table><td>" + "<b>" * n + "<div>a</div>" * n, "<ul>" + "<li>a" * n):
        start = time.perf_counter()
        P.page_lines(html)
        assert time.perf_counter() - start < 10


def test_long_pages_take_little_memory():
    import resource

    a = [f"line {i}" for i in range(100_000)]
    b = [x if i % 3 else f"other {i}" for i, x in enumerate(a)] + ["same"] * 5000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = P.shared_lines(a + ["same"] * 3000 + ["end"], b)
    assert len(got) == sum(1 for i in range(100_000) if i % 3) + 3000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def brute_texts(rows):
    """page_id -> text by comparing all pages of a host in order."""
    read = {i: P.page_lines(h) for i, _, h in rows}
    hosts, out = {}, {}
    for i, u, _ in rows:
        host, _, path = u.split("://")[1].partition("/")
        hosts.setdefault(host, []).append(("/" + path, str(i), i))
    for entries in hosts.values():
        first = {}
        for path, order, i in sorted(entries):
            first.setdefault(tuple(read[i]), (path, order, i))
        line = sorted(first.values())

        def page(i):
            texts = [t for t, _ in read[i]]
            return P._Page(type("Row", (), {"host": "h", "path": "", "id": i, "lines": [P._hash(t) for t in texts], "sizes": list(map(len, texts))}))

        for k, (path, _, i) in enumerate(line):
            sides = []
            for move in (-1, 1):
                j = k
                while 0 <= j + move < len(line) and P.near(page(line[j][2]), page(line[j + move][2])):
                    j += move
                sides.append(line[j + move] if 0 <= j + move < len(line) else None)
            common = [len(P.commonprefix([path, s[0]])) if s else -1 for s in sides]
            texts = [t for t, _ in read[i]]
            shared = [P.shared_lines(texts, [t for t, _ in read[s[2]]]) if s else set() for s in sides]
            mine = shared[common[1] > common[0]]
            text = "\n".join(t for n, (t, kind) in enumerate(read[i]) if kind and not (n in shared[0] and n in shared[1] if kind == 2 else n in mine))
            for other in [e[2] for e in entries if tuple(read[e[2]]) == tuple(read[i])]:
                out[other] = text
    return out


def test_partners_equal_brute_force_over_all_pages(spark):
    r = random.Random(6)
    body = [f"a sentence that many pages of the host quote, number {i}" for i in range(8)]
    rows = []
    for i in range(90):
        lines = ["Top", *(body if r.random() < 0.5 else r.sample(body, 3)), f"seen {r.randrange(60)}", "Bottom"]
        mark = "<article>" + "".join(f"<p>{x}" for x in lines[1:-1]) + "</article>"
        html = plain(lines[0]) + (mark if r.random() < 0.5 else plain(*lines[1:-1])) + plain(lines[-1]) if r.random() < 0.9 else plain("Top", "Bottom")
        rows.append((i, f"http://h{r.randrange(2)}.com/{r.choice('ab')}/{r.randrange(40):02d}", html))
    before, want = spark.conf.get("spark.sql.shuffle.partitions"), brute_texts(rows)
    try:
        for n in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert texts(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
