"""URL verdicts from host and path rules and, for the rest, a character language-model ratio.

Two variable-order Markov models over the characters of URLs, one of the URLs that an allow rule
accepts and one of those that a block rule rejects, give each character a probability after
the characters before it.  Lengths of contexts are interpolated by Witten-Bell smoothing (a
context gives as much weight to the shorter one as it has seen different characters), so a
context never seen leaves the word to the shorter one.  Contexts have up to three characters, and beyond that 4, 8, 16, 32 ... as
long as the context stands in `support` places of different ruled URLs: what the models keep grows with the corpus.
A URL's score is the mean over its characters of the log-likelihood difference, and the limit between block and allow is
the one that separates the ruled URLs best (balanced accuracy over fixed bins).

Characters are those of the URL after "://", in lower case.  The grams of a round are a Spark table, joined by gram to the
places whose context was supported so far; no join is a broadcast, as all its tables grow with the corpus; such a place travels with its gram, not with its URL.  Counts
are taken over all rows, scores once for each distinct URL.  Only DataFrame functions.

Defined results: a null url, or one without "://", has empty host and path and no rule; a URL
without characters after "://" scores 0; without ruled URLs of both kinds the limit is 0 (a tie
allows); null ids are kept, repeated rows judged one by one; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .page_diff import url_host, url_path

ORDER = 4  # characters of the shortest grams that places are looked up by: the context and the character
START = "\x02"  # stands three times before the first character
SUPPORT = 16
BINS, REACH = 2000, 10.0  # scores are binned between -REACH and REACH


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def _characters(url: Column) -> Column:
    """The URL after "://" (or whole) in lower case, led by three START."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)\A.*?://", "")
    return F.concat(F.lit(START * (ORDER - 1)), F.lower(rest))


def _gram(end: Column, length: int) -> Column:
    """The `length` characters of z that end at a place."""
    return F.col("z").substr(end - (length - 1), F.lit(length))


def _smoothed(level: DataFrame, support: int = 0) -> DataFrame:
    """key and the two probabilities of its last character after the others, from (key, allow, block, urls) and those after the
    shorter context (allow_p, block_p); only contexts with `support` places in different ruled URLs."""
    # the keys of a context are as many as there are characters, so they are added up where they lie: no join with their sums
    of = Window.partitionBy("context")
    level = level.withColumn("context", F.expr("substr(key, 1, length(key) - 1)"))
    level = level.withColumns({"support": F.sum("urls").over(of)} | {
        f"{v}_{name}": f(v).over(of) for v in ("allow", "block") for name, f in (("n", F.sum), ("kinds", lambda c: F.sum((F.col(c) > 0).cast("long"))))})
    level = level.where(F.col("support") >= support)
    p = {v: F.when(F.col(f"{v}_n") > 0, (F.col(v) + F.col(f"{v}_kinds") * F.col(f"{v}_p")) / (F.col(f"{v}_n") + F.col(f"{v}_kinds"))).otherwise(F.col(f"{v}_p")) for v in ("allow", "block")}
    return level.select("key", *[p[v].alias(f"{v}_p") for v in p])


def _short_model(urls: DataFrame) -> DataFrame:
    """key, allow_p, block_p of every gram of ORDER characters in any URL."""
    at = urls.select("allow", "block", "z", F.explode(F.sequence(F.lit(ORDER), F.length("z"))).alias("j"))
    counted = at.groupBy(_gram(F.col("j"), ORDER).alias("gram")).agg(*_counts())
    grams = materialise(counted, "url-grams")
    kinds = grams.where("allow + block > 0").select(F.substring("gram", ORDER, 1).alias("c")).distinct().count() + 1  # one for all characters that no ruled URL has
    lower = None
    for n in range(1, ORDER + 1):
        level = grams.groupBy(F.substring("gram", ORDER - n + 1, n).alias("key")).agg(*[F.sum(c).alias(c) for c in ("allow", "block", "urls")])
        if lower is None:
            level = level.withColumns({f"{v}_p": F.lit(1.0 / kinds) for v in ("allow", "block")})
        else:
            level = level.withColumn("short", F.substring("key", 2, n - 1)).join(lower.withColumnRenamed("key", "short").hint("merge"), "short")
        lower = _smoothed(level)
    return lower


def _counts() -> list[Column]:
    return [F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.sum((F.col("allow") + F.col("block") > 0).cast("long")).alias("urls")]


def _scores(urls: DataFrame, support: int) -> DataFrame:
    """z and its score, of URLs (z, allow, block, u) with their rows under allow and block rules."""
    gain = F.log("allow_p") - F.log("block_p")
    places = F.collect_list(F.struct("j", "allow_p", "block_p")).alias("places")
    at = urls.select("u", "z", F.explode(F.sequence(F.lit(ORDER), F.length("z"))).alias("j")).select("u", "j", _gram(F.col("j"), ORDER).alias("key"))
    state = materialise(at.join(_short_model(urls).hint("merge"), "key").groupBy("u").agg(places, F.sum(gain).alias("gain"), F.count("*").alias("n")), "url-places")
    gains, n = [state.select("u", "gain", "n")], ORDER
    while True:  # contexts of n characters; ends as no URL is endless
        open_ = state.join(urls.hint("merge"), "u").select("u", "z", "allow", "block", F.explode(F.filter("places", lambda x: x["j"] > n)).alias("p"))
        open_ = open_.select("u", "allow", "block", "p.j", "p.allow_p", "p.block_p", _gram(F.col("p.j"), n + 1).alias("key"))
        level = open_.groupBy("key").agg(*_counts(), F.first("allow_p").alias("allow_p"), F.first("block_p").alias("block_p"))
        model = materialise(_smoothed(level, support), "url-contexts")
        if model.isEmpty():
            break
        reached = open_.select("u", "j", "key", gain.alias("before")).join(model.hint("merge"), "key")
        state = materialise(reached.groupBy("u").agg(places, F.sum(gain - F.col("before")).alias("gain")), "url-places")
        gains.append(state.select("u", "gain", F.lit(0).cast("long").alias("n")))
        n *= 2
    total = reduce(DataFrame.union, gains).groupBy("u").agg(F.sum("gain").alias("gain"), F.sum("n").alias("n"))
    return materialise(urls.join(total.hint("merge"), "u").select("z", "allow", "block", (F.col("gain") / F.col("n")).alias("score")), "url-scores")


def _limit(scores: DataFrame) -> float:
    """The score that separates ruled URLs best; their counts over fixed bins reach the driver."""
    width = 2 * REACH / BINS
    inside = F.least(F.greatest(F.col("score"), F.lit(-REACH)), F.lit(REACH))
    binned = scores.where("allow + block > 0").groupBy(F.floor(inside / width).alias("bin")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect()
    count = {(r["bin"], v): r[v] for r in binned for v in ("allow", "block")}
    total = {v: sum(n for (_, w), n in count.items() if w == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    edges = sorted({b for b, _ in count} | {b + 1 for b, _ in count})
    best, limits = -1.0, [0.0]
    blocked, allowed = 0, total["allow"]
    for b in edges:  # block below the edge
        right = blocked / total["block"] + allowed / total["allow"]
        if right > best + 1e-12:
            best, limits = right, [b * width]
        elif abs(right - best) <= 1e-12:
            limits.append(b * width)
        blocked += count.get((b, "block"), 0)
        allowed -= count.get((b, "allow"), 0)
    return (limits[0] + limits[-1]) / 2


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", support: int = SUPPORT) -> DataFrame:
    """id, host, path, rule, verdict and score (null where a rule decides) of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_host("url"), url_path("url")
    longest = sorted(rules, key=lambda r: -len(r.name))
    pick = lambda value: F.coalesce(*[F.when(r.fits(F.col("host"), F.col("path")), F.lit(value(r))) for r in longest], F.lit(None).cast("string"))
    named = rows.withColumns({"host": host, "path": path}).withColumns({"rule": pick(lambda r: r.name), "ruled": pick(lambda r: r.verdict)})
    named = named.withColumn("z", _characters(F.col("url")))
    ruled = [F.count_if(F.col("ruled") == v).alias(v) for v in ("allow", "block")]
    urls = materialise(named.where(F.length("z") >= ORDER).groupBy("z").agg(*ruled).withColumn("u", F.monotonically_increasing_id()), "urls")
    scores = _scores(urls, support)
    limit = _limit(scores)
    judged = named.join(scores.select("z", "score").hint("merge"), "z", "left")
    score = F.when(F.col("ruled").isNull(), F.coalesce("score", F.lit(0.0)))
    by_model = F.when(score >= limit, "allow").otherwise("block")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), score.alias("score"))
