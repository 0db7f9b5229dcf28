"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

Everything is DataFrame and SQL functions: URLs are parsed, cut into n-grams, hashed and scored by column
expressions, and the model is fitted by the engine's own logistic regression on a small labelled URL table
(a parameter; the default is below).  The fitted weights are one literal array of ``buckets`` numbers.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's path; the longest fitting rule wins (by the length of host plus path, then in text order).  The rule
list is a short parameter and becomes one CASE expression.

Defined cases: a null URL or one without ``://`` has an empty host and path (no rule fits; the model judges
the empty text); repeated and null page_ids give one row per input row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: The hosts of the default labelled URL table.  Both classes get the same paths, so that hosts decide.
BLOCKED_HOSTS = [
    "cheap-pills.example.com", "pills-online.example.net", "buy-viagra.example.com", "diet-pills.example.net", "adult-x.example.net", "adult-video.example.com",
    "xxx-tube.example.net", "free-porn.example.com", "hot-singles.example.net", "casino-win.example.com", "best-casino.example.net", "online-betting.example.com",
    "free-bets.example.net", "poker-slots.example.com", "lottery-prize.example.net", "win-prize.example.com", "ads-track.example.net", "banner-ads.example.com",
    "click-tracker.example.net", "crack-keygen.example.com", "warez-serial.example.net", "payday-loan.example.com", "cheap-loans.example.net", "replica-watches.example.com",
]
ALLOWED_HOSTS = [
    "news.example.com", "library.example.net", "garden.example.com", "docs.example.net", "history.example.com", "weather.example.net", "recipes.example.com", "science.example.net",
    "travel.example.com", "school.example.net", "music.example.com", "museum.example.net", "thother.example.com", "therand.example.net", "thening.example.com", "thatre.example.net",
    "theror.example.com", "thonst.example.net", "tionea.example.com", "tionth.example.net", "enation.example.com", "ingthe.example.net", "maths.example.com", "forum.example.net",
    "city.example.com", "health.example.net", "sports.example.com", "theatre.example.net", "nature.example.com", "station.example.net", "thinking.example.com", "nation.example.net",
]
PATHS = ["/en/7", "/de/245.html", "/fr/30", "/es/883/", "/", "/en/926/"]
SUBDOMAINS = ["", "www.", "blog.", "m."]


def url_table(hosts: list[str]) -> list[str]:
    """Each host once with every subdomain, over the paths in turn."""
    return [f"http://{sub}{h}{PATHS[(i + 2 * k) % len(PATHS)]}" for i, h in enumerate(hosts) for k, sub in enumerate(SUBDOMAINS)]


BLOCKED, ALLOWED = url_table(BLOCKED_HOSTS), url_table(ALLOWED_HOSTS)


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return _lower(F.regexp_extract(url, shape, 1)), F.regexp_extract(url, shape, 2)


def _bucket(tag: str, s: Column, n: int, buckets: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(s, i, F.lit(n))), F.lit(buckets)).cast("int")


def ngram_buckets(host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """Bucket numbers of the character n-grams of host and path, ``^`` and ``$`` marking the ends of either."""
    parts = []
    for tag, c in (("h", host), ("p", _lower(path))):
        s = F.concat(F.lit("^"), c, F.lit("$"))
        for n in sizes:
            at = F.when(F.char_length(s) >= n, F.sequence(F.lit(1), F.char_length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(at, _bucket(tag, s, n, buckets)))
    return F.concat(*parts)


def fit_urls(spark: SparkSession, blocked: list[str], allowed: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[list[float], float]:
    """(weights, offset) of the logistic regression of "blocked" on n-gram counts."""
    rows = spark.createDataFrame([(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed], "url string, label double").coalesce(1)
    host, path = parse_url(F.col("url"))
    grams = rows.select("url", "label", F.explode(ngram_buckets(host, path, sizes, buckets)).alias("g")).groupBy("url", "label", "g").agg(F.count(F.lit(1)).alias("n"))
    counts = grams.groupBy("url", "label").agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.coalesce(F.col("n")[k], F.lit(0)).cast("double"))
    train = counts.orderBy("url").coalesce(1).select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=0.02, maxIter=25, standardization=False).fit(train)
    return [float(x) for x in model.coefficients], float(model.intercept)


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, sizes: tuple[int, ...] = (3, 4), buckets: int = 1024
) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of "block" for every row."""
    weights, offset = fit_urls(pages.sparkSession, blocked, allowed, sizes, buckets)
    host, path = parse_url(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is put outermost
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    table = F.lit(weights)
    z = F.aggregate(ngram_buckets(F.col("host"), F.col("path"), sizes, buckets), F.lit(offset), lambda acc, g: acc + F.element_at(table, g + 1))
    p = 1 / (1 + F.exp(-z))
    df = df.withColumn("p_block", p)
    return df.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")
