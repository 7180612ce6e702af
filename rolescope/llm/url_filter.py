"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame and SQL functions; the model is fitted by Spark's own logistic regression on a small
labelled table, so its size is that of the hash space whatever the number of URLs.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
N_GRAMS = (3, 4, 5)
FEATURES = 1 << 15
LABELLED_MOST = 10_000  # rows of the labelled table that are fitted

# Fixed values of the labelled table: topics of unwanted and of ordinary sites, words that either kind adds, ordinary names.
UNWANTED = ("casino", "bets", "betting", "poker", "slots", "jackpot", "pills", "viagra", "pharmacy-deals", "payday", "loans", "adult", "porn",
            "sexcams", "xxx", "escorts", "spam", "backlinks", "ads", "adserver", "clickbait", "popunder", "malware", "replica")
WANTED = ("library", "museum", "garden", "weather", "history", "nursery", "science", "theatre", "recipes", "orchestra", "council", "software",
          "sports", "railway", "astronomy", "teaching", "linen", "letters", "health", "letting", "pillow", "addresses", "poetry", "sussex")
ADDED = ("online", "club", "shop", "zone", "daily", "hub")
NAMES = ("thornton", "the-herald", "northern-times", "easter-fair", "stationery", "anchor-press", "mountain-hut", "green-farm", "race-track",
         "tension", "inland", "ornithology", "edition", "sentence", "nation", "shore-path", "lathe-work", "reading-room", "winter-sun", "free-school",
         "cheap-flights", "win-the-day", "farm-museum", "x-ray")
PLACES = (("north", "south", "old", "upper", "river", "stone", "white", "oak"),
          ("town", "church", "harbour", "smith", "mouth", "bridge", "field", "thorpe"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: topics before and behind each added word, names and places, as front pages and below language paths.

    Added words stand beside topics of both kinds, so that the topic decides. No host name is taken from data to be judged.
    """
    both = lambda topics: [f"{x}-{w}" if (i + j) % 2 else f"{w}-{x}" for i, x in enumerate(topics) for j, w in enumerate(ADDED)]
    places = list(product(("example.com", "example.org", "example.net"), ("/", "/en/12", "/de/7.html", "/fr/345/")))
    rows = [(f"https://{('', 'www.', 'blog.', 'm.')[(i + j) % 4]}{host}.{domain}{path}", label)
            for label, hosts in ((1.0, both(UNWANTED)), (0.0, [*both(WANTED), *NAMES, *map("".join, product(*PLACES))])) for i, host in enumerate(hosts)
            for j, (domain, path) in enumerate(places)]
    return spark.createDataFrame(rows, "url string, label double")


def host(url: Column) -> Column:
    """Behind the first `://`, A-Z lower-cased; empty without one or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or above it and whose path begins the URL's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of `^host$` (marked h) and of the path with its digits made 0 (marked p)."""
    def of(mark: str, text: Column, n: int) -> Column:
        last = F.length(text) - (n - 1)
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                            lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
        return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))

    whole, tail = F.concat(F.lit("^"), host, F.lit("$")), F.regexp_replace(path, "[0-9]", "0")
    return F.concat(*[of(m, t, n) for n in N_GRAMS for m, t in (("h", whole), ("p", tail))])


def _features(urls: DataFrame) -> DataFrame:
    """Takes columns _host and _path, adds _features."""
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return hashed.transform(urls.withColumn("_grams", grams(F.col("_host"), F.col("_path")))).drop("_grams")


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """On at most LABELLED_MOST rows of (url, label 0 or 1), those of least hash; null urls or labels are left out."""
    bounded = (labelled.where("url IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("url", "label"), "url", "label")
               .limit(LABELLED_MOST).coalesce(1))
    rows = _features(bounded.select(host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"), F.col("label").cast("double").alias("label")))
    return LogisticRegression(featuresCol="_features", labelCol="label", maxIter=60, regParam=0.003).fit(rows)


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None,
               threshold: float = 0.5) -> DataFrame:
    """All columns, with host, path, rule, verdict (allow or block) and score (the model's probability of block).

    Rules are a config-sized list of (verdict, host/path). Null URLs and those without `://` have an empty host and path: no rule fits, the
    model judges them by its intercept. Columns called like the new ones are replaced. Repeated rows are
    judged alike; a labelled table with one class or none cannot be fitted. No rows in, no rows out.
    """
    new = ["host", "path", "rule", "verdict", "score"]
    pages = pages.drop(*new)
    model = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"),
                        host(F.col(url)).alias("_host"), path(F.col(url)).alias("_path"))
    scored = model.setFeaturesCol("_features").transform(_features(rows))
    rule, said = rule_for(F.col("_host"), F.col("_path"), rules)
    score = F.element_at(vector_to_array("probability"), 2)
    verdict = F.coalesce(said, F.when(score >= threshold, "block").otherwise("allow"))
    return scored.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"),
                         verdict.alias("verdict"), score.alias("score"))
