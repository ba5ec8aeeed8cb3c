"""URL filter: longest fitting rule, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import json
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 12
SIZES = (2, 3, 4)
RULES_LIMIT = 1000  # rules are part of the expression; it checks them one by one
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# The small labelled table: hosts made of these words with these ends and paths.
_BAD = ("casino", "cheap-pills", "spam-farm", "xxx-video", "poker-bonus", "replica-watches", "payday-loans", "adult-cams", "free-prizes", "click-bait")
_GOOD = ("news", "library", "museum", "weather", "recipes", "journal", "university", "archive", "gardening", "history")
_FRONTS = ("", "www.", "blog.", "m.")
_ENDS = (".example.com", ".example.net")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): label 1 is to be blocked."""
    rows = [
        (f"https://{front}{word}{end}/{path}", label)
        for words, paths, label in ((_BAD, ("win/now", "buy?offer=1"), 1.0), (_GOOD, ("en/article", "index.html"), 0.0))
        for word, front, end, path in product(words, _FRONTS, _ENDS, paths)
    ]
    return spark.createDataFrame(rows, "url string, label double")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _buckets(host: Column, path: Column) -> Column:
    """Bucket of every n-gram of host and path, each with marks at both ends."""

    def cut(text: Column, mark: str) -> Column:
        marked = F.concat(F.lit(mark), text, F.lit("$"))
        grams = [
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))),
                lambda i, n=n: F.pmod(F.xxhash64(F.lit(mark), F.substring(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int"),
            )
            for n in SIZES
        ]
        return F.concat(*grams)

    return F.concat(cut(host, "^"), cut(path, "/"))


def train(labelled: DataFrame, regularisation: float = 1e-4) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept from (url, label)."""
    buckets = _buckets(host_of(F.col("url")), path_of(F.col("url"))).cast("array<string>")
    names = [str(k) for k in range(BUCKETS)]
    counter = CountVectorizerModel.from_vocabulary(names, inputCol="b", outputCol="n")
    counted = counter.transform(labelled.select("label", buckets.alias("b")))
    points = Normalizer(p=1.0, inputCol="n", outputCol="features").transform(counted).select("label", "features")
    model = LogisticRegression(maxIter=60, regParam=regularisation, standardization=False).fit(points)
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null. A rule is a host, with all its subdomains, and the start of a path."""
    if len(rules) > RULES_LIMIT:
        raise ValueError(f"more than {RULES_LIMIT} rules")
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        end, _, start = rule.partition("/")
        fits = ((host == end) | host.endswith("." + end)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def judge(pages: DataFrame, model: tuple[list[float], float], rules=RULES) -> DataFrame:
    """Every row of pages with host, path, rule, score and verdict (allow or block).

    The rule decides where one fits; of equally long ones a block. Else the score of host and path does, at 0.5. Null urls and
    those without :// have empty host and path and are scored so. Rows stay where they are.
    """
    weights, intercept = model
    held = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    url = F.col("url")
    rows = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumns({"_b": _buckets(F.col("host"), F.col("path")), "_rule": longest_rule(F.col("host"), F.col("path"), rules)})
    total = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(held, b))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-(total / F.size("_b") + intercept))))
    learnt = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", learnt)}).drop("_b", "_rule")
