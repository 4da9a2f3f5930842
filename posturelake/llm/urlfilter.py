"""URL filter: explicit rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame functions and Spark's own JVM feature and model stages only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: (verdict, host and path); the longest rule that fits a URL wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labelled URLs that the model is trained on at most: those of least hash.
MAX_LABELLED = 20_000
#: Buckets of the n-grams, their length, penalty and steps of the regression.
BUCKETS, NGRAM, PENALTY, STEPS = 4096, 3, 0.1, 50
BLOCK_ABOVE = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for null and for what has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The rule that decides, and its verdict; null where none fits. A rule fits its host and all subdomains."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits.append(((host == name) | host.endswith("." + name)) & path.startswith("/" + start))
        fits[-1] = (fits[-1], rule, verdict)
    none = F.lit(None).cast("string")
    pick = lambda k: reduce(lambda later, f: F.when(f[0], f[k]).otherwise(later), reversed(fits), none)
    return pick(1), pick(2)


def _grams(text: Column, mark: str) -> Column:
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    at = F.sequence(F.lit(1), F.greatest(F.char_length(whole) - (NGRAM - 1), F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(NGRAM))))


def _features(df: DataFrame) -> DataFrame:
    grams = df.withColumn("__grams", F.array_distinct(F.concat(_grams(F.col("host"), "h:"), _grams(F.col("path"), "p:"))))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features").transform(grams)


def train(labelled: DataFrame):
    """Model from (url, blocked 0/1), or None unless both labels occur. Null labels and URLs without a host are left out."""
    host, path = url_parts(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), F.col("blocked").cast("double").alias("label"), F.xxhash64("url").alias("__h")).where("label IS NOT NULL AND host <> ''")
    rows = rows.orderBy("__h", "host", "path", "label").limit(MAX_LABELLED)
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__block", regParam=PENALTY, maxIter=STEPS, threshold=BLOCK_ABOVE).fit(_features(rows))


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; the rule is null where the model decided.

    URLs without a host, and all URLs if there is no model, are allowed unless a rule fits. Repeated rows each get their row.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__rule_says": verdict})
    model = train(labelled)
    scored = model.transform(_features(rows)) if model else rows.withColumn("__block", F.lit(0.0))
    says = F.when((F.col("__block") > 0) & (F.col("host") != ""), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__rule_says", says).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's URL ends in the number of a document; where that has labels, junk and toxic ones label the URL as blocked."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$', 1) AS BIGINT)")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    labelled = pages.select("url", number.alias("doc_id")).join(labels.select("doc_id", bad.alias("blocked")), "doc_id").select("url", "blocked")
    return judge(pages, labelled)
