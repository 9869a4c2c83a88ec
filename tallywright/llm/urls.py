"""URL filter: rules, and a logistic regression for what no rule fits.

The regression sees hashed character n-grams of host and path. It learns from a
small table of labelled URLs of bounded size; by default those are URLs that the
rules decide. Features, training and scoring are Spark's DataFrame functions and
DataFrame-based estimators.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import let, stored, table

#: Verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
BLOCK, ALLOW = "block", "allow"
#: Labelled URLs of each verdict that training takes at most, by a hash of the URL.
LABELLED = 2000
FEATURES = 1 << 12
GRAMS = (3, 4)


def with_parts(rows: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``host`` and ``path``; both empty for null or without ``://``."""
    whole = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return rows.select(
        "*",
        F.translate(F.regexp_extract(whole, pattern, 1), string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(whole, pattern, 2).alias("path"),
    )


def rule_columns(rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none.

    The rules are a parameter, a few dozen at most: they become one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):  # the last to be set wins
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` with ``grams``, character n-grams of host and path."""

    def of(chars):
        ends = F.concat(F.array(F.lit("^")), chars, F.array(F.lit("$")))
        return let(ends, lambda c: F.flatten(F.array(*[_grams(c, n) for n in GRAMS])))

    return rows.withColumn("grams", let(F.split(F.concat("host", "path"), ""), of))


def _grams(chars, n: int):
    places = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(chars, i, n), ""))


def train(labelled: DataFrame, most: int = LABELLED):
    """Model of ``host, path, verdict`` rows, or the only verdict there is.

    ``most`` rows of each verdict at most, those of the smallest hashes, so that the
    choice does not depend on the order of rows.
    """
    table_of = labelled.select("host", "path", "verdict", F.xxhash64("host", "path").alias("h")).distinct()
    parts = [
        table_of.where(F.col("verdict") == v).orderBy("h", "host", "path").limit(most) for v in (BLOCK, ALLOW)
    ]
    rows = stored(parts[0].unionByName(parts[1]).coalesce(1).sortWithinPartitions("h", "host", "path"), "urls-labelled")
    seen = {r[0] for r in rows.select("verdict").distinct().collect()}
    if len(seen) < 2:
        return seen.pop() if seen else ALLOW
    features = _features(rows).withColumn("label", (F.col("verdict") == BLOCK).cast("double")).coalesce(1)
    return LogisticRegression(maxIter=40, regParam=0.01, tol=1e-5).fit(features)


def _features(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features") \
        .transform(with_grams(rows))


def judge(
    pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", labelled: DataFrame | None = None,
) -> DataFrame:
    """``key, host, path, rule, verdict, block_score``: the longest fitting rule and
    its verdict, else the regression's (``block`` from a score of 0.5).

    ``labelled`` has ``host, path, verdict``; by default URLs that a rule decides. If
    they know one verdict only, it is the answer; without any it is ``allow``. Null
    urls and those without ``://`` have empty parts and are judged like others.
    Repeated rows stay repeated; an empty table gives an empty one; other columns are
    not read.
    """
    rule, verdict = rule_columns(rules)
    parts = with_parts(pages.select(F.col(key).alias("key"), F.col(url).alias("url"))) \
        .select("key", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        labelled = parts.where("ruled is not null").select("host", "path", F.col("ruled").alias("verdict"))
    model = train(labelled)
    if isinstance(model, str):
        scored = parts.withColumn("block_score", F.lit(1.0 if model == BLOCK else 0.0))
    else:
        scored = model.transform(_features(parts)).withColumn("block_score", vector_to_array("probability")[1])
    said = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "block_score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("block_score")
