"""URL filters: host rules first, else a logistic regression on hashed character
n-grams of host and path. Built-in expressions and Spark ML only."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and all its subdomains, below a path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; empty for a null or a url without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Sequence[Rule], host: Column, path: Column, of: str = "name") -> Column:
    """Name (or verdict) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, of)))
        for r in longest
    ]
    return F.coalesce(*fits, F.lit(None).cast("string")) if fits else F.lit(None).cast("string")


def grams(text: Column, sizes: Sequence[int] = (3, 4)) -> Column:
    """All character n-grams of a text, framed by ``^`` and ``$``."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    parts = [
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1))), lambda i, n=n: F.substring(framed, i, F.lit(n)))
        for n in sizes
    ]
    return F.concat(*parts)


def _features(rows: DataFrame, buckets: int) -> DataFrame:
    """``features``: counts of the hashed n-grams of host and of path; the two are
    told apart by a mark."""
    words = F.concat(
        F.transform(grams(F.col("host")), lambda g: F.concat(F.lit("h"), g)),
        F.transform(grams(F.col("path")), lambda g: F.concat(F.lit("p"), g)),
    )
    hashed = HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="features")
    return hashed.transform(rows.withColumn("grams", words)).drop("grams")


def train(labelled: DataFrame, max_rows: int = 20_000, buckets: int = 1 << 14) -> LogisticRegressionModel:
    """Fit on a small table of ``url`` and ``label`` (1: to be blocked).

    Rows with a null label or url are left out. A table of more than ``max_rows``
    rows is cut to those of the smallest url hash, which is a uniform sample; the
    model's size is ``buckets`` whatever the input. Both classes weigh the same.
    With rows of one class only, every url gets that class.
    """
    rows = labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull()).select(
        F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label")
    )
    small = rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    sized = small.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    most = max((r["n"] for r in sized), default=1)
    weight = F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(most / r["n"])) for r in sized], F.lit(1.0))
    framed = small.select("label", weight.alias("weight"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = LogisticRegression(maxIter=60, regParam=0.0005, weightCol="weight", standardization=False, fitIntercept=False)
    return fit.fit(_features(framed, buckets))


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = (), max_rows: int = 20_000, threshold: float = 0.5
) -> DataFrame:
    """``page_id, host, path, rule, score, verdict`` of every url.

    ``rule`` names the longest host rule that fits (``net/es/``), ``verdict`` is
    that rule's, else ``block`` where ``score`` passes ``threshold``.

    Defined cases: a null or malformed url has an empty host and path, fits no rule
    and is scored like any other; repeated rows are each judged; a table without
    labelled rows of either class blocks nothing; an empty table gives an empty
    result. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    if labelled.filter(F.col("label").isNotNull() & F.col("url").isNotNull()).isEmpty():
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        model = train(labelled, max_rows)
        fitted = model.transform(_features(rows, model.numFeatures))
        scored = fitted.withColumn("score", F.element_at(vector_to_array("probability"), -1))
    host, path = F.col("host"), F.col("path")
    verdict = F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path",
        rule_of(rules, host, path).alias("rule"), "score",
        F.coalesce(rule_of(rules, host, path, "verdict"), verdict).alias("verdict"),
    )


def seed_labels(pages: DataFrame, bad_words: Sequence[str]) -> DataFrame:
    """A labelled url table from the pages themselves: the smallest url of each
    host and first path part, labelled 1 where a part of the host between dots or
    hyphens is one of ``bad_words``."""
    url = F.col("url").cast("string")
    host, part = host_of(url), F.regexp_extract(path_of(url), r"^/([^/]*)", 1)
    one = pages.filter(url.isNotNull()).groupBy(host.alias("host"), part.alias("part")).agg(F.min(url).alias("url"))
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in bad_words]))
    return one.select("url", bad.cast("int").alias("label"))
