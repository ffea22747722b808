"""URL filter: longest-match host rules, logistic regression for the rest.

Rules decide first.  A rule such as ``example.com/en/`` fits its host and all
subdomains if the URL's path starts with the rule's; the longest fitting rule
wins.  The model is a logistic regression on hashed character n-grams of host
and path, fitted on a small labelled URL table of at most ``MAX_TRAIN`` rows
(a documented bound: the rows with the smallest URL hashes) and applied to
every URL.  The whole path uses DataFrame functions and the DataFrame-based
``pyspark.ml``; the model that tasks receive is DIMS coefficients.

Defined cases: a null URL or one without ``://`` has an empty host and path,
no rule, and gets the model's verdict; with an empty or one-class training
table the verdict without a rule is that class (``allow`` when empty); long
URLs are used whole; repeated rows get equal answers; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from velas.llm.common import ascii_lower, store

MAX_TRAIN = 4000
DIMS = 4096
GRAMS = (3, 4)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, null if none fits.
    ``rules`` is a short list of (pattern, action); of equal lengths the first
    in code point order wins."""
    rule = action = F.lit(None).cast("string")
    for pattern, act in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, tail = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host and, marked apart, of the path."""

    def of(tag: str, c: Column, n: int) -> Column:
        marked = F.concat(F.lit("^"), c, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(tag), F.substring(marked, i, F.lit(n))))

    return F.concat(*(of(tag, c, n) for tag, c in (("h", host), ("p", path)) for n in GRAMS))


def _hasher() -> HashingTF:
    return HashingTF(inputCol="_grams", outputCol="features", numFeatures=DIMS, binary=True)


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> LogisticRegressionModel | None:
    """Model of P(block) from columns url, label (1 = block); None if empty.

    The sample is the ``max_train`` rows with the smallest URL hashes, a top-k
    that each task cuts before sending anything on."""
    sample = store(labelled.where("url is not null and label is not null")
                   .orderBy(F.xxhash64("url"), "url", "label").limit(max_train), "url-sample")
    if sample.isEmpty():
        return None
    host, path = host_and_path(F.col("url"))
    n_block, n = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    # both classes weigh the same: how often rules block says nothing about other URLs
    weight = F.when(F.col("label") == 1, n / (2.0 * max(n_block, 1))).otherwise(n / (2.0 * max(n - n_block, 1)))
    rows = sample.select(F.col("label").cast("double").alias("label"), weight.alias("weight"),
                         grams(host, path).alias("_grams"))
    return (LogisticRegression(maxIter=50, regParam=0.002, standardization=False, weightCol="weight")
            .fit(_hasher().transform(rows)))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", max_train: int = MAX_TRAIN) -> DataFrame:
    """id, host, path, rule, verdict and p_block for every page.

    Without a ``labelled`` table (url, label) the URLs that a rule decides
    serve as one."""
    host, path = host_and_path(F.col("_url"))
    rule, action = rule_columns(rules, F.col("host"), F.col("path"))
    ruled = (pages.select(F.col(id_col), F.col(url_col).alias("_url"))
             .withColumn("host", host).withColumn("path", path)
             .withColumn("rule", rule).withColumn("_action", action))
    if labelled is None:
        labelled = ruled.where("_action is not null").select(
            F.col("_url").alias("url"), (F.col("_action") == "block").cast("int").alias("label"))
    model = fit(labelled, max_train)
    if model is None:
        scored = ruled.withColumn("p_block", F.lit(0.0))
    else:
        hashed = _hasher().transform(ruled.withColumn("_grams", grams(F.col("host"), F.col("path"))))
        scored = model.transform(hashed)
        p = vector_to_array("probability")
        # a one-class model knows only that class, 0 or 1
        scored = scored.withColumn("p_block", F.element_at(p, 2) if model.numClasses == 2 else F.lit(0.0))
    verdict = F.coalesce(F.col("_action"), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "p_block")
