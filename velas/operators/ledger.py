"""Ledger of the bake-off (M17, M18, M20): fitted hold-out predictions by
(symbol, target, model, data fingerprint), so that a rerun fits only what is
absent.

A fingerprint is a hash over all source rows of a symbol (their order does
not matter): new or changed bars give another one, and the symbol is fitted anew.

Fitted predictions also depend on the code: the caller names the folder after a
hash of it.

Layout under a folder: ``entries/run=<id>`` holds the predictions of one fit,
``manifest/run=<id>`` one row per (symbol, target, model, fingerprint) that it
covers.  The manifest rows of a fit are written after its entries
are complete and readers go through the manifest, so the files of a fit that was
cut off are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.session import materialize

KEY = ["symbol", "target", "model", "fingerprint"]
ENTRIES = "symbol string, rn long, target string, model string, y double, p double, prob_up double"
MANIFEST = "symbol string, target string, model string, fingerprint long, run string"
THREADS = 4

#: a fit: the (target, model) pairs it covers, and prepared rows -> predictions (ENTRIES)
Fit = tuple[list[tuple[str, str]], Callable[[DataFrame], DataFrame]]


def fingerprints(source: DataFrame) -> DataFrame:
    """(symbol, fingerprint) of the rows that everything is derived from."""
    columns = sorted(source.columns)
    rows = source.select("symbol", F.xxhash64(*columns).alias("_h"))
    return rows.groupBy("symbol").agg(F.xxhash64(F.bit_xor("_h"), F.count(F.lit(1))).alias("fingerprint"))


def manifest(spark, folder: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException:  # nothing has been fitted yet
        return spark.createDataFrame([], MANIFEST)


def fit_absent(prepared: DataFrame, source: DataFrame, fits: Iterable[Fit], folder: str) -> DataFrame:
    """Fits what the ledger lacks for ``prepared``, derived from ``source``, and
    returns the predictions of all symbols and fits (ENTRIES)."""
    spark = prepared.sparkSession
    fits = list(fits)
    prints = materialize(fingerprints(source))
    known = materialize(manifest(spark, folder).join(prints, ["symbol", "fingerprint"], "left_semi"))

    def fit(one: Fit) -> None:
        covers, run_fit = one
        wanted = prints.select("*", F.explode(F.array(*[
            F.struct(F.lit(t).alias("target"), F.lit(m).alias("model")) for t, m in covers])).alias("_c")).select(*prints.columns, "_c.*")
        absent = materialize(wanted.join(known, KEY, "left_anti"))
        if absent.isEmpty():
            return
        run = uuid.uuid4().hex
        rows = prepared.join(absent.select("symbol").distinct(), "symbol", "left_semi")
        made = run_fit(rows).select("symbol", F.col("rn").cast("long").alias("rn"), "target", "model",
                                    *(F.col(c).cast("double").alias(c) for c in ("y", "p", "prob_up")))
        made.write.parquet(f"{folder}/entries/run={run}")
        absent.select(*KEY).coalesce(1).write.parquet(f"{folder}/manifest/run={run}")

    # independent fits of few tasks each overlap
    with ThreadPoolExecutor(max_workers=THREADS) as pool:
        list(pool.map(fit, fits))
    # of several runs for one key any will do: they saw the same rows
    pairs = {c for covers, _ in fits for c in covers}
    asked = F.struct("target", "model").isin([F.struct(F.lit(t), F.lit(m)) for t, m in sorted(pairs)])
    runs = (manifest(spark, folder).join(prints, ["symbol", "fingerprint"], "left_semi").where(asked)
            .groupBy("symbol", "target", "model").agg(F.min("run").alias("run")))
    entries = spark.read.schema(f"{ENTRIES}, run string").parquet(f"{folder}/entries")
    return entries.join(runs, ["symbol", "target", "model", "run"], "left_semi").drop("run")
