"""The ledger fits what is absent, once, and reads only finished fits."""

import uuid

from pyspark.sql import functions as F

from velas.operators import ledger
from velas.session import scratch_path


def test_ledger_fits_only_what_is_absent(spark):
    calls = []

    def fit(target, model, shift):
        def run(prepared):
            calls.append((target, model, sorted(r.symbol for r in prepared.select("symbol").distinct().collect())))
            return prepared.select("symbol", "rn", F.lit(target).alias("target"), F.lit(model).alias("model"),
                                   F.col("v").alias("y"), (F.col("v") + shift).alias("p"), F.lit(None).alias("prob_up"))
        return [(target, model)], run

    def table(rows):
        return spark.createDataFrame(rows, "symbol string, rn long, v double")

    folder = scratch_path(spark, f"ledger-{uuid.uuid4().hex}")
    first = table([("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0)])
    out = ledger.fit_absent(first, first, [fit("t", "m", 1)], folder)
    assert sorted((r.symbol, r.rn, r.model, r.p) for r in out.collect()) == [("A", 1, "m", 2.0), ("A", 2, "m", 3.0), ("B", 1, "m", 4.0)]
    assert calls == [("t", "m", ["A", "B"])]

    # the same rows in another order: nothing is fitted; another model: all symbols
    again = table([("B", 1, 3.0), ("A", 2, 2.0), ("A", 1, 1.0)])
    calls.clear()
    out = ledger.fit_absent(again, again, [fit("t", "m", 9), fit("t", "k", 5)], folder)
    assert calls == [("t", "k", ["A", "B"])]
    assert sorted((r.symbol, r.rn, r.model, r.p) for r in out.collect()) == [
        ("A", 1, "k", 6.0), ("A", 1, "m", 2.0), ("A", 2, "k", 7.0), ("A", 2, "m", 3.0), ("B", 1, "k", 8.0), ("B", 1, "m", 4.0)]

    # a changed bar and a new symbol are fitted, the other symbol is not
    new = table([("A", 1, 1.0), ("A", 2, 2.5), ("B", 1, 3.0), ("C", 1, 0.0)])
    calls.clear()
    out = ledger.fit_absent(new, new, [fit("t", "m", 1)], folder)
    assert calls == [("t", "m", ["A", "C"])]
    assert sorted((r.symbol, r.rn, r.p) for r in out.collect()) == [("A", 1, 2.0), ("A", 2, 3.5), ("B", 1, 4.0), ("C", 1, 1.0)]

    # entries without manifest rows, as a fit that was cut off leaves them, are not read
    out.withColumn("p", F.lit(-1.0)).write.parquet(f"{folder}/entries/run=cut")
    calls.clear()
    out = ledger.fit_absent(new, new, [fit("t", "m", 1)], folder)
    assert calls == [] and {r.p for r in out.collect()} == {2.0, 3.5, 4.0, 1.0}
