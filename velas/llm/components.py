"""Connected components of an edge table by smallest labels and pointer jumps.

Every node starts as its own label.  A round gives each node the smallest
label among itself and its neighbours, then the label of its label; labels
thus reach over paths that double in length.  Rounds end when nothing changes:
then all neighbours agree, on the smallest node of their component.  Minima
are partial aggregations and the joins are equi-joins of stored tables, which
adaptive execution splits at a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from velas.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (u, v): root is the smallest
    node of its component.  Loops and repeated edges do no harm."""
    one_way = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    both = store(one_way.union(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    # the first round needs no join: every neighbour is its own label
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    labels = store(labels.withColumn("changed", F.lit(True)), "labels")
    while not labels.where("changed").isEmpty():
        jumps = labels.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
        jumped = store(labels.join(jumps, F.col("root") == F.col("_at")).select(
            "node", F.col("root").alias("was"), F.col("_to").alias("root")), "labels")
        near = both.join(jumped.select(F.col("node").alias("v"), F.col("root").alias("_near")), "v").groupBy("u").agg(
            F.min("_near").alias("_near"))
        labels = store(jumped.join(near, F.col("node") == F.col("u")).select(
            "node", F.least("root", "_near").alias("root"),
            (F.col("was") != F.least("root", "_near")).alias("changed")), "labels")
    return labels.select("node", "root")
