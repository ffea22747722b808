"""Mixing sources to target weights with a hypergeometric splitting tree.

Targets: the sources share ``budget`` times all words by weight; a target
stops at ``max_repeat`` times its source's size and the excess is shared again
by weight among the others until no target is above its stop.

Draws: a source's documents, in the order of a hash of their ids, form a line
of words; repeats continue the line.  The line up to the target is cut into
blocks of ``block_words`` words.  A splitting tree then deals the exact block
quotas of all sources to the output shards: at each node the multiset of
blocks is divided between the two halves of the node's shards by a
multivariate hypergeometric draw, so each shard receives a random mixture and
the quotas add up exactly.  Shard j of source s gets a range of a permutation
of the block numbers of s, so draws are disjoint.  A copy of a document goes
where the block at its middle word goes; it is taken if that word lies before
the target, which keeps a source within half a document of its target.

Scale: positions on a source's line are running sums in two levels.  Hash
ranges of about ``BUCKET_ROWS`` documents are summed first (partial
aggregation), a running sum over that small table gives each range its start,
and rows are summed within their (source, range) only: a source with a third
of all rows spreads over as many tasks as it has ranges.  The recipe has one
entry per source and is held by the driver; more than ``MAX_SOURCES`` sources
raise an error rather than be cut.

Defined cases: null text has size 0 and is never taken; a null source is the
last source; ids may be null or repeated (order is then settled by size and
text hash); an empty table gives an empty result; input columns named like the
added ones are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from velas.llm.common import WORD, store

WEIGHTS = (5, 2, 1)
MAX_SOURCES = 100_000
BUCKET_ROWS = 512
ADDED = ("size", "source_size", "target", "copy", "shard", "copies")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[int], budget: float, max_repeat: int) -> list[float]:
    """Words to take per source: shares by weight, stopped and reshared."""
    total = budget * sum(sizes)
    stops = [max_repeat * s for s in sizes]
    stopped = {i for i, s in enumerate(sizes) if s == 0}
    share = 0.0
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        if not free:
            break
        share = (total - sum(stops[i] for i in stopped)) / sum(weights[i] for i in free)
        above = {i for i in free if share * weights[i] > stops[i]}
        if not above:
            break
        stopped |= above
    return [float(stops[i]) if i in stopped else share * weights[i] for i in range(len(sizes))]


def split_tree(blocks: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """(source, shard) block counts; row sums are ``blocks`` exactly.

    Each node hands the left half of its shards their fair number of blocks,
    drawn without replacement from the node's blocks of all sources.
    """
    out = np.zeros((len(blocks), n_shards), dtype=np.int64)
    todo = [(0, n_shards, np.asarray(blocks, dtype=np.int64))]
    while todo:
        lo, hi, here = todo.pop()
        if hi - lo == 1:
            out[:, lo] = here
            continue
        mid = (lo + hi) // 2
        n_left = int(here.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(here, n_left, method="marginals")
        todo.append((lo, mid, left))
        todo.append((mid, hi, here - left))
    return out


def _step(q: int, rng: np.random.Generator) -> int:
    """A multiplier prime to q, so that b -> a*b + c is a permutation modulo q."""
    while True:
        a = int(rng.integers(1, q + 1))
        if math.gcd(a, q) == 1:
            return a


def recipe(rows: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_repeat: int = 2,
           n_shards: int = 16, block_words: int = 2048, seed: int = 1) -> list[tuple]:
    """One tuple per source: (source, is_null, size, target, blocks, a, c, shard ends, rows)."""
    found = (rows.groupBy("_source", "_null").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
             .limit(MAX_SOURCES + 1).collect())
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    found.sort(key=lambda r: (r["_null"], r["_source"]))  # str order is code point order
    sizes = [r["w"] for r in found]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], budget, max_repeat)
    blocks = np.array([math.ceil(t / block_words) for t in want], dtype=np.int64)
    rng = np.random.default_rng(seed)
    dealt = split_tree(blocks, n_shards, rng) if len(found) else np.zeros((0, n_shards), dtype=np.int64)
    out = []
    for i, r in enumerate(found):
        q = max(1, int(blocks[i]))
        out.append((r["_source"], r["_null"], sizes[i], want[i], q, _step(q, rng), int(rng.integers(q)),
                    np.cumsum(dealt[i]).tolist(), r["n"]))
    return out


RECIPE_SCHEMA = ("_source string, _null boolean, source_size long, target double, _q long, _a long, _c long, "
                 "_ends array<long>, _rows long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep_text: bool = True, **options) -> DataFrame:
    """All documents with size, source_size, target and ``copies``: an array of
    (copy, shard) structs, one for each time the mix takes the document.

    ``keep_text=False`` drops the text before the shuffle."""
    block_words = options.get("block_words", 2048)
    max_repeat = options.get("max_repeat", 2)
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ADDED and (keep_text or c != text_col)]
    rows = docs.select(
        F.struct(*names).alias("_given"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("_t"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"), F.col(source_col).isNull().alias("_null"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_h"))

    made = recipe(rows.select("_source", "_null", "size"), **options)
    n_buckets = max([1, *(math.ceil(m[-1] / BUCKET_ROWS) for m in made)])
    # the first 32 bits of the hash, scaled: ranges of the hash order
    bucket = F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(n_buckets)
                     / F.lit(1 << 32)).cast("long").alias("_bucket")
    sources = spark.createDataFrame(made, RECIPE_SCHEMA).drop("_rows")
    key = ["_source", "_null", "_bucket"]
    sums = rows.select("_source", "_null", bucket, "size").groupBy(*key).agg(F.sum("size").alias("_sum"))
    line = Window.partitionBy("_source", "_null").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("_start", F.coalesce(F.sum("_sum").over(line), F.lit(0)))
              .join(sources, ["_source", "_null"]).drop("_sum"))

    within = Window.partitionBy(*key).orderBy("_h", "size", "_t").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.select("*", bucket).join(starts, key)
              .withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))))

    def copy(e: int) -> Column:
        middle = F.col("_before") + e * F.col("source_size") + F.col("size") / 2
        at = F.pmod(F.floor(middle / block_words).cast("long") * F.col("_a") + F.col("_c"), F.col("_q"))
        return F.when((F.col("size") > 0) & (middle < F.col("target")), F.struct(
            F.lit(e).alias("copy"), F.size(F.filter("_ends", lambda x: x <= at)).alias("shard")))

    return placed.select("_given.*", "size", "source_size", "target",
                         F.filter(F.array(*(copy(e) for e in range(max_repeat))), lambda x: x.isNotNull()).alias("copies"))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         seed: int = 1, **options) -> DataFrame:
    """The mixed rows themselves: every taken copy of a document once, with
    exactly the input's columns, each task's part of an output shard shuffled."""
    whole = docs.select(F.struct(*docs.columns).alias("_whole"), F.col(id_col).alias("_id"),
                        F.col(text_col).alias("_text"), F.col(source_col).alias("_from"))
    mixed = mix(whole, "_id", "_text", "_from", keep_text=False, seed=seed, **options)
    return (mixed.select("_whole", "_id", F.explode("copies").alias("_one"))
            .sortWithinPartitions("_one.shard", F.xxhash64("_id", "_one.copy", F.lit(seed)))
            .select("_whole.*"))
