"""Exact k-nearest-neighbour scoring over a metric index.

Test rows look for their k nearest training rows of the same symbol
(Euclidean distance over the scaled features).  Every row gets a few
coordinates that change by no more than the distance between two rows:

* its projections on the leading principal directions of the symbol's training
  rows (together they are a contraction, too);
* its distances to four pivots, the training rows at the ends of the first two
  directions (triangle inequality).

1. Training rows are cut into slabs of equal depth along the first direction
   and, inside a slab, into cells of equal depth along the second; a cell holds
   about ``CELL_ROWS`` rows, packed in arrays, and the range of each
   coordinate.  The test rows over one cell are packed into blocks.
2. Seed: each block measures the two cells of its slab nearest along the
   second direction; the k-th smallest distance of a test row bounds its radius.
3. A block is joined with the cells of the slabs that its widest radius can
   reach, by (symbol, slab) on the ranges alone; only pairs whose ranges
   come within that radius fetch the packed rows.
4. The pairs of a block come in rings, nearest ranges first: the radius shrinks
   as rings are measured, later cells are rejected by their ranges, single
   rows by their coordinates, and the full distance is taken of the rest.

A bound never exceeds the distance, so the answer is exact whatever the data;
how much is rejected depends on how well a few directions describe them.
``n_compared`` counts the distances that the task which found a neighbour took
for its test row (all of them unless a block was split over tasks).

No task holds more than a block, a cell and k neighbours per row of the block;
a symbol with a third of all rows spreads over its slabs and cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velas.session import materialize

K = 5
CELL_ROWS = 128
BLOCK_ROWS = 64
MAX_SLABS = 256
CHUNK_ROWS = 100_000
N_DIRECTIONS = 6
PIVOTS = ("low0", "high0", "low1", "high1")
SLACK = 1e-9  # relative: bounds and distances are rounded differently

MOMENTS = "symbol string, n long, total array<double>, products array<double>"
FOUND = "symbol string, rn long, t_rn long, dist double, y array<double>, t_label array<double>, n_compared long"
RADII = "symbol string, slab int, part long, radius array<double>"


# --- the leading directions of a symbol --------------------------------------
def _moments(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.vstack(pdf["x"].to_numpy())
    return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "n": [len(x)], "total": [x.sum(axis=0).tolist()],
                         "products": [(x.T @ x).ravel().tolist()]})


def _leading(pdf: pd.DataFrame) -> pd.DataFrame:
    n = int(pdf["n"].sum())
    mean = np.vstack(pdf["total"].to_numpy()).sum(axis=0) / n
    d = len(mean)
    cov = np.vstack(pdf["products"].to_numpy()).sum(axis=0).reshape(d, d) / n - np.outer(mean, mean)
    vectors = np.zeros((N_DIRECTIONS, d))
    vectors[:min(d, N_DIRECTIONS)] = np.linalg.eigh(cov)[1].T[::-1][:N_DIRECTIONS]
    return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], **{f"v{i}": [v.tolist()] for i, v in enumerate(vectors)}})


def directions(train: DataFrame) -> DataFrame:
    """(symbol, v0, v1, ...): orthogonal unit vectors of the largest variance (or
    zero, where a row has fewer features), from sums per chunk."""
    chunk = F.pmod(F.xxhash64("rn"), F.ceil(F.col("_n") / F.lit(CHUNK_ROWS))).alias("chunk")
    sizes = train.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    return (train.join(sizes, "symbol").select("symbol", chunk, "x").groupBy("symbol", "chunk")
            .applyInPandas(_moments, MOMENTS).groupBy("symbol").applyInPandas(
                _leading, "symbol string, " + ", ".join(f"v{i} array<double>" for i in range(N_DIRECTIONS))))


def _summed(a: str, b: str, of) -> Column:
    return F.aggregate(F.zip_with(a, b, of), F.lit(0.0), lambda s, v: s + v)


def _dot(a: str, b: str) -> Column:
    return _summed(a, b, lambda u, v: u * v)


def _dist(a: str, b: str) -> Column:
    return F.sqrt(_summed(a, b, lambda u, v: (u - v) * (u - v)))


# --- measuring pairs of a block and a cell ------------------------------------
def _gap(g: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible distance of rows with coordinates ``g`` to rows with
    coordinates between ``low`` and ``high``."""
    off = np.maximum(np.maximum(low - g, g - high), 0.0)
    return np.maximum(np.sqrt((off[..., :N_DIRECTIONS] ** 2).sum(axis=-1)), off[..., N_DIRECTIONS:].max(axis=-1))


class _Block:
    """The k nearest training rows found so far for the rows of one block."""

    def __init__(self, row, k: int, d: int, n_labels: int):
        self.symbol, self.slab, self.part = row.symbol, row.slab, row.part
        self.rn = np.asarray(row.rn, dtype=np.int64)
        n = len(self.rn)
        self.x = np.asarray(row.x, dtype=float).reshape(n, d)
        self.g = np.asarray(row.g, dtype=float).reshape(n, -1)
        self.y = np.asarray(row.labels, dtype=float).reshape(n, n_labels)
        self.radius = np.asarray(row.radius, dtype=float)
        self.dist = np.full((n, k), np.inf)
        self.near = np.full((n, k), np.iinfo(np.int64).max)
        self.label = np.full((n, k, n_labels), np.nan)
        self.compared = np.zeros(n, dtype=np.int64)

    def measure(self, row) -> None:
        reach = np.minimum(self.radius, self.dist[:, -1]) * (1 + SLACK) + 1e-12
        rows = np.flatnonzero(_gap(self.g, np.asarray(row.low), np.asarray(row.high)) <= reach)
        if not len(rows):
            return
        t_rn = np.asarray(row.t_rn, dtype=np.int64)
        n, k = len(t_rn), self.dist.shape[1]
        t_x, t_g = np.asarray(row.t_x, dtype=float).reshape(n, -1), np.asarray(row.t_g, dtype=float).reshape(n, -1)
        near = _gap(self.g[rows][:, None, :], t_g[None], t_g[None]) <= reach[rows][:, None]
        i, j = np.nonzero(near)
        total = np.zeros(len(i))
        for f in range(t_x.shape[1]):  # summed feature by feature, as SQL does
            diff = self.x[rows[i], f] - t_x[j, f]
            total += diff * diff
        dist = np.full(near.shape, np.inf)
        dist[i, j] = np.sqrt(total)
        self.compared[rows] += near.sum(axis=1)
        both = np.concatenate([self.dist[rows], dist], axis=1)
        ids = np.concatenate([self.near[rows], np.where(near, t_rn, np.iinfo(np.int64).max)], axis=1)
        t_label = np.asarray(row.t_label, dtype=float).reshape(n, -1)
        labels = np.concatenate([self.label[rows], np.broadcast_to(t_label, (len(rows), *t_label.shape))], axis=1)
        best = np.lexsort((ids, both), axis=1)[:, :k]
        self.dist[rows] = np.take_along_axis(both, best, axis=1)
        self.near[rows] = np.take_along_axis(ids, best, axis=1)
        self.label[rows] = np.take_along_axis(labels, best[:, :, None], axis=1)

    def radii(self) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [self.symbol], "slab": [self.slab], "part": [self.part],
                             "radius": [self.dist[:, -1].tolist()]})

    def found(self) -> pd.DataFrame:
        i, j = np.nonzero(np.isfinite(self.dist))
        return pd.DataFrame({"symbol": self.symbol, "rn": self.rn[i], "t_rn": self.near[i, j], "dist": self.dist[i, j],
                             "y": self.y[i].tolist(), "t_label": self.label[i, j].tolist(), "n_compared": self.compared[i]})


def _measure_pairs(k: int, d: int, n_labels: int, result):
    """Over rows sorted by block and ring: ``result`` of every block (of every
    run of its rows, where a block is split over tasks)."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if block is None or (row.symbol, row.slab, row.part) != (block.symbol, block.slab, block.part):
                    if block is not None and len(made := result(block)):
                        yield made
                    block = _Block(row, k, d, n_labels)
                block.measure(row)
        if block is not None and len(made := result(block)):
            yield made
    return fn


# --- the search ---------------------------------------------------------------
def _packed(rows: DataFrame, depth: int, n_coords: int) -> DataFrame:
    """Rows of a (symbol, slab, home) packed ``depth`` at a time along the second direction:
    (symbol, slab, part, rn, x, g, labels, low, high) with flat arrays."""
    key = ["symbol", "slab", "home"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(depth))
    at = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("g")[1], "rn")) - 1
    part = F.shiftleft(F.col("home").cast("long"), 32) + F.floor(at * parts / F.col("_n")).cast("long")
    one = F.struct("rn", "x", "g", "labels")
    made = (rows.join(counts, key).withColumn("part", part).groupBy("symbol", "slab", "part")
            .agg(F.array_sort(F.collect_list(one)).alias("_r"),
                 F.array(*[F.min(F.col("g")[i]) for i in range(n_coords)]).alias("low"),
                 F.array(*[F.max(F.col("g")[i]) for i in range(n_coords)]).alias("high")))
    return made.select("symbol", "slab", "part", F.col("_r.rn").alias("rn"), F.flatten("_r.x").alias("x"),
                       F.flatten("_r.g").alias("g"), F.flatten("_r.labels").alias("labels"), "low", "high")


def _between(i: int) -> Column:
    return F.greatest(F.col("low")[i] - F.col("b_high")[i], F.col("b_low")[i] - F.col("high")[i], F.lit(0.0))


def neighbours(prepared: DataFrame, features, k: int = K, cell_rows: int = CELL_ROWS,
               labels: tuple[str, ...] = ("label",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(symbol, rn, y*, t_rn, t_label*, dist, nn_rank, n_compared) for the k
    nearest training rows of every test row; one (y_x, t_x) pair per label column
    (plain ``y``/``t_label`` for the single column ``label``).  Ties in
    distance go to the earlier training row; a symbol with fewer than k
    training rows gives all of them."""
    d, n_coords = len(features), N_DIRECTIONS + len(PIVOTS)
    rows = materialize(prepared.select(
        "symbol", F.col("rn").cast("long").alias("rn"), "is_train", F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.array(*[F.col(c).cast("double") for c in labels]).alias("labels")))
    train = rows.where("is_train")
    placed = rows.join(materialize(directions(train)), "symbol").select(
        *rows.columns, *[_dot("x", f"v{i}").alias(f"p{i}") for i in range(N_DIRECTIONS)])
    # equal depth: as many slabs as a slab then has cells
    slabs = F.least(F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(cell_rows))), F.lit(MAX_SLABS)).cast("int")
    cuts = [i / MAX_SLABS for i in range(MAX_SLABS)]
    per_symbol = placed.where("is_train").groupBy("symbol").agg(
        slabs.alias("slabs"), F.percentile_approx("p0", cuts, 40 * MAX_SLABS).alias("cuts"),
        *[by("x", p).alias(name) for name, by, p in zip(PIVOTS, (F.min_by, F.max_by) * 2, ("p0", "p0", "p1", "p1"))])
    per_symbol = materialize(per_symbol.withColumn("cuts", F.transform(
        F.sequence(F.lit(0), F.col("slabs") - 1), lambda i: F.get("cuts", F.floor(i * MAX_SLABS / F.col("slabs")).cast("int")))))

    def slab_of(p: Column) -> Column:  # cuts below the value; the least training value has slab 1
        return F.greatest(F.size(F.filter("cuts", lambda c: c <= p)), F.size(F.filter("cuts", lambda c: c <= F.get("cuts", F.lit(0)))))

    indexed = placed.join(per_symbol, "symbol").select(
        "symbol", "rn", "is_train", "x", "labels", slab_of(F.col("p0")).alias("slab"),
        F.array(*[f"p{i}" for i in range(N_DIRECTIONS)], *[_dist("x", name) for name in PIVOTS]).alias("g"))
    cells = materialize(_packed(indexed.where("is_train").withColumn("home", F.lit(0)), cell_rows, n_coords).select(
        "symbol", F.col("slab").alias("t_slab"), F.col("part").alias("t_part"), F.col("rn").alias("t_rn"),
        F.col("x").alias("t_x"), F.col("g").alias("t_g"), F.col("labels").alias("t_label"), "low", "high"))
    # a block's rows lie over one cell along the second direction, so that the cell is a good seed for all
    starts = cells.groupBy("symbol", F.col("t_slab").alias("slab")).agg(F.collect_list(F.col("low")[1]).alias("_starts"))
    asked = (indexed.where(~F.col("is_train")).join(starts, ["symbol", "slab"], "left")
             .withColumn("home", F.coalesce(F.size(F.filter("_starts", lambda c: c <= F.col("g")[1])), F.lit(0))).drop("_starts"))
    blocks = materialize(_packed(asked, block_rows, n_coords)
                         .withColumnRenamed("low", "b_low").withColumnRenamed("high", "b_high"))
    ranges = cells.select("symbol", "t_slab", "t_part", "low", "high")
    held = blocks.select("symbol", "slab", "part", "b_low", "b_high")

    def measured(pairs: DataFrame, with_radius: DataFrame, result, schema: str) -> DataFrame:
        order = ["symbol", "slab", "part", "bound", "t_slab", "t_part"]
        return (pairs.select(*order).join(cells, ["symbol", "t_slab", "t_part"])
                .join(with_radius, ["symbol", "slab", "part"]).sortWithinPartitions(*order)
                .mapInPandas(_measure_pairs(k, d, len(labels), result), schema))

    near = F.struct(_between(1).alias("bound"), "t_slab", "t_part")
    seeds = (held.join(ranges, (held.symbol == ranges.symbol) & (F.col("slab") == F.col("t_slab"))).drop(ranges.symbol)
             .groupBy("symbol", "slab", "part")
             .agg(F.min(near).alias("_a"), F.min(F.when(_between(1) > 0, near)).alias("_b"))
             .select("symbol", "slab", "part", F.explode(F.array_distinct(F.array_compact(F.array("_a", "_b")))).alias("_t"))
             .select("symbol", "slab", "part", "_t.*"))
    nothing = F.transform("rn", lambda _: F.lit(math.inf))
    # where a block was split over tasks each of its rows holds a bound; any will do
    radii = (measured(seeds, blocks.withColumn("radius", nothing), _Block.radii, RADII)
             .groupBy("symbol", "slab", "part").agg(F.first("radius").alias("radius")))
    bounded = materialize(blocks.join(radii, ["symbol", "slab", "part"], "left")
                          .withColumn("radius", F.coalesce("radius", nothing)))

    widest = F.array_max("radius") * (1 + SLACK) + 1e-12
    reach = (bounded.select("symbol", "slab", "part", "b_low", "b_high", widest.alias("_r"))
             .join(per_symbol.select("symbol", "cuts"), "symbol")
             .withColumn("t_slab", F.explode(F.sequence(slab_of(F.col("b_low")[0] - F.col("_r")),
                                                        slab_of(F.col("b_high")[0] + F.col("_r")))))
             .drop("cuts"))
    bound = F.greatest(F.sqrt(sum((_between(i) * _between(i) for i in range(1, N_DIRECTIONS)), _between(0) * _between(0))),
                       *[_between(i) for i in range(N_DIRECTIONS, n_coords)])
    pairs = reach.join(ranges, ["symbol", "t_slab"]).withColumn("bound", bound).where(F.col("bound") <= F.col("_r"))
    found = measured(pairs, bounded, _Block.found, FOUND)

    row = Window.partitionBy("symbol", "rn")
    types = dict(prepared.select(*labels).dtypes)
    out = []
    for i, c in enumerate(labels):
        suffix = "" if c == "label" else f"_{c}"
        out += [F.nanvl(F.col(v)[i], F.lit(None)).cast(types[c]).alias(f"{v}{suffix}") for v in ("y", "t_label")]
    return (found.withColumn("nn_rank", F.row_number().over(row.orderBy("dist", "t_rn"))).where(F.col("nn_rank") <= k)
            .select("symbol", "rn", *out, "t_rn", "dist", "nn_rank", "n_compared"))


def knn_predict(prepared: DataFrame, features, k: int = K, classify: bool = False) -> DataFrame:
    """(symbol, rn, y, p[, prob]) for test rows: mean of the neighbours' labels
    (regression) or the majority class with its share (classification)."""
    nb = neighbours(prepared, features, k)
    agg = nb.groupBy("symbol", "rn").agg(F.first("y").alias("y"),
                                         F.avg(F.col("t_label").cast("double")).alias("share"))
    if not classify:
        return agg.select("symbol", "rn", "y", F.col("share").alias("p"))
    return agg.select("symbol", "rn", F.col("y").cast("double").alias("y"),
                      F.when(F.col("share") > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("p"),
                      F.col("share").alias("prob_up"))


def knn_predict_multi(prepared: DataFrame, features, labels: dict[str, bool], k: int = K) -> DataFrame:
    """One neighbour search shared by several label columns.

    ``labels`` maps a label column to classify?; output is long:
    (symbol, rn, label, y, p, prob_up)."""
    nb = neighbours(prepared, features, k, labels=tuple(labels))
    aggs = []
    for c in labels:
        aggs += [F.first(f"y_{c}").alias(f"y_{c}"),
                 F.avg(F.col(f"t_label_{c}").cast("double")).alias(f"share_{c}")]
    agg = nb.groupBy("symbol", "rn").agg(*aggs)
    entries = []
    for c, classify in labels.items():
        share = F.col(f"share_{c}")
        p = F.when(share > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)) if classify else share
        entries.append(F.struct(F.lit(c).alias("label"), F.col(f"y_{c}").cast("double").alias("y"), p.alias("p"),
                                (share if classify else F.lit(None).cast("double")).alias("prob_up")))
    return agg.select("symbol", "rn", F.explode(F.array(*entries)).alias("_e")).select("symbol", "rn", "_e.*")
