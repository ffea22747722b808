"""Decision forests and boosted trees of all symbols in one job.

**Bins.**  Each symbol's features are cut at up to ``BINS`` - 1 quantiles of its
training rows (one mergeable sketch per feature, a single aggregation).  Rows
travel as one byte per feature; a split is "bin <= b", stored with the edge's
value, so a fitted tree is applied to unbinned rows.

**Splits** come from sums per (tree, node, feature, bin) of three statistics: a
(weight in the split rule), b (gradient) and c (weight in the leaf).  A split
maximises B_l**2 / (A_l + l2) + B_r**2 / (A_r + l2) over all features and bins,
ties going to the first feature, then the lowest bin; a leaf's value is
B / (C + l2).

* Random Forest: a = c = bag weight, b = weight * y.  For 0/1 labels the rule is
  the Gini impurity's.  The bag weight of a row in a tree is Poisson(1), drawn
  from a hash of (tree, row number), so every pass sees the same bag.
* Gradient Boosting (first order): a = 1, b = residual; c = 1, or for 0/1 labels
  p (1 - p), a Newton step in the leaves.
* XGBoost (second order): a = c = hessian, b = -gradient, l2 = 1, at least 1
  hessian a child.

**Large and small.**  A group of rows of up to ``LOCAL_ROWS`` (28 bytes each) is
grown in one task: a tree block of a symbol for forests, a symbol for
boosting.  A larger symbol is grown level by level over its chunks of
``CHUNK_ROWS`` rows: tasks send partial sums per node, one aggregation per level for
all symbols and trees adds them up and picks the splits, and forest nodes that
have come down to ``LOCAL_ROWS`` are finished in one task each.  Both ways call the
same functions on the same bins and bags, and give the same trees but for the
order of float sums.

A model is a table of nodes (symbol, tree, node, feature, threshold, child,
value): ``child`` is the left child's number, the right one follows it, and a leaf
has feature -1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.session import materialize

BINS = 64
LOCAL_ROWS = 1_000_000
CHUNK_ROWS = 100_000
TREES_PER_TASK = 5
SEED = 42


@dataclass(frozen=True)
class Kind:
    """Fixed settings of a model: the defaults its name stands for."""

    name: str
    classify: bool
    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    l2: float = 0.0
    least: float = 1.0          # of statistic a in a child
    per_split: str = "all"      # features that a split may use: all or sqrt
    boosted: bool = True
    second_order: bool = False


def kind_of(name: str, classify: bool) -> Kind:
    if name == "Random Forest":
        return Kind(name, classify, depth=30, rate=1.0, per_split="sqrt" if classify else "all", boosted=False)
    if name == "Gradient Boosting":
        return Kind(name, classify)
    if name == "XGBoost":
        return Kind(name, classify, depth=6, rate=0.3, l2=1.0, second_order=True)
    raise KeyError(name)


# ---- numpy steps that both ways share

def _hash(*parts) -> np.ndarray:
    """Mixes integer arrays into 64 random bits."""
    x = np.uint64(SEED)
    for p in parts:
        x = (x ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(32))
    return x


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8, 9]))


def bag_weights(tree: int, rn: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        u = (_hash(np.full(len(rn), tree), rn) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


def level_sums(bins: np.ndarray, at: np.ndarray, stats: np.ndarray, k: int, n_bins: int) -> np.ndarray:
    """(node, feature, bin, statistic) sums; ``at``: node position 0..k-1 of each row."""
    d = bins.shape[1]
    cell = ((at[:, None] * d + np.arange(d)) * n_bins + bins).ravel()
    return np.stack([np.bincount(cell, np.repeat(s, d), k * d * n_bins).reshape(k, d, n_bins) for s in stats.T], axis=-1)


def best_splits(sums: np.ndarray, kind: Kind, tree: int, keys: np.ndarray):
    """Per node: feature (-1: leaf), bin and value, from (node, feature, bin, 3) sums."""
    k, d, n_bins, _ = sums.shape
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left

    def score(s: np.ndarray) -> np.ndarray:
        return np.divide(s[..., 1] ** 2, s[..., 0] + kind.l2, out=np.zeros(s.shape[:-1]), where=s[..., 0] + kind.l2 > 0)

    gain = score(left) + score(right) - score(total)[:, None, None]
    gain[(left[..., 0] < kind.least - 1e-9) | (right[..., 0] < kind.least - 1e-9)] = -np.inf
    if kind.per_split == "sqrt":
        with np.errstate(over="ignore"):
            draw = _hash(np.full((k, d), tree), np.broadcast_to(keys[:, None], (k, d)), np.broadcast_to(np.arange(d), (k, d)))
        # of the features that can split the node at all, the first sqrt(d) by draw
        draw = np.where(np.isfinite(gain).any(axis=2), draw, np.uint64((1 << 64) - 1))
        place = np.argsort(np.argsort(draw, axis=1, kind="stable"), axis=1)
        gain[place >= max(1, int(np.sqrt(d)))] = -np.inf
    flat = gain.reshape(k, -1)
    # gains that differ only by rounding are ties, settled by the first place
    top = flat.max(axis=1, initial=-np.inf)
    first = np.argmax(flat >= (top - 1e-9 * np.abs(np.where(np.isfinite(top), top, 0.0)))[:, None], axis=1)
    split = top > 1e-10 * np.maximum(score(total), 1e-300)
    value = np.divide(total[:, 1], total[:, 2] + kind.l2, out=np.zeros(k), where=total[:, 2] + kind.l2 > 0)
    return np.where(split, first // (n_bins - 1), -1), first % (n_bins - 1), value


class Tree:
    """Nodes as lists: feature (-1: leaf), bin, child (left; right follows), value, and
    key, a hash of the path from the root, whatever the node's number is."""

    def __init__(self, feature=(-1,), bin=(0,), child=(-1,), value=(0.0,), key=(1,)):
        self.feature, self.bin, self.child, self.value, self.key = (list(x) for x in (feature, bin, child, value, key))

    def frontier(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row is in."""
        feature, cut, child = np.array(self.feature), np.array(self.bin), np.array(self.child)
        at = np.zeros(len(bins), dtype=np.int64)
        inner = np.arange(len(bins))
        while len(inner):
            inner = inner[feature[at[inner]] >= 0]
            here = at[inner]
            at[inner] = child[here] + (bins[inner, feature[here]] > cut[here])
        return at

    def put(self, nodes: np.ndarray, feature, cut, value) -> list[int]:
        """Enters splits and values; returns the new children."""
        new = []
        for i, f, b, v in zip(nodes.tolist(), feature.tolist(), cut.tolist(), value.tolist()):
            self.value[i] = v
            if f >= 0:
                self.feature[i], self.bin[i], self.child[i] = f, b, len(self.feature)
                new += [len(self.feature), len(self.feature) + 1]
                for x, start in ((self.feature, -1), (self.bin, 0), (self.child, -1), (self.value, 0.0)):
                    x += [start, start]
                self.key += [(self.key[i] * 6364136223846793005 + side) % (1 << 62) for side in (1, 3)]
        return new


def grow(tree: Tree, start: list[int], depth: int, bins, at, stats, kind: Kind, number: int, n_bins: int) -> Tree:
    """Grows the nodes ``start`` of a tree to the end; ``at``: node of each row."""
    nodes = np.array(start)
    while len(nodes):
        inside = np.isin(at, nodes)
        if not inside.all():
            bins, at, stats = bins[inside], at[inside], stats[inside]
        place = np.searchsorted(nodes, at)
        total = np.stack([np.bincount(place, x, len(nodes)) for x in stats.T], axis=1)
        feature, cut = np.full(len(nodes), -1), np.zeros(len(nodes), dtype=np.int64)
        value = np.divide(total[:, 1], total[:, 2] + kind.l2, out=np.zeros(len(nodes)), where=total[:, 2] + kind.l2 > 0)
        # a node of one row is a leaf, as are all at the last level
        more = np.flatnonzero(np.bincount(place, minlength=len(nodes)) > 1) if depth else []
        if len(more):
            of = np.full(len(nodes), -1)
            of[more] = np.arange(len(more))
            use = of[place] >= 0
            feature[more], cut[more], _ = best_splits(
                level_sums(bins[use], of[place[use]], stats[use], len(more), n_bins), kind, number,
                np.array([tree.key[i] for i in nodes[more].tolist()]))
        new = tree.put(nodes, feature, cut, value)
        moved = feature[place] >= 0
        bins, at, stats, place = bins[moved], at[moved], stats[moved], place[moved]
        at = np.array(tree.child)[at] + (bins[np.arange(len(bins)), feature[place]] > cut[place])
        nodes, depth = np.array(new), depth - 1
    return tree


def start_margin(mean: float, kind: Kind) -> float:
    if not kind.boosted:
        return 0.0
    if not kind.classify:
        return mean
    p = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def boost_stats(y: np.ndarray, margin: np.ndarray, kind: Kind) -> np.ndarray:
    one = np.ones(len(y))
    if kind.classify:
        p = 1 / (1 + np.exp(-margin))
        h = np.maximum(p * (1 - p), 1e-16)
        return np.stack([h if kind.second_order else one, y - p, h], axis=1)
    return np.stack([one, y - margin, one], axis=1)


def forest_stats(y: np.ndarray, rn: np.ndarray, tree: int) -> np.ndarray:
    w = bag_weights(tree, rn)
    return np.stack([w, w * y, w], axis=1)


# ---- tables

NODE_SCHEMA = "symbol string, tree int, node int, feature int, threshold double, child int, value double"


def bin_edges(train: DataFrame, features, n_bins: int = BINS) -> DataFrame:
    """(symbol, edges: array per feature of its distinct quantiles, n, mean_y) of the training rows."""
    shares = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    return train.groupBy("symbol").agg(
        F.array(*[F.array_sort(F.array_distinct(F.percentile_approx(F.col(f).cast("double"), shares, F.lit(10_000))))
                  for f in features]).alias("edges"),
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("mean_y"))


def _binned(x: np.ndarray, edges) -> np.ndarray:
    return np.stack([np.searchsorted(np.asarray(e, dtype=np.float64), x[:, j], side="left") for j, e in enumerate(edges)],
                    axis=1).astype(np.uint8)


def binned_rows(train: DataFrame, features, edges: DataFrame) -> DataFrame:
    """(symbol, rn, y, bins: one byte per feature)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b), dtype=object)
            for _, at in b.groupby("symbol").indices.items():
                x = np.vstack(b["x"].iloc[at].to_numpy())
                out[at] = [r.tobytes() for r in _binned(x, b["edges"].iloc[at[0]])]
            yield pd.DataFrame({"symbol": b["symbol"], "rn": b["rn"], "y": b["y"], "bins": out})

    rows = train.select("symbol", F.col("rn").cast("long").alias("rn"), F.col("label").cast("double").alias("y"),
                        F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    return rows.join(edges.select("symbol", "edges"), "symbol").mapInPandas(run, "symbol string, rn long, y double, bins binary")


def _arrays(pdf: pd.DataFrame):
    pdf = pdf.sort_values("rn", kind="stable")
    bins = np.frombuffer(b"".join(pdf["bins"]), dtype=np.uint8).reshape(len(pdf), -1)
    return pdf["rn"].to_numpy(), pdf["y"].to_numpy(), bins


def _node_rows(symbol: str, number: int, tree: Tree, edges, rate: float) -> pd.DataFrame:
    feature, cut = tree.feature, tree.bin
    return pd.DataFrame({
        "symbol": symbol, "tree": number, "node": range(len(feature)), "feature": feature,
        "threshold": [float(edges[f][b]) if f >= 0 else None for f, b in zip(feature, cut)],
        "child": tree.child, "value": [v * rate for v in tree.value]})


def _first_tree(symbol: str, margin: float) -> pd.DataFrame:
    return _node_rows(symbol, -1, Tree(value=(margin,)), None, 1.0)


def _fit_small(rows: DataFrame, edges: DataFrame, kind: Kind, n_bins: int) -> DataFrame:
    """Symbols of up to LOCAL_ROWS training rows: rows has symbol, rn, y, bins."""
    per = TREES_PER_TASK if not kind.boosted else kind.trees

    def fit(key, pdf: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(info):
            return pd.DataFrame(columns=["symbol", "tree", "node", "feature", "threshold", "child", "value"])
        symbol, block = key
        edge, mean = info["edges"].iloc[0], float(info["mean_y"].iloc[0])
        rn, y, bins = _arrays(pdf)
        none = np.zeros(len(y), dtype=np.int64)
        out = [_first_tree(symbol, start_margin(mean, kind))] if block == 0 else []
        margin = np.full(len(y), start_margin(mean, kind))
        for number in range(block * per, min((block + 1) * per, kind.trees)):
            if kind.boosted:
                stats, use = boost_stats(y, margin, kind), slice(None)
            else:
                stats = forest_stats(y, rn, number)
                use = stats[:, 0] > 0
            tree = grow(Tree(), [0], kind.depth, bins[use], none[use], stats[use], kind, number, n_bins)
            if kind.boosted:
                margin = margin + kind.rate * np.array(tree.value)[tree.frontier(bins)]
            rate = kind.rate if kind.boosted else 1.0 / kind.trees
            out.append(_node_rows(symbol, number, tree, edge, rate))
        return pd.concat(out, ignore_index=True)

    blocks = -(-kind.trees // per)
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    infos = edges.select(F.col("symbol").alias("_of"), "edges", "mean_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_at"))
    return dealt.groupBy("symbol", "block").cogroup(infos.groupBy("_of", "_at")).applyInPandas(fit, NODE_SCHEMA)


# ---- large symbols, level by level over chunks

GROWN_COLUMNS = ["feature", "bin", "child", "value", "key", "n", "open"]
GROWN = ("symbol string, tree int, node int, feature int, bin int, child int, value double, key long, n double, open boolean")
NUMBER = ["symbol", "tree", "node"]


def _trees_of(nodes: pd.DataFrame) -> dict[int, Tree]:
    return {int(t): Tree(*(g[c].tolist() for c in GROWN_COLUMNS[:5]))
            for t, g in nodes.sort_values(["tree", "node"]).groupby("tree")}


def _stats(number: int, rn, y, margin, kind: Kind) -> np.ndarray:
    return boost_stats(y, margin, kind) if kind.boosted else forest_stats(y, rn, number)


def _over_chunks(chunks: DataFrame, grown: DataFrame, fn, schema: str) -> DataFrame:
    """fn(symbol, rows, nodes) for every chunk with the trees of its symbol."""
    nodes = grown.join(chunks.select(F.col("symbol").alias("_of"), F.col("chunk").alias("_at")).distinct(), F.col("symbol") == F.col("_of"))

    def run(key, rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        out = fn(key[0], rows.sort_values("rn", kind="stable"), nodes) if len(rows) and len(nodes) else []
        return pd.DataFrame(out, columns=columns)

    return chunks.groupBy("symbol", "chunk").cogroup(nodes.groupBy("_of", "_at")).applyInPandas(run, schema)


def _splitter(kind: Kind, n_bins: int, last: bool):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        """A node's split from the partial sums of all chunks."""
        first = pdf.iloc[0]
        total = sum(np.frombuffer(x, dtype=np.float64) for x in pdf["sums"]).reshape(1, -1, n_bins, 3)
        f, b, v = best_splits(total, kind, int(first["tree"]), np.array([first["key"]]))
        return pd.DataFrame([(first["symbol"], first["tree"], first["node"], -1 if last else int(f[0]), int(b[0]), float(v[0]),
                              float(total[0, 0, :, 0].sum()))], columns=[*NUMBER, "feature", "bin", "value", "n"])

    return split


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row with the sum of a node's partial sums."""
    total = sum(np.frombuffer(x, dtype=np.float64) for x in pdf["sums"])
    return pdf.iloc[:1][[*NUMBER, "key"]].assign(sums=[total.tobytes()])


def _grow_large(chunks: DataFrame, roots: DataFrame, kind: Kind, n_bins: int, local_rows: int, parts: int) -> DataFrame:
    """Nodes (GROWN) of all trees in ``roots`` (symbol, tree); chunks: symbol,
    chunk, rn, y, margin, bins.  One aggregation per level for all of them, in
    two steps: among chunks that are equal modulo ``parts``, then among the parts."""
    grown = materialize(roots.selectExpr("symbol", "tree", "0 as node", "-1 as feature", "0 as bin", "-1 as child",
                                         "0D as value", "1L as key", "0D as n", "true as open"))

    def partial(symbol: str, rows: pd.DataFrame, nodes: pd.DataFrame) -> list[tuple]:
        rn, y, bins = _arrays(rows)
        part, margin, out, live = int(rows["chunk"].iloc[0]) % parts, rows["margin"].to_numpy(), [], nodes[nodes["open"]]
        for number, tree in _trees_of(nodes).items():
            want = np.sort(live.loc[live["tree"] == number, "node"].to_numpy())
            if not len(want):
                continue
            stats, at = _stats(number, rn, y, margin, kind), tree.frontier(bins)
            use = np.isin(at, want) & (stats[:, 0] > 0)
            sums = level_sums(bins[use], np.searchsorted(want, at[use]), stats[use], len(want), n_bins)
            out += [(symbol, number, int(i), tree.key[int(i)], part, s.tobytes()) for i, s in zip(want, sums)]
        return out

    for depth in range(kind.depth + 1):
        last = depth == kind.depth

        sums = _over_chunks(chunks, grown, partial, "symbol string, tree int, node int, key long, part int, sums binary")
        if parts > 1:
            sums = sums.groupBy(*NUMBER, "part").applyInPandas(_added, "symbol string, tree int, node int, key long, sums binary")
        found = materialize(sums.groupBy(*NUMBER).applyInPandas(
            _splitter(kind, n_bins, last), "symbol string, tree int, node int, feature int, bin int, value double, n double"))

        def enter(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            """The tree with this level's splits; their children are open."""
            old, new = old.sort_values("node"), new.sort_values("node")
            tree = _trees_of(old)[int(key[1])]
            children = tree.put(*(new[c].to_numpy() for c in ("node", "feature", "bin", "value")))
            n = dict(zip(old["node"], old["n"])) | dict(zip(new["node"], new["n"]))
            of_parent = {c: n[i] for i, f, x in zip(new["node"], new["feature"], np.array(tree.child)[new["node"]]) if f >= 0
                         for c in (x, x + 1)}
            size = len(tree.feature)
            return pd.DataFrame({"symbol": key[0], "tree": key[1], "node": range(size), "feature": tree.feature, "bin": tree.bin,
                                 "child": tree.child, "value": tree.value, "key": tree.key,
                                 "n": [float(of_parent.get(i, n.get(i, 0.0))) for i in range(size)],
                                 "open": np.isin(np.arange(size), children)})

        grown = materialize(grown.groupBy("symbol", "tree").cogroup(found.groupBy("symbol", "tree")).applyInPandas(enter, GROWN))
        if not kind.boosted and not last:
            # an open node's n is its parent's until its own sums are known
            small = grown.where(F.col("open") & (F.col("n") <= local_rows))
            if not small.isEmpty():
                grown = _finish(chunks, grown, small.select(*NUMBER), kind, n_bins, kind.depth - depth - 1, local_rows)
        if grown.where("open").isEmpty():
            break
    return grown


def _finish(chunks: DataFrame, grown: DataFrame, small: DataFrame, kind: Kind, n_bins: int, depth: int, local_rows: int) -> DataFrame:
    """Grows the forest nodes ``small`` to the end: the rows of each come
    together in one task, at most ``local_rows`` of them."""
    marked = materialize(grown.join(small.withColumn("mine", F.lit(True)), NUMBER, "left").fillna({"mine": False}))

    def rows_of(symbol: str, rows: pd.DataFrame, nodes: pd.DataFrame) -> list[tuple]:
        rn, y, bins = _arrays(rows)
        out = []
        for number, tree in _trees_of(nodes).items():
            mine = nodes.loc[(nodes["tree"] == number) & nodes["mine"], "node"].to_numpy()
            at = tree.frontier(bins)
            for i in np.flatnonzero(np.isin(at, mine) & (bag_weights(number, rn) > 0)).tolist():
                out.append((symbol, number, int(at[i]), tree.key[int(at[i])], int(rn[i]), float(y[i]), bins[i].tobytes()))
        return out

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        """The subtree of a node, numbered from its own root."""
        first = pdf.iloc[0]
        rn, y, bins = _arrays(pdf)
        number = int(first["tree"])
        tree = grow(Tree(key=(int(first["key"]),)), [0], depth, bins, np.zeros(len(y), dtype=np.int64),
                    forest_stats(y, rn, number), kind, number, n_bins)
        return pd.DataFrame({"symbol": first["symbol"], "tree": number, "top": int(first["node"]), "node": range(len(tree.feature)),
                             "feature": tree.feature, "bin": tree.bin, "child": tree.child, "value": tree.value, "key": tree.key})

    rows = _over_chunks(chunks, marked, rows_of, "symbol string, tree int, node int, key long, rn long, y double, bins binary")
    subtrees = rows.groupBy(*NUMBER).applyInPandas(
        below, "symbol string, tree int, top int, node int, feature int, bin int, child int, value double, key long")

    def graft(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        """A subtree's root takes the place of its node; its other nodes follow at the end."""
        table = {c: old.sort_values("node")[c].tolist() for c in GROWN_COLUMNS}
        for top, g in new.sort_values(["top", "node"]).groupby("top"):
            size = len(table["feature"])
            place = [int(top), *range(size, size + len(g) - 1)]
            for c in GROWN_COLUMNS:
                table[c] += [table[c][0]] * (len(g) - 1)
            for i, r in zip(place, g.itertuples()):
                child = place[int(r.child)] if r.child >= 0 else -1
                for c, v in zip(GROWN_COLUMNS, (int(r.feature), int(r.bin), child, float(r.value), int(r.key), 0.0, False)):
                    table[c][i] = v
        return pd.DataFrame({"symbol": key[0], "tree": key[1], "node": range(len(table["feature"])), **table})

    return materialize(grown.groupBy("symbol", "tree").cogroup(subtrees.groupBy("symbol", "tree")).applyInPandas(graft, GROWN))


def _fit_large(rows: DataFrame, edges: DataFrame, kind: Kind, n_bins: int, local_rows: int, chunk_rows: int) -> DataFrame:
    begin = F.col("mean_y")
    if not kind.boosted:
        begin = F.lit(0.0)
    elif kind.classify:
        p = F.least(F.greatest(begin, F.lit(1e-6)), F.lit(1 - 1e-6))
        begin = F.log(p / (1 - p))
    starts = edges.select("symbol", begin.cast("double").alias("margin"))
    chunks = materialize(rows.withColumn("chunk", F.floor(F.col("rn") / chunk_rows)).join(starts, "symbol"))
    rate = kind.rate if kind.boosted else 1.0 / kind.trees
    grown_parts = []
    # a symbol's chunks meet in groups of about the root of their number
    parts = math.ceil(math.sqrt((edges.agg(F.max("n")).first()[0] or 1) / chunk_rows))

    def numbered(first: int, n: int) -> DataFrame:
        return edges.select("symbol", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("tree"))

    if kind.boosted:
        def step(symbol: str, pdf: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            _, _, bins = _arrays(pdf)
            (tree,) = _trees_of(nodes).values()
            return pdf.assign(margin=pdf["margin"].to_numpy() + kind.rate * np.array(tree.value)[tree.frontier(bins)])[chunks_columns]

        chunks_columns = ["symbol", "chunk", "rn", "y", "margin", "bins"]
        chunks = chunks.select(*chunks_columns)
        for number in range(kind.trees):
            grown_parts.append(_grow_large(chunks, numbered(number, 1), kind, n_bins, local_rows, parts))
            chunks = materialize(_over_chunks(chunks, grown_parts[-1], step,
                                              "symbol string, chunk long, rn long, y double, margin double, bins binary"))
    else:
        grown_parts.append(_grow_large(chunks, numbered(0, kind.trees), kind, n_bins, local_rows, parts))
    grown = grown_parts[0]
    for part in grown_parts[1:]:
        grown = grown.unionByName(part)
    nodes = grown.join(edges.select("symbol", "edges"), "symbol").select(
        *NUMBER, "feature", F.when(F.col("feature") >= 0, F.get(F.get("edges", F.greatest("feature", F.lit(0))), F.col("bin"))).alias("threshold"),
        "child", (F.col("value") * rate).alias("value"))
    first = starts.select("symbol", F.lit(-1).alias("tree"), F.lit(0).alias("node"), F.lit(-1).alias("feature"),
                          F.lit(None).cast("double").alias("threshold"), F.lit(-1).alias("child"), F.col("margin").alias("value"))
    return nodes.unionByName(first)


def fit_trees(prepared: DataFrame, features, kind: Kind, n_bins: int = BINS, local_rows: int = LOCAL_ROWS,
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Node table (NODE_SCHEMA) of the model of every symbol, from its training rows."""
    train = prepared.where("is_train")
    edges = materialize(bin_edges(train, features, n_bins))
    rows = binned_rows(train, features, edges)
    if edges.where(F.col("n") > local_rows).isEmpty():
        return _fit_small(rows, edges, kind, n_bins)
    sizes = edges.select("symbol", (F.col("n") > local_rows).alias("_large"))
    rows = materialize(rows.join(sizes, "symbol"))
    small = _fit_small(rows.where("not _large").drop("_large"), edges.where(F.col("n") <= local_rows), kind, n_bins)
    large = _fit_large(rows.where("_large").drop("_large"), edges.where(F.col("n") > local_rows), kind, n_bins, local_rows, chunk_rows)
    return small.unionByName(large)


def predict_trees(rows: DataFrame, nodes: DataFrame, features, kind: Kind, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """symbol, rn, y, p (and prob_up for classifiers) of rows with symbol, rn, label and features."""
    asked = rows.select("symbol", F.floor(F.col("rn") / chunk_rows).alias("chunk"), F.col("rn").cast("long").alias("rn"),
                        F.col("label").cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    of_chunk = nodes.join(asked.select(F.col("symbol").alias("_of"), F.col("chunk").alias("_at")).distinct(), F.col("symbol") == F.col("_of"))

    def run(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["symbol", "rn", "y"]].copy()
        if not len(pdf) or not len(model):
            return out.iloc[:0].assign(p=[], prob_up=[])
        x, total = np.vstack(pdf["x"].to_numpy()), np.zeros(len(pdf))
        model = model.sort_values(["tree", "node"])
        feature, cut, child, value = (model[c].to_numpy() for c in ("feature", "threshold", "child", "value"))
        tree = model["tree"].to_numpy()
        for root in np.flatnonzero(np.append(True, tree[1:] != tree[:-1])).tolist():
            at = np.full(len(x), root)
            inner = np.flatnonzero(feature[at] >= 0)
            while len(inner):
                here = at[inner]
                at[inner] = root + child[here] + (x[inner, feature[here]] > cut[here])
                inner = inner[feature[at[inner]] >= 0]
            total += value[at]
        if kind.classify:
            prob = 1 / (1 + np.exp(-total)) if kind.boosted else total
            return out.assign(p=(prob > 0.5).astype(float), prob_up=prob)
        return out.assign(p=total, prob_up=None)

    found = asked.groupBy("symbol", "chunk").cogroup(of_chunk.groupBy("_of", "_at")).applyInPandas(
        run, "symbol string, rn long, y double, p double, prob_up double")
    return found if kind.classify else found.drop("prob_up")


def fit_predict_trees(prepared: DataFrame, name: str, features, classify: bool) -> DataFrame:
    """Hold-out predictions of a tree model for every symbol."""
    kind = kind_of(name, classify)
    nodes = materialize(fit_trees(prepared, features, kind))
    return predict_trees(prepared.where("not is_train"), nodes, features, kind)
