"""MinHash near-duplicates with sequential Bayesian verification.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets
of distinct word shingles.  Equal sets form one *class* first, so exact copies
cost nothing further; everything below works on classes.

**Signature and bands.**  A class has ``HASHES`` minima of its set under as many
hash functions.  Bands of r consecutive minima become keys; r is the largest
number at which a pair right at the threshold t shares no band with a
probability of at most ``MISS``: (1 - t**r) ** (HASHES / r) <= MISS (4 minima at 0.8,
where the miss is 5e-8).

**Candidates.**  Classes that share a key are candidates.  A key held by up to
``SMALL`` classes gives its pairs; a larger one a star: every member with one
pivot, another one in every key, so a cluster of near copies hangs together
after a number of pairs in proportion to its size.  Only where the members of
a large key still lie in different components after the links of the stars
are known, members outside the key's main component meet the others, block by
block inside tasks.  A first pass over signatures gives the members that have a
pair left (rows of members, not pairs); a second, over their whole sets, gives
each such member's best link, and is repeated for those that had one.

**Sequential Bayesian verification.**  Signatures are compared in batches of
``BATCH`` minima.  After m matches of k, with a flat prior, similarity reaches t with
probability P(Bin(k + 1, t) <= m); a pair is dropped as soon as that is below
``MISS``.  One byte of each minimum is compared: two different minima share it
once in 256, which can only keep a pair longer.

**Exact verification.**  What survives is compared by its whole sets.  First
each class meets the survivor with most matches; components follow; other
survivors are compared only if they lie between components, since a link
inside one changes nothing.

Scale: shuffles carry band keys (one row per class and band), 128-byte signatures and
the sets of survivors; texts are read twice and enter a shuffle only if their
class survives.  Blocks have a fixed number of rows on both sides, so no task
grows with a group.

Defined cases: null and empty texts, and texts without words, have an empty
set and link with nothing (their component is their own id); fewer words than
a shingle has make one shingle; null ids are larger than any id and a
component of null ids only has a null id and is kept; repeated rows are
copies; extra columns are ignored; texts are processed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from velas.llm.common import store
from velas.llm.components import components
from velas.llm.jaccard_join import NO_ID, _merge, _rooted, _sets, _verify, class_key, shingle_sets
from velas.llm.text_tokens import blocks, mix64

SHINGLE = 5
PERCENT = 80
HASHES = 128
MISS = 1e-6
BATCH = 32
SMALL = 16
BLOCK_ROWS = 512
LINK_ROWS = 256         # rows a block where whole sets are compared

_U = np.uint64
_seeds = np.random.default_rng(20240301).integers(0, 1 << 31, (2, HASHES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def rows_per_band(percent: int) -> int:
    t = percent / 100
    fit = [r for r in range(1, HASHES + 1) if (1 - t ** r) ** (HASHES // r) <= MISS]
    return max(fit, default=1)


def least_matches(percent: int) -> list[int]:
    """For each batch the matches so far below which a pair is dropped."""
    t = percent / 100
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += math.comb(k + 1, m) * t ** m * (1 - t) ** (k + 1 - m)
            if below >= MISS:
                break
            m += 1
        out.append(m)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(set, hash) minima as 32-bit integers; no set is empty."""
    x = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    y, z = np.empty_like(x), np.empty_like(x)
    for i, (a, b) in enumerate(_seeds.T):
        np.multiply(x, a, out=y)
        np.right_shift(y, 15, out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, b, out=y)
        out[:, i] = np.minimum.reduceat(y, start)
    return out


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """(set, band) keys of bands of ``rows`` minima."""
    n = HASHES // rows
    out = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (len(minima), n)).copy()
    for k in range(rows):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + minima[:, k:n * rows:rows])
    return out.view(np.int64)


def _describe(size: int, rows: int):
    """doc_id, n and class of every document; signature bytes and band keys
    where the task meets the class for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            n, key, bits, bands = [], [], [], []
            for block in blocks(b.column("text"), lower=True):
                new, at = [], []
                for s in shingle_sets(block, size):
                    c = class_key(s) if len(s) else None
                    n.append(len(s))
                    key.append(c)
                    if c is not None and c not in seen:
                        seen.add(c)
                        new.append(s)
                        at.append(len(bits))
                    bits.append(None)
                    bands.append(None)
                if new:
                    minima = signatures(new)
                    for i, sig, keys in zip(at, minima.astype(np.uint8), band_keys(minima, rows).tolist()):
                        bits[i], bands[i] = sig.tobytes(), keys
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()),
                 pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "cls", "sig", "bands"])

    return run


def _fits(n: str, m: str, percent: int) -> Column:
    """Sizes that can reach the threshold."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def _sequential(percent: int):
    """Pairs (u, v) that no batch rejects, with their matches."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _matrix(b.column("sig_u")), _matrix(b.column("sig_v"))
            at, m = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            for i, need in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                m = m + (x[at, part] == y[at, part]).sum(axis=1)
                at, m = at[m >= need], m[m >= need]
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("u").take(keep), b.column("v").take(keep), pa.array(m)],
                                             ["u", "v", "matches"])

    return run


def _survivors(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    side = {c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
            for c in ("u", "v")}
    return store(pairs.join(side["u"], "u").join(side["v"], "v").where(_fits("n_u", "n_v", percent))
                 .select("u", "v", "sig_u", "sig_v")
                 .mapInArrow(_sequential(percent), "u long, v long, matches long"), "minhash-survivors")


def _units(answer):
    """Calls ``answer`` with both sides of each (key, i, j) of rows sorted by
    (key, i, j, side): per side the arrays cls, n, root and the list of data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1]:
                yield from answer(unit[0], *(
                    [*(np.concatenate(x) for x in list(zip(*s))[:3]), [d for part in s for d in part[3]]] for s in sides))

        for b in batches:
            keys, i, j, side, cls, n, root = (
                b.column(c).to_numpy() for c in ("key", "i", "j", "side", "cls", "n", "root"))
            if not len(keys):
                continue
            data = b.column("data").to_pylist()
            edge = np.flatnonzero((np.diff(keys) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip(np.append(0, edge), np.append(edge, len(keys))):
                if (keys[lo], i[lo], j[lo]) != unit:
                    yield from done()
                    unit, sides = (keys[lo], i[lo], j[lo]), ([], [])
                sides[side[lo]].append([cls[lo:hi], n[lo:hi], root[lo:hi], data[lo:hi]])
        yield from done()

    return run


def _apart(a: list, b: list, percent: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of a[lo:hi] and b in different components whose sizes fit."""
    i, j = np.nonzero((a[2][lo:hi, None] != b[2][None, :])
                      & (100 * np.minimum(a[1][lo:hi, None], b[1][None, :])
                         >= percent * np.maximum(a[1][lo:hi, None], b[1][None, :])))
    return i + lo, j


def _alive(percent: int):
    """(key, cls, n, root, outer): rows of a unit that are in a pair which no batch rejects."""
    least = least_matches(percent)

    def answer(key: int, a: list, b: list) -> Iterator[pa.RecordBatch]:
        a_sig, b_sig = (np.frombuffer(b"".join(x[3]), dtype=np.uint8).reshape(-1, HASHES) for x in (a, b))
        kept = np.zeros(len(a_sig), dtype=bool), np.zeros(len(b_sig), dtype=bool)
        step = max(1, (1 << 17) // len(b_sig))
        for lo in range(0, len(a_sig), step):
            i, j = _apart(a, b, percent, lo, lo + step)
            m = np.zeros(len(i), dtype=np.int64)
            for k, need in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                m += (a_sig[i, cut] == b_sig[j, cut]).sum(axis=1)
                stay = m >= need
                i, j, m = i[stay], j[stay], m[stay]
            kept[0][i] = kept[1][j] = True
        for side, rows, outer in ((a, kept[0], True), (b, kept[1], False)):
            n = int(rows.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, key)), *(pa.array(x[rows]) for x in side[:3]), pa.array(np.full(n, outer))],
                ["key", "cls", "n", "root", "outer"])

    return _units(answer)


def _links(percent: int):
    """For each row of side 0 that links to another component by whole sets, its best link."""

    def answer(key: int, a: list, b: list) -> Iterator[pa.RecordBatch]:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in b[3]]
        length = np.array([len(x) for x in sets], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(length)])
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        flag = np.zeros(len(values), dtype=np.int32)
        found = []
        for x in range(len(a[0])):
            _, j = _apart(a, b, percent, x, x + 1)
            if not len(j):
                continue
            mine = np.searchsorted(values, own := np.frombuffer(a[3][x], dtype=np.uint64))
            mine[mine == len(values)] = 0
            mine = mine[values[mine] == own]
            flag[mine] = 1
            before = np.concatenate([[0], np.cumsum(flag[at], dtype=np.int64)])
            flag[mine] = 0
            both = before[start[j + 1]] - before[start[j]]
            either = len(own) + length[j] - both
            linked = np.flatnonzero(100 * both >= percent * either)
            if len(linked):
                y = j[linked[np.lexsort((b[0][j[linked]], -both[linked] / either[linked]))[0]]]
                found.append((int(a[0][x]), int(b[0][y])))
        if found:
            x, y = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), key)), pa.array(x), pa.array(y)], ["key", "u", "v"])

    return _units(answer)


def _dealt(outer: DataFrame, members: DataFrame, block_rows: int) -> DataFrame:
    """Units (key, i, j): about ``block_rows`` rows of ``outer`` and as many of
    ``members`` (both key, cls, n, root, data) for every pair of blocks of a key."""
    def blocks_of(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    counts = store(blocks_of(outer, "n_i").join(blocks_of(members, "n_j"), "key"), "minhash-counts")

    def side(rows: DataFrame, number: int, own: str, other: str) -> DataFrame:
        rows = rows.join(counts, "key")
        return (rows.withColumn(own, F.pmod(F.xxhash64("cls"), F.col(f"n_{own}")).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
                .select("key", "i", "j", F.lit(number).alias("side"), "cls", "n", "root", "data"))

    return (side(outer, 0, "i", "j").union(side(members, 1, "j", "i")).repartition("key", "i", "j")
            .sortWithinPartitions("key", "i", "j", "side"))


def _join_apart(many: DataFrame, classes: DataFrame, sets: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """``joined`` with all further links between members of one large key.

    First signatures say which members have a pair left, one row each; no pair
    leaves the task.  Then each of those that are *outer* gives its best link by
    whole sets, if any, until none does: a member without a link has none later
    on, and every link has an end that was outer, so nothing is missed."""
    placed = store(_rooted(many, joined, "cls", "root"), "minhash-placed")
    roots = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = store(roots.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"),
                                           F.count(F.lit(1)).alias("_k")).where("_k > 1").select("key", "main"), "minhash-mixed")
    members = store(placed.join(mixed, "key").join(classes.select("cls", F.col("sig").alias("data")), "cls"), "minhash-members")
    alive = store(_dealt(members.where("root <> main"), members, BLOCK_ROWS)
                  .mapInArrow(_alive(percent), "key long, cls long, n long, root long, outer boolean")
                  .groupBy("key", "cls").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.max("outer").alias("outer")),
                  "minhash-alive")
    # with their sets, once; later rounds read the keys that had a link
    rows = whole = store(alive.join(sets.withColumnRenamed("set", "data"), "cls"), "minhash-whole")
    outer = rows.where("outer")
    while True:
        found = store(_dealt(outer, rows, LINK_ROWS).mapInArrow(_links(percent), "key long, u long, v long"), "minhash-across")
        if found.isEmpty():
            return joined
        joined = _merge(joined, found.select("u", "v").distinct())
        active = store(found.select("key", F.col("u").alias("cls")).distinct(), "minhash-active")
        rows = store(_rooted(whole.drop("root").join(active.select("key").distinct(), "key", "left_semi"), joined, "cls", "root"),
                     "minhash-whole")
        outer = rows.join(active, ["key", "cls"], "left_semi")


def linked_classes(rows: DataFrame, described: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of all classes that link to another; rows have (_id, text)."""
    classes = store(described.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("_id"), F.first("n").alias("n"), F.first("sig", True).alias("sig"),
        F.first("bands", True).alias("bands")), "minhash-classes")
    keyed = classes.select("cls", "n", F.explode("bands").alias("key"))
    groups = store(keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("cls", "key").alias("h"), "cls")).alias("least"))
        .where("size > 1").select("key", "size", F.col("least.cls").alias("pivot")), "minhash-groups")
    members = store(keyed.join(groups, "key"), "minhash-members")
    few = members.where(F.col("size") <= SMALL).select("key", F.col("cls").alias("u"), "n")
    other = few.select("key", F.col("u").alias("v"), F.col("n").alias("m"))
    pairs = few.join(other, "key").where((F.col("u") < F.col("v")) & _fits("n", "m", percent)).select("u", "v")
    many = store(members.where(F.col("size") > SMALL).select("key", "cls", "n", "pivot"), "minhash-many")
    stars = many.where("cls <> pivot").select(F.least("cls", "pivot").alias("u"), F.greatest("cls", "pivot").alias("v"))
    alive = _survivors(pairs.union(stars).distinct(), classes, percent)

    wanted = (alive.select(F.explode(F.array("u", "v")).alias("cls")).union(many.select("cls")).distinct()
              .join(classes.select("cls", "_id"), "cls"))
    sets = _sets(rows, store(wanted, "minhash-wanted"), size)
    ends = alive.select("u", "v", "matches", F.explode(F.array("u", "v")).alias("_end"))
    nearest = (ends.groupBy("_end").agg(F.max_by(F.struct("u", "v"), F.struct("matches", "u", "v")).alias("p"))
               .select("p.u", "p.v").distinct())
    joined = store(components(_verify(nearest, sets, percent)), "minhash-components")
    rest = store(_rooted(_rooted(alive.select("u", "v"), joined, "u", "_ru"), joined, "v", "_rv")
                 .where("_ru <> _rv").select("u", "v"), "minhash-rest")
    if not rest.isEmpty():
        joined = _merge(joined, _verify(rest, sets, percent))
    return joined if many.isEmpty() else _join_apart(many.select("key", "cls", "n"), classes, sets, joined, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """Per row doc_id, n_shingles, component_id and kept."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    described = store(rows.select(F.col("_id").alias("doc_id"), "text")
                      .mapInArrow(_describe(size, rows_per_band(percent)),
                                  "doc_id long, n long, cls long, sig binary, bands array<long>"), "minhash-docs")
    joined = linked_classes(rows, described, size, percent)
    narrow = described.select("doc_id", "n", "cls")
    placed = store(_rooted(narrow.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("_least")),
                           joined, "cls", "grp"), "minhash-placed")
    least = placed.groupBy("grp").agg(F.min("_least").alias("component_id"))
    of_class = store(placed.join(least, "grp").select(F.col("cls").alias("_cls"), "component_id"), "minhash-of")

    def real(c: Column) -> Column:
        return F.when(c != NO_ID, c)

    component = F.coalesce("component_id", "doc_id")
    return narrow.join(of_class, F.col("cls") == F.col("_cls"), "left").select(
        real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"),
        (F.col("doc_id") == component).alias("kept"))
