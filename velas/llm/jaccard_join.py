"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of
distinct word shingles; shingle size and percent are arguments (4 words and 85
if not given).  Equal sets form one *class* first (by a hash of the
set), so copies cost nothing further; everything below works on classes.

**Prefixes.**  In any fixed order of all shingles, two linked sets of sizes n
and m share a shingle within their first n - ceil(t n) + 1 and
m - ceil(t m) + 1 ones (t = percent / 100), and at least l shingles within prefixes that are
l - 1 longer.  The order used here is: shingles of a fixed *zone* of the hash
space (a quarter of it, so that the exact number of classes holding each zone
shingle can be counted), the rarest first, then all others by hash.  A prefix
thus passes over costly shingles as long as the zone offers cheaper ones, and
most documents end with a prefix of shingles that nobody else has: no
candidates at all.  The cost of the others is estimated as the number of rows
their prefix shingles hold; the higher it is, the longer the prefix (l up to
``MAX_MATCHES``) and the more shared prefix shingles a pair needs before it is
verified.

**Candidates.**  Shingles held by up to ``SMALL`` prefixes give their pairs, at
most SMALL * (SMALL - 1) / 2 each, counted per pair against l.  A larger group
gives a star: every member with one pivot.  Only where members of such a group
still lie in different components after that, sketches are compared across
components inside a task, block by block, and the pairs they admit follow; no
pair within a component is ever made.  Candidates are cut by size and by a
parity sketch: 512 bits, each the parity of the shingles hashed to it, so that
differing bits never exceed the symmetric difference.

**Verification** compares whole sets.  First each class meets its nearest
candidate by sketch; components follow; the remaining pairs are verified only
where they lie between components.  Links that would join what is joined
already change no component.

Hot shingles (in many documents of a bounded sample) skip the counting and
take the last place in the zone's order; this fixes the order, not the result.

Defined cases: null and empty texts, and texts without words, have an empty
set and link with nothing (their component is their own id); fewer words
than a shingle has make one shingle; null ids are larger than any id and a component of
null ids only has a null id; repeated rows are copies; extra columns are
ignored; texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from velas.llm.common import store
from velas.llm.components import components
from velas.llm.text_tokens import Block, blocks, gram_hashes, mix64

SHINGLE = 4
PERCENT = 85
ZONE = np.uint64(1 << 62)   # the zone: hashes below a quarter of 2**64
SAMPLE_DOCS = 8192
HOT_DOCS = 40
HOT_RANK = 1 << 20          # count that stands for every hot shingle
BEYOND_ZONE = 1 << 30       # and for shingles outside the zone
SMALL = 16
MAX_MATCHES = 4
BLOCK_ROWS = 1024
TOKEN_PARTS = 8             # the groups of one pivot go to so many tasks
NO_ID = (1 << 63) - 1
SIEVE_BITS = 1 << 26


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(block: Block, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    grams = gram_hashes(block.hash, size)
    for lo, hi in zip(block.offset[:-1], block.offset[1:]):
        if hi - lo >= size:
            yield np.unique(grams[lo:hi - size + 1])
        elif hi > lo:
            yield mix64(gram_hashes(block.hash[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, dtype=np.uint64)


def class_key(s: np.ndarray) -> int:
    """64-bit hash of a set, as a signed integer."""
    return int(mix64(np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True) + np.uint64(len(s)))
               .view(np.int64)[0])


def sketch(s: np.ndarray) -> list[int]:
    odd = np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _describe(size: int):
    """doc_id, n, class key and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, bits = [], [], []
            for block in blocks(b.column("text"), lower=True):
                for s in shingle_sets(block, size):
                    n.append(len(s))
                    key.append(class_key(s) if len(s) else None)
                    bits.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.int64()),
                 pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "cls", "bits"])

    return run


def _hot_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted zone shingles that HOT_DOCS or more documents of a sample hold."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column("text"), lower=True):
                s = np.concatenate([x[:np.searchsorted(x, ZONE)] for x in shingle_sets(block, size)])
                found, n = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["token", "n"])

    span = 1 << 30
    hot = (docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(share * span)).select("text")
           .mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= HOT_DOCS).select("token").toArrow())
    return np.sort(hot["token"].to_numpy().astype(np.int64).view(np.uint64))


TOKEN_SCHEMA = "token long, cls long, sizes long, rank int"


def _tokens(hot_broadcast, size: int, percent: int):
    """Zone shingles of each class (and, where the zone is shorter than the
    prefix, the next ones by hash): token, cls, sizes = n << 32 | emitted, and
    rank: 0 if the count is still to be made.  A task emits a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_broadcast.value
        seen: set[int] = set()
        for b in batches:
            for block in blocks(b.column("text"), lower=True):
                parts, keys, sizes, lengths, zones = [], [], [], [], []
                for s in shingle_sets(block, size):
                    if not len(s) or (key := class_key(s)) in seen:
                        continue
                    seen.add(key)
                    zone = int(np.searchsorted(s, ZONE))
                    e = max(zone, prefix_length(len(s), percent))
                    parts.append(s[:e])
                    keys.append(key)
                    sizes.append(len(s) << 32 | e)
                    lengths.append(e)
                    zones.append(zone)
                if not parts:
                    continue
                token = np.concatenate(parts)
                rank = np.where(token < ZONE, 0, BEYOND_ZONE).astype(np.int32)
                if len(hot):
                    near = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    rank[hot[near] == token] = HOT_RANK
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(np.repeat(keys, lengths)),
                     pa.array(np.repeat(sizes, lengths)), pa.array(rank)], ["token", "cls", "sizes", "rank"])

    return run


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (token, cls): those whose token several classes hold,
    with their number as rank.  A group longer than the buffer counts as
    HOT_RANK // 2 and is passed on as it comes; rows that have a rank pass."""
    most, long = 1 << 16, HOT_RANK // 2
    names = ["token", "cls", "sizes"]
    held = [np.zeros(0, dtype=np.int64)] * 3
    running = last = None  # token of a group that is being passed on; the row before

    def settle(rows: list[np.ndarray], end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, running
        token = rows[0]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(first, len(token)))
        rank = np.where(size >= most, long, size)
        if running is not None and token[0] == running:
            rank[0] = long
        stop = len(token) if end or rank[-1] == long else int(first[-1])
        held = [x[stop:] for x in rows]
        running = int(token[-1]) if stop == len(token) else None
        rank = np.repeat(rank, size)
        out = np.flatnonzero(rank[:stop] >= 2)
        if len(out):
            yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in rows), pa.array(rank[out].astype(np.int32))],
                                             [*names, "rank"])

    for b in batches:
        rank = b.column("rank").to_numpy()
        if rank.any():
            yield b.take(pa.array(np.flatnonzero(rank)))
            b = b.take(pa.array(np.flatnonzero(rank == 0)))
        rows = [b.column(c).to_numpy() for c in names]
        if not len(rows[0]):
            continue
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        new[0] = last != (rows[0][0], rows[1][0])  # another task's copy of the class
        last = (rows[0][-1], rows[1][-1])
        rows = [np.concatenate([h, x[new]]) for h, x in zip(held, rows)]
        if len(rows[0]):
            yield from settle(rows, False)
    if len(held[0]):
        yield from settle(held, True)


def _prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, cls, n, matches): the shared shingles of each class's prefix and
    the number of matches it asks for."""
    hot = docs.sparkSession.sparkContext.broadcast(_hot_shingles(docs, size))
    found = docs.select("text").mapInArrow(_tokens(hot, size, percent), TOKEN_SCHEMA)
    # hot shingles need no counting, so they go with their classes to all partitions
    spread = F.when(F.col("rank") == HOT_RANK, F.col("cls")).otherwise(F.col("token"))
    counted = store(found.repartition(spread).sortWithinPartitions("token", "cls")
                    .mapInArrow(_rank, TOKEN_SCHEMA), "jaccard-tokens")
    by_class = Window.partitionBy("cls")
    n = F.shiftright("sizes", 32).cast("int")
    emitted = F.col("sizes").bitwiseAND((1 << 32) - 1).cast("int")
    p = n - F.floor((F.lit(percent) * n + 99) / 100).cast("int") + 1
    ranked = (counted.repartition("cls").dropDuplicates(["cls", "token"])
              .withColumn("_shared", F.count(F.lit(1)).over(by_class))
              .withColumn("_at", F.row_number().over(by_class.orderBy("rank", "token")))
              # shingles of its own come first in the order
              .withColumn("_own", emitted - F.col("_shared")))
    base = F.col("_own") + F.col("_at") <= p
    cost = F.sum(F.when(base, F.least("rank", F.lit(HOT_RANK))).otherwise(0).cast("long")).over(by_class)
    matches = (F.when(F.col("_cost") > 256, MAX_MATCHES).when(F.col("_cost") > 64, 3)
               .when(F.col("_cost") > 16, 2).otherwise(1))
    # a prefix can be lengthened only within the shingles whose order is known
    room = F.greatest(F.lit(1), F.least(matches, emitted - p + 1))
    return store(ranked.withColumn("_cost", cost).withColumn("n", n).withColumn("matches", room)
                 .where((F.col("_own") + F.col("_at") <= p + F.col("matches") - 1) & (F.col("_cost") > 0))
                 .select("token", "cls", "n", "matches"), "jaccard-prefixes")


def _fits(n: str, m: str, percent: int) -> Column:
    """Sizes that can reach the threshold."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _near(candidates: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that size and sketch admit, with ``apart``: differing bits."""
    side = {c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
            for c in ("u", "v")}
    apart = F.aggregate(F.zip_with("bits_u", "bits_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0),
                        lambda acc, x: acc + x)
    # 100 * i >= percent * (s - i) with s = n + m: at most s - 2 * ceil(percent s / (100 + percent)) shingles differ
    s = F.col("n_u") + F.col("n_v")
    return (candidates.join(side["u"], "u").join(side["v"], "v").where(_fits("n_u", "n_v", percent))
            .withColumn("apart", apart)
            .where(F.col("apart") <= s - 2 * F.ceil(F.lit(percent) * s / (100 + percent)))
            .select("u", "v", "apart"))


def _first_of(x: np.ndarray) -> np.ndarray:
    """Positions where a sorted array takes a new value."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _across(nearest: bool, percent: int):
    """Pairs across components: all, or for each row only its nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by (pivot, part, block, token, side): pairs of a row of side 0
        and one of side 1 in the same group, in different components, that size and
        sketch admit.  A pair that several groups of a part hold comes once."""
        key = token = done = None
        kept: list[list[np.ndarray]] = []  # side 0 of the group at hand: cls, n, root, bits
        seen: set[tuple[int, int]] = set()
        for b in batches:
            pivot, part, block, tokens, side, cls, n, root = (
                b.column(c).to_numpy() for c in ("pivot", "part", "block", "token", "side", "cls", "n", "root"))
            bits = b.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, 8)
            out: list[tuple[int, int]] = []
            edge = np.flatnonzero((np.diff(pivot) != 0) | (np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(tokens) != 0)
                                  | (np.diff(side) != 0)) + 1
            for lo, hi in zip(np.append(0, edge), np.append(edge, len(pivot))):
                if lo == hi:
                    continue
                if (pivot[lo], part[lo], block[lo]) != key:
                    key, seen = (pivot[lo], part[lo], block[lo]), set()
                    token = None
                if tokens[lo] != token:
                    token, kept, done = tokens[lo], [], None
                rows = [x[lo:hi] for x in (cls, n, root, bits)]
                if side[lo] == 0:
                    kept.append(rows)
                    continue
                if not kept:
                    continue
                if len(kept) > 1:
                    kept = [[np.concatenate(x) for x in zip(*kept)]]
                a_cls, a_n, a_root, a_bits = kept[0]
                done = np.zeros(len(a_cls), dtype=bool) if done is None else done
                step = max(1, (1 << 17) // len(a_cls))
                for at in range(0, hi - lo, step):
                    b_cls, b_n, b_root, b_bits = (x[at:at + step] for x in rows)
                    s = a_n[:, None].astype(np.int64) + b_n[None, :]
                    apart = np.bitwise_count(a_bits[:, None, :] ^ b_bits[None, :, :]).sum(axis=2, dtype=np.int64)
                    room = s - 2 * (-(-percent * s // (100 + percent)))
                    i, j = np.nonzero((apart <= room) & (a_root[:, None] != b_root[None, :])
                                      & (100 * np.minimum(a_n[:, None], b_n[None, :])
                                         >= percent * np.maximum(a_n[:, None], b_n[None, :])))
                    if nearest:  # one pair for each row of side 0 in a group, the nearest found first
                        i, j = i[~done[i]], j[~done[i]]
                    if nearest and len(i):
                        order = np.lexsort((apart[i, j], i))
                        first = order[_first_of(i[order])]
                        i, j = i[first], j[first]
                        done[i] = True
                    for u, v in zip(np.minimum(a_cls[i], b_cls[j]).tolist(), np.maximum(a_cls[i], b_cls[j]).tolist()):
                        if (u, v) not in seen:
                            seen.add((u, v))
                            out.append((u, v))
            if out:
                u, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _between_components(placed: DataFrame, classes: DataFrame, nearest: bool, percent: int) -> DataFrame:
    """Pairs (u, v) of large groups whose members lie in several components.
    ``placed``: token, pivot, cls, n, root.  The members outside a group's main
    component, in blocks of about BLOCK_ROWS, meet all its members."""
    roots = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    main = (roots.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"),
                                       F.count(F.lit(1)).alias("k"), (F.sum("c") - F.max("c")).alias("outside"))
            .where("k > 1"))
    mixed = store(placed.join(main.select("token", "main", "outside"), "token")
                  .join(classes.select("cls", "bits"), "cls"), "jaccard-mixed")
    blocks_of = store(mixed.groupBy("pivot").agg(
        F.ceil(F.max("outside") / BLOCK_ROWS).cast("int").alias("n_blocks")), "jaccard-blocks")
    rows = mixed.join(blocks_of, "pivot").select(
        "pivot", "token", "cls", "n", "root", "bits", (F.col("root") != F.col("main")).alias("_out"), "n_blocks")
    rows = rows.withColumn("part", F.pmod("token", F.lit(TOKEN_PARTS)).cast("int"))
    key = ["pivot", "part", "block"]
    columns = [*key, "token", "side", "cls", "n", "root", "bits"]
    ours = rows.where("_out").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int")).withColumn(
        "side", F.lit(0))
    theirs = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn(
        "side", F.lit(1))
    return store(ours.select(columns).union(theirs.select(columns)).repartition(*key)
                 .sortWithinPartitions(*key, "token", "side")
                 .mapInArrow(_across(nearest, percent), "u long, v long").distinct(), "jaccard-across")


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u, v, x, y in zip(*(b.column(c).to_pylist() for c in ("u", "v", "set_u", "set_v"))):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((u, v))
            u, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold."""
    return store(pairs.select("u", "v")
                 .join(sets.select(F.col("cls").alias("u"), F.col("set").alias("set_u")), "u")
                 .join(sets.select(F.col("cls").alias("v"), F.col("set").alias("set_v")), "v")
                 .mapInArrow(_compare(percent), "u long, v long"), "jaccard-links")


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, set) of the classes in ``wanted`` (cls, _id: a document that has it).

    Only the texts of those documents enter the shuffle: a bit table of a fixed
    number of bits tells them apart at the scan."""
    bit = F.pmod(F.xxhash64("_id"), F.lit(SIEVE_BITS))
    word, at = F.shiftright(bit, 6), F.pmod(bit, F.lit(64)).cast("int")
    table = store(wanted.select(word.alias("_word"), F.lit(1).cast("long").alias("_one"), at.alias("_at"))
                  .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _at)")).alias("_mask")), "jaccard-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("cls").to_pylist()
            out = []
            for block in blocks(b.column("text"), lower=True):
                for i, s in enumerate(shingle_sets(block, size), block.first):
                    if len(s) and class_key(s) == keys[i]:
                        out.append((keys[i], s.tobytes()))
            cls, found = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(found, pa.binary())],
                                             ["cls", "set"])

    held = (rows.withColumn("_word", word).withColumn("_at", at).join(F.broadcast(table), "_word")
            .where(F.expr("shiftrightunsigned(_mask, _at) & 1L") == 1).select("_id", "text"))
    return store(held.join(wanted.hint("shuffle_hash"), "_id").select("cls", "text")
                 .mapInArrow(run, "cls long, set binary").dropDuplicates(["cls"]), "jaccard-sets")


def _rooted(table: DataFrame, joined: DataFrame, key: str, name: str) -> DataFrame:
    """``table`` with the component of ``key`` as column ``name``."""
    c = joined.select(F.col("node").alias(key), F.col("root").alias(name))
    return table.join(c, key, "left").withColumn(name, F.coalesce(name, key))


def _merge(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links: components of the graph of the roots
    that the links join, put through to the nodes."""
    between = store(_rooted(_rooted(links, joined, "u", "_ru"), joined, "v", "_rv")
                    .select(F.col("_ru").alias("u"), F.col("_rv").alias("v")), "jaccard-roots")
    found = components(between).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    again = joined.join(found, F.col("root") == F.col("_node"), "left").select(
        "node", F.coalesce("_root", "root").alias("root"))
    alone = found.join(joined.select("node"), F.col("_node") == F.col("node"), "left_anti")
    return store(again.union(alone), "jaccard-components")


def jaccard_classes(rows: DataFrame, described: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all classes that link to another; rows have (_id, text)."""
    classes = store(described.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("_id"), F.first("n").cast("int").alias("n"), F.first("bits").alias("bits")),
        "jaccard-classes")
    prefixes = _prefixes(rows.select(F.col("_id").alias("doc_id"), "text"), size, percent)
    groups = store(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("pivot"))
                   .where("size > 1"), "jaccard-groups")

    def members(which: Column) -> DataFrame:
        return prefixes.join(groups.where(which).select("token", "pivot"), "token")

    few = store(members(F.col("size") <= SMALL).select("token", "cls", "n", "matches"), "jaccard-few")
    other = few.select("token", F.col("cls").alias("v"), F.col("n").alias("m"), F.col("matches").alias("asked"))
    counted = (few.withColumnRenamed("cls", "u").join(other, "token").where((F.col("u") < F.col("v")) & _fits("n", "m", percent))
               .groupBy("u", "v").agg(F.count(F.lit(1)).alias("_k"), F.first(F.least("matches", "asked")).alias("_l"))
               .where("_k >= _l").select("u", "v"))
    many = store(members(F.col("size") > SMALL), "jaccard-many")
    stars = many.where("cls <> pivot").select(F.col("pivot").alias("u"), F.col("cls").alias("v")).distinct()
    candidates = store(_near(counted.union(stars).distinct(), classes, percent), "jaccard-candidates")

    wanted = (candidates.select(F.explode(F.array("u", "v")).alias("cls"))
              .union(many.select("cls")).distinct().join(classes.select("cls", "_id"), "cls"))
    sets = _sets(rows, store(wanted, "jaccard-wanted"), size)
    ends = candidates.select("u", "v", "apart", F.explode(F.array("u", "v")).alias("_end"))
    nearest = (ends.groupBy("_end").agg(F.min_by(F.struct("u", "v"), F.struct("apart", "u", "v")).alias("p"))
               .select("p.u", "p.v").distinct())
    joined = store(components(_verify(nearest, sets, percent)), "jaccard-components")

    def between(pairs: DataFrame) -> DataFrame:
        """Pairs that lie in different components of ``joined``."""
        return (_rooted(_rooted(pairs, joined, "u", "_ru"), joined, "v", "_rv")
                .where("_ru <> _rv").select("u", "v"))

    rest = store(between(candidates.select("u", "v")), "jaccard-rest")
    if not rest.isEmpty():
        joined = _merge(joined, _verify(rest, sets, percent))
    # large groups whose members still lie in several components: the nearest pair of each
    # outer member twice, which joins what belongs together, then all pairs that remain between
    for nearest in (True, True, False):
        placed = store(_rooted(many.select("token", "pivot", "cls", "n"), joined, "cls", "root"), "jaccard-placed")
        more = _between_components(placed, classes, nearest, percent)
        if more.isEmpty():
            break
        joined = _merge(joined, _verify(more, sets, percent))
    return joined


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 percent: int = PERCENT) -> DataFrame:
    """Per row doc_id, n_shingles, component_id, grp (a number for the component;
    null for empty sets) and text_hash."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    described = store(rows.select(F.col("_id").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
                      .mapInArrow(_describe(size), "doc_id long, text_hash long, n long, cls long, bits array<long>"),
                      "jaccard-docs")
    joined = jaccard_classes(rows, described, size, percent)
    narrow = described.select("doc_id", "text_hash", "n", "cls")
    placed = store(_rooted(narrow.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("_least")),
                           joined, "cls", "grp"), "jaccard-placed")
    least = placed.groupBy("grp").agg(F.min("_least").alias("component_id"))
    of_class = store(placed.join(least, "grp").select(F.col("cls").alias("_cls"), "grp", "component_id"), "jaccard-of")

    def real(c: Column) -> Column:
        return F.when(c != NO_ID, c)

    return narrow.join(of_class, F.col("cls") == F.col("_cls"), "left").select(
        real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        real(F.coalesce("component_id", "doc_id")).alias("component_id"), "grp", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
             percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one of each component does: the one
    with the smallest id (null ids last, then by text hash), of repeated rows
    one; rows with an empty set all stay.  Columns are as they came."""
    found = store(jaccard_join(docs, id_col, text_col, size, percent).where("grp is not null")
                  .select("grp", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_hash").alias("_hash")),
                  "jaccard-found")
    rows = found.groupBy("grp", "_id", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    first = store(found.groupBy("grp").agg(F.min(F.struct("_id", "_hash")).alias("_first")).select(
        F.col("grp").alias("_grp"), F.col("_first._id").alias("_first_id"), F.col("_first._hash").alias("_first_hash")),
        "jaccard-first")
    marked = store(store(rows, "jaccard-rows").join(first, F.col("grp") == F.col("_grp")).select(
        "_id", "_hash", ((F.col("_id") == F.col("_first_id")) & (F.col("_hash") == F.col("_first_hash"))).alias("_stay"),
        "_n").where("not _stay or _n > 1"), "jaccard-marks")
    keyed = docs.select(F.struct(*docs.columns).alias("_whole"),
                        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    stay = keyed.join(marked.select("_id", "_hash").hint("shuffle_hash"), ["_id", "_hash"], "left_anti")
    repeated = marked.where("_stay")
    if not repeated.isEmpty():
        stay = stay.union(keyed.join(repeated.select("_id", "_hash").hint("shuffle_hash"), ["_id", "_hash"], "left_semi")
                          .dropDuplicates(["_id", "_hash"]))
    return stay.select("_whole.*")
