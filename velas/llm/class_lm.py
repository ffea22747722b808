"""Language-model scoring with a Brown class-based bigram model.

Every token is a word or the end of a text.  Every word seen at least
``MIN_COUNT`` times is put into a class by exchange clustering; the number of
classes grows with the number of such words (``classes_for``).  Rarer words
and unknown ones form one open class, the end another.  A text's probability is
the product, over its tokens, of

    P(class | class before) * P(word | class),

the first factor drawn to the class's overall share (``PRIOR`` pseudo-counts),
the second relative frequency, in the open class with half a count added to
every word and to the unknown one.

Clustering starts with the commonest words, exchanged one by one on the driver
over their own bigrams (at most ``SEEDS``, a bounded matrix).  Then whole
sweeps run on Spark: one pass over the texts counts, for every word to be
classed, the classes before and after it; each word moves to the class that
raises the class-bigram likelihood most, all against the same class table.  In
that gain the crossing of a word's own bigrams is left out, and words move at
once, so the likelihood is recomputed from the texts after every sweep: a
sweep that lowers it is undone, and sweeps end when they raise it by less than
``LEAST_RISE`` nats a token or after ``SWEEPS``; ``Model.settled`` tells which.

What is gathered from the corpus covers all training rows and grows with
them: counts of all words, and the classes around every word to be classed.

Scale: the arrays that tasks receive are bounded: the words with the highest
counts, at most ``KNOWN_WORDS``, and the class table.  What lies beyond that
list reaches the same classes by joins, so the list decides where a word is
looked up and never what comes out.  In fitting, the words around the classed
words beyond it are gathered once, a row per word; every sweep joins it with the
words' classes and corrects the counts of the pass over the texts, which takes
these words for open.  Where two of them meet, a table of such pairs does the same.  In scoring, the hashes beyond it stay in the row, and a join
with the table of all words, which never leaves the cluster, gives their counts
and classes, as the word itself and as the word before.  Words are told apart
by 64-bit hashes.  Texts are cut into words once for fitting; sweeps read the
words' numbers in the list (three bytes a word).

Defined cases: null and empty texts consist of the end token; null ids belong
to the training rows (crc32 of '' is 0); without training rows every token is
unknown; repeated rows count and are scored each; only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from velas.llm.common import discard, store
from velas.llm.spelling import bit_table
from velas.llm.text_tokens import blocks

MIN_COUNT = 5
SEEDS = 2048
SWEEPS = 4
LEAST_RISE = 0.01
KNOWN_WORDS = 1 << 19
PRIOR = 8.0
OPEN, END = 0, 1               # the two fixed classes
END_HASH, OPEN_HASH = -1, -2   # keys of the end token and of all open words together
FLUSH = 3_000_000
TOKENS = 1 << 18               # words of coded texts that a task takes at a time
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26  # of the bit table of words beyond the list, at most 8 MB
BUCKET_WORDS = 4096            # classed words that a task moves at a time, about
GAIN_CELLS = 1 << 21           # cells of a gain matrix that a task holds at a time


def classes_for(words: int) -> int:
    """Number of classes for so many words to be classed."""
    return max(1, round(3 * words ** 0.25))


def count_words(texts: DataFrame) -> DataFrame:
    """(h, c) of all tokens of the column ``text``; the end token has END_HASH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        n = docs = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for b in batches:
            docs += b.num_rows
            for block in blocks(b.column("text"), lower=True):
                waiting.append(block.hash)
                n += len(block.hash)
                if n >= FLUSH:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([docs])], ["h", "c"])

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _bucket() -> Column:
    return F.floor(F.log2("c") * 8).cast("int")


def commonest(counts: DataFrame, most: int = KNOWN_WORDS) -> tuple[pa.Table, Column]:
    """The words above a count that at most ``most`` words reach, and the
    condition that says so.  A histogram of the counts' logarithms (some
    hundred rows) sets the limit, so nothing is sorted."""
    words = counts.where(F.col("h") != END_HASH)
    taken, least = 0, None
    for r in sorted(words.groupBy(_bucket().alias("b")).count().collect(), key=lambda r: -r["b"]):
        if taken + r["count"] > most:
            break
        taken, least = taken + r["count"], r["b"]
    within = F.lit(False) if least is None else _bucket() >= least
    return words.where(within).toArrow(), within


def bigrams(texts: DataFrame, class_words: np.ndarray) -> np.ndarray:
    """Counts of neighbours among the class words (sorted hashes) and the two
    fixed classes: rows the word before, columns the word; word i is i + 2."""
    size = len(class_words) + 2
    shared = texts.sparkSession.sparkContext.broadcast(class_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(size * size, dtype=np.int64)
        for b in batches:
            for block in blocks(b.column("text"), lower=True):
                before, after, _ = _neighbours(block.offset, _lookup(known, block.hash, OPEN, 2))
                total += np.bincount(before * size + after, minlength=size * size)
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["k", "n"])

    out = np.zeros(size * size, dtype=np.int64)
    table = texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[table["k"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(size, size)


def _lookup(sorted_hashes: np.ndarray, h: np.ndarray, missing: int, first: int) -> np.ndarray:
    if not len(sorted_hashes):
        return np.full(len(h), missing, dtype=np.int64)
    at = np.searchsorted(sorted_hashes, h)
    at[at == len(sorted_hashes)] = 0
    return np.where(sorted_hashes[at] == h, at + first, missing)


def _neighbours(offset: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id before, id, document) of every token, ends included; document k has
    the words offset[k] .. offset[k + 1] - 1."""
    n_words = np.diff(offset)
    n_docs = len(n_words)
    doc = np.repeat(np.arange(n_docs), n_words + 1)
    after = np.full(len(ids) + n_docs, END, dtype=ids.dtype)
    word_at = np.arange(len(ids)) + np.repeat(np.arange(n_docs), n_words)
    after[word_at] = ids
    before = np.empty_like(after)
    before[0:1] = END
    before[1:] = after[:-1]  # a text begins after the end of the one before
    return before, after, doc


CODES = "low binary, high binary, far binary"


def encode(texts: DataFrame, listed: Listed) -> DataFrame:
    """(low, high, far): per text the words' numbers, 0 beyond the list and
    rank + 2 in it, as 16 low and 8 high bits, and the hashes of those beyond."""
    shared = texts.sparkSession.sparkContext.broadcast(listed)

    def column(data: np.ndarray, offset: np.ndarray) -> pa.Array:
        at = (offset * data.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offset) - 1, [None, pa.py_buffer(at.tobytes()),
                                                                    pa.py_buffer(data.tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for block in blocks(b.column("text"), lower=True):
                ids = known.ids(block.hash)
                far = ids == 0
                yield pa.RecordBatch.from_arrays(
                    [column(ids.astype(np.uint16), block.offset), column((ids >> 16).astype(np.uint8), block.offset),
                     column(block.hash[far], np.concatenate([[0], np.cumsum(far)])[block.offset])],
                    ["low", "high", "far"])

    return texts.mapInArrow(run, CODES)


def _binary(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, offset) of a binary column that holds arrays of ``kind``."""
    size = np.dtype(kind).itemsize
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=kind), (at - at[0]) // size


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, offset, hashes beyond the list) of texts from ``encode``, of about
    ``TOKENS`` words at a time; one longer text comes alone."""
    for b in batches:
        low, offset = _binary(b.column("low"), np.uint16)
        high, _ = _binary(b.column("high"), np.uint8)
        far, far_offset = _binary(b.column("far"), np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + TOKENS, side="right")) - 1)
            part = slice(offset[lo], offset[hi])
            yield (low[part].astype(np.int32) | (high[part].astype(np.int32) << 16), offset[lo:hi + 1] - offset[lo],
                   far[far_offset[lo]:far_offset[hi]])
            lo = hi


def beyond_neighbours(codes: DataFrame, words: DataFrame, listed: Listed) -> tuple[DataFrame, DataFrame]:
    """Where the words ``words``, all beyond the list, stand: (h, before, after),
    the numbers of the words around every occurrence, beyond the list counting as
    open, and (h, next, n): how often ``h`` is followed by another of ``words``.
    A bit table of bounded size keeps the rest out of the shuffle; what it lets
    through wrongly goes in the joins."""
    size = words.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * size).bit_length()))
    shared = codes.sparkSession.sparkContext.broadcast(bit_table(words.select(F.col("h").alias("key")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for ids, offset, far in _decoded(batches):
            before, after, _ = _neighbours(offset, ids)
            h = far.view(np.uint64)
            place = (h >> np.uint64(3)) & np.uint64(bits - 1)
            held = (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            at = np.flatnonzero(after == 0)[held]
            word = far[held]
            # an end stands between two texts, so what follows at once is of the same text
            follows = np.append(np.diff(at) == 1, False)[:len(at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(before[at]), pa.array(after[at + 1]),
                 pa.array(np.append(word[1:], 0)[:len(at)], mask=~follows)], ["h", "before", "after", "next"])

    rows = store(codes.where(F.length("far") > 0).mapInArrow(run, "h long, before int, after int, next long"),
                 "class-lm-beyond")
    own = words.select("h")
    near = store(rows.select("h", "before", "after").join(own, "h", "left_semi")
                 .groupBy("h").agg(F.collect_list("before").alias("before"), F.collect_list("after").alias("after")),
                 "class-lm-beyond")
    pairs = store(rows.where("next is not null").groupBy("h", "next").agg(F.count(F.lit(1)).alias("n"))
                  .join(own, "h", "left_semi").join(own.withColumnRenamed("h", "next"), "next", "left_semi")
                  .select("h", "next", "n"), "class-lm-beyond")
    discard(rows)
    return near, pairs


@dataclass
class Placed:
    """What ``beyond_neighbours`` gives, with the classes of a sweep."""

    near: DataFrame   # (h, before, after, cls)
    pairs: DataFrame  # (h, next, n, cls, to): the classes of h and next

    @classmethod
    def of(cls, near: DataFrame, pairs: DataFrame, classes: DataFrame) -> Placed:
        own = classes.select("h", "cls")
        return cls(store(near.join(own, "h"), "class-lm-placed"),
                   store(pairs.join(own, "h").join(own.toDF("next", "to"), "next"), "class-lm-placed"))

    def discard(self) -> None:
        discard(self.near)
        discard(self.pairs)


def _around(b: pa.RecordBatch) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether after, row, number) of the words before and after those of ``Placed.near``."""
    for side in ("before", "after"):
        column = b.column(side)
        size = np.diff(column.offsets.to_numpy())
        yield side == "after", np.repeat(np.arange(b.num_rows), size), column.flatten().to_numpy()


def _g(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0.5, x * np.log(np.maximum(x, 1.0)), 0.0)


def exchange(pairs: np.ndarray, n_classes: int, sweeps: int = 12) -> np.ndarray:
    """Class (2 .. n_classes + 1) of each word of a bigram matrix as ``bigrams``
    gives it, by the exchange algorithm."""
    n = len(pairs) - 2
    k = n_classes + 2
    of = np.concatenate([[OPEN, END], 2 + np.arange(n) % n_classes])
    left = np.zeros((n + 2, k))   # word -> class after it
    right = np.zeros((n + 2, k))  # class before it -> word
    np.add.at(left.T, of, pairs.T.astype(float))
    np.add.at(right.T, of, pairs.astype(float))
    table = np.zeros((k, k))
    np.add.at(table, of, left)

    g = _g
    order = np.argsort(-pairs.sum(axis=1)[2:], kind="stable") + 2
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a = of[w]
            out, into, own = left[w], right[w], float(pairs[w, w])
            # out[c]: w followed by class c; into[c]: class c followed by w; both count w itself in a
            out0, into0 = out.copy(), into.copy()
            out0[a] -= own
            into0[a] -= own
            rest = table.copy()
            rest[a, :] -= out
            rest[:, a] -= into
            rest[a, a] += own
            # likelihood change when w joins class b: row b, column b and their crossing
            row_gain = (g(rest + out0[None, :]) - g(rest)).sum(axis=1)
            col_gain = (g(rest + into0[:, None]) - g(rest)).sum(axis=0)
            d = np.diag(rest)
            cross = (g(d + out0 + into0 + own) - g(d)) - (g(d + out0) - g(d)) - (g(d + into0) - g(d))
            row_sum, col_sum = rest.sum(axis=1), rest.sum(axis=0)
            n_out, n_in = out.sum(), into.sum()
            gain = row_gain + col_gain + cross - (g(row_sum + n_out) - g(row_sum)) - (g(col_sum + n_in) - g(col_sum))
            gain[[OPEN, END]] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] > gain[a] + 1e-9:
                moved += 1
                table = rest
                table[b, :] += out0
                table[:, b] += into0
                table[b, b] += own
                left[:, a] -= pairs[:, w]
                left[:, b] += pairs[:, w]
                right[:, a] -= pairs[w, :]
                right[:, b] += pairs[w, :]
                of[w] = b
        if moved <= 0.002 * n:
            break
    return of[2:]


PACKED = "bucket long, words binary, size binary, key binary, n binary"


def _planes(x: np.ndarray, kind) -> bytes:
    """The numbers' lowest bytes, then their next ones: the high ones, mostly
    zero, are then compressed to nothing."""
    x = np.ascontiguousarray(x, dtype=kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed(bucket: np.ndarray, hashes: np.ndarray, event: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
    """PACKED rows of sorted events, word * 2k + key, for words in order of their buckets."""
    word = event // (2 * k)
    key = event - word * (2 * k)
    edge = np.flatnonzero(np.diff(bucket[word], prepend=-1))
    out = []
    for lo, hi in zip(edge, np.append(edge[1:], len(word))):
        here, size = np.unique(word[lo:hi], return_counts=True)
        out.append((int(bucket[here[0]]), hashes[here].tobytes(), _planes(size, "<u2"), _planes(key[lo:hi], "<i2"),
                    _planes(n[lo:hi], "<i4")))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["bucket", "words", "size", "key", "n"])


def contexts(codes: DataFrame, listed: Listed, classes: np.ndarray, k: int, buckets: int) -> DataFrame:
    """(bucket, words, events): how often listed words to be classed follow
    class ``key`` (key < k) or precede class ``key - k``, by bucket of the words'
    hashes, in several rows: hashes as bytes, the number of contexts of each, and
    per context the key and the number.  ``classes``: of the listed words by
    rank, -1 for those that stay open.  Words beyond the list count as open."""
    shared = codes.sparkSession.sparkContext.broadcast((listed.by_rank, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, of = shared.value
        kind = np.concatenate([[OPEN, END], np.maximum(of, OPEN)]).astype(np.int32)
        # words to be classed in order of their buckets; the others have no place
        bucket = hashes.view(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        order = order[of[order] >= 0]
        bucket, hashes = bucket[order], hashes[order]
        place = np.full(len(kind), -1, dtype=np.int32)
        place[order + 2] = np.arange(len(order))
        number = np.int32 if len(kind) * 2 * k < 1 << 31 else np.int64
        waiting: list[np.ndarray] = []
        sums: tuple[np.ndarray, np.ndarray] | None = None
        n = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            event, c = np.unique(np.concatenate(waiting), return_counts=True)
            if sums is None:
                return event, c
            both, c = np.concatenate([sums[0], event]), np.concatenate([sums[1], c])
            at = np.argsort(both, kind="stable")
            both = both[at]
            first = np.flatnonzero(np.diff(both, prepend=-1))
            return both[first], np.add.reduceat(c[at], first)

        for ids, offset, _ in _decoded(batches):
            before, after, _ = _neighbours(offset, ids)
            own, first = place[after], place[before]
            in_own, in_first = np.flatnonzero(own >= 0), np.flatnonzero(first >= 0)
            waiting += [own[in_own].astype(number) * (2 * k) + kind[before[in_own]],
                        first[in_first].astype(number) * (2 * k) + k + kind[after[in_first]]]
            n += len(in_own) + len(in_first)
            if n >= FLUSH:
                sums, waiting, n = added(), [], 0
                if len(sums[0]) >= FLUSH:
                    yield _packed(bucket, hashes, *sums, k)
                    sums = None
        if n:
            sums = added()
        if sums is not None and len(sums[0]):
            yield _packed(bucket, hashes, *sums, k)

    return codes.mapInArrow(run, PACKED)


def beyond_contexts(placed: Placed, listed: Listed, classes: np.ndarray, k: int, buckets: int) -> DataFrame:
    """PACKED rows to add to ``contexts``: those of the classed words beyond the
    list, and for their neighbours what was counted as next to an open word."""
    shared = placed.near.sparkSession.sparkContext.broadcast((listed.by_rank, classes))

    def packed(events: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, key, n = (np.concatenate(x) for x in zip(*waiting))
            hashes, word = np.unique(h, return_inverse=True)
            order = np.argsort(hashes % buckets, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            code = place[word] * (2 * k) + key
            at = np.argsort(code, kind="stable")
            code, n = code[at], n[at]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            return _packed(hashes[order] % buckets, hashes[order], code[first], np.add.reduceat(n, first), k)

        for e in events:
            if len(e[0]):
                waiting.append(e)
                size += len(e[0])
                if size >= FLUSH:
                    yield flush()
                    waiting, size = [], 0
        if size:
            yield flush()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank, of = shared.value
        hashes = np.concatenate([[0, 0], by_rank.view(np.int64)])
        given = np.concatenate([[-1, -1], of]).astype(np.int64)
        kind = np.concatenate([[OPEN, END], np.maximum(of, OPEN)]).astype(np.int64)

        def events() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                h, cls = (b.column(c).to_numpy().astype(np.int64) for c in ("h", "cls"))
                for is_after, row, number in _around(b):
                    yield h[row], kind[number] + k * is_after, np.ones(len(row), dtype=np.int64)
                    # a listed neighbour sees the word on its other side
                    at = np.flatnonzero(given[number] >= 0)
                    other, back = hashes[number[at]], k * (not is_after)
                    yield other, cls[row[at]] + back, np.ones(len(at), dtype=np.int64)
                    yield other, np.full(len(at), OPEN + back), np.full(len(at), -1)

        return packed(events())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                h, after, n, cls, to = (b.column(c).to_numpy().astype(np.int64) for c in ("h", "next", "n", "cls", "to"))
                yield h, to + k, n
                yield h, np.full(len(h), OPEN + k), -n
                yield after, cls, n
                yield after, np.full(len(h), OPEN), -n

        return packed(events())

    return placed.near.mapInArrow(near, PACKED).unionByName(placed.pairs.mapInArrow(pairs, PACKED))


def class_table(codes: DataFrame, classes_by_rank: np.ndarray, placed: Placed | None, k: int) -> np.ndarray:
    """Class bigram counts: rows the class before, columns the class."""
    shared = codes.sparkSession.sparkContext.broadcast(classes_by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.concatenate([[OPEN, END], np.maximum(shared.value, OPEN)]).astype(np.int32)
        total = np.zeros(k * k, dtype=np.int64)
        for ids, offset, _ in _decoded(batches):
            # ``kind`` keeps the end apart, so classes may be paired in place of words
            before, after, _ = _neighbours(offset, kind[ids])
            total += np.bincount(before * k + after, minlength=k * k)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From open words, as the pass took them, to their classes."""
        kind = np.concatenate([[OPEN, END], np.maximum(shared.value, OPEN)]).astype(np.int64)
        total = np.zeros(k * k, dtype=np.int64)
        for b in batches:
            cls = b.column("cls").to_numpy().astype(np.int64)
            for is_after, row, number in _around(b):
                own, to = cls[row], kind[number]
                for c, sign in ((own, 1), (np.full(len(own), OPEN), -1)):
                    total += sign * np.bincount(c * k + to if is_after else to * k + c, minlength=k * k)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    cells = codes.mapInArrow(run, "cell long, n long")
    if placed is not None:
        def cell(a: Column, b: Column, n: Column) -> Column:
            return F.struct((a * k + b).cast("long").alias("cell"), n.alias("n"))

        cls, to, n, open_ = F.col("cls").cast("long"), F.col("to").cast("long"), F.col("n"), F.lit(OPEN)
        # each of the two was taken for open where the other was corrected
        moved = F.array(cell(cls, to, n), cell(cls, open_, -n), cell(open_, to, -n), cell(open_, open_, n))
        cells = (cells.unionByName(placed.near.mapInArrow(near, "cell long, n long"))
                 .unionByName(placed.pairs.select(F.explode(moved).alias("_c")).select("_c.*")))
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most k squared rows
    out = np.zeros(k * k)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(k, k)


def likelihood(table: np.ndarray) -> float:
    """Class-bigram log-likelihood, but for the term of the words' own counts."""
    return float(_g(table).sum() - _g(table.sum(axis=0)).sum() - _g(table.sum(axis=1)).sum())


def best_classes(table: np.ndarray, cls: np.ndarray, offset: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of highest gain of each word; word i has the class ``cls[i]``
    and the context counts offset[i] .. offset[i + 1] - 1 (none empty)."""
    k = len(table)
    cells = np.vstack([table, table.T])  # by key: what each class has with that neighbour
    cells_g = _g(cells)
    col, row = table.sum(axis=0), table.sum(axis=1)
    out = np.empty(len(cls), dtype=np.int64)
    i = 0
    while i < len(cls):
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + GAIN_CELLS // k, side="right")) - 1)
        at, m = key[offset[i]:offset[j]], n[offset[i]:offset[j]].astype(float)
        starts = (offset[i:j] - offset[i]).astype(np.int64)
        own = cls[i:j]
        owner = np.repeat(own, np.diff(offset[i:j + 1]))
        gain = np.add.reduceat(_g(cells[at] + m[:, None]) - cells_g[at], starts, axis=0)
        held = cells[at, owner]
        stay = np.add.reduceat(_g(held) - _g(np.maximum(held - m, 0)), starts)
        n_in = np.add.reduceat(np.where(at < k, m, 0.0), starts)
        n_out = np.add.reduceat(np.where(at >= k, m, 0.0), starts)
        gain -= _g(col + n_in[:, None]) - _g(col) + _g(row + n_out[:, None]) - _g(row)
        stay -= (_g(col[own]) - _g(np.maximum(col[own] - n_in, 0))
                 + _g(row[own]) - _g(np.maximum(row[own] - n_out, 0)))
        here = np.arange(j - i)
        gain[here, own] = stay + 1e-9
        gain[:, [OPEN, END]] = -np.inf
        out[i:j] = gain.argmax(axis=1)
        i = j
    return out


def move(around: DataFrame, classes: DataFrame, table: np.ndarray, buckets: int) -> DataFrame:
    """(h, c, cls, new): the class that each word moves to.  The contexts
    (PACKED) of a bucket's words come together in one task; merged, a word has at
    most two counts per class."""
    spark = around.sparkSession
    shared = spark.sparkContext.broadcast(table)
    k = len(table)

    def moved(rows: pa.Table) -> pa.RecordBatch:
        """One bucket: a row of ``classes`` for every word, the rest in no order."""
        def column(name: str, at: np.ndarray, kind) -> np.ndarray:
            return rows[name].take(pa.array(at)).to_numpy(zero_copy_only=False).astype(kind)

        stated = np.flatnonzero(rows["cls"].is_valid().to_numpy(zero_copy_only=False))
        h = column("h", stated, np.int64)
        order = np.argsort(h)
        stated, h = stated[order], h[order]
        word, key, n = [], [], []
        for words, size, keys, ns in zip(*(rows[c].drop_null().to_pylist() for c in ("words", "size", "key", "n"))):
            word.append(np.repeat(np.searchsorted(h, np.frombuffer(words, dtype=np.int64)), _from_planes(size, "<u2")))
            key.append(_from_planes(keys, "<i2").astype(np.int64))
            n.append(_from_planes(ns, "<i4").astype(np.int64))
        code = np.concatenate(word) * (2 * k) + np.concatenate(key)
        order = np.argsort(code, kind="stable")
        code = code[order]
        at = np.flatnonzero(np.diff(code, prepend=-1))
        total = np.add.reduceat(np.concatenate(n)[order], at)
        code, total = code[at][total != 0], total[total != 0]
        offset = np.searchsorted(code, np.arange(len(h) + 1) * (2 * k))
        own = column("cls", stated, np.int64)
        new = best_classes(shared.value, own, offset, code % (2 * k), total)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(column("c", stated, np.int64)),
                                           pa.array(own.astype(np.int32)), pa.array(new.astype(np.int32))],
                                          ["h", "c", "cls", "new"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            bucket = b.column("bucket").to_numpy()
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
                if waiting and bucket[lo] != last:
                    yield moved(pa.Table.from_batches(waiting))
                    waiting = []
                last = bucket[lo]
                waiting.append(b.slice(lo, hi - lo))
        if waiting:
            yield moved(pa.Table.from_batches(waiting))

    bucket = F.pmod("h", F.lit(buckets)).alias("bucket")
    rows = around.unionByName(classes.select(bucket, "h", F.col("c").cast("long").alias("c"), F.col("cls").cast("int").alias("cls")),
                              allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "h long, c long, cls int, new int"))


class Listed:
    """The words that tasks receive, at most KNOWN_WORDS, by rank: falling
    counts, equal ones by hash."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        rank = np.lexsort((h, -c))
        self.by_rank, self.counts = h[rank], c[rank]
        order = np.argsort(self.by_rank)
        self.hashes, self.number = self.by_rank[order], (order + 2).astype(np.int32)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """rank + 2 of every hash, 0 for those not listed."""
        at = _lookup(self.hashes, h, len(self.hashes), 0)
        return np.append(self.number, np.int32(0))[at]


@dataclass
class Model:
    listed: Listed
    listed_classes: np.ndarray  # by rank, open: 0
    beyond: DataFrame           # (h, c, cls) of the classed words beyond the list
    transition: np.ndarray  # log10 P(class | class before)
    class_size: np.ndarray  # tokens per class
    tokens: int             # N
    words: int              # V
    end_count: int
    open_denominator: float
    n_classed: int          # words in classes of their own choice
    classed_tokens: int
    settled: bool           # the sweeps ended by themselves

    @property
    def base_denominator(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)

    @cached_property
    def _gathered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far = self.beyond.toArrow()
        columns = (np.concatenate([self.listed.by_rank, far["h"].to_numpy().view(np.uint64)]),
                   np.concatenate([self.listed.counts, far["c"].to_numpy()]),
                   np.concatenate([self.listed_classes, far["cls"].to_numpy()]))
        order = np.argsort(columns[0])
        return tuple(x[order] for x in columns)

    # For inspection only, gathered from the cluster: the listed words and all
    # classed ones, sorted by hash.  Neither fitting nor scoring asks for them.
    @property
    def hashes(self) -> np.ndarray:
        return self._gathered[0]

    @property
    def counts(self) -> np.ndarray:
        return self._gathered[1]

    @property
    def classes(self) -> np.ndarray:
        return self._gathered[2]


def cluster(texts: DataFrame, counts: DataFrame, listed: Listed, within: Column) -> tuple[DataFrame, np.ndarray, bool]:
    """((h, c, cls) of all words to be classed, their class table, settled);
    ``within``: who is listed."""
    spark = texts.sparkSession
    words = counts.where((F.col("h") != END_HASH) & (F.col("c") >= MIN_COUNT))
    n_words = words.count()
    n_classes = min(classes_for(n_words), max(1, n_words))
    k = n_classes + 2
    # falling counts, equal ones by unsigned hash
    top = words.orderBy(F.desc("c"), F.col("h") < 0, "h").limit(min(SEEDS, 16 * n_classes)).select("h").toArrow()
    seeds = np.sort(top["h"].to_numpy().view(np.uint64))
    of = exchange(bigrams(texts, seeds), n_classes)
    seeded = spark.createDataFrame(pa.table({"h": pa.array(seeds.view(np.int64)),
                                             "cls": pa.array(of.astype(np.int32))}))
    classes = store(words.join(F.broadcast(seeded), "h", "left")  # at most SEEDS rows
                    .select("h", "c", F.coalesce("cls", F.lit(OPEN)).alias("cls")), "class-lm-classes")
    codes = store(encode(texts, listed), "class-lm-codes")
    beyond = placed = None
    if n_words > int((listed.counts >= MIN_COUNT).sum()):
        beyond = beyond_neighbours(codes, words.where(~within), listed)
    tokens = max(1, int(counts.agg(F.sum("c")).first()[0] or 0))
    buckets = n_words // BUCKET_WORDS + 1
    kept, settled = None, False
    try:
        for sweep in range(SWEEPS + 1):
            by_rank = listed_classes(classes, listed, within)
            if beyond is not None:
                if placed is not None:
                    placed.discard()
                placed = Placed.of(*beyond, classes.where(~within))
            table = class_table(codes, by_rank, placed, k)
            value = likelihood(table) / tokens
            if kept and value < kept[2]:
                return kept[0], kept[1], True
            settled = bool(kept) and value - kept[2] < LEAST_RISE
            kept = (classes, table, value)
            if settled or sweep == SWEEPS or not n_words:
                break
            around = contexts(codes, listed, by_rank, k, buckets)
            if placed is not None:
                around = around.unionByName(beyond_contexts(placed, listed, by_rank, k, buckets))
            moved = store(move(around, classes, table, buckets), "class-lm-classes")
            if not moved.where("cls != new").count():
                return classes, table, True
            classes = moved.select("h", "c", F.col("new").alias("cls"))
        return kept[0], kept[1], settled or not n_words
    finally:
        # nothing reads these again
        if placed is not None:
            placed.discard()
        for stored in (codes, *(beyond or ())):
            discard(stored)


def listed_classes(classes: DataFrame, listed: Listed, within: Column) -> np.ndarray:
    """Classes of the listed words by rank, -1 for those too rare to be classed."""
    got = classes.where(within).select("h", "cls").toArrow()  # at most KNOWN_WORDS rows
    of = np.full(len(listed.by_rank), -1, dtype=np.int16)
    if got.num_rows:
        of[listed.ids(got["h"].to_numpy().view(np.uint64)) - 2] = got["cls"].to_numpy()
    return of


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """Model of a table with the column ``text`` (training rows only), and the
    open words beyond its list, (h, c, cls), cls null."""
    counts = store(count_words(texts), "class-lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                       F.sum(F.when(F.col("h") == END_HASH, F.col("c"))).alias("e")).first()
    tokens, words, ends = total["n"] or 0, total["v"], total["e"] or 0
    got, within = commonest(counts)
    listed = Listed(got["h"].to_numpy().view(np.uint64), got["c"].to_numpy())
    classes, table, settled = cluster(texts, counts, listed, within)
    k = len(table)
    share = (table.sum(axis=0) + 1) / (table.sum() + k)
    transition = np.log10((table + PRIOR * share[None, :]) / (table.sum(axis=1, keepdims=True) + PRIOR))
    in_class = np.zeros(k)
    n_classed = 0
    for r in classes.groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # k rows
        in_class[r["cls"]] = r["c"]
        n_classed += r["n"]
    classed_tokens = int(in_class.sum())
    open_tokens = tokens - ends - classed_tokens
    open_words = words - (1 if ends else 0) - n_classed
    in_class[OPEN] = open_tokens
    model = Model(listed, np.maximum(listed_classes(classes, listed, within), OPEN), classes.where(~within), transition,
                  in_class, tokens, words, ends, open_tokens + 0.5 * (open_words + 1), n_classed, classed_tokens, settled)
    rest = counts.where(~within & (F.col("h") != END_HASH) & (F.col("c") < MIN_COUNT))
    return model, rest.select("h", "c", F.lit(None).cast("int").alias("cls"))


def score(docs: DataFrame, model: Model, unlisted: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with n_tokens, n_known,
    train_tokens, base_score and score (log10 probabilities)."""
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [c for c in docs.columns if c not in added and c != text_col]
    rows = docs.select(F.struct(*names).alias("_given"), F.col(text_col).alias("_text"))
    arrays = (model.listed, model.listed_classes, model.transition, model.class_size, model.open_denominator,
              model.base_denominator, model.end_count)
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, of_listed, transition, class_size, open_denominator, base_denominator, end_count = shared.value
        c = listed.counts
        base = np.log10(c + 0.5) - np.log10(base_denominator)
        emit = np.where(of_listed == OPEN, np.log10(c + 0.5) - np.log10(open_denominator),
                        np.log10(c) - np.log10(np.maximum(class_size[of_listed], 1)))
        # a word beyond the list: its count, class and transitions are added by the join, here only the denominators
        base = np.concatenate([[-np.log10(base_denominator), 0.0], base])
        emit = np.concatenate([[-np.log10(open_denominator), 0.0], emit])
        classes = np.concatenate([[-1, END], of_listed]).astype(np.int64)
        end_base = np.log10((end_count + 0.5) / base_denominator)
        for b in batches:
            parts = []
            for block in blocks(b.column("_text"), lower=True):
                ids = listed.ids(block.hash)
                n_words = np.diff(block.offset)
                doc = np.repeat(np.arange(block.n_docs), n_words)
                before, after, of = _neighbours(block.offset, classes[ids])
                n = block.n_docs
                both = (before >= 0) & (after >= 0)
                missing = np.flatnonzero(ids == 0)
                at = missing + doc[missing]  # ends stand between the texts
                parts.append((
                    n_words + 1,
                    np.bincount(doc, ids > 0, n).astype(np.int64) + (end_count > 0),
                    np.bincount(doc, base[ids], n) + end_base,
                    np.bincount(doc, emit[ids], n)
                    + np.bincount(of[both], transition[before[both], after[both]], n),
                    np.bincount(doc[missing], minlength=n), block.hash[missing].view(np.int64),
                    (missing - block.offset[doc[missing]]).astype(np.int32),
                    before[at].astype(np.int16), after[at + 1].astype(np.int16)))
            if parts:
                n_tokens, known, base_sum, score_sum, n_rest, *rest = (np.concatenate(x) for x in zip(*parts))
                offsets = np.concatenate([[0], np.cumsum(n_rest)]).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(x) for x in rest], ["h", "pos", "before", "after"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("_given"), pa.array(n_tokens), pa.array(known), pa.array(base_sum),
                     pa.array(score_sum), pa.ListArray.from_arrays(pa.array(offsets), rest)],
                    ["_given", "n_tokens", "_known", "_base", "_score", "_rest"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row what its words beyond the list add; -1: a neighbour that is one of them."""
        _, _, transition, class_size, open_denominator, _, _ = shared.value
        emit = np.log10(open_denominator) - np.log10(np.maximum(class_size, 1.0))
        for b in batches:
            if not b.num_rows:
                continue
            found = b.column("found")
            size = np.diff(found.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)
            word = found.flatten()
            pos, before, after, cls, c = (word.field(x).to_numpy(zero_copy_only=False).astype(np.int64)
                                          for x in ("pos", "before", "after", "cls", "c"))
            order = np.lexsort((pos, row))
            row, before, after, cls, c = row[order], before[order], after[order], cls[order], c[order]
            last = np.concatenate([[OPEN], cls[:-1]])  # of a neighbour beyond the list: the word before in its row
            half = np.log10(c + 0.5)
            fit = np.where(cls != OPEN, np.log10(np.maximum(c, 1)) + emit[cls], half)
            fit += transition[np.where(before < 0, last, before), cls]
            fit += np.where(after < 0, 0.0, transition[cls, np.maximum(after, 0)])
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), pa.array(np.bincount(row, c > 0, n).astype(np.int64)),
                 pa.array(np.bincount(row, half, n)), pa.array(np.bincount(row, fit, n))], ["_row", "_more", "_log", "_fit"])

    kind = rows.schema["_given"].dataType.simpleString()
    scanned = store(rows.mapInArrow(run, f"_given {kind}, n_tokens long, _known long, _base double, _score double, "
                                                 "_rest array<struct<h:long,pos:int,before:short,after:short>>")
                    .withColumn("_row", F.monotonically_increasing_id()), "class-lm-rows")
    words = unlisted.select("h", "c", "cls").unionByName(model.beyond.select("h", "c", "cls"))
    found = (scanned.select("_row", F.explode("_rest").alias("_at")).select("_row", "_at.*")
             .join(words, "h", "left")
             .groupBy("_row").agg(F.collect_list(F.struct(
                 "pos", "before", "after", F.coalesce("cls", F.lit(OPEN)).alias("cls"),
                 F.coalesce("c", F.lit(0)).cast("long").alias("c"))).alias("found"))
             .mapInArrow(add, "_row long, _more long, _log double, _fit double"))
    return scanned.join(found, "_row", "left").select(
        "_given.*", "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_log", F.lit(0.0))).alias("base_score"),
        (F.col("_score") + F.coalesce("_fit", F.lit(0.0))).alias("score"))
