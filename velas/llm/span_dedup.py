"""Substring dedup: repeated runs of words, by a compacted graph of word k-mers.

Every window of ``K`` words is an edge of the corpus's De Bruijn graph.  A
word covered by a window that also starts in a document with a smaller id is
removed.

1. **Edges, partitioned.**  Windows travel in runs: consecutive windows with
   the same minimiser (the smallest hash among the window's ``M``-word grams,
   its *anchor*) form one row ``(anchor, doc, pos, tails)``, a nonbranching
   piece of the document's path.  Equal windows have equal anchors, so all
   occurrences of an edge meet under one anchor; a row costs 5 bytes for each
   window it carries instead of a row each.
2. **Sources.**  Rows come sorted by (anchor, doc, pos), so an edge's first
   occurrence, its *source coordinate*, is met first.  A task keeps only the
   distinct edges of the anchor at hand.  Runs of edges whose sources are
   consecutive too come out as pieces ``(doc, start, n, src_doc, src_start)``.
3. **Compaction.**  Pieces that continue each other in the document and in the
   source lie on one nonbranching path; they are joined end to end into spans.
4. **Verification.**  The words at both ends of a span, its own and its
   source's, are looked up by their coordinates and compared by a second,
   independent hash; a span is applied only where its words hash to that.

Hot anchors (a passage that a large part of all documents share) are found in
a bounded sample of documents and salted: each salt settles its own first
occurrences, and these few rows are settled among the salts in a second round.
The sample only decides how rows are dealt out, not what comes out.

Texts enter a shuffle only for documents that hold a span or a source; these
are told apart at the scan by a bit table of ``SIEVE_BITS`` bits, whatever the
data; what it lets through needlessly has no spans in the join.

Defined cases: null and empty texts have no words; texts below K words lose
nothing; null ids count as larger than any id and never as smaller than each
other; rows that repeat an id do not remove each other's words; extra columns
are ignored.  Texts are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from velas.llm.common import store
from velas.llm.text_tokens import Block, blocks, gram_hashes, mix64

K, M = 13, 4
TAIL = 5  # bytes of a window's hash that travel; the anchor adds 8
NO_ID = (1 << 63) - 1
SAMPLE_DOCS = 8192   # about so many documents are looked through for hot anchors
HOT_DOCS = 40        # an anchor that so many of them hold is hot
SALTS = 64
SALT_STEP = 0x2545F4914F6CDD1D
SIEVE_BITS = 1 << 26


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[:len(x) - (width - have)], x[width - have:])
    return x


def _windows(block: Block, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, anchor, hash) of all windows of a block, in order."""
    n = len(block.hash)
    if n < k:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64)
    anchor = _sliding_min(gram_hashes(block.hash, m), k - m + 1)
    whole = gram_hashes(block.hash, k)
    doc = np.repeat(np.arange(block.n_docs), np.diff(block.offset))
    valid = np.flatnonzero(doc[:n - k + 1] == doc[k - 1:])
    d = doc[valid]
    return d, valid - block.offset[d], anchor[valid], whole[valid]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Positions where a new run begins: any of the columns changes."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _tail_bytes(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :TAIL]).ravel()


def _hot_anchors(docs: DataFrame, k: int, m: int) -> np.ndarray:
    """Sorted anchors that HOT_DOCS or more documents of a sample hold.  The
    sample is a range of the id hash, so the list has a bound."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column("text"), lower=False):
                doc, _, anchor, _ = _windows(block, k, m)
                first = _starts(doc, anchor)
                pairs = np.unique(np.stack([anchor[first], doc[first].astype(np.uint64)], axis=1), axis=0)
                found, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "n"])

    span = 1 << 30
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(share * span)).select("text")
    hot = (sample.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= HOT_DOCS).select("anchor").toArrow())
    return np.sort(hot["anchor"].to_numpy().astype(np.int64)).view(np.uint64)


def _runs(k: int, m: int, hot_broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_broadcast.value
        for b in batches:
            ids = b.column("doc_id")
            id_values = ids.to_numpy().view(np.uint64)
            for block in blocks(b.column("text"), lower=False):
                doc, pos, anchor, whole = _windows(block, k, m)
                if not len(doc):
                    continue
                first = _starts(doc, anchor)
                limits = np.append(first, len(doc)).astype(np.int32) * TAIL
                tails = pa.Array.from_buffers(pa.binary(), len(first), [
                    None, pa.py_buffer(limits.tobytes()), pa.py_buffer(_tail_bytes(whole).tobytes())])
                part, row = anchor[first], doc[first] + block.first
                at = pos[first].astype(np.int64)
                if len(hot):
                    near = np.minimum(np.searchsorted(hot, part), len(hot) - 1)
                    salt = np.where(hot[near] == part, mix64(id_values[row]) % np.uint64(SALTS) + np.uint64(1),
                                    np.uint64(0))
                    part = part + salt * np.uint64(SALT_STEP)
                    at = at | (salt.astype(np.int64) << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.view(np.int64)), ids.take(pa.array(row)), pa.array(at), tails],
                    ["part", "doc_id", "at", "tails"])

    return run


#: part: the anchor, for a hot one moved by its salt; at: position, and the salt above bit 40
RUN_SCHEMA = "part long, doc_id long, at long, tails binary"
#: a piece, or (edge not null) an edge of a hot anchor in the first document of a salt
PIECE_SCHEMA = "doc_id long, start int, n int, src_doc long, src_start int, edge long"


def _expand(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(part, doc, position, key, salt) of every window in a batch of run rows."""
    tails = b.column("tails")
    limits = np.frombuffer(tails.buffers()[1], dtype=np.int32)[tails.offset:tails.offset + len(tails) + 1]
    data = np.frombuffer(tails.buffers()[2], dtype=np.uint8)[limits[0]:limits[-1]]
    n = np.diff(limits) // TAIL
    total = int(n.sum())
    wide = np.zeros((total, 8), dtype=np.uint8)
    wide[:, :TAIL] = data.reshape(-1, TAIL)
    at = b.column("at").to_numpy()
    salt = (at >> 40).astype(np.uint64)
    part = b.column("part").to_numpy().view(np.uint64)
    key = wide.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15) + np.repeat(
        part - salt * np.uint64(SALT_STEP), n)
    ramp = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return (np.repeat(part, n), np.repeat(b.column("doc_id").to_numpy(), n),
            np.repeat(at & ((1 << 40) - 1), n) + ramp, key, np.repeat(salt, n))


def _pieces(doc: np.ndarray, pos: np.ndarray, src_doc: np.ndarray, src_pos: np.ndarray) -> pa.RecordBatch:
    """Runs of windows that are consecutive in the document and at the source."""
    step = np.arange(len(doc))
    first = _starts(doc, src_doc, pos - step, src_pos - step)
    n = np.diff(np.append(first, len(doc)))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[first]), pa.array(pos[first].astype(np.int32)), pa.array(n.astype(np.int32)),
         pa.array(src_doc[first]), pa.array(src_pos[first].astype(np.int32)),
         pa.nulls(len(first), pa.int64())], ["doc_id", "start", "n", "src_doc", "src_start", "edge"])


def _firsts(doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(np.ones(n, dtype=np.int32)),
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(key.view(np.int64))],
        ["doc_id", "start", "n", "src_doc", "src_start", "edge"])


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (part, doc, at): the windows that a smaller document
    of the same part has, and, under salted parts, what the smallest one has."""
    kept = [np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.uint64, np.uint64)]
    for b in batches:
        if not b.num_rows:
            continue
        n_kept = len(kept[0])
        part, doc, pos, key, salt = (np.concatenate([a, x]) for a, x in zip(kept, _expand(b)))
        _, first, group = np.unique(key ^ mix64(salt), return_index=True, return_inverse=True)
        source = first[group]
        later = doc[source] < doc
        new = np.arange(len(doc)) >= n_kept
        hit = np.flatnonzero(later & new)
        if len(hit):
            yield _pieces(doc[hit], pos[hit], doc[source[hit]], pos[source[hit]])
        fresh = np.flatnonzero(~later & new & (salt > 0))
        if len(fresh):
            yield _firsts(doc[fresh], pos[fresh], key[fresh])
        last = np.sort(first[part[first] == part[-1]])  # the next batch may go on with this part
        kept = [x[last] for x in (part, doc, pos, key, salt)]


def repeated_pieces(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Pieces of repeated text (doc_id, start, n, src_doc, src_start) from rows
    (doc_id long, text); n counts windows."""
    hot = docs.sparkSession.sparkContext.broadcast(_hot_anchors(docs, k, m))
    found = store(docs.mapInArrow(_runs(k, m, hot), RUN_SCHEMA)
                  .repartition("part").sortWithinPartitions("part", "doc_id", "at")
                  .mapInArrow(_sources, PIECE_SCHEMA), "span-pieces")
    # the first of an edge's rows, by partial aggregation, joined back to them
    among = found.where("edge is not null")
    source = store(among.groupBy(F.col("edge").alias("_edge")).agg(F.min(F.struct("doc_id", "start")).alias("_first")),
                   "span-sources")
    settled = (among.join(source, F.col("edge") == F.col("_edge"))
               .withColumn("src_doc", F.col("_first.doc_id")).withColumn("src_start", F.col("_first.start"))
               .where("src_doc < doc_id").select(*found.columns))
    return found.where("edge is null").union(settled).drop("edge")


def compact(pieces: DataFrame) -> DataFrame:
    """Pieces joined end to end along nonbranching paths: one row per maximal
    span (doc_id, start, n, src_doc, src_start), n counting windows."""
    path = [F.col("doc_id"), F.col("src_doc"), F.col("src_start") - F.col("start")]
    along = Window.partitionBy("doc_id", "src_doc", "_diagonal").orderBy("start")
    joined = (pieces.repartition("doc_id").withColumn("_diagonal", path[2])
              .withColumn("_new", F.coalesce((F.col("start") > F.lag(F.col("start") + F.col("n")).over(along))
                                             .cast("int"), F.lit(0)))
              .withColumn("_path", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))))
    return (joined.groupBy("doc_id", "src_doc", "_diagonal", "_path")
            .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("_end"))
            .select("doc_id", "start", (F.col("_end") - F.col("start")).cast("int").alias("n"), "src_doc",
                    (F.col("start") + F.col("_diagonal")).cast("int").alias("src_start")))


def _digest(words: list[bytes], lo: int, hi: int) -> int | None:
    if hi > len(words):
        return None
    return int.from_bytes(hashlib.blake2b(b" ".join(words[lo:hi]), digest_size=8).digest(), "big", signed=True)


def _look_up(k: int):
    """(span, source, digest) for the ranges asked of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, asked in zip(b.column("_text").to_pylist(), b.column("_asked").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                out += [(a["span"], a["source"], _digest(words, a["start"], a["start"] + a["n"] + k - 1))
                        for a in asked]
            span, source, digest = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(span, pa.int64()), pa.array(source, pa.bool_()),
                                              pa.array(digest, pa.int64())], ["span", "source", "digest"])

    return run


def _cut(k: int):
    """n_words, n_removed and kept_sha256 of texts, given their verified spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = words
                if spans:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans:
                        lo, hi = s["start"], s["start"] + s["n"] + k - 1
                        if s["digest"] == _digest(words, lo, hi):
                            change[lo] += 1
                            change[hi] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _involved(ids: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Bit table of the ids in column ``_id``, and (word, position) of a row's key."""
    bit = F.pmod(F.xxhash64("_id"), F.lit(SIEVE_BITS))
    word, at = F.shiftright(bit, 6), F.pmod(bit, F.lit(64)).cast("int")
    table = (ids.select(word.alias("_word"), F.lit(1).cast("long").alias("_one"), at.alias("_at"))
             .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _at)")).alias("_mask")))
    return table, word, at


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"))
    spans = store(compact(repeated_pieces(rows.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text")), k))
                  .withColumn("span", F.monotonically_increasing_id()), "spans")

    table, word, at = _involved(spans.select(F.explode(F.array("doc_id", "src_doc")).alias("_id")))
    told = (rows.withColumn("_word", word).withColumn("_at", at)
            .join(F.broadcast(store(table, "span-ids")), "_word", "left")
            .withColumn("_hit", F.coalesce(F.expr("shiftrightunsigned(_mask, _at) & 1L") == 1, F.lit(False)))
            .select("doc_id", "_id", "_text", "_hit"))
    held = told.where("_hit").drop("_hit")

    ends = spans.select(F.explode(F.array(
        F.struct("doc_id", "span", F.lit(False).alias("source"), "start", "n"),
        F.struct(F.col("src_doc").alias("doc_id"), "span", F.lit(True).alias("source"),
                 F.col("src_start").alias("start"), "n"))).alias("e")).select("e.*")
    asked = (ends.groupBy(F.col("doc_id").alias("_id"))
             .agg(F.collect_list(F.struct("span", "source", "start", "n")).alias("_asked")))
    digests = (held.join(asked.hint("shuffle_hash"), "_id").select("_text", "_asked")
               .mapInArrow(_look_up(k), "span long, source boolean, digest long").where("digest is not null"))
    agreed = (digests.groupBy("span").agg(
        F.collect_set(F.when(~F.col("source"), F.col("digest"))).alias("_here"),
        F.collect_set(F.when(F.col("source"), F.col("digest"))).alias("_there"))
        .select("span", F.explode(F.array_intersect("_here", "_there")).alias("digest")))
    cuts = store(spans.join(agreed, "span").groupBy(F.col("doc_id").alias("_id"))
                 .agg(F.collect_list(F.struct("start", "n", "digest")).alias("_spans")), "span-cuts")
    joined = held.join(cuts.hint("shuffle_hash"), "_id", "left").select("doc_id", "_text", "_spans")
    plain = told.where("not _hit").select("doc_id", "_text", F.lit(None).cast(joined.schema["_spans"].dataType).alias("_spans"))
    return plain.union(joined).mapInArrow(
        _cut(k), "doc_id long, n_words long, n_removed long, kept_sha256 string")
