"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time.

A document's score for a query is the sum, over the query's distinct terms
that it holds, of ``w * ((10**9 * tf) div (1000 * tf + 20 * m))``; w falls with the
number of documents that hold the term, m grows with the document's length
against the mean (integers, so that every order of summation agrees).

**Two passes.**  The first counts documents with terms (N), all terms (L) and, for the
queries' terms only, the documents that hold them: partial sums per task, one
small shuffle.  The second searches.  Each task turns its texts into blocks of
``BLOCK_POSTINGS`` postings of query terms, inverts a block and answers all
queries on it, and carries each query's best ``k`` so far from block to block,
so the score that a document must reach rises while the task runs.

**Hybrid.**  Within a block a query's lists are dealt by length.  *Short*
lists (up to ``SHORT_SHARE`` of the block's documents each) are worked off
term at a time: their scores are summed into accumulators, which are then
materialised as one list in document order, bounded by its largest sum.  That
list and the *long* lists go document at a time, in ranges of documents: lists
whose bounds together stay below the score to beat name no candidates; they
are only looked up (binary search over the list, which skips everything in
between) for candidates of the others, the strongest list first, and a
candidate is dropped as soon as its sum and the bounds still open stay below
that score.  A tie with the score to beat is kept: it is settled by the id.

**Merging.**  A task passes on at most k rows per query; they are ranked among
groups of tasks, then overall, each by a window whose limit is applied before
its shuffle.  Texts are never shuffled.

The queries are given to all tasks, so their number is bounded: more than
``QUERY_TERMS`` (query, term) pairs are searched in blocks of queries, each in
a pass of its own.

Defined cases: null and empty texts have no terms, match nothing and do not
count in N; rows of one query id are one query with the terms of all of them;
a query without terms, or without a match, has no rows; null document ids come
last among equal scores, and repeated rows rank one after the other; an empty
table gives an empty result; extra columns are ignored; texts are processed
whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from velas.llm.common import store
from velas.llm.text_tokens import blocks

TOP = 50
BLOCK_POSTINGS = 1 << 20
SHORT_SHARE = 1 / 32
RANGE = 4096            # candidates that are scored before the score to beat is set anew
QUERY_TERMS = 1 << 20
MERGE_GROUPS = 64
NO_ID = (1 << 63) - 1

#: a term is a run of digits, letters A-Z, a-z and everything beyond ASCII
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: byte -> itself in lower case for a byte of a term, else a space
_NORMAL = np.array([c if c >= 0x80 or chr(c).isdigit() or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
                    for c in range(256)], dtype=np.uint8)


def _normal(texts: pa.Array) -> pa.Array:
    """The texts with A-Z as lower case and a space for every byte between terms."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    new = pa.py_buffer(_NORMAL[np.frombuffer(data, dtype=np.uint8)])
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, new], offset=texts.offset)


def term_blocks(texts: pa.Array):
    return blocks(_normal(texts), lower=False)


@dataclass
class Queries:
    """``terms``: sorted hashes of all query terms; ``of``: per query its id and
    the positions of its terms in ``terms``."""

    terms: np.ndarray
    of: list[tuple[str, np.ndarray]]


def gather_queries(rows: list[tuple[str, str]]) -> list[tuple[str, np.ndarray]]:
    """(id, sorted distinct term hashes) of every query with terms."""
    found: dict[str, list[np.ndarray]] = {}
    for query, text in rows:
        for block in term_blocks(pa.array([text], pa.string())):
            found.setdefault(query, []).append(block.hash)
    out = []
    for query, hashes in sorted(found.items()):
        h = np.unique(np.concatenate(hashes))
        if len(h):
            out.append((query, h))
    return out


def _positions(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of each hash among ``terms``, or -1."""
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    return np.where(terms[at] == h, at, -1)


def _held(block, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of the query terms in a block, in that order."""
    at = _positions(terms, block.hash)
    doc = np.repeat(np.arange(block.n_docs), np.diff(block.offset))
    known = at >= 0
    key, tf = np.unique(doc[known] * len(terms) + at[known], return_counts=True)
    return key // len(terms), key % len(terms), tf


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """N, L and the number of documents with each term; column ``_text``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms) + 2, dtype=np.int64)
        for b in batches:
            for block in term_blocks(b.column("_text")):
                total[-2] += np.count_nonzero(np.diff(block.offset))
                total[-1] += len(block.hash)
                total[:-2] += np.bincount(_held(block, terms)[1], minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    table = docs.select("_text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(terms) + 2, dtype=np.int64)
    total[table["at"].to_numpy()] = table["n"].to_numpy()
    return int(total[-2]), int(total[-1]), total[:-2]


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


class Index:
    """Postings of the query terms in some documents, and the search on them."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, weights: np.ndarray, ids: np.ndarray):
        order = np.lexsort((docs, terms))
        self.doc, term, tf = docs[order], terms[order], tf[order]
        self.score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self.ids = ids
        self.short = max(1, int(len(ids) * SHORT_SHARE))

    def lists(self, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The query's lists as (documents in order, scores): the accumulators
        of the short ones as one list, and the long ones."""
        short, out = [], []
        for t in query.tolist():
            lo, hi = self.start[t], self.start[t + 1]
            if lo < hi:
                (short if hi - lo <= self.short else out).append((self.doc[lo:hi], self.score[lo:hi]))
        if short:
            docs = np.concatenate([d for d, _ in short])
            found, at = np.unique(docs, return_inverse=True)
            total = np.zeros(len(found), dtype=np.int64)
            for part, (d, s) in zip(np.split(at, np.cumsum([len(d) for d, _ in short])[:-1]), short):
                total[part] += s  # one term at a time; a list names a document once
            out.append((found, total))
        return out

    def search(self, query: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the best k, given those of earlier blocks."""
        lists = self.lists(query)
        if not lists:
            return best
        bound = np.array([int(s.max()) for _, s in lists])
        order = np.argsort(-bound, kind="stable")
        lists, bound = [lists[i] for i in order], bound[order]
        open_after = np.append(np.cumsum(bound[::-1])[::-1], 0)  # bounds of a list and the weaker ones

        def to_beat() -> int:
            return int(best[0][-1]) if len(best[0]) == k else 1

        # lists that name candidates: without them no sum reaches the score to beat
        naming = int(np.searchsorted(-open_after[:-1], -to_beat(), side="right"))
        if not naming:
            return best
        candidates = (lists[0][0] if naming == 1 else
                      np.unique(np.concatenate([d for d, _ in lists[:naming]])))
        for at in range(0, len(candidates), RANGE):
            docs = candidates[at:at + RANGE]
            total = np.zeros(len(docs), dtype=np.int64)
            least = to_beat()
            for i, (d, s) in enumerate(lists):
                lo, hi = np.searchsorted(d, (docs[0], docs[-1] + 1))  # skip to the range
                if lo < hi:
                    place = np.searchsorted(d[lo:hi], docs)
                    place[place == hi - lo] = 0
                    place += lo
                    total += np.where(d[place] == docs, s[place], 0)
                stay = total + open_after[i + 1] >= least
                if not stay.all():
                    docs, total = docs[stay], total[stay]
                    if not len(docs):
                        break
            if len(docs):
                score = np.concatenate([best[0], total])
                ids = np.concatenate([best[1], self.ids[docs]])
                first = np.lexsort((ids, -score))[:k]
                best = score[first], ids[first]
        return best


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n, length = shared.value
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none) for _ in queries.of]
        parts: list[list[np.ndarray]] = []
        docs = postings = 0

        def answer() -> None:
            d, t, tf, m, ids = (np.concatenate(x) for x in zip(*parts))
            index = Index(d, t, tf, m, weights, ids)
            for i, (_, query) in enumerate(queries.of):
                best[i] = index.search(query, best[i], k)

        for b in batches:
            ids = b.column("_id").to_numpy()
            for block in term_blocks(b.column("_text")):
                d, t, tf = _held(block, queries.terms)
                m = 50 + (50 * np.diff(block.offset) * n) // max(length, 1)
                parts.append([d + docs, t, tf, m, ids[block.first:block.first + block.n_docs]])
                docs += block.n_docs
                postings += len(d)
                if postings >= BLOCK_POSTINGS:
                    answer()
                    parts, docs, postings = [], 0, 0
        if parts:
            answer()
        at = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array([queries.of[i][0] for i in at.tolist()], pa.string()),
                 pa.array(np.concatenate([x for _, x in best])), pa.array(np.concatenate([s for s, _ in best]))],
                ["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", k: int = TOP,
           query_terms: int = QUERY_TERMS) -> DataFrame:
    """The best k documents of each item: the item's id as it came, rank,
    doc_id and score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = items.schema[item_col].dataType
    # a mark before the id keeps a null id apart from an empty one
    named = items.select(F.coalesce(F.concat(F.lit("="), F.col(item_col).cast("string")), F.lit("")).alias("item"),
                         F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = named.agg(F.sum(F.regexp_count("text", F.lit(TERM))).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-2 * size // query_terms) if size > query_terms else 1)
    found = None
    for block in range(n_blocks):
        mine = named.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)
        gathered = gather_queries([(r["item"], r["text"]) for r in mine.collect()])
        terms = np.unique(np.concatenate([h for _, h in gathered])) if gathered else np.zeros(1, dtype=np.uint64)
        queries = Queries(terms, [(q, _positions(terms, h)) for q, h in gathered])
        n, length, df = statistics(texts, terms)
        shared = spark.sparkContext.broadcast((queries, term_weights(n, df), n, length))
        part = texts.mapInArrow(_search(shared, k), "item string, doc_id long, score long")
        found = part if found is None else found.union(part)
    found = store(found, "search-found")
    order = [F.col("score").desc(), F.col("doc_id")]
    some = Window.partitionBy("item", "_group").orderBy(*order)
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))
    best = (found.withColumn("_group", group).withColumn("_rank", F.row_number().over(some))
            .where(F.col("_rank") <= k).drop("_rank", "_group"))
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .where(F.col("rank") <= k)
            .select(F.when(F.col("item") != "", F.substr("item", F.lit(2))).cast(kind).alias("item_id"), "rank",
                    F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
