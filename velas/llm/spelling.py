"""Spelling variant grouping by generation over a reduced alphabet.

**Words.**  The runs of letters of all texts, A-Z as lower case, are counted
inside each task first, so a shuffle carries a word once per task, however
frequent it is.  Words are the runs of at least ``MIN_LENGTH`` code points with at
least ``MIN_COUNT`` occurrences.  ``thin`` may change a run first: it sees the row's
key and the run (operator 11's query deletes one code point of a few runs so
that there are misspellings to find).

**Reduced alphabet.**  Every letter is dealt to one of ``SYMBOLS`` symbols,
the most frequent letters first and each to the symbol with the least
occurrences so far.  A *reduced word* is the word in these symbols: two words
that differ by one edit have reduced words that are equal or differ by one.

**Generation.**  For each word the full one-edit neighbourhood of its reduced
word is generated: the reduced word itself, all deletions, replacements and
insertions, as 64-bit polynomial keys that follow from prefix and suffix sums.  A
neighbour is passed on only if the reduced vocabulary may hold it; that is
looked up in a bit table of the vocabulary's keys (its size follows the
vocabulary up to ``MOST_BITS``, 32 MB; a full table lets more rows through and
changes nothing else).  Of the two directions of a pair the one with the
larger neighbour key goes on.  An equi-join with the reduced vocabulary gives
candidate pairs of words, and each is verified on the original strings with a
bounded edit distance.

**Forms.**  A word's form is its near word with most occurrences, if it has
``RATIO`` times as many; ties go to the smallest word.  Counts grow along
forms, so they have no cycle, and pointer jumps reach the last form in a number
of rounds that is the logarithm of the longest chain.

Scale: every step is a partial aggregation or an equi-join of stored tables;
nothing is gathered per word, cell or group.  The driver sees the counts of
single letters (at most as many rows as the alphabet has) and the bit table.

Defined cases: null and empty texts have no words; a null key is the empty
string; repeated rows count each; only the named columns are read; texts are
processed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from velas.llm.common import store
from velas.llm.text_tokens import mix64

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
SYMBOLS = 8
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
FLUSH = 400_000   # distinct words that a task holds at once

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_letter(key: str, every: int = 97) -> Callable[[str], str]:
    """For the runs of one row: where ``every`` divides the crc32 of
    '<key>:<run>', the run without its code point at crc32 % length."""
    start = zlib.crc32(f"{key}:".encode("utf-8", "surrogatepass"))

    def change(run: str) -> str:
        h = zlib.crc32(run.encode("utf-8", "surrogatepass"), start)
        if h % every:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1:]

    return change


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thin=None,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all texts.  ``thin``: key -> (run -> run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN).findall
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              ["word", "n"])

        for b in batches:
            for key, text in zip(b.column("_key").to_pylist(), b.column("_text").to_pylist()):
                found = Counter(find(text.translate(_UPPER)))
                if thin is not None:
                    change = thin(key)
                    for word, n in list(found.items()):
                        new = change(word)
                        if new != word:
                            del found[word]
                            total[new] += n
                for word, n in found.items():
                    total[word] += n
                if len(total) >= FLUSH:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return (texts.mapInArrow(run, "word string, n long").where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def deal_letters(counts: dict[str, int], symbols: int = SYMBOLS) -> dict[str, int]:
    """letter -> symbol: the most frequent letters first, each to the symbol
    that has the least so far."""
    load = [0] * symbols
    out = {}
    for letter in sorted(counts, key=lambda x: (-counts[x], x)):
        s = min(range(symbols), key=lambda i: (load[i], i))
        out[letter] = s
        load[s] += counts[letter]
    return out


class Reducer:
    """Reduced words of a batch as 64-bit keys, and the keys around them."""

    def __init__(self, letters: dict[str, int], symbols: int = SYMBOLS):
        self.symbols = symbols
        self.table = np.zeros(max([256, *(ord(x) + 1 for x in letters)]), dtype=np.uint64)
        for letter, s in letters.items():
            self.table[ord(letter)] = s
        self.values = mix64(np.arange(1, symbols + 1, dtype=np.uint64)) | _U(1)  # of the symbols

    def rows(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, symbols as a matrix) for the words of each length."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            code = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield at, self.table[code].astype(np.int64).reshape(len(at), n)

    @staticmethod
    def _key(sums: np.ndarray, length: int) -> np.ndarray:
        return mix64(sums + mix64(np.array([length], dtype=np.uint64)))

    def own(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.uint64)
        for at, s in self.rows(words):
            out[at] = self._key((self.values[s] * self._powers(s.shape[1])[:-1]).sum(axis=1, dtype=np.uint64), s.shape[1])
        return out

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        out = np.full(n + 1, _BASE)
        out[0] = 1
        return np.multiply.accumulate(out)

    def around(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, keys as a matrix): the full neighbourhood of each
        reduced word, itself first; a key may come more than once."""
        for at, s in self.rows(words):
            n = s.shape[1]
            power = self._powers(n)
            terms = self.values[s] * power[:n]
            before = np.zeros((len(at), n + 1), dtype=np.uint64)  # sum of the symbols before a place
            np.cumsum(terms, axis=1, out=before[:, 1:])
            total = before[:, -1:]
            after = total - before                                # of those from a place on
            parts = [self._key(total, n)]
            # deletion: what follows moves one place down
            parts.append(self._key(before[:, :-1] + after[:, 1:] * _INVERSE, n - 1))
            for v in self.values:
                parts.append(self._key(total - terms + v * power[:n], n))               # replacement
                parts.append(self._key(before + v * power + after * _BASE, n + 1))      # insertion
            yield at, np.concatenate(parts, axis=1)


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U(3)) & _U(bits - 1)


def bit_table(keyed: DataFrame, bits: int) -> np.ndarray:
    """Bytes with a bit set for every key, put together by partial aggregation."""
    place = F.shiftrightunsigned("key", 3).bitwiseAND(F.lit(bits - 1).cast("long"))
    rows = (keyed.select(F.shiftright(place, 6).alias("slot"),
                         F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 3) & 63L as int))").alias("mask"))
            .groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow())
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return table


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words that differ by
    exactly one inserted, deleted or replaced code point."""
    spark = vocabulary.sparkSession
    letters = (vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
               .groupBy("letter").count().collect())
    reducer = Reducer(deal_letters({r["letter"]: r["count"] for r in letters}, symbols), symbols)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"), pa.array(reducer.own(b.column("word").to_pylist()).view(np.int64))],
                ["word", "n", "key"])

    keyed = store(vocabulary.mapInArrow(own, "word string, n long, key long"), "spelling-keys")
    size = keyed.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * max(size, 1) - 1).bit_length()))
    shared = spark.sparkContext.broadcast(bit_table(keyed, bits))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            words = b.column("word").to_pylist()
            for at, keys in reducer.around(words):
                place = _bit(keys, bits)
                held = (table[place >> _U(6)] >> (place & _U(63))) & _U(1)
                # signed order, as the engine compares keys
                held = (held == 1) & (keys.view(np.int64) >= keys[:, :1].view(np.int64))
                row, col = np.nonzero(held)
                key = keys[row, col].view(np.int64)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[:len(row)]
                source = pa.array(at[row[new]])
                yield pa.RecordBatch.from_arrays(
                    [b.column("word").take(source), b.column("n").take(source),
                     b.column("key").take(source), pa.array(key[new])],
                    ["word", "n", "own", "key"])

    generated = keyed.mapInArrow(generate, "word string, n long, own long, key long")
    other = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    found = store(generated.join(other, "key")
                  .where((F.col("key") != F.col("own")) | (F.col("word") < F.col("near")))
                  .where(F.levenshtein("word", "near", 1) == 1)
                  .select("word", "n", "near", "near_n"), "spelling-pairs")
    return found.union(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                    F.col("word").alias("near"), F.col("n").alias("near_n")))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of an acyclic table (word, form)."""
    at = store(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while not at.where("open").isEmpty():
        step = at.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        at = store(at.join(step, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("open")), "spelling-roots")
    return at.select("word", "root")


def group_variants(vocabulary: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """Every word of (word, n) with form, root, n, n_near and form_n."""
    vocabulary = store(vocabulary, "spelling-words")
    best = store(near_words(vocabulary, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.first("n").alias("_n"),
        # most occurrences, then the smallest word: bytes compare like code points
        F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("_best"))
        .select("word", "n_near", F.when(-F.col("_best.minus") >= ratio * F.col("_n"), F.col("_best.form")).alias("form"),
                F.when(-F.col("_best.minus") >= ratio * F.col("_n"), -F.col("_best.minus")).alias("form_n")),
        "spelling-near")
    roots = last_forms(best.where("form is not null"))
    return (vocabulary.join(best, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thin=None,
                      symbols: int = SYMBOLS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: int = RATIO) -> DataFrame:
    """The spelling variants among the words of all texts."""
    return group_variants(count_words(docs, id_col, text_col, thin, min_length, min_count), symbols, ratio)
