"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z become lower case, and
every byte that is not a word byte becomes a space.  Both steps map one byte
to one byte, so an offset in the normalised text is the offset in the original
and hits need no translation table.  Words are numbered by the benchmark's own
vocabulary (0: any other word), and the automaton runs over these numbers: its
patterns are the items' windows of ``window`` words (a shorter item is one
window), and one scan of a text reports every occurrence of every pattern.

Scale: documents are only mapped, never shuffled.  The automaton is built once
in each Python worker from the broadcast item texts.  Their size is measured
first: up to ``MAX_ITEM_BYTES`` (about 90,000 words) they form one automaton;
a larger benchmark is cut by item into blocks below that size, each scanned in
its own pass, and the hits of a row are united by a shuffle of hit positions.

Defined cases: null or empty texts have no words and no hits; items without
words are ignored; an empty benchmark hits nothing; items with equal ids count
once, a null item id is written as the empty string; repeated rows get equal
answers; only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from velas.llm.common import store

WINDOW = 10
MAX_ITEM_BYTES = 512 * 1024

_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: byte -> itself for a word byte, lower case for A-Z, else a space
NORMAL = bytes(c if c in _WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Matcher:
    """The automaton of some items: ``items`` is a list of (id, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick  # an optional extra, needed only where texts are scanned

        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            n = min(window, len(ids))
            if n:
                for i in range(len(ids) - n + 1):
                    owners.setdefault(tuple(ids[i:i + n]), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, owner in owners.items():
            self.machine.add_word(pattern, (len(pattern), owner))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], set[str]]:
        """(number of words, hit word positions in order, items found)."""
        get = self.number.get
        ids = tuple([get(w, 0) for w in words(text)])
        if self.empty or not ids:
            return len(ids), [], set()
        runs: list[list[int]] = []  # hit words as [first, last]; apart and in order
        found: set[str] = set()
        for end, (n, owner) in self.machine.iter(ids):
            start = end - n + 1
            while runs and runs[-1][0] >= start:  # a shorter item inside this window
                runs.pop()
            if runs and runs[-1][1] >= start - 1:
                runs[-1][1] = end
            else:
                runs.append([start, end])
            found |= owner
        return len(ids), [p for a, b in runs for p in range(a, b + 1)], found


def spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Character ranges of the original text that cover runs of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    out: list[list[int]] = []
    last = None
    for p in hit:
        if last is not None and p == last + 1:
            out[-1][1] = ends[p][1]
        else:
            out.append([ends[p][0], ends[p][1]])
        last = p
    return [(len(raw[:a].decode("utf-8", "surrogatepass")), len(raw[:b].decode("utf-8", "surrogatepass")))
            for a, b in out]


_built: dict[str, Matcher] = {}


def _matcher(key: str, items, window: int) -> Matcher:
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, window)
    return _built[key]


SCAN_SCHEMA = "n_words long, hit array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def _scanner(items_broadcast, key: str, window: int, with_spans: bool):
    def scan(text: pd.Series) -> pd.DataFrame:
        m = _matcher(key, items_broadcast.value, window)
        rows = []
        for t in text:
            n, hit, found = m.scan(t)
            rows.append((n, hit, sorted(found), spans(t, hit) if with_spans and hit else []))
        return pd.DataFrame(rows, columns=["n_words", "hit", "items", "spans"])

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield scan(t)

    return run


def scan_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   max_item_bytes: int = MAX_ITEM_BYTES, with_spans: bool = True) -> DataFrame:
    """Per row of ``docs``, all its columns and: n_words, hit (word positions),
    items (sorted ids found), spans (character ranges in the original)."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                         F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-2 * size // max_item_bytes) if size > max_item_bytes else 1)
    names = [c for c in docs.columns if c not in ("n_words", "hit", "items", "spans")]
    given = docs.select(F.struct(*names).alias("_given"), F.col(text_col).alias("_text"))

    def one(rows: DataFrame, block: int, with_spans: bool) -> DataFrame:
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        listed = [(r["item"], r["text"]) for r in mine.collect()]
        key = hashlib.sha256(repr((window, sorted(listed))).encode()).hexdigest()
        udf = F.pandas_udf(_scanner(spark.sparkContext.broadcast(listed), key, window, with_spans), SCAN_SCHEMA)
        return rows.withColumn("_found", udf(F.col("_text")))

    if n_blocks == 1:
        return one(given, 0, with_spans).select("_given.*", "_found.*")
    # more items than one automaton should hold: a pass per block of items
    keyed = store(given.select("*", F.monotonically_increasing_id().alias("_row")), "decontaminate")
    parts = None
    for block in range(n_blocks):
        part = store(one(keyed.select("_row", "_text"), block, False).select("_row", "_found.*")
                     .where((F.size("hit") > 0) | F.lit(block == 0)), "decontaminate")
        parts = part if parts is None else parts.union(part)
    gathered = parts.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def united(text: pd.Series, hit: pd.Series) -> pd.Series:
        """Spans of the united hits: those that touch across blocks are one."""
        return pd.Series([spans(t, [int(p) for p in h]) if with_spans and len(h) else [] for t, h in zip(text, hit)])

    return keyed.join(gathered, "_row").select("_given.*", "n_words", "hit", "items",
                                               united("_text", "hit").alias("spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with the columns they came with."""
    whole = docs.select(F.struct(*docs.columns).alias("_whole"), F.col(id_col).alias("_id"),
                        F.col(text_col).alias("_text"))
    found = scan_documents(whole, items, "_id", "_text", with_spans=False, **options)
    return found.where(F.size("hit") == 0).select("_whole.*")
