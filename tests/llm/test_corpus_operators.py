"""Sharding, decontamination, mixing and the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import ODD
from velas.llm import decontaminate, mixing, sharding
from velas.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_lookup_table_follows_the_turns():
    shards, size = ["a", "b", "c"], 31
    want = [None] * size
    orders = []
    for s in shards:
        offset, skip = sharding.preference(s, size)
        orders.append([(offset + j * skip) % size for j in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    turn = 0
    while None in want:
        free = next(x for x in orders[turn % 3] if want[x] is None)
        want[free] = turn % 3
        turn += 1
    assert sharding.lookup_table(shards, size).tolist() == want


def test_table_is_even_and_changes_little():
    shards = [f"s{i}" for i in range(16)]
    a = sharding.lookup_table(shards)
    n = np.bincount(a)
    assert n.max() - n.min() <= 1
    b = sharding.lookup_table(shards[:-1])
    moved = np.mean((a != b) & (a != 15))
    assert moved < 0.05
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_place(docs_of):
    got = sharding.place(docs_of(ODD, extra=True), ["a", "b"], size=101)
    rows = got.collect()
    table = sharding.lookup_table(["a", "b"], 101)
    assert len(rows) == len(ODD) and all(r.shard == "ab"[table[r.slot]] for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.place(docs_of([]), ["a"]).count() == 0


def brute_hits(docs, items, window=10):
    def words(t):
        t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    wanted = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[j:j + n])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(g) for g in wanted}:
            for j in range(len(w) - n + 1):
                if who := wanted.get(tuple(w[j:j + n])):
                    hit.update(range(j, j + n))
                    found |= who
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven"), (2, "short item"), (2, "short item"),
         (10, "café au lait"), (3, None), (4, "--"), (None, "nobody knows")]
TEXTS = ODD + [(20, "x one, two three four five six seven eight nine TEN! eleven y"),
               (21, "two three four five six seven eight nine ten eleven twelve"), (22, "a short-item; Café au lait"),
               (23, "one two three four five six seven eight nine"), (24, "nobody Knows short item short item")]


@pytest.mark.parametrize("limit", [512 * 1024, 40], ids=["one automaton", "blocks"])
def test_decontaminate(spark, docs_of, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan_documents(docs_of(TEXTS, extra=True), items, max_item_bytes=limit)
    rows = sorted(((r.doc_id, r.n_words, len(r.hit), ",".join(r["items"])) for r in got.collect()), key=repr)
    assert rows == brute_hits(TEXTS, ITEMS)
    kept = decontaminate.drop_contaminated(docs_of(TEXTS, extra=True), items, max_item_bytes=limit)
    assert kept.columns == docs_of(TEXTS, extra=True).columns
    assert kept.count() == sum(r[2] == 0 for r in rows)
    none = decontaminate.scan_documents(docs_of(TEXTS), items.limit(0))
    assert none.where(F.size("hit") > 0).count() == 0


def test_spans_point_into_the_original(spark, docs_of):
    text = "Été: SHORT -- Item, plus"
    items = spark.createDataFrame([(2, "short item")], "item_id long, text string")
    row = decontaminate.scan_documents(docs_of([(1, text)]), items).first()
    assert [text[s.start:s.end] for s in row.spans] == ["SHORT -- Item"]


def test_short_items_inside_longer_windows(spark, docs_of):
    items = [(1, "four five"), (2, "one two three four five six seven eight nine ten"), (3, "eight nine"), (4, "b c"),
             (5, "a b c d"), (6, "e f")]
    texts = [(1, "one two three four five six seven eight nine ten"), (2, "x four five six a b c d e f y b c"),
             (3, "eight nine one two three four five six seven eight nine ten four")]
    rng = np.random.default_rng(2)
    texts += [(10 + i, " ".join(rng.choice(list("abcdef"), 40))) for i in range(40)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan_documents(docs_of(texts), table).collect()
    rows = sorted(((r.doc_id, r.n_words, len(r.hit), ",".join(r["items"])) for r in got), key=repr)
    assert rows == brute_hits(texts, items)
    assert all(r.hit == sorted(set(r.hit)) for r in got)
    first = next(r for r in got if r.doc_id == 1)
    assert first.hit == list(range(10)) and [(s.start, s.end) for s in first.spans] == [(0, len(texts[0][1]))]


def test_targets_stop_and_reshare():
    got = mixing.targets([100, 100, 1000], [5, 2, 1], 1.5, 2)
    assert got == [200.0, 200.0, 1400.0]
    assert mixing.targets([0, 10], [5, 2], 1.5, 2) == [0.0, 15.0]
    assert mixing.targets([], [], 1.5, 2) == []
    assert mixing.targets([0, 0], [5, 2], 1.5, 2) == [0.0, 0.0]


def test_split_tree_keeps_quotas():
    blocks = np.array([1000, 0, 37, 5, 12345])
    dealt = mixing.split_tree(blocks, 16, np.random.default_rng(3))
    assert (dealt.sum(axis=1) == blocks).all() and (dealt >= 0).all()
    assert np.ptp(dealt.sum(axis=0)) <= 16


def brute_mix(rows, weights=(5, 2, 1)):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[3]].append(i)
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[i] for i in by[s]) for s in sources]
    want = mixing.targets(sizes, [weights[k % 3] for k in range(len(sources))], 1.5, 2)
    out = {}
    for s, w, t in zip(sources, sizes, want):
        at = 0
        for i in sorted(by[s], key=lambda i: hashlib.md5(str(rows[i][0]).encode()).hexdigest()):
            out[rows[i][0]] = (size[i], w, t, size[i] * sum(e * w + at + size[i] / 2 < t for e in (0, 1)))
            at += size[i]
    return out


def test_mix_against_plain_running_sums(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(i, "w " * (i * 7 % 50), None, [None, "a", "b", "z"][min(3, i % 9)]) for i in range(300)]
    got = mixing.mix(docs_of(rows, extra=True), block_words=64).collect()
    want = brute_mix(rows)
    for r in got:
        assert (r.size, r.source_size, r.target, r.size * len(r.copies)) == want[r.doc_id]
    for s in {r[3] for r in rows}:
        mine = [r for r in got if r.source == s]
        taken = sum(r.size * len(r.copies) for r in mine)
        assert abs(taken - mine[0].target) <= 50
    again = {r.doc_id: r.copies for r in mixing.mix(docs_of(rows), block_words=64).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    drawn = mixing.draw(docs_of(rows, extra=True), block_words=64)
    assert drawn.columns == docs_of(rows, extra=True).columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter({r.doc_id: len(r.copies) for r in got if r.copies})


def test_mix_odd_rows(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    got = mixing.mix(docs_of(ODD)).collect()
    assert len(got) == len(ODD) and all(len(r.copies) <= 2 for r in got)
    assert all(not r.copies for r in got if r.size == 0)


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from llm_cases import brute_jaccard
    from velas.llm.common import store

    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing",
                                        "sharding"]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = store(stage(spark, docs, SF), "stage")
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        ids = sorted(r.doc_id for r in after)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
            gone = {r.doc_id for r in before} - set(ids)
            assert all(labels.get(d) != 0 for d in gone)
        elif name == "ngram_jaccard_join":
            want = brute_jaccard([(r.doc_id, r.text) for r in before])
            assert ids == sorted({c if n else d for d, n, c in want})
        elif name == "benchmark_decontamination":
            assert ids == sorted(d for d, _, n, _ in brute_hits([(r.doc_id, r.text) for r in before], items) if not n)
        elif name == "mixing":
            want = brute_mix([(r.doc_id, r.text, None, r.source) for r in before])
            assert Counter(ids) == Counter({d: w[3] // w[0] for d, w in want.items() if w[3]})
        else:
            assert len(after) == len(before) and all(r.shard for r in after)


def test_pipeline_near_copies_share_four_fifths_of_five_word_shingles(spark, docs_of):
    import random

    import corpus_pipeline as P

    rng = random.Random(8)
    rows = []

    def changed(words, spots):
        return [f"new{rng.random()}" if i in spots else w for i, w in enumerate(words)]

    for k, (n, spots) in enumerate([(50, {25}), (98, {30, 60}), (49, {25}), (60, {20, 40}), (40, {0}), (3, set())] * 4):
        words = [f"w{k}x{i}" for i in range(n)]
        rows += [(100 * k + j, " ".join(t)) for j, t in enumerate((words, changed(words, spots)))]
    lists = [t.split() for _, t in rows]
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for w in lists]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    kept = P.drop_near_copies(spark, docs_of(rows), SF).collect()
    want = sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))
    assert sorted(r.doc_id for r in kept) == want
    assert {0, 100, 300, 301} <= set(want) and not {1, 101, 201} & set(want)  # 201 shares four fifths exactly


def test_stored_tables_are_discarded(spark):
    import os
    from velas.llm import common
    kept, common._stored[:] = list(common._stored), []
    common.store(spark.range(5), "t")
    path = common._stored[0].removeprefix("file:")
    assert os.path.isdir(path)
    common.discard_stored(spark)
    assert not os.path.exists(path) and not common._stored
    common._stored[:] = kept
