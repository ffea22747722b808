"""Exact dedup, span dedup and the Jaccard join against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from llm_cases import ODD, brute_exact, brute_jaccard, brute_spans
from velas.llm import exact_dedup, jaccard_join, span_dedup
from velas.llm.components import components


def random_docs(seed, n=120):
    """Copies, near copies, shared passages, one large group of near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = [[rng.choice(words) for _ in range(rng.choice([2, 5, 13, 14, 40, 120, 300]))] for _ in range(n)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(40):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(near)
    for i in range(0, n, 3):
        at = rng.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + passage[:rng.choice([12, 13, 30, 60])] + texts[i][at:]
    for i in range(20):
        texts.append(list(texts[rng.randrange(len(texts))]))
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return [(i, rng.choice([" ", "\n", "  "]).join(t)) for i, t in zip(ids, texts)]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CASES = [ODD, random_docs(1), []]


@pytest.mark.parametrize("rows", CASES, ids=["odd", "random", "empty"])
def test_exact_dedup(docs_of, rows):
    got = exact_dedup.exact_dedup(docs_of(rows, extra=True), digest="all").withColumn(
        "sha256", F.lower(F.hex("sha256")))
    assert collected(got) == brute_exact(rows)


def test_exact_dedup_hashes_survivors_only(docs_of):
    got = exact_dedup.exact_dedup(docs_of([(1, "same text"), (2, "same  text"), (3, "alone")]))
    assert {r.doc_id: r.sha256 is None for r in got.collect()} == {1: False, 2: False, 3: True}


@pytest.mark.parametrize("hot", [40, 3])
@pytest.mark.parametrize("rows", CASES, ids=["odd", "random", "empty"])
def test_span_dedup(docs_of, rows, hot, monkeypatch):
    monkeypatch.setattr(span_dedup, "HOT_DOCS", hot)  # 3: most shared passages take the salted way
    assert collected(span_dedup.span_dedup(docs_of(rows, extra=True))) == brute_spans(rows)


@pytest.mark.parametrize("hot,small", [(40, 16), (3, 4)])
@pytest.mark.parametrize("rows", CASES, ids=["odd", "random", "empty"])
def test_jaccard_join(docs_of, rows, hot, small, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_DOCS", hot)
    monkeypatch.setattr(jaccard_join, "SMALL", small)  # 4: stars and the pairs between components
    got = jaccard_join.jaccard_join(docs_of(rows, extra=True)).select("doc_id", "n_shingles", "component_id")
    assert collected(got) == brute_jaccard(rows)


def test_keep_one_keeps_columns_and_one_row_each(docs_of):
    docs = docs_of([(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "a b c d e"), (4, "x"), (4, "x"),
                    (5, None), (6, "")], extra=True)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(7, 7)]
    group = list(range(400))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        group[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
