"""Spelling variants, ranked search and MinHash against plain Python."""

import random

import numpy as np
import pytest

from llm_cases import ODD, brute_jaccard, brute_search, brute_spelling
from velas.llm import lexical_search, minhash, spelling
from test_text_operators import collected, random_docs


def spelled_docs(seed, n=60):
    """Words with misspellings, chains of forms, ties and letters beyond ASCII."""
    rng = random.Random(seed)
    letters = "abcdeosñéü"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 3, 6, 14, 30])
        for _ in range(4):
            i = rng.randrange(len(w))
            x = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
            words += [x] * rng.choice([1, 2, 3, 6, 7])
    rng.shuffle(words)
    size = len(words) // n
    return [(i, rng.choice([" ", ", ", "\n1"]).join(x.upper() if rng.random() < 0.1 else x
                                                     for x in words[i * size:(i + 1) * size])) for i in range(n)]


@pytest.mark.parametrize("symbols", [2, 8])
@pytest.mark.parametrize("rows", [ODD, spelled_docs(1), spelled_docs(2), []], ids=["odd", "spelled", "again", "empty"])
def test_spelling_variants(docs_of, rows, symbols, monkeypatch):
    if symbols == 2:  # a table that is full lets everything through
        monkeypatch.setattr(spelling, "MOST_BITS", 64)
        monkeypatch.setattr(spelling, "FLUSH", 10)
    got = spelling.spelling_variants(docs_of(rows, extra=True), thin=spelling.drop_letter, symbols=symbols)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert collected(got) == brute_spelling(rows)


def test_spelling_keys_of_neighbours():
    """The generated keys are those of the reduced words one edit away."""
    letters = {"a": 0, "b": 1, "c": 2}
    r = spelling.Reducer(letters, 3)
    word = "abcab"
    (_, keys), = r.around([word])
    want = {word} | {word[:i] + word[i + 1:] for i in range(5)}
    want |= {word[:i] + x + word[i + 1:] for i in range(5) for x in letters}
    want |= {word[:i] + x + word[i:] for i in range(6) for x in letters}
    assert set(keys[0].tolist()) == set(r.own(sorted(want)).tolist())
    assert len(set(r.own(sorted(want)).tolist())) == len(want)


def test_last_forms_of_a_long_chain(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(100)]
    got = {x.word: x.root for x in spelling.last_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w100" for w, _ in chain}


def searched_docs(seed, n=300):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(6)]
    rare = [f"r{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randint(0, 12)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(n)]
    return rows + rows[:40] + [(None, "c1 r3 r3"), (7, "C1,r3;R3"), (9999, "zzz")]


ITEMS = [(1, "c0 c1 r1 r2 r3 C1"), (2, "c0 c1 c2 c3 c4 c5"), (3, None), (4, ""), (5, "nowhere"), (None, "r3 c1"),
         (6, "zzz"), (7, "r7 r8"), (7, "c4 r9"), (8, "c1"), (8, "c1")]


@pytest.mark.parametrize("postings,span,terms", [(1 << 20, 4096, 1 << 20), (64, 7, 1 << 20), (200, 16, 10)],
                         ids=["one block", "small blocks", "blocks of queries"])
@pytest.mark.parametrize("rows", [ODD, searched_docs(1), []], ids=["odd", "random", "empty"])
def test_lexical_search(spark, docs_of, rows, postings, span, terms, monkeypatch):
    items = [*ITEMS, (9, "word a"), (10, "ünï 1234")]
    want = brute_search(rows, items)
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as item", "1 as rank")
    shared = {"BLOCK_POSTINGS": postings, "RANGE": span}
    for name, value in shared.items():
        monkeypatch.setattr(lexical_search, name, value)
    got = lexical_search.search(docs_of(rows, extra=True), table, query_terms=terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collected(got) == want


def test_search_skips_and_agrees_with_full_sums():
    """Blocks in turn, with a score to beat from the blocks before, give the
    same best k as the sum over all lists."""
    rng = np.random.default_rng(5)
    n_docs, n_terms, k = 4000, 30, 10
    held = rng.random((n_docs, n_terms)) < np.linspace(0.002, 0.6, n_terms)[None, :]
    docs, terms = np.nonzero(held)
    tf = rng.integers(1, 6, len(docs))
    m = rng.integers(50, 200, n_docs)
    weights = rng.integers(1, 9000, n_terms)
    score = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
    none = np.zeros(0, dtype=np.int64)
    for _ in range(20):
        query = rng.choice(n_terms, rng.integers(1, 12), replace=False)
        total = np.zeros(n_docs, dtype=np.int64)
        use = np.isin(terms, query)
        np.add.at(total, docs[use], score[use])
        order = np.lexsort((np.arange(n_docs), -total))[:k]
        want = [(int(total[i]), int(i)) for i in order if total[i] > 0]
        best = (none, none)
        for lo in range(0, n_docs, 500):
            part = (docs >= lo) & (docs < lo + 500)
            index = lexical_search.Index(docs[part] - lo, terms[part], tf[part], m[lo:lo + 500], weights,
                                         np.arange(lo, lo + 500))
            best = index.search(query, best, k)
        assert list(zip(best[0].tolist(), best[1].tolist())) == want


def near_rows(rows, size, percent):
    return sorted(((d, n, c, d == c) for d, n, c in brute_jaccard(rows, size, percent)), key=repr)


@pytest.mark.parametrize("rows,size,percent,small,block", [
    (ODD, 4, 80, 16, 1024), ([], 4, 80, 16, 1024), (random_docs(4), 5, 80, 16, 1024), (random_docs(4), 4, 80, 3, 8),
    (random_docs(5), 2, 60, 3, 8)], ids=["odd", "empty", "random", "large keys", "two words"])
def test_minhash(docs_of, rows, size, percent, small, block, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)   # 3: stars and the pairs between components
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(minhash, "LINK_ROWS", block)
    got = minhash.near_duplicates(docs_of(rows, extra=True), size=size, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collected(got) == near_rows(rows, size, percent)


def test_minhash_bounds():
    assert minhash.rows_per_band(80) == 4
    for k, m in zip(range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH), minhash.least_matches(80)):
        # a flat prior and m matches of k: the posterior tail by summing the density
        t = np.linspace(0, 1, 200_001)
        for matches, dropped in ((m - 1, True), (m, False)):
            density = t ** matches * (1 - t) ** (k - matches)
            assert (density[t >= 0.8].sum() / density.sum() < minhash.MISS) == dropped


def test_minhash_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    for both in (1000, 2000, 3000):
        a, b = minhash.signatures([np.sort(x[:both + (4000 - both) // 2]),
                                   np.sort(np.concatenate([x[:both], x[both + (4000 - both) // 2:]]))])
        assert abs((a == b).mean() - both / 4000) < 0.13
