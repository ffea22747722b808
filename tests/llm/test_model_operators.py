"""Language identification, toxicity, the class model and the URL filter."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import ODD
from velas.llm import class_lm, language_id, queries, toxicity, url_filter
from velas.llm.common import fold, read_table, text_or_empty

SF = "/root/testdata/sf0.01"


def test_fold_is_crc32(spark, docs_of):
    got = {r.doc_id: r.f for r in docs_of([(i, "") for i in (1, 77, None)]).select(
        "doc_id", fold(F.col("doc_id"), 5).alias("f")).collect()}
    assert got == {1: zlib.crc32(b"1") % 5, 77: zlib.crc32(b"77") % 5, None: 0}


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.op2_language_id(spark, SF).join(read_table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, docs_of):
    train = read_table(spark, SF, "documents").select("doc_id", "text", "lang", "source").limit(300)
    model = language_id.fit(train, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs_of(ODD, extra=True), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= got
    assert all(lang in {*model.langs, "und"} for _, lang in got)
    assert (4, "und") not in got
    none = language_id.fit(docs_of([]), F.lit(True))
    assert none is None
    assert {r.lang_pred for r in language_id.predict(docs_of(ODD), none).collect()} == {"und"}


def test_fuzzy_lexicon_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, was = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
        return row[-1]

    terms = [("loser", False, 1.0), ("scum", False, 2.0), ("worthless", False, 3.0), ("moron", False, 4.0),
             ("vequ", True, 5.0)]
    lexicon = toxicity.FuzzyLexicon(terms)
    rng = random.Random(5)
    words = [t for t, _, _ in terms] + ["loose", "lsoer", "vequilo", "xvequ"]
    for t, _, _ in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(w) + 1)
                w[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "s", "é"])
            words.append("".join(w))
    for w in words:
        exact = [s for t, stem, s in terms if not stem and w == t]
        stems = [s for t, stem, s in terms if stem and w.startswith(t)]
        near = [s for t, stem, s in terms if not stem and 0 < distance(w, t) <= toxicity.edits_allowed(t, stem)]
        want = ((lexicon.EXACT, max(exact)) if exact else (lexicon.STEM, max(stems)) if stems
                else (lexicon.FUZZY, max(near)) if near else None)
        assert lexicon.match(w) == want, w


def test_misspelled_forms_of_stems():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, was = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
        return row[-1]

    terms = [("idio", True, 1.0), ("idiot", False, 4.0), ("idiotic", False, 2.0), ("achlich", True, 3.0),
             ("achlichen", False, 5.0), ("reeux", True, 6.0), ("stupid", True, 2.5)]
    lexicon = toxicity.FuzzyLexicon(terms)
    assert lexicon.match("ideot") == (lexicon.FUZZY, 4.0)
    assert lexicon.match("idiot") == (lexicon.EXACT, 4.0)
    assert lexicon.match("idiocy") == (lexicon.STEM, 1.0)
    assert lexicon.match("achlochkeitzz") == (lexicon.FUZZY, 3.0)
    assert lexicon.match("reuxxx") is None
    rng = random.Random(6)
    for t, _, _ in terms:
        for _ in range(300):
            w = list(t + rng.choice(["", "s", "keiten"]))
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w) + 1)
                w[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "i", "é"])
            w = "".join(w)
            exact = [s for t, stem, s in terms if not stem and w == t]
            stems = [s for t, stem, s in terms if stem and w.startswith(t)]
            near = [s for t, stem, s in terms
                    if min(distance(w[:n], t) for n in (range(len(w) + 1) if stem else [len(w)]))
                    <= toxicity.edits_allowed(t, stem)]
            want = ((lexicon.EXACT, max(exact)) if exact else (lexicon.STEM, max(stems)) if stems
                    else (lexicon.FUZZY, max(near)) if near else None)
            assert lexicon.match(w) == want, w


def test_words_whose_stem_is_learned_are_matched_misspelled(spark):
    rng = random.Random(3)

    def text(*more):
        words = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(6)]
        return " ".join(words + list(more))

    forms = ["idiot", "idiots", "idiotic", "idiocy", "idioten"]
    rows = [(i, text(forms[i % 5]), 1) for i in range(90)] + [(100 + i, text(), 0) for i in range(90)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "_id long, text string, toxic int"))
    assert ("idio", True) in {t[:2] for t in terms}
    lexicon = toxicity.FuzzyLexicon(terms)
    assert {lexicon.match(w)[0] for w in forms} == {lexicon.EXACT}
    assert {lexicon.match(w)[0] for w in ("ideot", "ideotic", "ydiocy")} == {lexicon.FUZZY}
    assert lexicon.match("idiotenhaft")[0] == lexicon.STEM and lexicon.match("music") is None


def test_rare_terms_are_learned_from_large_samples(spark):
    rng = random.Random(4)

    def text(*more):
        return " ".join(["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(4)] + list(more))

    rows = [(i, text(*["grobian"] * (i < 15)), 1) for i in range(2000)] + [(9000 + i, text(), 0) for i in range(2000)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "_id long, text string, toxic int"))
    assert [t[:2] for t in terms] == [("grobian", False)]


def test_context_separates_quotation_from_abuse():
    lexicon = toxicity.FuzzyLexicon([("idiot", False, 3.0)])
    meant = toxicity.features("you are an idiot", lexicon)
    quoted = toxicity.features('he wrote the word "idiot" there', lexicon)
    assert meant[0] > 0 and meant[1] == 0 and meant[6] > 0
    assert quoted[0] == 0 and quoted[1] > 0


def test_toxicity_finds_toxic_and_spares_clean(spark):
    sf = "/root/testdata/sf0.1"
    got = (queries.op7_toxicity(spark, sf).where("held_out")
           .join(read_table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").collect())
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxicity_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (4, None), (4, 0), (9, 1), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(ODD), labels)
    got = toxicity.score(docs_of(ODD, extra=True), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(docs_of([]), labels.limit(0)).terms == []
    kept = toxicity.reject_toxic(docs_of(ODD, extra=True), model)
    assert kept.columns == docs_of(ODD, extra=True).columns


@pytest.mark.parametrize("known", [1 << 19, 50])
def test_class_model(spark, known, monkeypatch):
    monkeypatch.setattr(class_lm.commonest, "__defaults__", (known,))  # 50: most words take the join
    docs = (read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", text_or_empty().alias("text"))
            .withColumn("held_out", fold(F.col("doc_id"), 5) == 1))
    model, rest = class_lm.fit(docs.where("not held_out").select("text"))
    got = {r.doc_id: r for r in class_lm.score(docs, model, rest).collect()}
    tokens = {r.doc_id: [*r.text.encode().lower().split(), None] for r in docs.collect()}
    held = {r.doc_id: r.held_out for r in docs.collect()}
    count = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    n, v = sum(count.values()), len(count)
    for d, ts in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(count[t] > 0 for t in ts), n)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    total = {h: [sum(f(got[d]) for d in got if held[d] == h) for f in (lambda r: r.score, lambda r: r.base_score)]
             for h in (True, False)}
    assert total[True][0] > total[True][1] and total[False][0] > total[False][1]


@pytest.mark.parametrize("known", [1 << 19, 40])
def test_class_model_score_equals_plain_python(spark, known, monkeypatch):
    """With 40 listed words most words to be classed are found by the join."""
    monkeypatch.setattr(class_lm.commonest, "__defaults__", (known,))
    docs = (read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", text_or_empty().alias("text"))
            .withColumn("held_out", fold(F.col("doc_id"), 5) == 1))
    model, rest = class_lm.fit(docs.where("not held_out").select("text"))
    got = {r.doc_id: r.score for r in class_lm.score(docs, model, rest).collect()}
    tokens = {(r.doc_id, r.held_out): r.text.encode().lower().split() for r in docs.collect()}
    train = [ts for (_, held), ts in tokens.items() if not held]
    count = Counter(t for ts in train for t in ts)
    words = list(count)
    hashed = dict(zip(words, np.concatenate([b.hash for b in class_lm.blocks(pa.array([w.decode() for w in words]),
                                                                              lower=True)]).tolist()))
    listed = dict(zip(model.hashes.tolist(), model.classes.tolist()))
    joined = {r.h % (1 << 64): r.cls for r in rest.collect()}
    assert set(listed).isdisjoint(joined) and len(listed) + len(joined) == len(words)
    # as the word itself, and as the word before
    kind = {w: (listed[h] if h in listed else joined[h] or class_lm.OPEN) for w, h in hashed.items()}
    before = {w: listed.get(h, class_lm.OPEN) for w, h in hashed.items()}
    assert all((kind[w] != class_lm.OPEN) == (count[w] >= class_lm.MIN_COUNT) for w in words)
    k = len(model.transition)
    table, in_class = np.zeros((k, k)), Counter()
    for ts in train:
        last = class_lm.END
        for t in ts:
            table[last, kind[t]] += 1
            in_class[kind[t]] += 1
            last = before[t]
        table[last, class_lm.END] += 1
    share = (table.sum(axis=0) + 1) / (table.sum() + k)
    p = np.log10((table + class_lm.PRIOR * share) / (table.sum(axis=1, keepdims=True) + class_lm.PRIOR))
    open_words = sum(kind[w] == class_lm.OPEN for w in words)
    for (d, _), ts in tokens.items():
        want, last = 0.0, class_lm.END
        for t in ts:
            c = kind.get(t, class_lm.OPEN)
            want += p[last, c] + (math.log10(count[t] / in_class[c]) if c != class_lm.OPEN else
                                  math.log10((count[t] + 0.5) / (in_class[c] + 0.5 * (open_words + 1))))
            last = before.get(t, class_lm.OPEN)
        want += p[last, class_lm.END]
        assert got[d] == pytest.approx(want, abs=1e-6)


def test_class_model_does_not_depend_on_the_list(spark, monkeypatch):
    """All words in the list, some, and none: the same scores."""
    docs = (read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", text_or_empty().alias("text"))
            .withColumn("held_out", fold(F.col("doc_id"), 5) == 1))
    got = []
    for known in (1 << 19, 60, 0):
        monkeypatch.setattr(class_lm.commonest, "__defaults__", (known,))
        monkeypatch.setattr(class_lm, "BUCKET_WORDS", 4096 if known else 200)
        monkeypatch.setattr(class_lm, "FLUSH", 3_000_000 if known else 3000)
        monkeypatch.setattr(class_lm, "TOKENS", 1 << 18 if known else 5000)
        model, rest = class_lm.fit(docs.where("not held_out").select("text"))
        assert (model.beyond.count() > 0) == (known < 100)
        got.append({r.doc_id: r for r in class_lm.score(docs, model, rest).collect()})
    for other in got[1:]:
        assert other.keys() == got[0].keys()
        for d, r in got[0].items():
            assert other[d].n_known == r.n_known
            assert other[d].base_score == pytest.approx(r.base_score, abs=1e-6)
            assert other[d].score == pytest.approx(r.score, abs=1e-6)


def test_class_model_gathers_a_row_per_word_beyond_the_list(spark, docs_of, monkeypatch):
    """Around the words beyond the list: a row per word, pairs only where two of them meet; gone after the fit."""
    from velas.llm import common
    monkeypatch.setattr(class_lm.commonest, "__defaults__", (2,))
    texts = ["the a x y the", "x y a", "x", "rare x rare2 the", ""] * 5
    docs = docs_of([*enumerate(texts)])
    counts = class_lm.count_words(docs.select("text"))
    got, within = class_lm.commonest(counts)
    listed = class_lm.Listed(got["h"].to_numpy().view(np.uint64), got["c"].to_numpy())
    seen = {}
    codes = class_lm.encode(docs.select("text"), listed)
    words = counts.where((F.col("h") != class_lm.END_HASH) & (F.col("c") >= 10) & ~within)
    near, pairs = class_lm.beyond_neighbours(codes, words, listed)
    hashes = {w: int(np.concatenate([b.hash for b in class_lm.blocks(pa.array([w]), lower=True)])[0])
              for w in ("the", "a", "x", "y", "rare", "rare2")}
    number = {w: int(listed.ids(np.array([h], dtype=np.uint64))[0]) for w, h in hashes.items()}
    beyond = {w for t in texts for w in t.split() if not number[w] and not w.startswith("rare")}
    assert 0 < len(beyond) < 4
    for t in texts:
        line = [*t.split()]
        for i, w in enumerate(line):
            if w in beyond:
                at = seen.setdefault(w, ([], [], Counter()))
                at[0].append(number[line[i - 1]] if i else class_lm.END)
                at[1].append(number[line[i + 1]] if i + 1 < len(line) else class_lm.END)
                if i + 1 < len(line) and line[i + 1] in beyond:
                    at[2][hashes[line[i + 1]]] += 1
    rows = near.collect()
    assert len(rows) == len(beyond)
    assert {r.h % (1 << 64): (sorted(r.before), sorted(r.after)) for r in rows} == {
        hashes[w]: (sorted(b), sorted(a)) for w, (b, a, _) in seen.items()}
    assert {(r.h % (1 << 64), r.next % (1 << 64)): r.n for r in pairs.collect()} == {
        (hashes[w], o): n for w, (_, _, follow) in seen.items() for o, n in follow.items()}

    before = set(common._stored)
    model, _ = class_lm.fit(docs.select("text"))
    assert model.beyond.count() > 0
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(common._stored) - before}
    assert left == {"class-lm-counts", "class-lm-classes"}


def test_best_classes_is_the_largest_gain_in_likelihood(monkeypatch):
    """Against the likelihood of the changed table, for words whose neighbour is always the end (no crossing)."""
    rng = np.random.default_rng(2)
    k, words = 6, 9
    table = rng.integers(30, 90, (k, k)).astype(float)
    monkeypatch.setattr(class_lm, "GAIN_CELLS", 30)  # several slices
    cls, offset, key, n, want = [], [0], [], [], []
    for _ in range(words):
        own, near = int(rng.integers(2, k)), class_lm.END
        ins, outs = int(rng.integers(1, 25)), int(rng.integers(1, 25))
        gains = {}
        for b in range(2, k):
            t = table.copy()
            for c, sign in ((own, -1), (b, 1)):
                t[near, c] += sign * ins
                t[c, near] += sign * outs
            gains[b] = class_lm.likelihood(t)
        want.append(max(gains, key=gains.get))
        cls.append(own)
        key += [near, k + near]
        n += [ins, outs]
        offset.append(len(key))
    got = class_lm.best_classes(table, np.array(cls), np.array(offset), np.array(key), np.array(n))
    assert got.tolist() == want


def test_class_model_is_a_distribution(spark, docs_of):
    docs = docs_of([(i, "the cat sat on the mat the dog sat") for i in range(5)] + [(9, None)])
    model, rest = class_lm.fit(docs.select(text_or_empty().alias("text")))
    np.testing.assert_allclose((10.0 ** model.transition).sum(axis=1), 1.0, atol=1e-9)
    listed = model.classes != class_lm.OPEN
    for c in set(model.classes[listed].tolist()):
        assert model.counts[model.classes == c].sum() == model.class_size[c]
    odd = class_lm.score(docs_of(ODD, extra=True), model, rest).collect()
    assert len(odd) == len(ODD) and all(math.isfinite(r.score) for r in odd)
    empty, none = class_lm.fit(docs.select("text").limit(0))
    assert all(math.isfinite(r.score) for r in class_lm.score(docs, empty, none).collect())


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    # two kinds of word that alternate
    pairs = np.zeros((22, 22), dtype=np.int64)
    for a in range(2, 12):
        for b in range(12, 22):
            pairs[a, b], pairs[b, a] = rng.integers(5, 50, 2)
    of = class_lm.exchange(pairs, 2)
    assert len(set(of[:10])) == 1 and len(set(of[10:])) == 1 and of[0] != of[10]


def test_url_parts_and_rules(spark):
    rows = [(1, "http://WWW.Example.com/en/a?x=1#y"), (2, "https://example.com/en/"), (3, "http://a.example.com/de/"),
            (4, "ftp://x.net/es/"), (5, "http://xnet/es/"), (6, None), (7, "no scheme"), (8, "http://foo.com"),
            (9, "http://h?q=http://b.com/"), (10, "http://notexample.com/en/"), (1, "http://WWW.Example.com/en/a?x=1#y"),
            (None, "http://y.org/" + "p" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' as rule", "1 as _url")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/")
    assert got[2] == ("example.com", "/en/", "example.com/en/")
    assert got[3] == ("a.example.com", "/de/", "com/")
    assert got[4] == ("x.net", "/es/", "net/es/")
    assert got[5] == ("xnet", "/es/", None)
    assert got[6] == got[7] == ("", "", None)
    assert got[8] == ("foo.com", "", None)
    assert got[9] == ("h", "", None)
    assert got[10] == ("notexample.com", "/en/", "com/")
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_model_learns_the_labels(spark):
    pages = read_table(spark, SF, "pages")
    labelled = pages.select("url", F.col("url").contains("/de/").cast("int").alias("label"))
    got = url_filter.judge(pages, [], labelled).join(pages.select("page_id", "url"), "page_id").collect()
    assert sum((r.verdict == "block") == ("/de/" in r.url) for r in got) >= 0.97 * len(got)
