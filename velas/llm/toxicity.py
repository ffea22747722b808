"""Toxicity by fuzzy lexicon matching in context.

* **Lexicon.** Words, and word beginnings ("stems") for languages that inflect
  an insult, that labelled toxic texts hold far more often than clean ones.
* **Matching.** The lexicon is a trie of words and stems; a Levenshtein automaton
  of up to two edits (by term length, a stem's one letter less) is intersected
  with it.  The intersection is walked as
  a deterministic automaton whose states are built when first reached, so a
  word costs one table look-up per letter and an unlike word dies after a few.
* **Context.** A window of words around a match decides how much it counts: a
  match between quotation marks, or near a verb of reporting, is quoted rather
  than meant; a word that addresses the reader makes it abuse.
* **Score.** Logistic regression over saturated sums of term strengths (how
  much likelier a toxic text is to hold the term): exact, misspelled and stem
  matches, each meant or quoted, and addressed matches.

Lexicon and regression are fitted on a bounded sample of labelled rows: at
most ``MAX_TRAIN`` of each class (a documented parameter), those with the
smallest id hashes.  All rows are then scored whole, in one map-only pass; the
model that tasks receive has at most ``MAX_TERMS`` terms.

Defined cases: null and empty texts have no match and get the score of the
intercept; labels that are null are ignored, a row labelled twice counts as
toxic if any label says so; without toxic (or without clean) training rows the
lexicon is empty and every score is 0; repeated rows get equal scores; only the
named columns are read, and columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from velas.llm.common import fold, store, text_or_empty

MAX_TRAIN = 6000
MAX_TERMS = 2000
MIN_TOXIC = 4               # toxic texts that hold a term, whatever the size of the sample
STEM_LENGTHS = (4, 5, 6, 7, 8, 9)
WINDOW = 6
WORD = re.compile(r"[^\W_]+")
KEPT_WORDS = 400_000

#: Fixed lists: verbs of reporting and words of address, by language.
REPORTING = frozenset("""said says say wrote writes called calls quoted quote quotes reported reports stated
    sagte schrieb nannte zitierte dit écrit appelé cité dijo escribió llamó citó""".split())
ADDRESS = frozenset("you your youre u du dich dein ihr euch tu te toi vous votre tú usted tus".split())
QUOTES = re.compile("[\"“”„«»]")


def edits_allowed(term: str, stem: bool) -> int:
    n = len(term) - stem  # any ending may follow a stem, so it asks for a letter more
    return 0 if n < 5 else 1 if n < 9 else 2


@dataclass
class Node:
    children: dict[str, "Node"] = field(default_factory=dict)
    word: int | None = None   # edits allowed if a whole word ends here
    stem: int | None = None   # edits allowed if a stem ends here
    strength: float = 0.0     # of the word that ends here
    stem_strength: float = 0.0
    most: int = 0             # edits allowed anywhere below


#: A lexicon term: text, whether it is a stem, strength.
Term = tuple[str, bool, float]


def trie(terms: list[Term]) -> Node:
    root = Node()
    for term, stem, strength in terms:
        allowed = edits_allowed(term, stem)
        node = root
        node.most = max(node.most, allowed)
        for c in term:
            node = node.children.setdefault(c, Node())
            node.most = max(node.most, allowed)
        if stem:
            node.stem, node.stem_strength = allowed, max(node.stem_strength, strength)
        else:
            node.word, node.strength = allowed, max(node.strength, strength)
    return root


class FuzzyLexicon:
    """Levenshtein automata of all terms, intersected with their trie.  A whole
    word as it is goes before a stem, a stem before a misspelling of either: a
    misspelled stem is a beginning of the word within the stem's edits."""

    EXACT, STEM, FUZZY = 0, 1, 2

    def __init__(self, terms: list[Term]):
        self.alphabet = {c for t, _, _ in terms for c in t}
        self.states: dict[tuple, int] = {}
        self.members: list[list[tuple[Node, int]]] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, float] | None] = []     # of a word that ends in the state
        self.begun: list[tuple[int, float] | None] = []    # of a word that passes the state: stems
        self.cache: dict[str, tuple[int, float] | None] = {}
        root = trie(terms)
        self.start = self._state({id(root): (root, 0)})

    def _state(self, found: dict[int, tuple[Node, int]]) -> int:
        """Number of the state of these (node, edits); edits are the least per node."""
        todo = list(found.values())
        while todo:  # a term's letter left out: go down without reading
            node, e = todo.pop()
            if e < node.most:
                for child in node.children.values():
                    if e + 1 <= child.most and found.get(id(child), (None, 9))[1] > e + 1:
                        found[id(child)] = (child, e + 1)
                        todo.append((child, e + 1))
        key = tuple(sorted((k, e) for k, (_, e) in found.items()))
        if key not in self.states:
            self.states[key] = len(self.members)
            members = list(found.values())
            stems = ([(self.STEM, n.stem_strength) for n, e in members if e == 0 and n.stem is not None]
                     or [(self.FUZZY, n.stem_strength) for n, e in members if n.stem is not None and 0 < e <= n.stem])
            words = ([(self.EXACT, n.strength) for n, e in members if e == 0 and n.word is not None]
                     or [(self.FUZZY, n.strength) for n, e in members if n.word is not None and 0 < e <= n.word])
            self.members.append(members)
            self.moves.append({})
            self.ends.append(max(words, default=None))
            self.begun.append(max(stems, default=None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        found: dict[int, tuple[Node, int]] = {}

        def reach(node: Node, e: int) -> None:
            if e <= node.most and found.get(id(node), (None, 9))[1] > e:
                found[id(node)] = (node, e)

        for node, e in self.members[state]:
            for letter, child in node.children.items():
                if letter == c:
                    reach(child, e)
                elif e < child.most:
                    reach(child, e + 1)     # another letter
            if e < node.most:
                reach(node, e + 1)          # an extra letter
        return self._state(found) if found else -1

    def match(self, word: str) -> tuple[int, float] | None:
        """(kind, strength) of the best match of a word, or None."""
        try:
            return self.cache[word]
        except KeyError:
            if len(self.cache) >= KEPT_WORDS:
                self.cache.clear()
            found = self.cache[word] = self._walk(word)
            return found

    def _walk(self, word: str) -> tuple[int, float] | None:
        state = self.start
        best = self.begun[state]
        for c in word:
            if c not in self.alphabet:
                c = "\0"                    # all foreign letters move alike
            following = self.moves[state].get(c)
            if following is None:
                following = self.moves[state][c] = self._move(state, c)
            if following < 0:
                return best
            state = following
            best = self._better(best, self.begun[state])
        return self._better(best, self.ends[state])

    @staticmethod
    def _better(a: tuple[int, float] | None, b: tuple[int, float] | None) -> tuple[int, float] | None:
        """The match of the earlier kind, of one kind the stronger."""
        if a is None or b is None:
            return a or b
        return min(a, b, key=lambda m: (m[0], -m[1]))


FEATURES = 7
#: weights before any evidence: meant and quoted exact, stem and fuzzy matches; addressed matches
PRIOR = (2.0, 0.5, 2.0, 0.5, 2.0, 0.5, 0.5)


def features(text: str, lexicon: FuzzyLexicon) -> list[float]:
    """Strengths of [exact, stem, fuzzy] x [meant, quoted] matches, then of addressed ones; log-saturated."""
    text = text.lower()
    match = lexicon.match
    words = WORD.findall(text)
    kinds = [(k, i) for i, w in enumerate(words) if (k := match(w))]
    out = [0.0] * FEATURES
    if kinds:
        spots = [m.span() for m in WORD.finditer(text)]
        marks = [m.start() for m in QUOTES.finditer(text)]
        for (kind, strength), i in kinds:
            around = words[max(0, i - WINDOW):i + WINDOW + 1]
            lo, hi = spots[max(0, i - WINDOW)][0], spots[min(len(spots) - 1, i + WINDOW)][1]
            enclosed = (any(lo <= q < spots[i][0] for q in marks) and any(spots[i][1] <= q <= hi for q in marks))
            quoted = enclosed or any(w in REPORTING for w in around)
            out[2 * kind + quoted] += strength
            out[6] += strength * (not quoted and any(w in ADDRESS for w in around))
    return [float(np.log1p(x)) for x in out]


@dataclass
class Model:
    terms: list[Term]
    weights: list[float]
    intercept: float


def learn_terms(sample: DataFrame, max_terms: int = MAX_TERMS) -> list[Term]:
    """Terms from rows (_id, text, toxic): words and stems whose toxic share is
    high beyond doubt (likelihood ratio), the strongest ``max_terms``.

    Near copies share rare words by copying, so of the texts with the same
    smallest three-word shingle hash only one gives evidence."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    shingle = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1))),
                                      lambda i: F.xxhash64(F.array_join(F.slice("_w", i, 3), " "))))
    train = store(sample.withColumn("_w", words).withColumn("_m", shingle)
                  .groupBy("_m", "toxic").agg(F.min_by("_w", "_id").alias("_w"))
                  .select("toxic", F.array_distinct("_w").alias("_w")), "toxicity-words")
    tally = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    na, nb = float(tally.get(1, 0)), float(tally.get(0, 0))

    def of_length(n: int) -> Column:
        return F.transform(F.filter("_w", lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n))

    by_word = (train.select("toxic", F.explode("_w").alias("w")).where("length(w) >= 3")
               .groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    stems = train.select("toxic", F.explode(F.array_distinct(F.concat(*map(of_length, STEM_LENGTHS)))).alias("w"))
    spread = (by_word.where("a > 0").select(F.explode(F.array(*(
        F.when(F.length("w") > n, F.substring("w", 1, n)) for n in STEM_LENGTHS))).alias("w"))
        .where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("n_words")))
    by_stem = (stems.groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
               .join(spread, "w").where("n_words >= 4").drop("n_words"))

    rows = by_word.withColumn("stem", F.lit(False)).union(by_stem.withColumn("stem", F.lit(True)))
    expected_a = (F.col("a") + F.col("b")) * (na / (na + nb))
    expected_b = (F.col("a") + F.col("b")) * (nb / (na + nb))
    g2 = 2 * (F.col("a") * F.log(F.col("a") / expected_a)
              + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / expected_b)).otherwise(0.0))
    strong = (rows.where((F.col("a") >= MIN_TOXIC) & (F.col("a") / na > 20 * F.col("b") / nb))
              .withColumn("g2", g2).where("g2 >= 16").orderBy(F.desc("g2"), "w", "stem").limit(max_terms).collect())
    strength = {(r["w"], r["stem"]): math.log((r["a"] + 0.5) / (na + 1) / ((r["b"] + 0.5) / (nb + 1)))
                for r in strong}
    # whole words stay beside the stems that they begin with: a stem has fewer edits, if any
    return sorted((w, stem, x) for (w, stem), x in strength.items())


def regress(x: np.ndarray, y: np.ndarray, share: float, l2: float = 0.001,
            rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by damped Newton steps; ``share`` is that of toxic rows
    among all labelled ones, which the sample need not keep.  Weights are drawn
    to PRIOR, which decides for kinds of match that the sample lacks, and are not
    below 0: no kind of match speaks for a clean text."""
    n, k = x.shape
    prior = np.array([*PRIOR, 0.0])
    z = np.hstack([x, np.ones((n, 1))])
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    theta = prior.copy()
    ridge = np.append(np.full(k, l2), 1e-4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge * (theta - prior)
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
        step = np.linalg.solve(curve, gradient)
        theta = theta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        theta[:k] = np.maximum(theta[:k], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return theta[:k], float(theta[k])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learn from the labelled rows for which ``train`` (on the id) holds."""
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
              .where("_id is not null and toxic is not null"))
    if train is not None:
        chosen = labels.where(train).select(
            F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where(
            "_id is not null and toxic is not null")
    chosen = chosen.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    share = chosen.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)).alias("p")).first()["p"]
    order = [F.xxhash64("_id"), F.col("_id")]
    # at most 2 * max_train ids: the bound of the broadcast below
    chosen = store(chosen.where("toxic = 1").orderBy(*order).limit(max_train).union(
        chosen.where("toxic = 0").orderBy(*order).limit(max_train)), "toxicity-labels")
    sample = store(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
                   .join(F.broadcast(chosen), "_id").select("_id", "text", "toxic"), "toxicity-sample")
    tally = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = tally.get(1, 0), tally.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], [0.0] * FEATURES, -30.0)
    terms = learn_terms(sample)
    seen = sample.select("toxic", _featurizer(docs.sparkSession, terms)(F.col("text")).alias("x")).collect()
    x = np.array([list(r["x"]) for r in seen], dtype=float)
    y = np.array([r["toxic"] for r in seen], dtype=float)
    weights, intercept = regress(x, y, share)
    return Model(terms, weights.tolist(), intercept)


_lexicons: dict[tuple, FuzzyLexicon] = {}


def _lexicon(terms: list[Term]) -> FuzzyLexicon:
    key = tuple(terms)
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = FuzzyLexicon(terms)
    return _lexicons[key]


def _featurizer(spark: SparkSession, terms: list[Term]):
    shared = spark.sparkContext.broadcast(terms)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = _lexicon(shared.value)
        for t in texts:
            yield pd.Series([features(s or "", lexicon) for s in t])

    return F.pandas_udf(run, "array<double>")


def score_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score (0 to 1) of a text column."""
    x = _featurizer(spark, model.terms)(text)
    weighted = F.zip_with(x, F.array(*map(F.lit, model.weights)), lambda a, w: a * w)
    return F.aggregate(weighted, F.lit(model.intercept), lambda acc, v: acc + v, lambda z: 1 / (1 + F.exp(-z)))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted``."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    return (docs.select(*names, score_of(docs.sparkSession, model, F.col(text_col)).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with the columns they came with."""
    return docs.where(score_of(docs.sparkSession, model, F.col(text_col)) < 0.5)


def held_out(id_col: str = "doc_id") -> Column:
    return fold(F.col(id_col), 5) == 0
