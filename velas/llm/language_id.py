"""Language identification by nearest TF-IDF centroid.

A text's vector holds its byte bigrams and trigrams (lower-cased, everything
but letters folded into spaces, hashed into ``DIMS`` dimensions), weighted by
(1 + log count) * idf and scaled to length one.  Every language has several
centroids, found by spherical k-means on its training vectors, so that a
language written in several styles is not blurred into one mean.  A text gets
the language of the centroid with the largest cosine.  Distance-based
rejection: ``rejected`` is set where that cosine is below what the centroid's
own members reach (mean minus ``REJECT_SD`` deviations); the nearest language
is still reported, as the score is.

Document frequencies cover all training rows.  The centroids are fitted on a
bounded sample: at most ``MAX_SAMPLE`` training rows (a documented parameter),
spread evenly over the languages by a hash of the id.  Texts are used whole.

Scale: two map-only passes; what moves is DIMS counts per task and the sample.
Tasks work through blocks of about 0.5 MB of text and at most 256 documents.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
without any training row every text is; a text whose letters give no n-gram is
given the commonest language with score 0; ties go to the first language in
code point order; repeated rows get equal answers; only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

DIMS = 4096
CENTROIDS = 3
MAX_SAMPLE = 2400
REJECT_SD = 4.0
UNDETERMINED = "und"

_letter = np.zeros(256, dtype=np.uint32)
for _c in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    _letter[_c] = _c
_BLOCK_DOCS, _BLOCK_BYTES = 256, 1 << 19


def _arrays(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, document limits) of blocks of lower-cased texts."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(at, at[lo] + _BLOCK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + _BLOCK_DOCS, len(texts))
        yield raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """n-gram counts, a row per document, block by block."""
    for data, at in _arrays(texts):
        n_docs = len(at) - 1
        out = np.zeros(n_docs * DIMS, dtype=np.int64)
        c = _letter[data]
        doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(at)) * DIMS
        for n in (2, 3):
            if len(c) < n:
                continue
            code = c[:len(c) - n + 1] + np.uint32(n << 28)
            for k in range(1, n):
                code = code * np.uint32(0x01000193) + c[k:len(c) - n + 1 + k]
            at_dim = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)
            keep = doc[:len(code)] == doc[n - 1:]
            blank = c[:len(code)] | c[n - 1:]
            keep &= blank > 0  # not from space to space
            out += np.bincount(doc[:len(code)][keep] + at_dim[keep], minlength=n_docs * DIMS)
        yield out.reshape(n_docs, DIMS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log(np.maximum(count, 1)).astype(np.float32)
    v += count > 0
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.where(norm > 0, norm, 1)[:, None]
    return v


def cluster(v: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (unit centroids, smallest cosine to accept for each).
    Starts from rows drawn with a fixed seed; a cluster of under 2 % of the rows
    (a few odd texts) gives its members back to the others."""
    rng = np.random.default_rng(0)
    centre = v[rng.choice(len(v), size=min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(v @ centre.T, axis=1)
        size = np.bincount(own, minlength=len(centre))
        stay = np.flatnonzero(size >= max(1, 0.02 * len(v)))
        fresh = np.stack([v[own == j].mean(axis=0) for j in stay])
        fresh /= np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
        if fresh.shape == centre.shape and np.allclose(fresh, centre, atol=1e-6):
            break
        centre = fresh
    cos = v @ centre.T
    own, best = np.argmax(cos, axis=1), cos.max(axis=1)
    floor = np.array([best[own == j].mean() - REJECT_SD * best[own == j].std() if (own == j).any() else 0.0
                      for j in range(len(centre))], dtype=np.float32)
    return centre, floor


@dataclass
class Model:
    idf: np.ndarray
    centres: np.ndarray
    floors: np.ndarray
    langs: list[str]  # of each centre
    commonest: str


def _letters(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        centroids: int = CENTROIDS, max_sample: int = MAX_SAMPLE) -> Model | None:
    """Learn from the rows where ``train`` holds and text and language exist."""
    rows = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"), train.alias("train")).where(
        "train and text is not null and lang is not null")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not per_lang:
        return None

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS + 1, dtype=np.int64), 0
        for b in batches:
            for c in counts(b.column("text")):
                df[:DIMS] += (c > 0).sum(axis=0)
                n += len(c)
        df[DIMS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(df)], ["dim", "n"])

    df = np.zeros(DIMS + 1)
    for r in (rows.select("text").mapInArrow(frequency, "dim long, n long")
              .groupBy("dim").agg(F.sum("n").alias("n")).collect()):
        df[r["dim"]] = r["n"]
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])).astype(np.float32) + np.float32(0.1)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.minimum(c, 65535).astype(np.uint16).tobytes() for m in counts(b.column("text")) for c in m]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array(v, pa.binary())],
                                             ["h", "lang", "v"])

    # each language's share of the sample, as a range of the hash
    span = 1 << 40
    share = {k: max_sample / len(per_lang) / n for k, n in per_lang.items()}
    wanted = F.lit(False)
    for k, p in share.items():
        wanted = wanted | ((F.col("lang") == k) & (F.pmod("h", F.lit(span)) < int(min(1.0, p) * span)))
    sample = (rows.where(wanted).select("h", "lang", "text").mapInArrow(sampled, "h long, lang string, v binary")
              .orderBy("h", "lang", "v").limit(max_sample).collect())
    centres, floors, langs = [], [], []
    for lang in sorted(per_lang):
        mine = [np.frombuffer(r["v"], dtype=np.uint16) for r in sample if r["lang"] == lang]
        if mine:
            v = vectors(np.stack(mine).astype(np.int64), idf)
            v = v[(v * v).sum(axis=1) > 0]
            if len(v):
                c, f = cluster(v, centroids)
                centres.append(c)
                floors.append(f)
                langs += [lang] * len(c)
    if not centres:
        return None
    commonest = min(per_lang, key=lambda k: (-per_lang[k], k))
    return Model(idf, np.concatenate(centres), np.concatenate(floors), langs, commonest)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
            extra: list[str] | None = None) -> DataFrame:
    """id, the ``extra`` columns, lang_pred, score (cosine, 0 to 1), rejected."""
    keep = [id_col, *(extra or [])]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("_text")
            n = len(texts)
            lang, score, rejected = np.full(n, UNDETERMINED, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
            if m is not None and n:
                known = _letters(texts)
                lo = 0
                for c in counts(texts):
                    cos = vectors(c, m.idf) @ m.centres.T
                    best = cos.argmax(axis=1)
                    top = cos[np.arange(len(c)), best]
                    hi = lo + len(c)
                    lang[lo:hi] = [m.langs[j] if t > 0 else m.commonest for j, t in zip(best, top)]
                    score[lo:hi] = np.clip(top, 0.0, 1.0)
                    rejected[lo:hi] = top < m.floors[best]
                    lo = hi
                lang[~known], score[~known], rejected[~known] = UNDETERMINED, 0.0, True
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                [*keep, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
