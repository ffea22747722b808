"""Cases and plain-Python references shared by the tests of this folder."""

import hashlib
import math
import re
import zlib
from collections import defaultdict


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: nulls, empty and blank texts, ties, repeated rows, a long text
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a"), (None, None), (5, "word " * 30000),
       (6, "word " * 30000), (7, "ünï cödé ßtraße"), (8, "1234 5678"), (9, "a\x0bb\x0cc")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, sha(t)))
    return sorted(out, key=repr)


def brute_spans(rows, k=13):
    top = 1 << 63
    key = [top if i is None else i for i, _ in rows]
    words = [words_of(t) for _, t in rows]
    first = {}
    for i, w in zip(key, words):
        for j in range(len(w) - k + 1):
            g = tuple(w[j:j + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for (d, _), i, w in zip(rows, key, words):
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j:j + k])] < i:
                gone.update(range(j, j + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=repr)


def brute_jaccard(rows, size=4, percent=85):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = words_of((t or "").translate(lower))
        sets.append({tuple(w[j:j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    best = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        best[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in best[root(i)] if x is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_spelling(rows, min_length=5, min_count=3):
    """(word, form, root, n, n_near, form_n) with every pair of words compared."""
    count = defaultdict(int)
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    around = {w: [x for x in count if near(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(around[w], key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), count[form[w]] if w in form else None))
    return sorted(out, key=repr)


def brute_search(rows, items, k=50):
    """(item, rank, doc_id, score) with every document scored for every item."""
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    docs = [(d, terms(t)) for d, t in rows]
    n, length = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = defaultdict(int)
    for _, t in docs:
        for x in set(t):
            df[x] += 1
    queries = defaultdict(set)
    for item, t in items:
        queries[item] |= set(terms(t))
    out = []
    for item, query in queries.items():
        scored = []
        for d, t in docs:
            m = 50 + (50 * len(t) * n) // max(length, 1)
            s = 0
            for x in query:
                if tf := t.count(x):
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (
                        (1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)
