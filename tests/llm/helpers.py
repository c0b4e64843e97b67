"""Fixtures of odd rows, and brute-force versions."""

import re
from collections import Counter, defaultdict

ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, h string, label int, node long, tokens int, row long, key string, m string, gone int, shard string, line int"
LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(40_000))


def odd_docs(spark):
    """Null, empty, blank and very long texts, nulls in every column, repeated rows and ids, clashing names."""
    more = (True, "h", 1, 2, 3, 4, "k", "m", 5, "s", 6)
    none = (None,) * 11
    words = "the quick brown fox jumps over the lazy dog and then it runs far away from all of them to sleep in the sun by a river"
    rows = [
        (1, None, "en", "a", 0, *more), (2, "", "en", "a", 0, *more), (3, " \t\n ", None, "a", 4, *more), (4, LONG, "en", None, len(LONG), *more),
        (5, words, "en", "a", len(words), *more), (5, words, "en", "a", len(words), *more), (6, words, None, None, None, *none), (None, words, "fr", "b", 3, *more),
        (None, None, None, None, None, *none), (7, words + " now", "en", "a", 1, *more), (8, "é€😀 <s>[INST] \\ | # %", "fr", "b", 2, *more), (9, "one two three", "en", "a", 13, *more), (7, "other text of the same id", "en", "a", 1, *more),
    ]
    return spark.createDataFrame(rows, ODD)


def no_docs(spark):
    return spark.createDataFrame([], ODD)


def shingles(text, k):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def components(docs, k, percent=80):
    """doc_id -> least doc_id of its component, by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    by, up = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for g in s:
            by[g].append(d)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        shared = Counter(o for g in s for o in by[g] if o < d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = top(d), top(o)
                up[max(a, b)] = min(a, b)
    return {d: top(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def overlaps(text, item, enough=13):
    """Whether some alignment of item in text has a segment with at most one mismatch in five and enough matches: all
    segments of all alignments are tried."""
    norm = lambda t: re.findall(r"[^\W_]+", t.lower())
    d, b = norm(text), norm(item)
    if len(b) < 5:
        return False
    need = min(enough, -(-4 * len(b) // 5))
    at = defaultdict(list)
    for i, w in enumerate(d):
        at[w].append(i)
    for shift, n in Counter(i - j for j, w in enumerate(b) for i in at[w]).items():
        if n < need:
            continue
        same = [d[shift + j] == b[j] for j in range(len(b)) if 0 <= shift + j < len(d)]
        for start in range(len(same)):
            matched = 0
            for k, s in enumerate(same[start:], 1):
                matched += s
                if matched >= need and 5 * (k - matched) <= k:
                    return True
    return False
