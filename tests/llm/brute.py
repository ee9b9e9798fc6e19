"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LAST = float("inf")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def key(doc_id):
    return LAST if doc_id is None else doc_id


def substrings(rows, size):
    """(n_words, n_removed, kept_sha256) of each (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            g = tuple(w[k:k + size])
            first[g] = min(first.get(g, LAST), key(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < key(i):
                gone[k:k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def byte_strings(rows, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each (doc_id, text)."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, (LAST, LAST)), (key(i), p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (key(i), p):
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def components(rows, shingle=4, bits=4):
    """(doc_id, fingerprint, component_id) of each (doc_id, text)."""
    prints = []
    for _, t in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
        grams = [b" ".join(w[k:k + shingle]) for k in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
        ones = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g, 42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, LAST), key(i))
    return [(i, f"{p:016x}", None if least[g] == LAST else least[g]) for (i, _), p, g in zip(rows, prints, group)]


def katz(rows, discounts, top=5):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) of each (doc_id, text)."""
    tokens = [[x.translate(LOWER) for x in WORD.findall(t or "")] + [None] for _, t in rows]
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i, _ in rows]
    single = Counter(w for t, use in zip(tokens, train) if use for w in t)
    double = Counter(p for t, use in zip(tokens, train) if use for p in zip([("start",), *t[:-1]], t))
    total, types = sum(single.values()), len(single)

    def of(counter):
        return discounts(np.array([0.0, *(sum(c == r for c in counter.values()) for r in range(1, top + 2))]))
    d1, d2 = of(single), of(double)
    kept = sum(d1[min(c, top + 1)] * c for c in single.values())
    norm = total if kept < total - 1e-9 else total + 1
    after = defaultdict(dict)
    for (h, w), c in double.items():
        after[h][w] = c

    def unigram(w):
        return d1[min(single[w], top + 1)] * single[w] / norm if single[w] else 1 - kept / norm

    def bigram(h, w):
        if h not in after:
            return unigram(w)
        n, mass = sum(after[h].values()), sum(d2[min(c, top + 1)] * c for c in after[h].values())
        n = n if mass < n - 1e-9 else n + 1
        if w in after[h]:
            return d2[min(after[h][w], top + 1)] * after[h][w] / n
        return (1 - mass / n) / (1 - sum(map(unigram, after[h]))) * unigram(w)
    if total:
        for h in list(after)[:10]:
            assert abs(sum(bigram(h, w) for w in [*single, "\0unknown"]) - 1) < 1e-9
    return [(i, not use, len(t), sum(single[w] > 0 for w in t), total, sum(math.log10((single[w] + 1) / (total + types + 1)) for w in t),
             sum(math.log10(bigram(h, w)) for h, w in zip([("start",), *t[:-1]], t))) for (i, _), t, use in zip(rows, tokens, train)]


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = WORD.findall(t)
    n = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    cover = [False] * len(w)
    for k in range(len(w) - 7):
        if n[tuple(w[k:k + 8])] > 1:
            cover[k:k + 8] = [True] * 8
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), again, sum(cover)
