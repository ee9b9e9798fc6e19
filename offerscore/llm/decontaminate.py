"""Benchmark decontamination: find passages of benchmark items in documents.

Method: q-gram lemma filtering.  Items are normalised and cut into patterns.  If a region
matches a pattern of ``n`` bytes with at most ``k`` edits, they share at least
``n - q + 1 - k * q`` q-grams whose diagonals differ by at most ``k``.  Every q-gram of a
document is looked up in the patterns; shared q-grams are counted in overlapping bands of
diagonals (each diagonal lies in two, so a match lies whole in one); bands that meet the
bound are verified by banded alignment.  Documents are only scanned: nothing is shuffled.

Quotes of a part of an item are found the same way: within a band, shared q-grams are also
counted in every window of ``quote`` bytes of a pattern, at each byte.  Patterns overlap by
half, so with ``quote`` at most half of ``piece`` every window of an item lies whole in one.

The pattern index is broadcast in blocks of at most ``block_bytes`` of item text; a larger
benchmark is searched block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T

Q = 10
#: Shared q-grams counted, and candidates verified, at a time.
POSTS, VERIFY = 1 << 20, 1 << 13
_TABLE_BITS = 22
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def normalise(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, every run of other ASCII characters than letters and digits one
    space, none at a text's ends.  Non-ASCII characters stay.  Texts end at the new ends."""
    folded = _FOLD[data]
    word = folded != 32
    keep = word.copy()
    if len(data):
        # a space stays if the byte before it is a word's, and another word follows in the text
        after = np.zeros(len(data), dtype=bool)
        after[1:] = ~word[1:] & word[:-1]
        starts = np.concatenate([[0], ends[:-1]])
        after[starts[starts < len(data)]] = False
        words = np.concatenate([[0], np.cumsum(word)])
        at = np.flatnonzero(after)
        end = ends[np.searchsorted(ends, at, side="right")]
        keep[at] = words[end] > words[at]
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes at each position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    with np.errstate(over="ignore"):
        h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += eight[Q - 8:Q - 8 + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class Patterns:
    """Index of a block of items: patterns, edit budgets, and q-gram positions."""

    def __init__(self, items: list[tuple[int, str]], rate: float, piece: int, quote: int = 0):
        #: Bytes of a window (0: patterns are only found whole), its edit budget and the q-grams it needs.
        self.quote = min(quote, piece // 2)
        self.quote_budget = max(0, min(int(rate * self.quote), (self.quote - Q) // Q))
        self.quote_need = self.quote - Q + 1 - self.quote_budget * Q
        if self.quote and self.quote < 2 * Q:
            raise ValueError(f"quote and half of piece must be at least {2 * Q}")
        self.item, self.text, self.budget, self.need, self.short = [], [], [], [], []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            data, _ = normalise(raw, np.array([len(raw)]))
            n = len(data)
            if not n:
                continue
            if n < 2 * Q:
                self.short.append((item, b" " + data.tobytes() + b" "))
                continue
            step = piece // 2
            begins = [0] if n <= piece + step else [*range(0, n - piece, step), n - piece]
            for a in begins:
                part = data if len(begins) == 1 else data[a:a + piece]
                k = min(int(rate * len(part)), (len(part) - Q) // Q)
                self.item.append(item)
                self.text.append(part)
                self.budget.append(k)
                self.need.append(len(part) - Q + 1 - k * Q)
        grams = [_grams(t) for t in self.text]
        which = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int32)
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0)]).astype(np.int32)
        grams = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.which, self.place = which[order], place[order]
        self.gram, self.first = np.unique(grams[order], return_index=True)
        self.count = np.diff(np.concatenate([self.first, [len(grams)]]))
        self.rank = np.repeat(np.arange(len(self.gram)), self.count) * len(self.text) + self.which
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.budget, self.need = np.array(self.budget, dtype=np.int64), np.array(self.need, dtype=np.int64)
        self.length = np.array([len(t) for t in self.text], dtype=np.int64)
        self.item = np.array(self.item, dtype=np.int64)
        self.item_number = np.unique(self.item, return_inverse=True)[1]

    def search(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) found in normalised back-to-back texts."""
        out = set()
        if self.short:
            start = 0
            for doc, end in enumerate(ends.tolist()):
                text = b" " + data[start:end].tobytes() + b" "
                out.update((doc, item) for item, phrase in self.short if phrase in text)
                start = end
        if not len(self.item):
            return sorted(out)
        grams = _grams(data)
        at = np.flatnonzero(self.table[(grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        slot = np.searchsorted(self.gram, grams[at])
        slot[slot == len(self.gram)] = 0
        same = self.gram[slot] == grams[at]
        at, slot = at[same], slot[same]
        doc = np.searchsorted(ends, at, side="right")
        inside = at + Q <= ends[np.minimum(doc, len(ends) - 1)]
        at, slot, doc = at[inside], slot[inside], doc[inside]
        # stretches of text with a bounded number of shared q-grams, each with the reach of a match behind it
        reach, upto, a = int((self.length + 2 * self.budget).max()), np.cumsum(self.count[slot]), 0
        while a < len(at):
            core = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + POSTS, side="right")))
            b = int(np.searchsorted(at, at[core - 1] + reach, side="right"))
            out.update(self._candidates(data, ends, at[a:b], slot[a:b], doc[a:b], 0, len(self.text)))
            a = core
        return sorted(out)

    def _candidates(self, data, ends, at, slot, doc, low, high) -> set[tuple[int, int]]:
        """(text, item) found by patterns low..high-1 among the q-grams at ``at``."""
        first = np.searchsorted(self.rank, slot * len(self.text) + low)
        n = np.searchsorted(self.rank, slot * len(self.text) + high) - first
        if n.sum() > 2 * POSTS and high - low > 1:        # q-grams that many patterns hold
            middle = (low + high) // 2
            return self._candidates(data, ends, at, slot, doc, low, middle) | self._candidates(data, ends, at, slot, doc, middle, high)
        row = np.repeat(np.arange(len(at)), n)
        post = first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pattern, place = self.which[post].astype(np.int64), self.place[post].astype(np.int64)
        diagonal = at[row] - place + int(self.length.max())            # from 0 up
        width = self.budget[pattern] + 1
        band = diagonal // width
        # each diagonal lies in the band that starts in its own stripe and in the one before
        key = np.concatenate([(pattern, doc[row], band, place), (pattern, doc[row], band - 1, place)], axis=1)
        order = np.lexsort(key[::-1])
        key = key[:, order]
        if not key.shape[1]:
            return set()
        new_place = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        new_band = np.concatenate([[True], (key[:3, 1:] != key[:3, :-1]).any(axis=0)])
        head = np.flatnonzero(new_band)
        shared = np.add.reduceat(new_place.astype(np.int64), head)
        good = head[shared >= self.need[key[0, head]]]
        out = set()
        for part in (good[i:i + VERIFY] for i in range(0, len(good), VERIFY)):
            pattern, doc, band = key[0, part], key[1, part], key[2, part]
            base = band * (self.budget[pattern] + 1) - int(self.length.max())
            found = self._verify(data, ends, pattern, doc, base)
            out.update(zip(doc[found].tolist(), self.item[pattern[found]].tolist()))
        return out | self._quotes(data, ends, key[:, new_place], out) if self.quote else out

    def _quotes(self, data, ends, key, known) -> set[tuple[int, int]]:
        """(text, item) of which a window is found, besides ``known``; ``key`` has the distinct
        (pattern, text, band, place) of shared q-grams in order."""
        need, span = self.quote_need, self.quote - Q
        if key.shape[1] < need:
            return set()
        size = int(self.length.max()) + self.quote
        head = np.concatenate([[True], (key[:3, 1:] != key[:3, :-1]).any(axis=0)])
        group = np.cumsum(head) - 1
        code = group * size + key[3]
        # windows that hold the need-th q-gram from i on begin in first..last; both grow with i
        i = np.flatnonzero(code[need - 1:] - code[:len(code) - need + 1] <= span)
        i = i[self.length[key[0, i]] >= self.quote]
        if not len(i):
            return set()
        zero = group[i] * size
        first = np.maximum(code[i + need - 1] - span, zero)
        last = np.minimum(code[i], zero + self.length[key[0, i]] - self.quote)
        first[1:] = np.maximum(first[1:], last[:-1] + 1)
        n = np.maximum(last - first + 1, 0)
        i, start = np.repeat(i, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.searchsorted(code, start + span, side="right") - np.searchsorted(code, start)
        pattern, doc, band, start = key[0, i], key[1, i], key[2, i], start - group[i] * size
        # the fullest windows of a text and item first, ever more of them until one is found
        pair = doc * (int(self.item_number.max()) + 1) + self.item_number[pattern]
        order = np.lexsort((-shared, pair))
        out, ask = set(), 1
        left = order[[(d, t) not in known for d, t in zip(doc[order].tolist(), self.item[pattern[order]].tolist())]]
        while len(left):
            mine = pair[left]
            new = np.concatenate([[True], mine[1:] != mine[:-1]])
            nth = np.arange(len(left)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            now, hit = left[nth < ask], np.zeros(0, dtype=np.int64)
            for part in (now[j:j + VERIFY] for j in range(0, len(now), VERIFY)):
                base = band[part] * (self.budget[pattern[part]] + 1) - int(self.length.max())
                found = part[self._verify(data, ends, pattern[part], doc[part], base, start[part])]
                hit = np.concatenate([hit, pair[found]])
                out.update(zip(doc[found].tolist(), self.item[pattern[found]].tolist()))
            left = left[(nth >= ask) & ~np.isin(mine, hit)]
            ask *= 4
        return out

    def _verify(self, data, ends, pattern, doc, low, start=None) -> np.ndarray:
        """Banded alignment of each candidate: whether its pattern, whole, is within its
        edit budget of some stretch of the text on the band's diagonals (and ``k`` beyond);
        with ``start``, whether the pattern's window from there is."""
        reach = self.budget[pattern]
        if start is None:
            start, length, k = np.zeros(len(pattern), dtype=np.int64), self.length[pattern], reach
        else:
            length, k = np.full(len(pattern), self.quote), np.full(len(pattern), self.quote_budget)
        begin = np.concatenate([[0], ends])[doc]
        end = ends[doc]
        wide = int((2 * reach + 2 * k + 3).max())
        base = low - k + start                           # first diagonal
        offsets = np.arange(wide)
        n, most = len(pattern), int(length.max())
        letters = np.zeros((n, most), dtype=np.int16)
        for i, (p, a) in enumerate(zip(pattern.tolist(), start.tolist())):
            letters[i, :length[i]] = self.text[p][a:a + length[i]]
        big = 1 << 20
        # cost[j]: pattern so far against text that ends before base + row + j
        cost = np.where((base[:, None] + offsets >= begin[:, None]) & (base[:, None] + offsets <= end[:, None]), 0, big)
        best = np.full(n, big)
        for row in range(most):
            at = base[:, None] + row + offsets
            ok = (at >= begin[:, None]) & (at < end[:, None])
            text = np.where(ok, data[np.clip(at, 0, len(data) - 1)], -1)
            take = np.where(ok, cost + (text != letters[:, row:row + 1]), big)
            skip = np.concatenate([cost[:, 1:], np.full((n, 1), big)], axis=1) + 1     # a pattern byte without text
            cost = np.minimum(take, skip)
            cost = np.minimum.accumulate(cost - offsets, axis=1) + offsets             # text bytes without pattern
            cost = np.where(at + 1 <= end[:, None], cost, big)
            ended = length == row + 1
            if ended.any():
                best[ended] = cost[ended].min(axis=1)
        return best <= k


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items in blocks of bounded size (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for b in range(n):
        mine = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in mine.collect()]


def _found(patterns: Patterns, texts: pa.Array):
    """(row, item) pairs of a batch of texts."""
    for a, b in T.slices(texts, 1 << 20):
        data, ends = normalise(*T.buffers(texts.slice(a, b - a)))
        for doc, item in patterns.search(data, ends):
            yield a + doc, item


def scan(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, piece: int = 128, block_bytes: int = 16 << 20,
         quote: int = 50) -> DataFrame:
    """Documents that hold a passage of a benchmark item.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are
    ignored.  A passage is an item, normalised (see ``normalise``), or a stretch of
    ``piece`` bytes of an item longer than one and a half of them, or any stretch of ``quote``
    bytes (at most half of ``piece``) of an item at least as long, at most ``rate`` of its
    length in edits away.  So a quote of ``quote`` bytes or more is found wherever it begins
    in the item.  Items shorter than 20 bytes must occur exactly, as whole words;
    blank and null items are ignored; an item without id is reported as -1.  Returns
    doc_id, contaminated (true), n_items, item_ids (sorted), one row for each doc_id with a
    passage: rows with equal or null ids are reported together.  Null and blank texts and
    an empty table or benchmark give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = None
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Patterns(block, rate, piece, quote))

        def run(batches, shared=shared):
            for batch in batches:
                pairs = list(_found(shared.value, batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([p[0] for p in pairs], pa.int64())),
                                                  pa.array([p[1] for p in pairs], pa.int64())], names=["doc_id", "item_id"])
        part = rows.mapInArrow(run, "doc_id long, item_id long")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")) \
        .select("doc_id", F.lit(True).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, piece: int = 128, block_bytes: int = 16 << 20,
          quote: int = 50) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds no passage of a benchmark item."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Patterns(block, rate, piece, quote))

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, _ in _found(shared.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
