"""LM scoring with a Katz backoff n-gram model.

Method: Katz backoff.  Counts up to ``TOP`` are discounted by Good-Turing; the mass they
free goes to the unseen words of a context in proportion to their probability in the next
shorter context, with a backoff weight that makes every context's distribution sum to one.  Unigrams are
discounted the same way, in favour of one unknown word.

The corpus is a chunk table of token numbers (see ``exchange``).  Shards count the words, by
which the table is written again with word numbers, then the n-grams of each higher order (keyed by context), from all chunks' requests, and write
a partitioned table of sorted arrays: counts and context statistics for every chunk that asked.
From these tables each token is evaluated recursively: n-gram, else backoff weight times its
probability in the shorter context, down to the unknown word.  A context with more than its share of all tokens is split over all shards by
the word that follows; at most ``HOT`` such contexts exist.

A shard also says which n-grams only one chunk has.  Everything that begins with one of them
is counted in that chunk and not sent again; what only ends with one is sent without its last
word, for its context's statistics.  Both are exact at every size.

What the other side can tell is not sent.  Words are numbered by falling count, so a number tells
its word's count and common words have small numbers (``Numbering``); a context's n-grams count
as much as the context itself; and an n-gram goes to the shard of the context's first word, so that
sorted contexts differ little.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, textops as T

#: Largest count that is discounted.
TOP = 5
HOT = 20_000
#: Words that are common enough for at most this many to exist are numbered without gaps.
COMMON = 100_000
_END = np.uint64(0x5BD1E9955BD1E995)
_STATS = ("total", *(f"m{r}" for r in range(1, TOP + 1)), "seen")


def in_training(doc_id: int | None) -> bool:
    """Documents whose crc32(doc_id as text) mod 7 is not 2 (no id: the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts d[r] for r = 0..TOP+1 (d[0] unused, d[TOP+1] = 1 for all larger counts) from
    n[r], the number of types with count r (r up to TOP+1).  Where repeated documents make
    the n[r] uneven, a line fitted to log n[r] over log r replaces them (simple Good-Turing);
    where that falls too slowly as well, the discount is (r - 1/2) / r."""
    d = np.array([1.0, *((r - 0.5) / r for r in range(1, TOP + 1)), 1.0])
    r = np.arange(1, TOP + 2)
    if (n[r] > 0).all():
        slope, height = np.polyfit(np.log(r), np.log(n[r]), 1)
        for m in (n[r].astype(float), np.exp(height + slope * np.log(r))):
            last = (TOP + 1) * m[TOP] / m[0]
            turing = (r[1:] * m[1:] / (r[:-1] * m[:-1]) - last) / (1 - last) if last < 1 else np.zeros(TOP)
            if ((turing > 0) & (turing < 1)).all():
                d[1:TOP + 1] = turing
                break
    return d


class Unigrams:
    """Discounted unigram probabilities: ``p(counts)``, with count 0 the unknown word."""

    def __init__(self, total: int, types: int, n: np.ndarray):
        self.total, self.types, self.d = total, types, good_turing(n)
        small = float(sum(n[r] * (1 - self.d[r]) * r for r in range(1, TOP + 1)))
        # without a discounted count, the unknown word gets one count of its own
        self.norm = total if small > 0 else total + 1
        self.unknown = (small if small > 0 else 1.0) / max(self.norm, 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.d[np.minimum(counts, TOP + 1)] * counts / max(self.norm, 1), self.unknown)


class Numbering:
    """Word numbers from 1 up by falling count in training, from which the count follows.

    ``rows`` has (count, shard, words): for counts above ``top`` the words of each shard, for
    the others (shard -1) the most that any of the ``n_shards`` has.  There shards take turns."""

    def __init__(self, rows: list[tuple[int, int, int]], n_shards: int, top: int):
        self.count, shard, most = np.array(sorted(rows, key=lambda r: (-r[0], r[1])), dtype=np.int64).reshape(-1, 3).T
        self.n_shards, self.top = n_shards, top
        room = np.where(shard < 0, most * n_shards, most)
        self.first = 1 + np.cumsum(room) - room
        self.end = 1 + int(room.sum())
        self.key = shard + 1 - self.count * (n_shards + 1)

    def number(self, count: np.ndarray, place: np.ndarray, shard: int) -> np.ndarray:
        """Numbers of words by their counts and places among the ``shard``'s words of that count."""
        common = count > self.top
        at = np.searchsorted(self.key, np.where(common, shard + 1, 0) - count * (self.n_shards + 1))
        return self.first[at] + np.where(common, place, place * self.n_shards + shard)

    def count_of(self, number: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.first, number, side="right") - 1]


def context_weights(stats: dict[str, np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and exactly normalising backoff weight of each context."""
    total = stats["total"].astype(np.float64)
    freed = sum(stats[f"m{r}"] * (r * (1 - d[r])) for r in range(1, TOP + 1))
    norm = np.where(freed > 0, total, total + 1)         # nothing discounted: one count for the unseen
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = (np.where(freed > 0, freed, 1.0) / norm) / (1 - stats["seen"])
    return norm, np.where(total > 0, weight, 1.0)


def context_stats(context: np.ndarray, count: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """What ``context_weights`` needs of contexts 0, 1, ..., from each n-gram's context, count
    and probability in the shorter context: all counts, the n-grams of each discounted count,
    and the probability of those seen."""
    k = int(context[-1]) + 1
    stats = {"total": np.bincount(context, weights=count, minlength=k).astype(np.int64)}
    for r in range(1, TOP + 1):
        stats[f"m{r}"] = np.bincount(context[count == r], minlength=k)
    return stats | {"seen": np.bincount(context, weights=np.where(count > 0, p, 0.0), minlength=k)}


def _counts_of(count: np.ndarray) -> np.ndarray:
    """Number of types by count; the last entry is all larger ones."""
    return np.bincount(np.minimum(count, TOP + 2), minlength=TOP + 3)


def _new(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.concatenate([[True], values[1:] != values[:-1]])[:len(values)]


def _flags(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, count=n).astype(bool) if n else np.zeros(0, dtype=bool)


# -- chunks ---------------------------------------------------------------------------------

def _tokens(batch: pa.RecordBatch) -> bytes:
    """A chunk's documents as numbers into its own vocabulary (by falling count there, then sorted);
    the end of a text is a token."""
    ids, texts = batch.column(0), batch.column(1)
    hashes, lengths = [], []
    for a, b in T.slices(texts, 1 << 20):
        data, ends = T.buffers(texts.slice(a, b - a))
        data = T.lower_ascii(data)
        starts, stops, upto = T.word_spans(data, ends)
        hashes.append(np.insert(T.span_hash(data, starts, stops), upto, _END))
        lengths.append(np.diff(np.concatenate([[0], upto])) + 1)
    vocabulary, local, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    doc = ids.to_pylist()
    return X.pack(vocabulary_d=vocabulary[order], local=np.argsort(order)[local].astype(np.uint32), n=np.concatenate(lengths).astype(np.int64),
                  id=np.array([X.NO_ID if i is None else i for i in doc], dtype=np.int64),
                  train=np.array([in_training(i) for i in doc], dtype=np.uint8))


class _Words:
    """A chunk's sorted vocabulary, and its tokens as numbers into it."""

    def __init__(self, payload: bytes, n_shards: int):
        self.got = X.unpack(payload)
        order = np.argsort(self.got["vocabulary_d"])
        self.vocabulary, self.local = self.got["vocabulary_d"][order], np.argsort(order)[self.got["local"]]
        self.shard = X.shard_of(self.vocabulary, n_shards)

    def counts(self) -> np.ndarray:
        return np.bincount(self.local[np.repeat(self.got["train"].astype(bool), self.got["n"])], minlength=len(self.vocabulary))

    def numbered(self, got: dict, n_shards: int, numbering: Numbering) -> bytes:
        """The payload of ``_Chunk``: word numbers in place of the vocabulary, from the shards' replies."""
        size = len(self.vocabulary)
        number, count, own = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
        for s, at in X.split(self.shard, n_shards):
            r = X.unpack(got[s])
            count[at], own[at] = r["count"], _flags(r["own"], len(at))
            place = np.empty(len(at), dtype=np.int64)
            place[np.argsort(count[at], kind="stable")] = r["place_d"]
            number[at] = numbering.number(count[at], place, s)
        order = np.argsort(number)
        return X.pack(number_d=number[order], own=np.packbits(own[order]), local=np.argsort(order)[self.local].astype(np.uint32),
                      texts=count[np.searchsorted(self.vocabulary, [_END])], **{k: self.got[k] for k in ("n", "id", "train")})


class _Chunk:
    """A chunk's word numbers in order, their counts and whether only this chunk has them; tokens."""

    def __init__(self, payload: bytes, numbering: Numbering):
        got = X.unpack(payload)
        self.ids, self.n, self.train = got["id"], got["n"], got["train"].astype(bool)
        self.number, self.local, self.texts = got["number_d"], got["local"].astype(np.int64), got["texts"][0]
        self.own, self.count = _flags(got["own"], len(self.number)), numbering.count_of(self.number)
        self.used = np.repeat(self.train, self.n)

    def grams(self, order: int):
        """For each order from 2 up to ``order``: the distinct (context, word), sorted, as numbers
        (contexts: words, then the shorter n-grams of this list; one more for a text's start),
        each token's n-gram, one token of each, and each one's count in training texts."""
        start = np.cumsum(self.n) - self.n
        gram, size, out = self.local, len(self.number), []
        for _ in range(2, order + 1):
            context = np.empty_like(self.local)
            context[1:] = gram[:-1]
            context[start] = size
            base = len(self.number) + 1
            code, token, gram = np.unique(context * base + self.local, return_index=True, return_inverse=True)
            size = len(code)
            out.append((code // base, code % base, gram, token, np.bincount(gram[self.used], minlength=size)))
        return out


def _unigram_reply(payloads, _):
    """The shard's words of each count; counts and places among the words of a count for each
    chunk's words (places by count, then in the request's order), and which only that chunk has."""
    got = [X.unpack(p) for p in payloads]
    word, n = np.concatenate([g["word_d"] for g in got]), np.concatenate([g["n"] for g in got]).astype(np.int64)
    known, where = np.unique(word, return_inverse=True)
    count = np.bincount(where, weights=n, minlength=len(known)).astype(np.int64)
    own = np.bincount(where, minlength=len(known)) == 1
    kinds, kind, words = np.unique(count, return_inverse=True, return_counts=True)
    order = np.argsort(kind, kind="stable")
    place = np.empty(len(known), dtype=np.uint32)
    place[order] = np.arange(len(known)) - (np.cumsum(words) - words)[kind[order]]
    cut = np.cumsum([0] + [len(g["n"]) for g in got])
    replies = []
    for i, j in zip(cut, cut[1:]):
        mine = where[i:j]
        replies.append(X.pack(count=count[mine].astype(np.uint64), place_d=place[mine][np.argsort(count[mine], kind="stable")], own=np.packbits(own[mine])))
    return X.pack(count=kinds, words=words), replies


def _short(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of 48 bits.  The error, below 1 in 10 ** 11, is that of sums in another order."""
    return (np.asarray(values, dtype=np.float64).view(np.uint64) + np.uint64(1 << 15)) >> np.uint64(16)


def _long(short: np.ndarray) -> np.ndarray:
    return (short << np.uint64(16)).view(np.float64)


def _seen(times: np.ndarray, norm: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Probability of n-grams by their count and their context's denominator."""
    return d[np.minimum(times, TOP + 1)] * times / np.maximum(norm, 1)


def _second(left: np.ndarray, numbering: Numbering, start: int) -> np.ndarray:
    """Training count of the second word of contexts of two (of a text's start: the texts)."""
    return np.where(left == 0, start, numbering.count_of(left & np.int64((1 << 32) - 1)))


def _below(g: dict, right: np.ndarray, alone: np.ndarray, unigrams: Unigrams, numbering: Numbering, d: np.ndarray | None) -> np.ndarray:
    """Probability of each n-gram of a request in the shorter context."""
    if d is None:
        count = np.empty(len(right), dtype=np.int64)
        count[alone], count[~alone] = g["single"], numbering.count_of(right[~alone])
        return unigrams.p(count)
    new = _new(g["left_d"])
    norm = g["norm"] if "norm" in g else _second(g["left_d"][new], numbering, g["start"][0]) + _flags(g["bare"], np.count_nonzero(new))
    return _seen(g["times"].astype(np.int64), norm[np.cumsum(new) - 1], d)


def _gram_reply(payloads, counted, unigrams: Unigrams, numbering: Numbering, d: np.ndarray | None, last: bool):
    """The shard's totals (with those that chunks have ``counted`` themselves) and the statistics
    of contexts that are split over shards; n-gram counts, context statistics and, below the
    ``last`` order, which n-grams only that chunk has, for each chunk's n-grams.  A last word's
    probability in the shorter context comes from its count there, in the request, and the
    context's denominator, with that order's ``d``.  Bigrams need the word's count only.  The
    denominator is the count of the shorter context, or one more: of two words, the request says
    which; of more it has the denominator.  N-grams that only the asking chunk has come without
    their last word."""
    of = np.zeros(TOP + 3, dtype=np.int64) + sum(X.unpack(p)["n"] for p in counted)
    if not payloads:
        return X.pack(n=of, left=np.zeros(0, dtype=np.int64), **{s: np.zeros(0) for s in _STATS}), []
    got = [X.unpack(p) for p in payloads]
    cut = np.cumsum([0] + [len(g["n"]) for g in got])
    left, n = np.concatenate([g["left_d"] for g in got]), np.concatenate([g["n"] for g in got])
    alone, hot = (np.concatenate([_flags(g[k], len(g["n"])) for g in got]) for k in ("alone", "hot"))
    right = np.empty(len(left), dtype=np.int64)
    right[~alone] = np.concatenate([g["right"] for g in got])
    right[alone] = -1 - np.arange(np.count_nonzero(alone))           # like no other
    below = np.concatenate([_below(g, right[i:j], alone[i:j], unigrams, numbering, d) for g, i, j in zip(got, cut, cut[1:])])
    order = np.lexsort((right, left))
    new_a = _new(left[order])
    new = new_a | _new(right[order])
    head = np.flatnonzero(new)
    count = np.add.reduceat(n[order].astype(np.int64), head)
    own = np.diff(np.append(head, len(order))) == 1
    context = np.cumsum(new_a[head]) - 1
    stats = context_stats(context, count, below[order][head])
    of += _counts_of(count)
    split = np.flatnonzero(hot[order][new_a])
    totals = X.pack(n=of, left=left[order][new_a][split], **{s: v[split] for s, v in stats.items()})
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    replies = []
    for i, j in zip(cut, cut[1:]):
        mine, first, told = number[i:j], _new(left[i:j]), ~alone[i:j]
        at = context[mine[first]]
        # a backoff weight is only needed for unseen n-grams; else it is enough if any count is discounted
        unseen = np.logical_or.reduceat(count[mine] == 0, np.flatnonzero(first))
        flags = {} if last else {"own": np.packbits(own[mine][told])}
        some = np.any([stats[f"m{r}"][at] > 0 for r in range(1, TOP + 1)], axis=0)
        need = {f"m{r}": np.where(unseen, stats[f"m{r}"][at], some if r == 1 else 0) for r in range(1, TOP + 1)}
        replies.append(X.pack(count=count[mine][told].astype(np.uint64), **flags, **need, unseen=_short(np.where(unseen, 1 - stats["seen"][at], 0))))
    return totals, replies


#: Rows that are no replies: a shard's totals in an answer; in a request, counts a chunk has taken itself.
TOTALS = -1


@contextmanager
def _shuffles_dropped(spark):
    """Queries that end in here leave no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _answer(requests: DataFrame, reply) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        ids, payloads, shard = group["chunk_id"].to_pylist(), group["payload"].to_pylist(), group["shard"][0].as_py()
        order = np.argsort(ids, kind="stable")
        asked = [i for i in order if ids[i] >= 0]
        totals, out = reply([payloads[i] for i in asked], [payloads[i] for i in order if ids[i] < 0])
        return X.messages([(shard, TOTALS, totals)] + [(shard, ids[i], data) for i, data in zip(asked, out)])
    return requests.groupBy("shard").applyInArrow(run, X.MESSAGE)


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """Score all texts with a model of ``order`` (2 or more) of those in training (see ``in_training``).

    ``docs`` needs doc_id and text; other columns are ignored.  Words are lower-cased (A-Z)
    ``[^\\x20\\x09-\\x0D]+``; each text ends with one end token.  Returns one row per input
    row: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (add-one unigram) and score, the model's log10 probability of the text.  A
    null or blank text is one end token; rows with equal ids count each; a null id is in
    training.  Without training texts every token is unknown, with probability one.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = X.Store(spark, "katz")
    table, n_bytes = X.chunks(store, docs, _tokens)
    n_shards = X.shards_for(n_bytes)

    def ask_words(payload):
        c = _Words(payload, n_shards)
        n = c.counts()
        for s, at in X.split(c.shard, n_shards):
            yield s, X.pack(word_d=c.vocabulary[at], n=n[at].astype(np.uint32))

    with _shuffles_dropped(spark):
        words = store.write(_answer(X.ask(table, ask_words), _unigram_reply), "unigrams")

    def kinds_of(batches):
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = X.unpack(payload)
                yield pa.RecordBatch.from_pydict({"count": pa.array(got["count"]), "shard": pa.array([shard] * len(got["count"]), pa.int32()), "n": pa.array(got["words"])})
    kinds = words.filter(F.col("chunk_id") == TOTALS).select("shard", "payload").mapInArrow(kinds_of, "count long, shard int, n long")
    total = kinds.agg(F.coalesce(F.sum(F.col("count") * F.col("n")), F.lit(0))).first()[0]
    top = total // COMMON
    # at most COMMON words are above the top, and only the square root of 2 * total counts can differ
    rows = kinds.groupBy("count", F.when(F.col("count") > top, F.col("shard")).otherwise(-1).alias("shard")) \
        .agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()
    of = np.zeros(TOP + 3, dtype=np.int64)
    for r in rows:
        of[min(r["count"], TOP + 2)] += r["n"]
    types = int(of[1:].sum())
    unigrams = Unigrams(total, types, of[:TOP + 2])
    numbered = spark.sparkContext.broadcast(Numbering([(r["count"], r["shard"], r["most"]) for r in rows], n_shards, top))
    paired = numbered.value.end < 1 << 31              # two word numbers fit one key
    hot_from = max(1, total // min(4 * n_shards, HOT))

    def number_words(payload, got, chunk):
        return pa.table({"chunk_id": pa.array([chunk], pa.int64()),
                         "payload": pa.array([_Words(payload, n_shards).numbered(got, n_shards, numbered.value)], pa.binary())})

    n_parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with _shuffles_dropped(spark):
        table = store.write(X.finish(table, words.filter("chunk_id >= 0"), number_words, "chunk_id long, payload binary"), "numbered", n_parts, "chunk_id")
    store.drop("chunks")
    store.drop("unigrams")

    replies = None
    levels: list[tuple] = []                           # of each finished order from 2 up: discounts, hot contexts' broadcast

    def walk(payload, got, n):
        """The chunk, its words' counts, each finished order's probabilities by n-gram, and, if
        order ``n`` is not finished, what its requests are made of."""
        c = _Chunk(payload, numbered.value)
        number, count, own = np.append(c.number, 0), np.append(c.count, 0), c.own
        # the start of a text is as frequent as its end
        key, often = number, np.append(c.count, c.texts)
        home = T.mix(number.astype(np.uint64))
        p, shorter, times, scale = unigrams.p(count[:-1]), c.local, count, np.zeros(len(count))
        for k, (left, right, gram, token, used) in enumerate(c.grams(n), 2):
            last, hot = shorter[token], often[left] > hot_from
            below = p[last]
            inside = np.append(own, False)[left]       # only this chunk has the context
            alone = own[last] & ~inside                # or the rest of the n-gram
            sent = np.flatnonzero(~inside)
            with np.errstate(over="ignore"):
                home = np.append(np.where(hot, T.mix(home[left] + number[right].astype(np.uint64)), home[left]), home[-1])
                shard = X.shard_of(home[:-1], n_shards)
            if k - 2 == len(levels):
                return c, count, p, shorter, (key[left], number[right], used, times[last], scale[last], hot, alone, sent, shard[sent], c.texts)
            d, shared = levels[k - 2]
            p, times, scale = np.empty(len(left)), np.zeros(len(left), dtype=np.int64), np.empty(len(left))
            own = inside | alone
            h = np.flatnonzero(inside)
            if len(h):
                which = np.cumsum(_new(left[h])) - 1
                norm, weight = context_weights(context_stats(which, used[h], below[h]), d)
                times[h], scale[h] = used[h], norm[which]
                p[h] = np.where(used[h] > 0, _seen(used[h], norm[which], d), weight[which] * below[h])
            for s, at in X.split(shard[sent], n_shards):
                r = X.unpack(got[(k - 1) * n_shards + s])
                at = sent[at]
                mine, told = left[at], at[~alone[at]]
                which = np.cumsum(_new(mine)) - 1
                # a context's n-grams count as much as the context
                norm, weight = context_weights(r | {"total": often[mine[_new(mine)]], "seen": 1 - _long(r["unseen"])}, d)
                norm, weight = norm[which], weight[which]
                if hot[at].any():
                    h_left, h_norm, h_weight = shared.value
                    h = np.flatnonzero(hot[at])
                    slot = np.searchsorted(h_left, key[mine[h]])
                    norm[h], weight[h] = h_norm[slot], h_weight[slot]
                times[at], times[told], scale[at] = used[at], r["count"], norm
                if "own" in r:
                    own[told] = _flags(r["own"], len(told))
                p[at] = np.where(times[at] > 0, _seen(times[at], norm, d), weight * below[at])
            # these n-grams are the next order's contexts: two word numbers, or a hash of more
            with np.errstate(over="ignore"):
                longer = (key[left] << np.int64(32)) + number[right] if k == 2 and paired else \
                    T.mix(T.mix(key[left].astype(np.uint64)) + number[right].astype(np.uint64)).astype(np.int64)
                key = np.append(longer, 0)
            often, shorter = np.append(times, often[-1]), gram
        return c, count, p, shorter, None

    def totals(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                got = X.unpack(payload)
                k = len(got["left"])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(got["left"]), pa.array([0] * (TOP + 1), pa.int64())]),
                                                  pa.array(np.concatenate([np.zeros(k, np.int64), np.arange(1, TOP + 2)])),
                                                  *[pa.array(np.concatenate([got[s].astype(np.float64), got["n"][1:TOP + 2] * (s == "total")])) for s in _STATS]],
                                                 names=["left", "r", *_STATS])
    kinds = "left long, r long, " + ", ".join(f"{s} double" for s in _STATS)

    for n in range(2, order + 1):
        def ask_grams(payload, got, chunk, n=n):
            left, right, used, times, norm, hot, alone, sent, shard, texts = walk(payload, got, n)[-1]

            def request(at):
                if n == 2:
                    lower = {"single": times[at][alone[at]].astype(np.uint32)}
                else:
                    first = at[_new(left[at])]
                    lower = {"times": times[at].astype(np.uint32)}
                    lower |= {"start": np.array([texts]), "bare": np.packbits(norm[first] > _second(left[first], numbered.value, texts))} \
                        if n == 3 and paired else {"norm": norm[first].astype(np.uint64)}
                return X.pack(left_d=left[at], right=right[at][~alone[at]], n=used[at].astype(np.uint32),
                              alone=np.packbits(alone[at]), hot=np.packbits(hot[at]), **lower)
            mine = np.ones(len(left), dtype=bool)
            mine[sent] = False
            return X.messages([((n - 1) * n_shards + s, chunk, request(sent[at])) for s, at in X.split(shard, n_shards)]
                              + [((n - 1) * n_shards + chunk % n_shards, TOTALS, X.pack(n=_counts_of(used[mine])))])

        def reply(payloads, counted, d=levels[-1][0] if levels else None, last=n == order):
            return _gram_reply(payloads, counted, unigrams, numbered.value, d, last)

        def ask_first(group: pa.Table) -> pa.Table:
            return pa.concat_tables([ask_grams(p, {}, chunk) for chunk, p in zip(group["chunk_id"].to_pylist(), group["payload"].to_pylist())])

        with _shuffles_dropped(spark):
            asked = X.finish(table, replies, ask_grams, X.MESSAGE) if replies is not None else table.groupBy("chunk_id").applyInArrow(ask_first, X.MESSAGE)
            grams = _answer(asked, reply)
            # replies that are read more than once lie with their chunks
            grams = store.write(grams, f"grams{n}") if n == order else store.write(grams.repartition(n_parts, "chunk_id"), f"grams{n}", n_parts, "chunk_id")
        sums = grams.filter(F.col("chunk_id") == TOTALS).select("payload").mapInArrow(totals, kinds) \
            .groupBy("left", "r").agg(*[F.sum(s).alias(s) for s in _STATS])
        of, hot_rows = np.zeros(TOP + 2), []
        for r in sums.collect():                       # at most HOT contexts
            if r["r"]:
                of[r["r"]] = r["total"]
            else:
                hot_rows.append(r)
        d = good_turing(of)
        hot_rows.sort(key=lambda r: r["left"])
        hot_norm, hot_weight = context_weights({s: np.array([r[s] for r in hot_rows], dtype=np.float64) for s in _STATS}, d)
        shared = spark.sparkContext.broadcast((np.array([r["left"] for r in hot_rows], dtype=np.int64), hot_norm, hot_weight))
        levels.append((d, shared))
        got = grams.filter("chunk_id >= 0")
        replies = got if replies is None else replies.unionByName(got)

    def work(payload, got, chunk):
        c, count, p, gram, _ = walk(payload, got, order)
        start = np.cumsum(c.n) - c.n
        single = count[:-1][c.local]
        base = np.log10((count[:-1] + 1) / (total + (types + 1)))[c.local]
        return pa.table({"doc_id": pa.array([None if i == X.NO_ID else i for i in c.ids.tolist()], pa.int64()), "held_out": pa.array(~c.train),
                         "n_tokens": pa.array(c.n), "n_known": pa.array(np.add.reduceat((single > 0).astype(np.int64), start)),
                         "train_tokens": pa.array(np.full(len(c.n), total)),
                         "base_score": pa.array(np.add.reduceat(base, start)), "score": pa.array(np.add.reduceat(np.log10(p)[gram], start))})

    return X.finish(table, replies, work,
                    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
