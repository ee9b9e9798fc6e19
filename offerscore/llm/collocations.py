"""Phrase collocation mining: phrases whose words stand together far more often than by chance.

Method: Toivonen.  A sample of the documents is mined at a lowered threshold and proposes the
set S of frequent phrases.  One pass over all documents then counts S and its negative border:
the phrases outside S whose two parts, without the last and without the first word, are
both in S (for single words: every word).  A border phrase that proves frequent is a failure
of the sample.  A phrase is never more frequent than its parts, so a frequent phrase that was
not counted contains a failure: if the failures are rare, one expansion pass counts every phrase
of frequent words around them and closes the set; if not, they join S, and passes count
the border that they add until no pass finds a new one.  The sample is mined by such passes, from nothing.

The sample is made of blocks of 64 words, drawn one by one, so that a phrase which one long text
repeats is drawn like any other.

S reaches the tasks as a bitmap of phrase hashes: 32 bits for each phrase, two of them set,
never more than 2^``max_bits`` bits (32 MB).  A bitmap can only let more phrases be counted, so
a saturated one costs shuffle, not results.  Phrases are counted by a 64-bit hash of language
and words.  With its count each hash keeps the number of one task that holds the phrase; a last
pass spells every frequent phrase in that task alone (and in all tasks, should the table be
dealt differently then).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import textops as T
from .exchange import Store
from .tokens import counted, runs, table

#: Pieces end at . , ; : ! ? and 0x0A-0x0D; words also at space and tab.
BREAK = table((0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
WORD = ~(BREAK | table((0x20, 0x20), (0x09, 0x09)))
#: Distinct phrases that a task holds before it sends their counts.
HELD = 3 << 18
#: Failures are rare if they have this share (one in ...) of all counted places at most.
RARE = 64
#: Words of a block of the sample.
BLOCK = 64
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Members:
    """A bitmap of phrase hashes: no false negatives."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words).bit_length() + 5

    def has(self, keys: np.ndarray) -> np.ndarray:
        high, low = keys >> np.uint64(64 - self.bits), keys & np.uint64((1 << self.bits) - 1)
        return self._bit(high) & self._bit(low)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bits(n: int, max_bits: int) -> int:
    return int(min(max_bits, max(12, (32 * n).bit_length())))


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """The 64-bit words of a bitmap of ``keys``; Spark sets the bits, at most 2^bits / 64 words come back."""
    places = F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))
    words = keys.select(F.explode(places).alias("at")) \
        .groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("value"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return out


def _words(langs: pa.Array, texts: pa.Array):
    """Pieces of a batch: first row, bytes, word starts and ends, their row, word hashes (of
    language and word), and whether the next word follows in the same piece."""
    if not len(texts):
        return
    codes = langs.dictionary_encode()
    names = codes.dictionary
    data, ends = T.buffers(names)
    salt = T.span_hash(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, seed=1)[codes.indices.to_numpy(zero_copy_only=False)]
    for a, b in T.slices(texts, 1 << 20):
        data, ends = T.buffers(texts.slice(a, b - a))
        data = T.lower_ascii(data)
        starts, stops, doc = runs(data, ends, WORD)
        piece = np.cumsum(BREAK[data])[starts] if len(starts) else starts
        with np.errstate(over="ignore"):
            hashes = T.mix(T.span_hash(data, starts, stops) + salt[a + doc])
        follows = np.zeros(len(starts), dtype=bool)
        follows[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        yield a, data, starts, stops, doc, hashes, follows


def _levels(hashes: np.ndarray, follows: np.ndarray, members: Members, most: int):
    """(words, places, keys, whether they are members) of the phrases whose parts are both members."""
    at, keys = np.arange(len(hashes)), hashes
    for k in range(1, most + 1):
        yield k, at, keys
        if k == most or not len(at):
            return
        known = np.zeros(len(hashes) + 1, dtype=bool)
        inside = members.has(keys)
        known[at[inside]] = True
        value = np.zeros(len(hashes), dtype=np.uint64)
        value[at] = keys
        # both parts are members, and the last word follows in the piece
        at = np.flatnonzero(known[:-1] & known[1:])
        at = at[(at + k < len(hashes))]
        at = at[follows[at + k - 1]]
        with np.errstate(over="ignore"):
            keys = T.mix(value[at] * _STEP[0] + hashes[at + k] * _STEP[1] + np.uint64(k))


def _counts(docs: DataFrame, phrases) -> DataFrame:
    """Rows (key, n, task) of the keys that ``phrases(hashes, follows)`` yields for a piece."""
    def run(batches):
        task, held, size = TaskContext.get().partitionId(), [], 0

        def merged():
            keys, n = (np.concatenate(x) for x in zip(*held))
            if not len(keys):
                return keys, n
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[at], np.add.reduceat(n, at, dtype=np.int32)

        def rows(keys, n):
            for a in range(0, len(keys), 1 << 16):
                part = keys[a:a + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[a:a + (1 << 16)]), pa.array(np.full(len(part), task, np.int32))],
                                                 names=["key", "n", "task"])
        for batch in batches:
            for *_, hashes, follows in _words(batch.column(0), batch.column(1)):
                keys, n = counted(np.concatenate([np.zeros(0, np.uint64), *phrases(hashes, follows)]))
                held.append((keys, n.astype(np.int32)))
                size += len(keys)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged())
    return docs.select("lang", "text").mapInArrow(run, "key long, n int, task int")


def border_counts(docs: DataFrame, members, before, most: int) -> DataFrame:
    """Rows (key, n, task): how often each phrase of the members and their border occurs in a task.

    With ``before`` (the members of an earlier pass) only phrases that it did not count."""
    def fresh(hashes, follows, inside, old):
        was = None
        for k, at, keys in _levels(hashes, follows, inside, most):
            if old is None:
                yield keys
                continue
            # counted before: both parts were members then (single words always were)
            seen = np.ones(len(at), dtype=bool) if k == 1 else was[at] & was[at + 1]
            yield keys[~seen]
            was = np.zeros(len(hashes) + 1, dtype=bool)
            was[at] = seen & old.has(keys)
    return _counts(docs, lambda hashes, follows: fresh(hashes, follows, members.value, before.value if before is not None else None))


def extension_counts(docs: DataFrame, members, failures, most: int) -> DataFrame:
    """Rows (key, n, task): the phrases around a failure whose words are all frequent, but for those
    that the pass over ``members`` and their border counted."""
    def fresh(hashes, follows, inside, failed):
        pad = lambda x: np.concatenate([x[1:], [False]])
        within = lambda b, keys, where: _masked(where, b.has(keys[where]))
        every = np.ones(len(hashes), dtype=bool)
        keys, listed, known, around = hashes, every, inside.has(hashes), failed.has(hashes)
        usable, valid = known | around, every
        for k in range(2, most + 1):
            with np.errstate(over="ignore"):
                last = np.concatenate([hashes[k - 1:], np.zeros(min(k - 1, len(hashes)), np.uint64)])[:len(hashes)]
                keys = T.mix(keys * _STEP[0] + last * _STEP[1] + np.uint64(k - 1))
            valid = valid & np.concatenate([follows[k - 2:], np.zeros(min(k - 2, len(hashes)), bool)])[:len(hashes)]
            listed = valid & known & pad(known)          # what the earlier pass counted
            usable = valid & usable & pad(usable)
            around = usable & (around | pad(around))
            yield keys[around & ~listed]
            known = within(inside, keys, listed)
            around = around | within(failed, keys, listed)
    return _counts(docs, lambda hashes, follows: fresh(hashes, follows, members.value, failures.value))


def _masked(where: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where), dtype=bool)
    out[where] = values
    return out


def _outside(keys: DataFrame, members) -> DataFrame:
    """The keys that are not in the bitmap."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~members.value.has(batch.column(0).to_numpy().view(np.uint64))))
    return keys.select("key").mapInArrow(run, "key long")


def frequent(store: Store, docs: DataFrame, start: DataFrame | None, least: int, most: int, max_bits: int, name: str) -> DataFrame:
    """A table (key, n, task) of all phrases that occur ``least`` times or more, whatever ``start`` proposes."""
    spark, found, before = docs.sparkSession, [], None
    n = start.count() if start is not None else 0
    words = np.zeros(1 << (_bits(n, max_bits) - 6), dtype=np.uint64) if not n else bitmap(start, _bits(n, max_bits))
    while True:
        shared = spark.sparkContext.broadcast(Members(words))
        counts = border_counts(docs, shared, before, most).groupBy("key").agg(F.sum("n").alias("n"), F.min("task").alias("task"))
        part = store.write(counts.filter(F.col("n") >= least), f"{name}{len(found)}")
        found.append(part)
        every = reduce(DataFrame.unionByName, found)
        # the failures: frequent, and not in the bitmap, so their extensions are not counted yet
        new, n = _outside(part, shared), n + part.count()
        bits = _bits(n, max_bits)
        more = bitmap(new, bits)
        if not more.any() or (start is None and len(found) == most):      # from nothing, pass k finds the phrases of k words
            return every
        if start is not None and len(found) == 1 and _rare(part, new):
            failures = spark.sparkContext.broadcast(Members(more))
            counts = extension_counts(docs, shared, failures, most).groupBy("key").agg(F.sum("n").alias("n"), F.min("task").alias("task"))
            return every.unionByName(store.write(counts.filter(F.col("n") >= least), f"{name}_around"))
        if bits == shared.value.bits:
            words = words | more
        else:
            proposed = every.select("key") if start is None else every.select("key").unionByName(start.select("key"))
            words = bitmap(proposed, bits)
        before = shared


def _rare(part: DataFrame, failures: DataFrame) -> bool:
    """Whether the places of the failures are few beside those of all counted phrases, so that counting
    what stands around them costs less than passes of one more word each."""
    n = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return RARE * n(part.join(failures, "key", "left_semi")) <= n(part)


def _sampled(rows: DataFrame, rate: float) -> DataFrame:
    """(lang, text): blocks of words, each drawn with probability ``rate``, one to a line."""
    def run(batches):
        drawn = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            names, out = batch.column(0), {}
            for first, data, starts, stops, doc, _, _ in _words(names, batch.column(1)):
                if not len(doc):
                    continue
                head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                number = np.arange(len(doc)) - np.repeat(head, np.diff(np.concatenate([head, [len(doc)]])))
                begin = np.flatnonzero(number % BLOCK == 0)
                end = np.concatenate([begin[1:], [len(doc)]]) - 1
                take = drawn.random(len(begin)) < rate
                raw = data.tobytes()
                for b, e, d in zip(starts[begin[take]].tolist(), stops[end[take]].tolist(), doc[begin[take]].tolist()):
                    out.setdefault(names[first + d].as_py(), []).append(raw[b:e])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(out), pa.string()),
                                              "text": pa.array([b"\n".join(x).decode() for x in out.values()], pa.string())})
    return rows.select("lang", "text").mapInArrow(run, "lang string, text string")


def _spelled(docs: DataFrame, members, chosen, most: int) -> DataFrame:
    """Rows (key, lang, phrase, words, n): each member, in the tasks that ``chosen`` (a bitmap of key
    and task; None: every task) has it in; and a row of key 0, no phrase and no words for the words of each language."""
    schema = "key long, lang string, phrase string, words int, n long"

    def run(batches):
        inside, task, words, known = members.value, TaskContext.get().partitionId(), {}, np.zeros(0, np.uint64)

        def batch_of(rows):
            return pa.RecordBatch.from_pydict({f: pa.array([r[k] for r in rows], t) for k, (f, t) in enumerate(
                [("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])})
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for first, data, starts, stops, doc, hashes, follows in _words(batch.column(0), batch.column(1)):
                for d, n in zip(*(x.tolist() for x in counted(doc))):
                    words[names[first + d]] = words.get(names[first + d], 0) + n
                raw = None
                for k, at, keys in _levels(hashes, follows, inside, most):
                    mine = inside.has(keys)
                    if chosen is not None:
                        mine[mine] = chosen.value.has(_with_task(keys[mine], task))
                    keys, pick = np.unique(keys[mine], return_index=True)
                    if not len(keys):
                        continue
                    where = np.searchsorted(known, keys)
                    new = np.ones(len(keys), dtype=bool)
                    inner = where < len(known)
                    new[inner] = known[where[inner]] != keys[inner]
                    raw = data.tobytes() if raw is None else raw
                    for key, p in zip(keys[new].view(np.int64).tolist(), at[mine][pick[new]].tolist()):
                        out.append((key, names[first + doc[p]], b" ".join([raw[starts[j]:stops[j]] for j in range(p, p + k)]).decode(), k, 0))
                    known = np.insert(known, where[new], keys[new]) if len(known) < HELD else keys
            if out:
                yield batch_of(out)
        yield batch_of([(0, x, None, 0, n) for x, n in words.items()])
    return docs.select("lang", "text").mapInArrow(run, schema)


def _with_task(keys: np.ndarray, task) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mix(keys + (np.asarray(task).astype(np.uint64) + np.uint64(1)) * _STEP[0])


def _chosen(found: DataFrame) -> DataFrame:
    """The key of each phrase together with its task."""
    def run(batches):
        for batch in batches:
            keys = _with_task(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])
    return found.select("key", "task").mapInArrow(run, "key long")


def phrases(docs: DataFrame, least: int = 100, most: int = 5, rate: float = 0.125, slack: float = 0.4,
            max_bits: int = 28) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of 1 to ``most`` words with ``least`` or more occurrences in a language,
    and (lang, n) with the words of each language; ``docs`` as in ``collocations``.

    A share ``rate`` of the words is the sample; there a phrase is frequent from
    ``least * rate * slack`` occurrences on.  Any sample gives the same result."""
    spark = docs.sparkSession
    store = Store(spark, "collocations")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = store.write(_sampled(rows, rate), "sample")
    proposed = frequent(store, sample, None, max(2, round(least * rate * slack)), most, max_bits, "sampled")
    found = frequent(store, rows, proposed.select("key"), least, most, max_bits, "found").groupBy("key").agg(F.max("n").alias("n"), F.min("task").alias("task"))
    found = store.write(found, "found")
    bits = _bits(found.count(), max_bits)
    inside, chosen = (spark.sparkContext.broadcast(Members(bitmap(k, bits))) for k in (found, _chosen(found)))
    spelled = store.write(_spelled(rows, inside, chosen, most), "spelled")
    totals = store.write(spelled.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    spelled = spelled.filter("words > 0").select("key", "lang", "phrase", "words")
    missing = store.write(found.join(spelled, "key", "left_anti"), "missing")      # the rows were dealt differently this time
    if missing.count():
        rest = _spelled(rows, inside, None, most).filter("words > 0").select("key", "lang", "phrase", "words")
        spelled = spelled.unionByName(rest.join(missing.select("key"), "key", "left_semi"))
    exact = found.join(spelled.dropDuplicates(["key"]), "key").select("lang", "phrase", "words", F.col("n").alias("a"))
    return store.write(exact, "phrases"), totals


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2000, rate: float = 0.125, slack: float = 0.4,
                 max_bits: int = 28, salts: int = 64) -> DataFrame:
    """The first ``top`` collocations of each language.

    ``docs`` needs text and lang; other columns are ignored.  Texts are lower-cased
    (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
    ``[^\\x20\\x09]+``.  Per language (null: ``und``) n counts the words and f the occurrences of
    a phrase within pieces, overlaps included.  Candidates have 2 to ``most`` words and
    a = f(phrase) >= ``least``.  Cut after its first k words into parts with l and r
    occurrences a candidate scores floor(1000 a n / (l r)); the lowest cut counts, the smallest
    k on ties.  A candidate inside a longer candidate with as many occurrences goes.  Products
    are decimals of 38 digits.

    Returns lang, rank (from 1; score descending, a descending, phrase ascending by UTF-8 bytes), phrase (words
    joined by one space), a, l, r, n, score.  Null and blank texts have no words;
    repeated rows count as often as they stand; an empty table gives an empty result.
    """
    known, totals = phrases(docs, least, most, rate, slack, max_bits)
    spelled = known.filter("words > 1").withColumn("part", F.split("phrase", " "))
    joined = lambda low, n: F.array_join(F.slice("part", low, n), " ")
    cuts = spelled.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))) \
        .select("lang", "phrase", "words", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
                joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = known.select("lang", F.col("phrase").alias("side"), F.col("a").alias("f"))
    cuts = cuts.join(side.withColumnRenamed("side", "left").withColumnRenamed("f", "l"), ["lang", "left"]) \
        .join(side.withColumnRenamed("side", "right").withColumnRenamed("f", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # floor of the exact quotient: the remainder is taken off before the division
    top_, bottom = F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r")
    cuts = cuts.withColumn("score", F.floor((top_ - top_ % bottom) / bottom).cast("long"))
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a longer candidate with as many occurrences: one word longer suffices, for those between have as many too
    longer = spelled.filter("words > 2").select("lang", "a", F.explode(F.array(
        joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase")).distinct()
    best = best.join(longer, ["lang", "phrase", "a"], "left_anti")
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score",
                       F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt"))
    out = _first(_first(rows, ["lang", "salt"], top).drop("rank"), ["lang"], top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
