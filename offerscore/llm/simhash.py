"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

Method: pigeonhole blocks.  A 64-bit fingerprint is split into ``bits + 3`` blocks; two
fingerprints that differ in at most ``bits`` bits agree on at least three whole blocks.
Fingerprints are grouped on every choice of three blocks and verified by Hamming distance.
Only distinct fingerprints are compared, so exact copies cost nothing; a group of many near
copies only gives the edges of a spanning forest, not its pairs; and a block that very many
fingerprints share is split by finer blocks of the bits it leaves open.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .exchange import Store
from .graph import components as connected

#: Groups up to this size are compared by neighbours in sorted order, larger ones by search.
SMALL = 24
#: Fingerprints of one block that a task compares; a more crowded block is split by finer ones.
MOST = 1 << 14


def fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprint of each text: bit set if it is set in over half the XXH64 values of its
    ``shingle``-word shingles (repeats included; fewer words: all of them; none: zero)."""
    out = []
    for a, b in T.slices(texts, 1 << 20):
        data, ends = T.buffers(texts.slice(a, b - a))
        data = T.lower_ascii(data)
        starts, stops, upto = T.word_spans(data, ends)
        # words and one space after each, back to back
        keep = ~T.SPACE[data]
        before = np.concatenate([[0], np.cumsum(keep)])
        n = np.arange(len(starts))
        flat = np.full(int(before[-1]) + len(starts), 32, dtype=np.uint8)
        word_of = np.repeat(n, stops - starts)
        flat[np.arange(int(before[-1])) + word_of] = data[keep]
        left, right = before[starts] + n, before[stops] + n
        count = np.diff(np.concatenate([[0], upto]))
        grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        first = np.repeat(upto - count, grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        last = np.minimum(first + shingle, np.repeat(upto, grams)) - 1
        raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
        h = np.array([digest(raw[i:j], seed) for i, j in zip(left[first].tolist(), right[last].tolist())], dtype=np.uint64)
        values = np.zeros(b - a, dtype=np.uint64)
        some = np.flatnonzero(grams)
        if len(some):
            heads = (np.cumsum(grams) - grams)[some]
            for lo in range(0, len(some), 4096):          # bounded: 64 counters a text
                part = some[lo:lo + 4096]
                begin, end = heads[lo], int((np.cumsum(grams))[part[-1]])
                bits = np.unpackbits(h[begin:end].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, heads[lo:lo + 4096] - begin, axis=0, dtype=np.int64)
                values[part] = np.packbits(2 * ones > grams[part][:, None], axis=1).view(">u8").ravel()
        out.append(values)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(bits: int, agree: int = 3) -> list[int]:
    """64-bit masks of every choice of ``agree`` blocks out of ``bits + agree``."""
    n = bits + agree
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(n)]
    return [sum(blocks[k] for k in chosen) for chosen in combinations(range(n), agree)]


def _finer(mask: int, bits: int) -> list[int]:
    """``mask`` with each of ``bits + 1`` blocks of its other positions: fingerprints that agree
    on ``mask`` and differ in at most ``bits`` bits agree on one of these as well."""
    free = [k for k in range(64) if not mask >> k & 1]
    n = bits + 1
    cuts = [len(free) * k // n for k in range(n + 1)]
    return [mask | sum(1 << k for k in free[cuts[i]:cuts[i + 1]]) for i in range(n)]


def _group_links(values: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of one group's links: from each reached fingerprint to all
    that are not reached yet, so a dense group is done after a few steps."""
    out, left = [], values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                out.append((np.full(len(found), x, dtype=np.uint64), found))
                queue.extend(found)
                left = left[~near]
    return out


def _links(keys: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints with equal keys (sorted)."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(cuts)
    small = np.repeat(size <= SMALL, size)
    pairs = []
    for d in range(1, min(SMALL, len(keys))):
        at = np.flatnonzero(small[d:] & (keys[d:] == keys[:-d]))
        if not len(at):
            break
        near = at[np.bitwise_count(values[at] ^ values[at + d]) <= bits]
        pairs.append((values[near], values[near + d]))
    for g in np.flatnonzero(size > SMALL):
        pairs += _group_links(values[cuts[g]:cuts[g + 1]], bits)
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*pairs))


def links(store: Store, distinct: DataFrame, bits: int = 4, most: int = MOST) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) at most ``bits`` apart, enough
    to connect all that are linked.

    A block that more than ``most`` fingerprints share is not compared by one task: they are
    keyed again on finer blocks (``_finer``), until each group is small.  A group whose mask
    leaves ``r`` bits has at most ``2**r`` members, so this ends."""
    def search(batches):
        held_k, held_v, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def edges(k, v):
            u, w = _links(k, v, bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(w.view(np.int64)), pa.nulls(len(u), pa.int32())], names=["u", "v", "mask"])

        def passed_on(k, v):
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.nulls(len(v), pa.int64()), pa.array((k & 0xFFFFF).astype(np.int32))],
                                              names=["u", "v", "mask"])
        for batch in batches:           # sorted by key; a group may go on in the next batch
            if not batch.num_rows:
                continue
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            v = np.concatenate([held_v, batch.column(1).to_numpy().view(np.uint64)])
            cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            large = (np.diff(cuts) > most) | (k[cuts[:-1]] == crowded if crowded is not None else False)
            if large.any():
                out = np.repeat(large, np.diff(cuts))
                crowded = k[-1] if large[-1] else None
                yield passed_on(k[out], v[out])
                k, v = k[~out], v[~out]
            if not len(k):
                held_k, held_v = k, v
                continue
            cut = len(k) if large[-1] else int(np.searchsorted(k, k[-1]))
            if cut:
                yield edges(k[:cut], v[:cut])
            held_k, held_v = k[cut:], v[cut:]
        if len(held_k):
            yield edges(held_k, held_v)

    masks, todo, found, level = _masks(bits), distinct.select("fp", F.lit(None).cast("int").alias("mask")), None, 0
    blocks = F.array(*[_block(n, m) for n, m in enumerate(masks)])
    while True:
        keyed = todo.select(F.explode(blocks).alias("k"), "fp")
        if level:
            keyed = keyed.distinct()            # finer masks of two masks can be the same
        out = store.write(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(search, "u long, v long, mask int"), f"links{level}")
        part = out.filter("v is not null").select("u", "v")
        found = part if found is None else found.unionByName(part)
        todo = out.filter("v is null").select(F.col("u").alias("fp"), "mask")
        used = sorted(r["mask"] for r in todo.select("mask").distinct().collect())      # masks, not keys: a short list
        if not used:
            return found.distinct()
        finer = {n: _finer(masks[n], bits) for n in used}
        masks = sorted({m for ms in finer.values() for m in ms})
        number = {m: n for n, m in enumerate(masks)}
        of = F.create_map(*[x for n in used for x in (F.lit(n), F.array(*[F.struct(F.lit(number[m]).alias("n"), F.lit(_signed(m)).alias("m"))
                                                                         for m in finer[n]]))])
        blocks = F.transform(F.element_at(of, F.col("mask")), lambda x: _block(x["n"], x["m"]))
        level += 1


def _block(number, mask):
    """Key of a fingerprint's bits under a mask: a hash, with the mask's number in the low 20 bits."""
    if isinstance(number, int):
        number, mask = F.lit(number), F.lit(_signed(mask))
    return F.shiftleft(F.xxhash64(number, F.col("fp").bitwiseAND(mask)), 20).bitwiseOR(number.cast("long"))


def _keys() -> list:
    """Columns that tell documents apart, without nulls: id (last if missing) and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("row_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key")]


def _labelled(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """doc_id, row_id, text_key, fp, root (a fingerprint that names the component), component_id."""
    def run(batches):
        for batch in batches:
            fp = pa.array(fingerprints(batch.column(3), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), fp], names=["doc_id", "row_id", "text_key", "fp"])
    store = Store(docs.sparkSession, "simhash")
    rows = docs.select(F.col("doc_id").cast("long"), *_keys(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = store.write(rows.mapInArrow(run, "doc_id long, row_id long, text_key long, fp long"), "fingerprints")
    distinct = store.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(store, links(store, distinct.select("fp"), bits))
    of = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(store.write(of.join(smallest, "root").select("fp", "root", "component_id"), "labels"), "fp")


def components(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """Near-duplicate components of documents.

    ``docs`` needs doc_id and text; other columns are ignored.  Texts are lower-cased (A-Z),
    words are ``[^\\x20\\x09-\\x0D]+``.  Returns one row per input row: doc_id, fingerprint (16
    hex digits) and component_id, the smallest doc_id reachable over links of at most
    ``bits`` differing bits, its own included.  A null or blank text has fingerprint zero
    and is linked like any other.  A null id takes the smallest id of its component, or
    null if that has none.  An empty table gives an empty result.
    """
    return _labelled(docs, shingle, bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row (all columns) of ``docs`` from each component: the one with the smallest doc_id
    (a missing one last; equal ones by their text), repeated rows once."""
    first = _labelled(docs, shingle, bits).groupBy("root").agg(F.min(F.struct("row_id", "text_key")).alias("first")).select("first.*")
    keyed = docs.select(F.struct("*").alias("row"), *_keys())
    return keyed.join(first, ["row_id", "text_key"], "left_semi").dropDuplicates(["row_id", "text_key"]).select("row.*")
