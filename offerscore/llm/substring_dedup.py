"""Substring dedup: remove words of passages that an earlier document also has.

Method: count-min prefilter.  Every map partition builds a count-min sketch of its window
hashes (counts saturate at 2); the sketches are merged by Spark.  A merged count is never
below the true one, so a window estimated to occur once does occur once and is skipped.
The second pass exactly groups only the windows estimated repeated.

The merged sketch is all that is broadcast: ``rows * 2**bits`` bits, with ``bits`` chosen
from the number of windows and bounded by ``max_bits`` (default 2**29 counters in a row,
64 MB).  Beyond that bound the sketch lets more windows through; the second pass is exact,
so results do not change, only its shuffle grows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, textops as T

ROWS = 2
_BLOCKS = 64
#: Text bytes that are hashed together (their hashes take some thirty times as much while they are made).
PIECE = 256 << 10


def _windows(payload: bytes, size: int):
    """Pieces of a chunk: (document ids, data, word starts, word ends, words before each
    text's end, window starts, window hash, second hash)."""
    ids, texts = X.unpack_texts(payload)
    for a, b in T.slices(texts, PIECE):
        data, ends = T.buffers(texts.slice(a, b - a))
        starts, stops, upto = T.word_spans(data, ends)
        words = T.span_hash(data, starts, stops)
        first = np.concatenate([[0], upto[:-1]])
        n = np.maximum(upto - first - size + 1, 0)
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        if len(at):
            h1, h2 = T.window_hash(words, size)[at], T.window_hash(words, size, 100)[at]
        else:
            h1 = h2 = np.zeros(0, np.uint64)
        yield ids[a:b], data, starts, stops, upto, at, h1, h2, np.repeat(np.arange(b - a), n)


def _coordinate(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Counter of each hash in a sketch row."""
    with np.errstate(over="ignore"):
        mixed = hashes if row == 0 else T.mix(hashes + np.uint64(0x632BE59BD9B4E019 * row & (1 << 64) - 1))
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _capped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether each occurs at least twice."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, bool)
    new = np.concatenate([[True], values[1:] != values[:-1]])
    return values[new], ~np.append(new[1:], True)[new]


def sketch(table: DataFrame, size: int, bits: int, rows: int = ROWS) -> np.ndarray:
    """The merged count-min sketch as bits "estimated at least 2" (rows x 2**bits / 8 bytes)."""
    block_bits = bits - 6

    def partial(group: pa.Table) -> pa.Table:
        hashes = [np.concatenate([w[6] for w in _windows(p, size)] or [np.zeros(0, np.uint64)]) for p in group["payload"].to_pylist()]
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        out = []
        for row in range(rows):
            value, twice = _capped(_coordinate(hashes, row, bits))
            cut = np.searchsorted(value, np.arange(_BLOCKS + 1) << block_bits)
            for b in np.flatnonzero(np.diff(cut)):
                part = slice(cut[b], cut[b + 1])
                out.append((int(row * _BLOCKS + b), 0, X.pack(at_d=(value[part] - (b << block_bits)).astype(np.uint32),
                                                             twice=np.packbits(twice[part]))))
        return X.messages(out)

    def merge(group: pa.Table) -> pa.Table:
        counts = np.zeros(1 << block_bits, dtype=np.uint8)
        for payload in group["payload"].to_pylist():
            got = X.unpack(payload)
            at = got["at_d"]
            counts[at] = np.minimum(counts[at] + 1 + np.unpackbits(got["twice"], count=len(at)), 2)
        return X.messages([(group["shard"][0].as_py(), 0, zstandard.ZstdCompressor().compress(np.packbits(counts == 2).tobytes()))])

    parts = table.select("chunk_id", "payload").groupBy("chunk_id").applyInArrow(partial, X.MESSAGE)
    merged = np.zeros((rows * _BLOCKS, (1 << block_bits) // 8), dtype=np.uint8)
    for row in parts.groupBy("shard").applyInArrow(merge, X.MESSAGE).toLocalIterator():   # bounded by the sketch's size
        merged[row["shard"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"]), np.uint8)
    return merged.reshape(rows, -1)


def _repeated(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch estimates each hash to occur at least twice."""
    keep = np.ones(len(hashes), dtype=bool)
    for row in range(len(bitmap)):
        at = _coordinate(hashes, row, bits)
        keep &= (bitmap[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


def _candidates(payload: bytes, size: int, bitmap: np.ndarray, bits: int):
    """Windows that the sketch estimates repeated, as lists with an entry for each piece: window starts,
    hash, second hash, document id.  Only they are held beyond their piece of the chunk."""
    out = [], [], [], []
    for ids, *_, at, h1, h2, doc in _windows(payload, size):
        keep = _repeated(h1, bitmap, bits)
        for column, values in zip(out, (at[keep].astype(np.int32), h1[keep], (h2[keep] >> np.uint64(32)).astype(np.uint32), ids[doc[keep]])):
            column.append(values)
    return out


def _joined(parts: list) -> np.ndarray:
    """The parts as one array; the list is emptied, so that they are not held twice."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _sorted_keys(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray):
    """Order by key and id, the keys in that order, and whether each is the first of its key."""
    order = np.lexsort((ids, h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(order) else np.zeros(0, bool)
    return order, h1, h2, new


def _keys(h1: list, h2: list, ids: list, n_shards: int):
    """Distinct candidate windows of a chunk: the number of each window's key, then per key its
    hash, second hash, smallest id and shard.  Empties the lists of hashes."""
    ids = np.concatenate(ids)
    order, a, b, new = _sorted_keys(_joined(h1), _joined(h2), ids)
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    least = ids[order[new]]
    a, b = a[new], b[new]
    return number, a, b, least, X.shard_of(a, n_shards)   # keys are sorted, so shards are too


def dedup(docs: DataFrame, size: int = 13, max_bits: int = 29, rows: int = ROWS,
          sketch_bits: int | None = None, with_text: bool = True) -> DataFrame:
    """Remove each word covered by a ``size``-word window whose word sequence also starts in
    a document with a smaller ``doc_id``; windows are judged on the input.

    ``docs`` needs doc_id and text; other columns are ignored.  Returns doc_id, n_words,
    n_removed, kept_text (kept words joined by one space; null without ``with_text``),
    kept_sha256, one row for each input row.  A null text has no words.  A null id counts as larger than all others.
    Rows with the same id do not remove from each other; texts shorter than a window lose
    nothing.  An empty table gives an empty result.
    """
    store = X.Store(docs.sparkSession, "substring")
    table, n_bytes = X.chunks(store, docs, X.pack_texts)
    # about one window per six or seven bytes; two counters for each in a row
    bits = sketch_bits or int(min(max_bits, max(12, int(n_bytes / 3).bit_length() - 1)))
    spread = docs.sparkSession.sparkContext.broadcast(sketch(table, size, bits, rows))
    n_shards = X.shards_for(n_bytes)

    def request(payload):
        _, h1, h2, ids = _candidates(payload, size, spread.value, bits)
        if not ids:
            return
        _, a, b, least, shard = _keys(h1, h2, ids, n_shards)
        for s, at in X.split(shard, n_shards):
            yield s, X.pack(h1_d=a[at], h2=b[at], least_d=least[at])

    def reply(payloads, _):
        got = [X.unpack(p) for p in payloads]
        cut = np.cumsum([0] + [len(g["h1_d"]) for g in got])
        h1, h2, least = (_joined([g.pop(c) for g in got]) for c in ("h1_d", "h2", "least_d"))
        order, _, _, new = _sorted_keys(h1, h2, least)
        lowest = np.empty(len(order), dtype=np.int64)
        lowest[order] = least[order[new]][np.cumsum(new, dtype=np.int32) - 1]
        return [X.pack(lowest_d=lowest[i:j]) for i, j in zip(cut, cut[1:])]

    def work(payload, replies, chunk):
        windows, h1, h2, owners = _candidates(payload, size, spread.value, bits)
        out, done = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")}, 0
        if windows:
            number, a, _, _, shard = _keys(h1, h2, owners, n_shards)
            lowest = np.empty(len(a), dtype=np.int64)
            for s, at in X.split(shard, n_shards):
                lowest[at] = X.unpack(replies[s])["lowest_d"]
        every, texts = X.unpack_texts(payload)
        for (i, j), at, own in zip(T.slices(texts, PIECE), windows, owners):
            ids = every[i:j]
            data, ends = T.buffers(texts.slice(i, j - i))
            starts, stops, upto = T.word_spans(data, ends)
            repeat = lowest[number[done:done + len(at)]] < own
            done += len(at)
            gone = T.covered(at[repeat], size, len(starts))
            raw, first = data.tobytes(), 0
            for k, end in enumerate(upto.tolist()):
                mask = gone[first:end]
                removed = int(mask.sum())
                s, e = (starts[first:end], stops[first:end]) if not removed else (starts[first:end][~mask], stops[first:end][~mask])
                kept = b" ".join([raw[i:j] for i, j in zip(s.tolist(), e.tolist())])
                out["doc_id"].append(None if ids[k] == X.NO_ID else int(ids[k]))
                out["n_words"].append(end - first)
                out["n_removed"].append(removed)
                out["kept_text"].append(kept if with_text else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                first = end
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.binary(), "kept_sha256": pa.string()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    replies = X.answer(X.ask(table, request), reply)     # shuffled to the chunks, not stored: nothing else reads them
    out = X.finish(table, replies, work, "doc_id long, n_words long, n_removed long, kept_text binary, kept_sha256 string")
    return out.withColumn("kept_text", F.decode("kept_text", "UTF-8"))
