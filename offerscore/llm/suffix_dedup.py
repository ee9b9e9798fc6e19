"""Suffix-array dedup: remove bytes covered by a 100-byte string that also starts earlier.

The suffix array is built by linear grouping: suffixes are grouped by their longest Lyndon
prefix, the groups are processed in descending order, each one refining the groups of its
members' previous smaller suffixes, and the order inside every group is then emitted in one
ascending sweep (``suffix_array``); nothing is renamed recursively.

One suffix array of a large corpus cannot be held by one task, so the corpus is cut at
anchors that only depend on content.  Every 100-byte window has one anchor, the smallest
hash of its 16-byte grams; equal windows have equal anchors at equal offsets.  Windows are
therefore compared among the occurrences of one anchor alone:

1. each chunk sends its anchors (hash, hash of the context: all windows of the anchor, and
   the earliest occurrence) to the anchor's shard.  Occurrences with the same context are
   one class; all but its earliest occurrence lose every byte of the context;
2. the earliest occurrences of anchors with several classes (where copies differ, or a
   passage ends) send the context's bytes.  Each shard builds one suffix array over its
   contexts, read right and left from the anchor.  Suffix order and common prefixes say
   which windows are equal, byte by byte; all but the earliest are removed;
3. an anchor with more than ``crowded`` classes (a line or passage edge that very many
   documents share) would be too much for one shard.  Its contexts' windows are spread by
   their own hash instead, each chunk sending one entry for each distinct window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, textops as T

GRAM = 16
#: Bytes in a symbol of the suffix array.
SYMBOL = 32
_ANCHOR_BYTES = 1 << 20
#: Classes of one anchor that a shard orders in a suffix array.
CROWDED = 1 << 14


# -- suffix array ---------------------------------------------------------------------------

def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Group suffixes by longest Lyndon prefix.  ``symbols`` ends with a unique smallest one.

    Returns each suffix's group, each suffix's previous smaller suffix (-1: none) and the
    groups from the highest to the lowest."""
    n = len(symbols)
    members: list[list[int]] = []
    size: list[int] = []
    below: list[int] = []          # linked list over groups by rank
    above: list[int] = []
    number = {c: k for k, c in enumerate(sorted(set(symbols)))}
    for k in range(len(number)):
        members.append([])
        size.append(0)
        below.append(k - 1)
        above.append(k + 1 if k + 1 < len(number) else -1)
    group = [number[c] for c in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
        size[g] += 1
    previous = [-1] * n
    high = bytearray(n)            # suffixes not below the group in hand
    order = []
    now = len(number) - 1
    while now != -1:
        mine = [i for i in members[now] if group[i] == now]
        mine.sort()
        members[now] = mine
        order.append(now)
        for i in mine:
            high[i] = 1
        times: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and high[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        # those followed by this group's prefix leave their group for one just above it,
        # the more often followed the higher
        moves: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            moves.setdefault(group[p], {}).setdefault(k, []).append(p)
        for old, by_times in moves.items():
            if len(by_times) == 1 and sum(map(len, by_times.values())) == size[old]:
                continue
            last = old
            for k in sorted(by_times):
                moved = by_times[k]
                new = len(members)
                members.append(moved)
                size.append(len(moved))
                size[old] -= len(moved)
                for p in moved:
                    group[p] = new
                up = above[last]
                below.append(last)
                above.append(up)
                above[last] = new
                if up != -1:
                    below[up] = new
                last = new
            if not size[old]:
                down, up = below[old], above[old]
                if down != -1:
                    above[down] = up
                if up != -1:
                    below[up] = down
        now = below[now]
    return group, previous, order


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of ``symbols`` (the last one smaller than all others)."""
    n = len(symbols)
    if not n:
        return []
    group, previous, order = lyndon_groups(symbols)
    count: dict[int, int] = {}
    for g in group:
        count[g] = count.get(g, 0) + 1
    start, at = {}, 0
    for g in reversed(order):
        start[g] = at
        at += count.get(g, 0)
    out = [0] * n
    out[0] = n - 1
    start[group[n - 1]] += 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


def rank_strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int = SYMBOL) -> np.ndarray:
    """Lexicographic rank of byte strings, through the suffix array of all of them:
    ``width`` bytes are a symbol, the smallest symbol ends a string."""
    n = len(starts)
    pieces = -(-lengths // width)
    first = np.cumsum(pieces) - pieces
    which = np.repeat(np.arange(n), pieces)
    piece = np.arange(pieces.sum()) - first[which]
    begin = starts[which] + piece * width
    have = np.minimum(lengths[which] - piece * width, width)
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    cells = padded[begin[:, None] + np.arange(width)]
    cells[np.arange(width) >= have[:, None]] = 0
    columns = cells.view(">u8").astype(np.uint64).T
    by = np.lexsort((have, *columns[::-1]))
    differs = np.zeros(len(by), dtype=bool)
    for column in (*columns, have):
        differs[1:] |= column[by][1:] != column[by][:-1]
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.cumsum(differs) + 2          # 0 ends the whole, 1 ends a string
    text = np.ones(len(by) + n + 1, dtype=np.int64)
    text[np.arange(len(by)) + which] = rank
    text[-1] = 0
    order = np.array(suffix_array(text.tolist()), dtype=np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[first + np.arange(n)]


# -- anchors --------------------------------------------------------------------------------

def gram_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes that start at each position."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    with np.errstate(over="ignore"):
        h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += eight[8:8 + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _anchors(payload: bytes, length: int):
    """Anchors of a chunk's documents: pieces' (ids, data, ends) and, over all pieces,
    id, start of the context in its document, offset of the anchor in it, its length,
    anchor hash, context hash, and the context's start and piece."""
    ids, texts = X.unpack_texts(payload)
    pieces, parts = [], []
    for a, b in T.slices(texts, _ANCHOR_BYTES):
        data, ends = T.buffers(texts.slice(a, b - a))
        pieces.append((ids[a:b], data, ends))
        grams = gram_hash(data)
        at, low, top = T.winnow(grams, ends, GRAM, length - GRAM + 1)
        doc = np.searchsorted(ends, at, side="right")
        start = np.concatenate([[0], ends])[doc]
        context = T.span_hash(data, low, top + length, 1)
        parts.append((ids[a:b][doc], low - start, at - low, top - low + length,
                      T.mix(grams[at]) if len(at) else np.zeros(0, np.uint64), context, low,
                      np.full(len(at), len(pieces) - 1)))
    return pieces, [np.concatenate(c) for c in zip(*parts)] if parts else None


def _classes(columns, n_shards: int):
    """Distinct (anchor, context) of a chunk: its number for every anchor, and for each one
    anchor hash, context hash, shard, row of the earliest occurrence."""
    ids, pos, _, _, anchor, context = columns[:6]
    order = np.lexsort((pos, ids, context, anchor))
    a, c = anchor[order], context[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]) if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, a[new], c[new], X.shard_of(a[new], n_shards), order[new]


def _reply_classes(payloads, crowded: int):
    """For every class a chunk asked for: 1 if its earliest occurrence is in that chunk
    (by value), plus 2 if the anchor has several classes, plus 4 if it has over ``crowded``."""
    got = [X.unpack(p) for p in payloads]
    anchor, context, ids, pos = (np.concatenate([g[k] for g in got]) for k in ("anchor_d", "context", "id", "pos"))
    order = np.lexsort((pos, ids, context, anchor))
    a, c = anchor[order], context[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_a | np.concatenate([[True], c[1:] != c[:-1]])
    head = order[new][np.cumsum(new) - 1]
    classes = np.bincount(np.cumsum(new_a) - 1, weights=new)[np.cumsum(new_a) - 1]
    code = np.empty(len(order), dtype=np.uint8)
    code[order] = ((ids[order] == ids[head]) & (pos[order] == pos[head])) + 2 * (classes > 1).astype(np.uint8) \
        + 4 * (classes > crowded).astype(np.uint8)
    cut = np.cumsum([0] + [len(g["id"]) for g in got])
    return [X.pack(code=code[i:j]) for i, j in zip(cut, cut[1:])]


def _codes(replies: dict, shard: np.ndarray, n_shards: int) -> np.ndarray:
    code = np.zeros(len(shard), dtype=np.uint8)
    for s, at in X.split(shard, n_shards):
        code[at] = X.unpack(replies[s])["code"]
    return code


def _spread(pieces, columns, rows: np.ndarray, length: int, n_shards: int):
    """The windows of the contexts in ``rows``, distinct by content: for each window its row,
    start in its piece and key number; for each key two hashes, the earliest (id, position)
    in the chunk and the shard."""
    ids, pos, offset, size, anchor, _, low, piece = (c[rows] for c in columns)
    n = size - length + 1
    of = np.repeat(np.arange(len(rows)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, h, second = low[of] + step, np.empty(len(of), dtype=np.uint64), np.empty(len(of), dtype=np.uint64)
    for k in np.unique(piece):
        mine = np.flatnonzero(piece[of] == k)
        h[mine], second[mine] = (T.span_hash(pieces[k][1], start[mine], start[mine] + length, seed) for seed in (0, 1))
    with np.errstate(over="ignore"):
        second ^= T.mix(anchor[of] + (offset[of] - step).astype(np.uint64))      # the anchor and its place in the window
    ids, at = ids[of], pos[of] + step
    order = np.lexsort((at, ids, second, h))
    a, b = h[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return rows[of], start, ids, at, number, h[first], second[first], ids[first], at[first], X.shard_of(h[first], n_shards)


def _reply_spread(payloads):
    """For every window a chunk asked for: whether it starts earlier elsewhere."""
    got = [X.unpack(p) for p in payloads]
    h, second, ids, pos = (np.concatenate([g[k] for g in got]) for k in ("h_d", "second", "id", "pos"))
    order = np.lexsort((pos, ids, second, h))
    a, b = h[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    head = order[new][np.cumsum(new) - 1]
    later = np.empty(len(order), dtype=bool)
    later[order] = (ids[order] != ids[head]) | (pos[order] != pos[head])
    cut = np.cumsum([0] + [len(g["id"]) for g in got])
    return [X.pack(later=np.packbits(later[i:j])) for i, j in zip(cut, cut[1:])]


def repeated_windows(data, starts, offset, size, group, ids, pos, length: int) -> np.ndarray:
    """For contexts that share anchors: which windows also start earlier.

    Context k is ``data[starts[k]:starts[k] + size[k]]`` with its anchor at ``offset[k]``; it
    begins at ``pos[k]`` of document ``ids[k]``.  Returns a matrix (context, bytes before
    the anchor at which the window starts)."""
    n = len(starts)
    most = length - GRAM + 1
    # from the anchor to the right, and from it to the left
    reach = int(size.max()) + 1
    padded = np.concatenate([data, np.zeros(reach, np.uint8)])
    back = padded[::-1]
    right_len, left_len = size - offset, offset
    both = np.concatenate([padded, back])
    right_at = starts + offset
    left_at = len(padded) + len(padded) - (starts + offset)
    rank = rank_strings(both, np.concatenate([right_at, left_at]), np.concatenate([right_len, left_len]))
    sides = []
    for ranks, at, lengths, wide in ((rank[:n], right_at, right_len, length), (rank[n:], left_at, left_len, most)):
        order = np.lexsort((ranks, group))
        cells = both[np.minimum(at[order, None] + np.arange(wide), len(both) - 1)]
        differs = cells[1:] != cells[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
        common = np.minimum(common, np.minimum(lengths[order][1:], lengths[order][:-1]))
        common = np.concatenate([[-1], np.where(group[order][1:] != group[order][:-1], -1, common)])
        sides.append((order, common))
    by_time = np.lexsort((pos, ids))
    later = np.concatenate([[False], (ids[by_time][1:] != ids[by_time][:-1]) | (pos[by_time][1:] != pos[by_time][:-1])])
    time = np.empty(n, dtype=np.int64)
    time[by_time] = np.cumsum(later)
    out = np.zeros((n, most), dtype=bool)
    shortest = offset - (size - length)
    for d in range(most):
        use = np.flatnonzero((shortest <= d) & (d <= offset))
        if len(use) < 2:
            continue
        key = np.zeros(n, dtype=np.int64)
        for (order, common), need in zip(sides, (length - d, d)):
            kind = np.empty(n, dtype=np.int64)
            kind[order] = np.cumsum(common < need)
            key = key * (n + 1) + kind
        # the same window starts at pos + offset - d; contexts of one anchor compare by it
        moment = time[use]
        order = np.lexsort((moment, key[use]))
        k, t = key[use][order], moment[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        out[use[order], d] = t > t[new][np.cumsum(new) - 1]
    return out


def _reply_windows(payloads, length: int):
    got = [X.unpack(p) for p in payloads]
    cat = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
    # documents' order is that of the window's start; the context's start serves as well,
    # as it lies as far before the anchor's window in each context of one offset
    size, offset = cat["size"].astype(np.int64), cat["offset"].astype(np.int64)
    starts = np.cumsum(size) - size
    hit = repeated_windows(cat["data"], starts, offset, size, cat["anchor"], cat["id"],
                           cat["pos"] + offset, length)
    cut = np.cumsum([0] + [len(g["row"]) for g in got])
    out = []
    for i, j in zip(cut, cut[1:]):
        # runs of window starts, from the left end of the context
        mine = np.zeros((j - i, hit.shape[1] + 2), dtype=np.int8)
        mine[:, 1:-1] = hit[i:j, ::-1]
        steps = np.diff(mine, axis=1)
        row, first = np.nonzero(steps == 1)
        _, after = np.nonzero(steps == -1)
        shift = offset[i:j][row] - (hit.shape[1] - 1)
        out.append(X.pack(row=cat["row"][i:j][row], first=(first + shift).astype(np.int32), last=(after - 1 + shift).astype(np.int32)) if len(row) else None)
    return out


def dedup(docs: DataFrame, length: int = 100, with_text: bool = True, carry: tuple[str, ...] = (), crowded: int = CROWDED) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier: in a
    document with a smaller ``doc_id``, or earlier in the same one.  Overlaps count, matches
    never cross documents, and strings are judged on the input.

    ``docs`` needs doc_id and text; of the other columns, those in ``carry`` are returned as
    they are.  Returns, one row for each input row: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 of the remaining bytes, kept (those bytes) and
    kept_text (the characters of which some byte remains), both null without ``with_text``,
    and the carried columns.  A null text is empty; a null id counts as larger
    than all others; rows with one id are compared by position, and equal positions do not
    remove each other.  Texts shorter than ``length`` lose nothing; an empty table gives an
    empty result.
    """
    store = X.Store(docs.sparkSession, "suffix")
    table, n_bytes = X.chunks(store, docs, X.pack_texts, carry)
    n_shards = X.shards_for(n_bytes)

    def request(payload):
        _, columns = _anchors(payload, length)
        if columns is None or not len(columns[0]):
            return
        _, anchor, context, shard, head = _classes(columns, n_shards)
        for s, at in X.split(shard, n_shards):
            yield s, X.pack(anchor_d=anchor[at], context=context[at], id=columns[0][head[at]], pos=columns[1][head[at]].astype(np.int64))

    def contexts(payload, replies, chunk):
        pieces, columns = _anchors(payload, length)
        rows = []
        if columns is not None and len(columns[0]):
            ids, pos, offset, size, anchor, _, low, piece = columns
            _, _, _, shard, head = _classes(columns, n_shards)
            code = _codes(replies, shard, n_shards)
            open_ = np.sort(head[code == 3])
            for s, at in X.split(X.shard_of(anchor[open_], n_shards), n_shards):
                row = open_[at]
                data = np.concatenate([pieces[p][1][i:i + n] for p, i, n in zip(piece[row].tolist(), low[row].tolist(), size[row].tolist())])
                rows.append((n_shards + s, chunk, X.pack(anchor=anchor[row], id=ids[row], pos=pos[row], offset=offset[row].astype(np.int16),
                                                         size=size[row].astype(np.int16), row=row.astype(np.int32), data=data)))
            *_, h, second, first_id, first_at, target = _spread(pieces, columns, np.sort(head[code == 7]), length, n_shards)
            for s, at in X.split(target, n_shards):
                rows.append((2 * n_shards + s, chunk, X.pack(h_d=h[at], second=second[at], id=first_id[at], pos=first_at[at].astype(np.int64))))
        return X.messages(rows)

    def settle(payloads, shard):
        return _reply_spread(payloads) if shard >= 2 * n_shards else _reply_windows(payloads, length)

    def work(payload, replies, chunk):
        pieces, columns = _anchors(payload, length)
        steps = [np.zeros(len(data) + 1, dtype=np.int32) for _, data, _ in pieces]
        if columns is not None and len(columns[0]):
            ids, pos, _, size, _, _, low, piece = columns
            number, _, _, shard, head = _classes(columns, n_shards)
            code = _codes(replies, shard, n_shards)
            mine = (code & 1).astype(bool)
            first = head[number]
            gone = ~mine[number] | (ids != ids[first]) | (pos != pos[first])
            begin, stop, where = [low[gone]], [(low + size)[gone]], [piece[gone]]
            row, start, id_, at_, key, _, _, first_id, first_at, target = _spread(pieces, columns, np.sort(head[code == 7]), length, n_shards)
            later = np.zeros(len(target), dtype=bool)
            for s, at in X.split(target, n_shards):
                later[at] = np.unpackbits(X.unpack(replies[2 * n_shards + s])["later"], count=len(at)).astype(bool)
            hit = later[key] | (id_ != first_id[key]) | (at_ != first_at[key])
            begin.append(start[hit])
            stop.append(start[hit] + length)
            where.append(piece[row[hit]])
            for s, data in replies.items():
                if n_shards <= s < 2 * n_shards:
                    got = X.unpack(data)
                    begin.append(low[got["row"]] + got["first"])
                    stop.append(low[got["row"]] + got["last"] + length)
                    where.append(piece[got["row"]])
            begin, stop, where = map(np.concatenate, (begin, stop, where))
            for k in range(len(pieces)):
                np.add.at(steps[k], begin[where == k], 1)
                np.add.at(steps[k], stop[where == k], -1)
        out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")}
        for (ids, data, ends), step in zip(pieces, steps):
            removed = np.cumsum(step[:-1]) > 0
            start = 0
            for doc, end in zip(ids.tolist(), ends.tolist()):
                mask, text = removed[start:end], data[start:end]
                n = int(mask.sum())
                kept = text[~mask].tobytes() if n else text.tobytes()
                out["doc_id"].append(None if doc == X.NO_ID else doc)
                out["n_bytes"].append(end - start)
                out["n_removed"].append(n)
                out["n_spans"].append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text and n:
                    lead = np.flatnonzero((text & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(mask, lead)      # a character goes when all its bytes do
                    out["kept_text"].append(text[~np.repeat(whole, np.diff(np.concatenate([lead, [len(text)]])))].tobytes())
                else:
                    out["kept_text"].append(kept if with_text else None)
                out["kept"].append(kept if with_text else None)
                start = end
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(),
                 "kept": pa.binary(), "kept_text": pa.binary()}
        rows = X.unpack_batch(payload) if carry else None
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()} | {f"carried_{k}": rows.column(k + 2) for k in range(len(carry))})

    first = store.write(X.answer(X.ask(table, request), lambda payloads, _: _reply_classes(payloads, crowded)), "classes")
    asked = X.finish(table, first, contexts, X.MESSAGE)
    second = store.write(X.answer(asked, settle), "windows")
    out = X.finish(table, first.unionByName(second), work,
                   "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text binary"
                   + "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)))
    own = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", F.decode("kept_text", "UTF-8").alias("kept_text")]
    return out.select(*own, *[F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)])
