"""Ranked lexical search: the documents that match each item best.

Method: reversed search.  The items are the index and the documents are the queries: an
inverted index over the items' terms is broadcast, each document's term counts stream
through it once, and every task keeps one heap of bounded size for each item.  The heaps are
merged in two steps (by task group, then by item), so that no task sees more than a few
rows for each item and task.

What is broadcast has a fixed bound: at most ``block_bytes`` of item texts make one index; more
items go block by block, each with its own two scans of the documents.  The first scan counts
documents, terms and the documents that hold each term of the block, the second one scores.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import textops as T
from .tokens import counted, runs, table

#: Bytes of terms: digits, letters and everything beyond ASCII.
TERM = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Scores held at once in a task (documents x items).
CELLS = 1 << 21
#: Task groups whose heaps are merged first.
GROUPS = 64


def _terms(texts: pa.Array):
    """Pieces of a column: first row, rows, term hashes, their row within the piece."""
    for a, b in T.slices(texts, 1 << 20):
        data, ends = T.buffers(texts.slice(a, b - a))
        starts, stops, doc = runs(data, ends, TERM)
        yield a, b - a, T.span_hash(T.lower_ascii(data), starts, stops), doc


class Index:
    """Inverted index of a block of items: sorted term hashes, and the items of each term."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        found = [(h, a + doc) for a, _, h, doc in _terms(pa.array([t for _, t in items], pa.string()))]
        h = np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)])
        item = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
        order = np.lexsort((item, h))
        h, item = h[order], item[order]
        once = np.ones(len(h), dtype=bool)
        once[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])      # an item's terms count once each
        h, self.items = h[once], item[once]
        self.terms, n = counted(h)
        self.begin = np.concatenate([[0], np.cumsum(n)])
        self.most = int(np.bincount(self.items).max()) if len(self.items) else 0

    def matches(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of the index's terms among a piece's terms."""
        if not len(self.terms) or not len(hashes):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = self.terms[at] == hashes
        pair, tf = counted(doc[hit] * len(self.terms) + at[hit])
        return pair // len(self.terms), pair % len(self.terms), tf


class Heaps:
    """The ``top`` best documents of each item, updated document by document.

    A document stands as (score, -doc_id), so that of equal scores the smaller id wins; a
    missing id loses to all."""

    def __init__(self, n: int, top: int):
        self.heaps, self.top = [[] for _ in range(n)], top
        self.least = np.ones(n, dtype=np.int64)         # a score below this cannot enter

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores``: documents x items."""
        least = self.least
        if len(scores) > self.top:
            least = np.maximum(least, np.partition(scores, len(scores) - self.top, axis=0)[-self.top])
        for d, i in np.argwhere(scores >= least).tolist():
            entry = (int(scores[d, i]), -math.inf if ids[d] is None else -ids[d])
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]


def _blocks(items: DataFrame, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text; equal rows are one item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .filter("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        mine = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in mine.toLocalIterator()]


def _counts(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and the documents that hold each term of the index."""
    def count(batches):
        index, n, total = shared.value, 0, 0
        df = np.zeros(len(index.terms), dtype=np.int64)
        for batch in batches:
            for _, rows, hashes, doc in _terms(batch.column(1)):
                n += int((np.bincount(doc, minlength=rows) > 0).sum())
                total += len(hashes)
                df += np.bincount(index.matches(hashes, doc)[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[n, total], df[at]]))],
                                         names=["term", "n"])
    df = np.zeros(len(shared.value.terms) + 2, dtype=np.int64)
    for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():   # the block's terms
        df[r["term"]] = r["n"]
    return int(df[-2]), int(df[-1]), df[:-2]


def _heaps(docs: DataFrame, shared, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best documents of every item in each task."""
    def rank(batches):
        index = shared.value
        wide, heaps = len(index.ids), Heaps(len(index.ids), top)
        # sums of whole numbers below 2^53 are exact in doubles
        exact = float(weight.max(initial=0)) * 1e6 * index.most < 2 ** 53
        for batch in batches:
            for first, rows, hashes, doc in _terms(batch.column(1)):
                length = np.array([10 + 90 * n * n_docs // n_terms for n in np.bincount(doc, minlength=rows).tolist()], dtype=np.int64)
                d, t, tf = index.matches(hashes, doc)
                gain = weight[t] * (1_000_000_000 * tf // (1000 * tf + 8 * length[d]))
                step = max(1, CELLS // max(1, wide))
                for low in range(0, rows, step):
                    a, b = np.searchsorted(d, [low, low + step])
                    if a == b:
                        continue
                    n = index.begin[t[a:b] + 1] - index.begin[t[a:b]]
                    post = np.repeat(index.begin[t[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    cell = np.repeat((d[a:b] - low) * wide, n) + index.items[post]
                    size = min(step, rows - low) * wide
                    if exact:
                        scores = np.bincount(cell, weights=np.repeat(gain[a:b], n), minlength=size).astype(np.int64)
                    else:
                        scores = np.zeros(size, dtype=np.int64)
                        np.add.at(scores, cell, np.repeat(gain[a:b], n))
                    ids = batch.column(0).slice(first + low, size // max(1, wide)).to_pylist()
                    heaps.update(scores.reshape(-1, wide), ids)
        out = [(k, index.ids[k], None if key == -math.inf else -key, score) for k, heap in enumerate(heaps.heaps) for score, key in heap]
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_pydict({"number": pa.array([r[0] for r in out], pa.int64()), "item_id": pa.array([r[1] for r in out], pa.int64()),
                                          "doc_id": pa.array([r[2] for r in out], pa.int64()), "score": pa.array([r[3] for r in out], pa.int64()),
                                          "part": pa.array([group] * len(out), pa.int32())})
    return docs.mapInArrow(rank, "number long, item_id long, doc_id long, score long, part int")


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The ``top`` highest-scoring documents of each item.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored.  Terms
    are runs of digits, letters and characters beyond ASCII in the whole text, only A-Z
    lower-cased, compared by a 64-bit hash.  With N documents that have a term, L terms in
    all, n in a document, df documents with a term and tf of it in the document: a term weighs
    w = floor(1000 ln((2N+2)/(2df+1))), m = 10 + (90 n N) div L, and a document scores the sum
    of w * ((10^9 tf) div (1000 tf + 8 m)) over the item's distinct terms.

    Returns item_id, rank (from 1), doc_id, score, best first; equal scores by ascending
    doc_id, a missing id last; only scores above 0.  Null and blank texts have no terms: such
    documents are not counted and such items have no rows.  Rows of ``docs`` with equal ids are documents of
    their own; equal rows of ``items`` are one item, rows that share only the id are several.
    Without documents or items the result is empty.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    for block in _blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(Index(block))
        n_docs, n_terms, df = _counts(rows, shared)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
        part = _best(_heaps(rows, shared, weight, n_docs, max(1, n_terms), top), ["number", "part"], top).drop("rank")
        part = _best(part, ["number"], top)
        out = part if out is None else out.unionByName(part)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
