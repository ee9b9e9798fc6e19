"""Chunk tables and keyed requests: joins on word or byte windows without a row per window.

A corpus has about as many windows as bytes or words; a shuffle with one row for each
costs many times the text.  These operators instead

1. write the corpus once as a bucketed table of *chunks* (a few MB of documents each);
2. let each chunk send one packed *request* per shard of the key space, holding its
   distinct keys (so a key that is hot in the corpus costs one entry per chunk);
3. answer all requests of a shard together (a Spark group per shard) with one *reply*
   per chunk, aligned with the request;
4. bring the replies back to the chunks (``cogroup`` on the bucketing key, so the text is
   not shuffled) and finish every document there.

Chunk table, replies and intermediate tables lie in a folder below ``spark.checkpoint.dir``
and are committed by Spark's writers, so a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import atexit
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from offerscore.session import scratch_dir

from . import textops as T

#: Text bytes in a chunk (a longer document is a chunk of its own) and in a shard's share.
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes.  Integer arrays are cut into byte planes first,
    names ending in ``_d`` into differences before that (for sorted values)."""
    head, body = [], []
    for name, values in arrays.items():
        values = np.ascontiguousarray(values)
        head.append((name, values.dtype.str, len(values)))
        if name.endswith("_d") and len(values):
            with np.errstate(over="ignore"):
                values = np.concatenate([values[:1], values[1:] - values[:-1]])
        body.append(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes() if len(values) else b"")
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((head, body), protocol=5))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    """The arrays that ``pack`` was given."""
    head, body = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    out = {}
    for (name, kind, n), raw in zip(head, body):
        dtype = np.dtype(kind)
        values = np.frombuffer(raw, dtype=np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel() if n else np.zeros(0, dtype)
        if name.endswith("_d") and n:
            with np.errstate(over="ignore"):
                values = np.cumsum(values, dtype=dtype)
        out[name] = values
    return out


def pack_texts(batch: pa.RecordBatch) -> bytes:
    """A chunk payload of documents as compressed Arrow data."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def unpack_batch(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_next_batch()


#: Stands for a missing doc_id: larger than every other.
NO_ID = np.iinfo(np.int64).max


def unpack_texts(payload: bytes) -> tuple[np.ndarray, pa.Array]:
    """Document ids (``NO_ID`` for null) and texts of a chunk payload."""
    batch = unpack_batch(payload)
    return batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1)


class Store:
    """Tables of one run in a fresh folder below ``spark.checkpoint.dir``.

    ``drop`` deletes a table as soon as nothing reads it any more; the rest goes when
    the driver ends (the result of a run still reads its last tables until then)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir, self.tables = spark, scratch_dir(spark, name), {}
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str, buckets: int = 0, key: str = "") -> DataFrame:
        path = f"{self.dir}/{name}"
        if not buckets:
            df.write.option("compression", "zstd").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        table = f"{self.dir.rsplit('/', 1)[-1]}_{name}".replace("-", "_")
        df.write.bucketBy(buckets, key).option("path", path).option("compression", "uncompressed").saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, name: str = "") -> None:
        """Delete one table, or the folder."""
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}" if name else self.dir)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            for name in [*self.tables, ""]:
                self.drop(name)


def chunks(store: Store, docs: DataFrame, build, carry: tuple[str, ...] = (), most: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """Write ``docs`` (doc_id, text and the columns in ``carry``) as a bucketed table
    (chunk_id, n_bytes, payload).

    ``build(batch)`` makes the payload of one chunk's rows.  Returns the table and the number
    of text bytes.  Chunk numbers come from the writing task; they are fixed once the write is
    committed.  There are as many buckets as shuffle partitions."""
    def cut(batches):
        task, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"chunk_id": pa.array([(task << 32) | seq], pa.int64()), "n_bytes": pa.array([n], pa.int64()),
                                               "payload": pa.array([build(rows)], pa.binary())})
        for batch in batches:
            size = np.diff(np.concatenate([[0], T.buffers(batch.column(1))[1]]))
            row = 0
            while row < len(size):
                fits = int(np.searchsorted(np.cumsum(size[row:]), most - n, side="right"))
                stop = row + (fits if fits or held else 1)
                if stop > row:
                    held.append(batch.slice(row, stop - row))
                    n += int(size[row:stop].sum())
                row = stop
                if row < len(size):
                    yield flush()
                    seq, held, n = seq + 1, [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    n = max(8, int(store.spark.conf.get("spark.sql.shuffle.partitions")))
    table = store.write(rows.mapInArrow(cut, "chunk_id long, n_bytes long, payload binary"), "chunks", n, "chunk_id")
    total = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    return table, int(total)


def shards_for(n_bytes: int, share: int = SHARD_BYTES) -> int:
    """Shards so that each answers for about ``share`` bytes of text."""
    return max(1, -(-n_bytes // share))


def split(shard: np.ndarray, n: int):
    """(shard, row numbers in their given order) for every shard that occurs."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s]:cuts[s + 1]]


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of a 64-bit key, by its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


MESSAGE = "shard int, chunk_id long, payload binary"


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()),
                     "chunk_id": pa.array([r[1] for r in rows], pa.int64()),
                     "payload": pa.array([r[2] for r in rows], pa.binary())})


def ask(table: DataFrame, request) -> DataFrame:
    """One packed request per chunk and shard: ``request(payload)`` yields (shard, bytes)."""
    def run(group: pa.Table) -> pa.Table:
        rows = []
        for chunk, payload in zip(group["chunk_id"].to_pylist(), group["payload"].to_pylist()):
            rows += [(s, chunk, data) for s, data in request(payload)]
        return messages(rows)
    return table.select("chunk_id", "payload").groupBy("chunk_id").applyInArrow(run, MESSAGE)


def answer(requests: DataFrame, reply) -> DataFrame:
    """Each shard's requests together: ``reply([bytes, ...], shard)`` returns bytes or None for each."""
    def run(group: pa.Table) -> pa.Table:
        shards, ids, payloads = (group[c].to_pylist() for c in ("shard", "chunk_id", "payload"))
        order = np.argsort(ids, kind="stable")     # the same result whatever order the shuffle has
        out = reply([payloads[i] for i in order], shards[0])
        return messages([(shards[i], ids[i], data) for i, data in zip(order, out) if data is not None])
    return requests.groupBy("shard").applyInArrow(run, MESSAGE)


def finish(table: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
    """``work(payload, {shard: reply bytes}, chunk_id)`` for every chunk, also those without replies."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right["shard"].to_pylist(), right["payload"].to_pylist()))
        out = [work(p, got, c) for c, p in zip(left["chunk_id"].to_pylist(), left["payload"].to_pylist())]
        return pa.concat_tables(out) if out else kind.empty_table()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    kind = to_arrow_schema(StructType.fromDDL(schema))
    return (table.select("chunk_id", "payload").groupBy("chunk_id")
            .cogroup(replies.groupBy("chunk_id")).applyInArrow(run, schema))
