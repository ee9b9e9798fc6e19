"""CSV files with line breaks inside quotes, read by many tasks.

Whether a byte lies inside quotes depends on all quotes before it, which is why Spark's
reader makes such a file one task.  But only the parity counts, and parities add up:

1. Spark cuts files into ranges of whole lines.  One aggregate counts the quotes of each range.
2. Prefix sums over a file's ranges (a row each) give the parity that each range begins with.
3. Every range is then cut at its true record ends by itself: a line that begins outside quotes
   begins a record.  A record that goes on in the next range leaves fragments, at most two a range.
4. Fragments of a record are joined in order, and all records are parsed by Spark's CSV parser.

Quotes must be used as in RFC 4180: around whole fields, doubled inside.  Line breaks inside
quotes keep their bytes (Spark's reader makes CRLF a line feed there, if lines end in CRLF).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a row of cut text is: a whole record, the end of one that began in an earlier range (or the
#: middle, if the range is inside one field), or the beginning of one.
WHOLE, REST, BEGUN = 0, 1, 2
RANGE = ["path", "start"]


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def parities(lines: DataFrame) -> DataFrame:
    """(path, start, inside): whether a range begins inside quotes; one row a range."""
    quotes = lines.groupBy(*RANGE).agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return quotes.select(*RANGE, (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(batches):
    """Records and fragments of the ranges of a task, from (path, start, value, inside) in file order."""
    names = ["path", "start", "kind", "header", "value"]
    held, at, open_, first = [], None, False, False       # lines of an unfinished record, of which range, inside quotes, the range's first

    def out(key, kind, header, values):
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(kind, pa.int32()),
                                           pa.array(header, pa.bool_()), pa.array(values, pa.string())], names=names)

    def rest():
        """What a range leaves at its end: a record that goes on, or the middle of a field."""
        kind = REST if first else BEGUN
        return out(at, [kind], [kind == BEGUN and at[1] == 0 and header], ["\n".join(held)])
    header = False
    for batch in batches:
        path, start, value, inside = batch.columns
        keys = np.flatnonzero(np.concatenate([[True], np.asarray(pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])))])) \
            if batch.num_rows else []
        for a, b in zip(keys, [*keys[1:], batch.num_rows]):
            key = (path[int(a)].as_py(), start[int(a)].as_py())
            if key != at:
                if held:
                    yield rest()
                held, at, open_, first, header = [], key, inside[int(a)].as_py(), inside[int(a)].as_py(), key[1] == 0
            part = value.slice(a, b - a)
            count = pc.count_substring(part, '"').to_numpy()
            ends = (open_ + np.cumsum(count)) % 2 == 0          # the line ends outside quotes, so a record ends
            stops, low, texts, kinds, heads = np.flatnonzero(ends), 0, [], [], []
            lines = part.to_pylist() if held or len(stops) < len(part) else None
            if lines is None:
                texts = part.to_pylist()                        # every line is a record
                kinds = [WHOLE] * len(texts)
            else:
                for s in stops.tolist():
                    texts.append("\n".join([*held, *lines[low:s + 1]]))
                    kinds.append(REST if first else WHOLE)
                    held, low, first = [], s + 1, False
                held = [*held, *lines[low:]]
            heads = [False] * len(texts)
            if texts and header:
                heads[0], header = kinds[0] != REST, False
            open_ = bool((open_ + int(count.sum())) % 2)
            if texts:
                yield out(key, kinds, heads, texts)
    if held:
        yield rest()


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value): the records of CSV files below their header, each with the line breaks inside its quotes."""
    lines = _lines(spark, path)
    # one row for each range of the files
    marked = lines.join(F.broadcast(parities(lines)), RANGE).select(*RANGE, "value", "inside")
    cut = marked.mapInArrow(_cut, "path string, start long, kind int, header boolean, value string")
    whole = cut.where(F.col("kind") == WHOLE).select("header", "value")
    order = Window.partitionBy("path").orderBy("start", "kind")
    parts = cut.where(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == BEGUN).cast("long")).over(order))
    joined = parts.groupBy("path", "number").agg(F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", "kind", "value"))).alias("p"))
    joined = joined.select("header", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    every = whole.unionByName(joined).where(~F.col("header"))
    return every.select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")


def read_records(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], **options: str) -> DataFrame:
    """The files' records as text columns; ``options`` go to the CSV parser."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = records(spark, path).select(F.from_csv("value", schema, {"escape": '"', "emptyValue": "", **options}).alias("r"))
    return parsed.select("r.*")
