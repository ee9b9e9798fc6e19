"""Mixing sources to target weights, with built-in functions only.

Method: weighted fair queueing.  Each source's documents are put in a shuffled order that
only depends on their ids; a document's virtual finish time is its source's cumulative
tokens divided by the source's target weight.  The queue of all sources (each passing its
documents up to ``cap`` times) is range-sorted by finish time and cut at the total budget.

No source and no time range is held by one task: cumulative sums are taken in fixed
ranges of the order, with the ranges' totals added from a table of one row per range.  The
part of the queue in which the budget ends is range-sorted again until one task can add it up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .exchange import Store

#: Ranges in a source's order.
RANGES = 4096
#: Passes of the queue that one task adds up one by one.
LAST = 1 << 20


def count_words(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def order_key(seed: int):
    """60 bits that shuffle documents by id, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")


def source_table(store: Store, sized: DataFrame, weights, ratio: float, cap: int) -> tuple[DataFrame, float | None, int]:
    """One row per source (number by code point, null last; weight; size; target), the
    water level and the budget in words.

    Targets are ``level * weight``, at most ``cap`` times the source's size; the level is the
    fixed point at which the targets make up ``ratio`` times all sizes (each round gives what
    capped sources cannot take to the others by weight)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # range-partitioned and written, so that row numbers come from a fixed layout
    sums = store.write(sums.select("source", "source_size", F.col("source").isNull().alias("last")), "sums")
    ranged = store.write(sums.repartitionByRange("last", "source").sortWithinPartitions("last", "source")
                         .withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.expr("shiftright(at, 33)")
    before = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))     # a row per partition
    before = before.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    numbered = ranged.withColumn("part", part).join(before, "part") \
        .withColumn("number", F.col("before") + F.expr("at & 8589934591L"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = store.write(numbered.select("source", "source_size", "number", weight.alias("weight")), "sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]
    budget, level = int(total * ratio), 0.0
    if ratio >= cap or not total:
        level = None
    while level is not None:
        capped = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        got = table.agg(F.sum(F.when(capped, F.col("source_size") * cap).otherwise(0)).alias("fixed"),
                        F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        new = (total * ratio - got["fixed"]) / got["weight"] if got["weight"] else level
        if new <= level:
            break
        level = new
    most = F.col("source_size") * F.lit(float(cap))
    return table.withColumn("target", most if level is None else F.least(most, F.lit(level) * F.col("weight"))), level, budget


def _cut(store: Store, passes: DataFrame, budget: int):
    """The first pass (time, number) of the queue at which its running total is above the
    budget; None if it never is."""
    before, level, size = 0, 0, None
    part = F.expr("shiftright(at, 33)")
    while True:
        # written, so that totals and rows come from the same ranges
        queue = store.write(passes.repartitionByRange("time", "number").sortWithinPartitions("time", "number")
                            .withColumn("at", F.monotonically_increasing_id()), f"queue{level}")
        totals = queue.groupBy(part.alias("part")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("passes"))      # a row per partition
        upto = F.lit(before) + F.sum("n").over(Window.orderBy("part"))
        row = totals.withColumn("upto", upto).filter(F.col("upto") > budget).orderBy("part").first()
        if row is None:
            return None
        before = row["upto"] - row["n"]
        passes = queue.filter(part == row["part"])
        if row["passes"] <= LAST or row["passes"] == size:         # the second: equal times of one source
            break
        level, size, passes = level + 1, row["passes"], passes.drop("at")
    upto = F.lit(before) + F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return passes.withColumn("upto", upto).filter(F.col("upto") > budget).orderBy("at").first()


def mix(docs: DataFrame, weights=(3, 1, 2), ratio: float = 1.5, cap: int = 2, seed: int = 17) -> DataFrame:
    """Mix all documents to the sources' targets.

    ``docs`` needs doc_id, text and source; other columns are ignored.  Returns one row per
    input row: doc_id, source, size (words; a null text has none), source_size, target,
    copies (0 to ``cap``) and taken (words the mix takes).  Sources are numbered by code
    point, null last, and weigh ``weights`` in turn.  Every row is a document of its own:
    repeated rows and null ids follow each other in the shuffled order, and equal rows are
    interchangeable.  Empty documents take nothing; an empty table gives an empty result.
    Reruns agree: the order depends on ids and ``seed`` only.
    """
    store = Store(docs.sparkSession, "mixing")
    sized = store.write(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"),
                                order_key(seed).alias("order_key")), "sized")
    table, level, budget = source_table(store, sized, weights, ratio, cap)
    shift = 60 - (RANGES - 1).bit_length()
    rows = sized.join(table, sized["source"].eqNullSafe(table["source"])).drop(table["source"]) \
        .withColumn("range", F.shiftright("order_key", shift))
    totals = rows.groupBy("number", "range").agg(F.sum("size").alias("n"))
    totals = totals.withColumn("offset", F.sum("n").over(Window.partitionBy("number").orderBy("range")) - F.col("n")).drop("n")
    inside = Window.partitionBy("number", "range").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.join(totals, ["number", "range"]).withColumn("upto", F.col("offset") + F.sum("size").over(inside))
    finish = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: (F.col("upto") + k * F.col("source_size")) / F.col("weight"))
    queued = store.write(queued.select("doc_id", "source", "size", "source_size", "target", "number", finish.alias("finish")), "queued")
    if level is None:                # the budget reaches every copy, or there is nothing to take
        taken = F.lit(cap)
    else:
        stop = _cut(store, queued.filter("size > 0").select("number", "size", F.explode("finish").alias("time")), budget)
        if stop is None:
            taken = F.lit(cap)
        else:
            ahead = lambda t: (t < stop["time"]) | ((t == stop["time"]) & (F.col("number") < stop["number"]))
            taken = F.size(F.filter("finish", ahead))
    return queued.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0)) \
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
