"""One-pass statistics, null-safe join back, and skew-safe ordered operators.

Design rules (apply to every operator in the package):

* Scalars an operator needs (min, max, mean, std, counts) come from one
  ``groupBy(by).agg(...)``: partial + final hash aggregation, so a hot tender
  is pre-aggregated on every map task before it is shuffled.
* The stats table is joined back on the ``by`` keys with null-safe equality.
  With ``by=[]`` it has exactly one row and is broadcast.  Keyed stats grow
  with the number of tenders, so they are *not* hinted: AQE broadcasts them
  only when the materialised size is under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``, else it keeps a
  sort-merge join whose skewed partitions it splits.
* Ordered quantities (row numbers, running sums, ranks, exact percentiles) of
  a group of up to ``HOT_ROWS`` rows are windows or sorted arrays of the group:
  one exchange on the group's keys, nothing written or persisted.
* One tender may hold a third of all rows, so larger groups (``hot_groups``,
  one count before; at most ``HOT_GROUPS`` of them, so their list is small)
  never meet in one task.  There ``running`` range-partitions on
  ``(by, order)`` - the sampled bounds split a hot tender over many tasks -
  numbers rows inside each (range partition, tender) slice, and adds the
  counts/sums of the earlier slices of the same tender, taken from a table
  with at most ``#tenders + #partitions`` rows.  Both ways give the same rows.
* Frames persisted here are registered with ``session.track`` so a caller
  can release them (``session.release``) once results are consumed;
  correctness never depends on a cache being present.
* Ranks and percentiles of hot groups work on the distinct values per tender (an
  aggregate), so ties collapse before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscore.session import ensure_checkpoint_dir, track


def _cols(by: Sequence[str] | None) -> list[str]:
    return list(by or [])


def num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame) -> DataFrame:
    """Persist and compute now.  Later plans then read a cached leaf instead of
    re-planning (and, under AQE, re-optimising after every stage) one very
    large tree.  Cached blocks lost with an executor are recomputed from the
    (deterministic) lineage."""
    df = track(df.persist(StorageLevel.MEMORY_AND_DISK))
    df.count()
    return df


def group_stats(df: DataFrame, by: Sequence[str] | None, *aggs: Column) -> DataFrame:
    by = _cols(by)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] | None, how: str = "left") -> DataFrame:
    """Join a stats table back on ``keys`` (null-safe).  No keys: one-row broadcast."""
    keys = _cols(keys)
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    ren = {c: f"__k_{c}" for c in keys}
    right = stats.select(*[F.col(f"`{c}`").alias(ren[c]) for c in keys],
                         *[F.col(f"`{c}`") for c in stats.columns if c not in keys])
    cond = [F.col(f"`{c}`").eqNullSafe(F.col(ren[c])) for c in keys]
    return df.join(right, cond, how).drop(*ren.values())


#: Rows of a group that one task may order; a larger one is cut into slices ...
HOT_ROWS = 1 << 17
#: ... as is one that holds more than two tasks' even shares of the table, from this many rows on.
FAIR_ROWS = 512
#: Largest number of groups that are cut for their size (in a very large table the limit on rows is higher).
HOT_GROUPS = 10_000
#: Rows of ordinary groups that meet in one task, on average; a larger table is dealt to more tasks.
TASK_ROWS = 1 << 17


def hot_groups(df: DataFrame, by: Sequence[str] | None) -> DataFrame | None:
    """The keys of groups too large for one task (see ``HOT_ROWS``, ``FAIR_ROWS``); None if there are
    none.  At most ``HOT_GROUPS`` and half the shuffle partitions, so their list is small.  ``by=[]``: a row
    without columns stands for the table.  One narrow counting job."""
    return hot_groups_and_rows(df, by)[0]


def hot_groups_and_rows(df: DataFrame, by: Sequence[str] | None) -> tuple[DataFrame | None, int]:
    """``hot_groups``, and the number of all rows (from the same job)."""
    by, n = _cols(by), F.col("_n")
    sizes = group_stats(df, by, F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    large = (n > HOT_ROWS) & (n * HOT_GROUPS > F.col("_total"))
    unfair = (n > FAIR_ROWS) & (n * num_partitions(df) > 2 * F.col("_total"))
    found = sizes.crossJoin(F.broadcast(total)).where(large | unfair).select(F.lit(None).cast("long").alias("_total"), *by)
    # one more row has the number of rows
    *rows, last = sorted(found.unionByName(total, allowMissingColumns=True).collect(), key=lambda r: r["_total"] is not None)
    if not rows:
        return None, last["_total"]
    hot = df.sparkSession.createDataFrame([tuple(r)[1:] for r in rows], df.select(*by).schema) if by else df.sparkSession.range(1).select()
    return hot, last["_total"]


def split_hot(df: DataFrame, by: Sequence[str] | None, hot: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of the other groups, rows of the hot groups); None for no rows."""
    by = _cols(by)
    if hot is None:
        return df, None
    if not by:
        return None, df
    keys = F.broadcast(hot.select(*[F.col(f"`{c}`").alias(f"__h_{c}") for c in by]))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__h_{c}")) for c in by]
    return df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")


def both(df: DataFrame, by: Sequence[str] | None, small, large, hot=()) -> DataFrame:
    """``small`` on the rows of ordinary groups and ``large`` on those of hot ones, together.
    ``hot`` may pass the keys found before.  The rows of ordinary groups go to as many tasks as
    keep a task near ``TASK_ROWS``, so that its memory does not grow with the table."""
    n_rows = 0
    if hot == ():
        hot, n_rows = hot_groups_and_rows(df, by)
    ordinary, hot_rows = split_hot(df, by, hot)
    if ordinary is not None and by and n_rows > TASK_ROWS * num_partitions(df):
        ordinary = ordinary.repartition(-(-n_rows // TASK_ROWS), *[F.col(f"`{c}`") for c in by])
    parts = [f(rows) for f, rows in ((small, ordinary), (large, hot_rows)) if rows is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def running(df: DataFrame, by: Sequence[str] | None, order: Sequence[Column],
            sums: Mapping[str, Column] | None = None, rn: str | None = "_rn", hot=()) -> DataFrame:
    """Row number (1-based) and running sums within each ``by`` group in ``order``.

    ``order`` must be a total order inside a group (add a unique tie-break).
    Skew-safe: no task ever holds more than ``HOT_ROWS`` rows of a group or one range
    partition.  A missing value adds 0 to a running sum, whatever the partitions.
    """
    sums = dict(sums or {})

    def small(rows: DataFrame) -> DataFrame:
        along = Window.partitionBy(*_cols(by)).orderBy(*order)
        frame = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbers = [F.row_number().over(along).cast("long").alias(rn)] if rn else []
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], *numbers,
                           *[F.sum(F.coalesce(c, F.lit(0))).over(frame).alias(n) for n, c in sums.items()])
    return both(df, by, small, lambda rows: running_in_slices(rows, by, order, sums, rn), hot)


def running_in_slices(df: DataFrame, by: Sequence[str] | None, order: Sequence[Column],
                      sums: Mapping[str, Column] | None = None, rn: str | None = "_rn") -> DataFrame:
    """``running`` for groups of any size: no task holds more than one range partition of rows."""
    by = _cols(by)
    sums = dict(sums or {})
    p = num_partitions(df)
    sort_keys = [F.col(f"`{c}`").asc_nulls_first() for c in by] + list(order)
    # The frame is read by two consumers (local numbering and the per-slice
    # totals), and both must see the same partition id for a row.  A range
    # exchange re-run from scratch may sample different bounds, so the frame is
    # checkpointed (written under spark.checkpoint.dir, lineage cut): both
    # consumers read the same files, whatever happens to caches or executors.
    # The explicit partition count keeps AQE from coalescing the exchange.
    ensure_checkpoint_dir(df.sparkSession)
    keyed = (df.repartitionByRange(p, *sort_keys).withColumn("_pid", F.spark_partition_id())
             .checkpoint(eager=True))

    local = Window.partitionBy("_pid", *by).orderBy(*order)
    frame = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.withColumn("_lrn", F.row_number().over(local).cast("long"))
    for name, c in sums.items():
        out = out.withColumn(f"_l_{name}", F.sum(F.coalesce(c, F.lit(0))).over(frame))

    part = keyed.groupBy("_pid", *by).agg(
        F.count(F.lit(1)).alias("_pn"), *[F.sum(F.coalesce(c, F.lit(0))).alias(f"_ps_{n}") for n, c in sums.items()])
    prior = (Window.partitionBy(*by) if by else Window).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = part.select(
        "_pid", *by,
        F.coalesce(F.sum("_pn").over(prior), F.lit(0)).cast("long").alias("_on"),
        *[F.coalesce(F.sum(f"_ps_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in sums])
    # Slices are contiguous in (by, order): only the first group of a range
    # partition can have rows in earlier partitions, so at most one row per
    # partition has a non-zero offset.  That table is bounded by the partition
    # count and is broadcast; every other row's offset is 0.
    offs = offs.where(F.col("_on") > 0)
    ren = {c: f"__k_{c}" for c in ["_pid", *by]}
    right = offs.select(*[F.col(f"`{c}`").alias(ren[c]) for c in ren],
                        "_on", *[f"_o_{n}" for n in sums])
    cond = [F.col(f"`{c}`").eqNullSafe(F.col(ren[c])) for c in ren]
    joined = out.join(F.broadcast(right), cond, "left").drop(*ren.values())
    joined = joined.withColumn("_on", F.coalesce(F.col("_on"), F.lit(0)))
    for n in sums:
        joined = joined.withColumn(f"_o_{n}", F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
    cols = [F.col(f"`{c}`") for c in df.columns]
    if rn:
        cols.append((F.col("_lrn") + F.col("_on")).alias(rn))
    for n in sums:
        cols.append((F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n))
    return joined.select(*cols)


def distinct_value_ranks(df: DataFrame, by: Sequence[str] | None, col: str,
                         ascending: bool = True) -> DataFrame:
    """Per (by, value): ``_cnt`` rows with the value, ``_cum`` rows up to and incl.
    the value in the given direction, and ``_n`` non-missing rows of the group."""
    by = _cols(by)
    c = F.col(f"`{col}`")
    v = df.where(c.isNotNull()).groupBy(*by, c.alias(col)).agg(F.count(F.lit(1)).alias("_cnt"))
    v = running_in_slices(v, by, [c.asc() if ascending else c.desc()], sums={"_cum": F.col("_cnt")}, rn=None)
    # group sizes from the source rows (a partial aggregate), so the ordered
    # frame above is evaluated once
    n = group_stats(df, by, F.count(c).alias("_n"))
    return materialize(attach(v, n, by, how="inner"))


def multi_value_ranks(df: DataFrame, by: Sequence[str] | None, cols: Sequence[str]) -> dict[str, DataFrame]:
    """``distinct_value_ranks`` (ascending) for several numeric columns in one
    ordering job: the distinct values of all columns are stacked as
    ``(by, column, value)`` and numbered with ``by + [column]`` as the group."""
    by = _cols(by)
    stacked = None
    for c in cols:
        part = df.select(*by, F.lit(c).alias("_col"), F.col(f"`{c}`").cast("double").alias("_val"))
        stacked = part if stacked is None else stacked.unionByName(part)
    v = stacked.where(F.col("_val").isNotNull()).groupBy(*by, "_col", "_val") \
        .agg(F.count(F.lit(1)).alias("_cnt"))
    keys = [*by, "_col"]
    v = running_in_slices(v, keys, [F.col("_val").asc()], sums={"_cum": F.col("_cnt")}, rn=None)
    # group sizes from one partial aggregate of the source rows, so the
    # ordered frame above is evaluated once
    counts = group_stats(df, by, *[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    n = counts.unpivot(by, list(cols), "_col", "_n") if by else \
        counts.unpivot([], list(cols), "_col", "_n")
    table = materialize(attach(v, n, keys, how="inner"))
    return {c: table.where(F.col("_col") == F.lit(c)).drop("_col").withColumnRenamed("_val", c)
            for c in cols}


def place(by: Sequence[str] | None, c: Column, ascending: bool = True) -> tuple[Column, Column]:
    """(lowest rank, rows with the same value) of a non-missing value among its group's, as windows
    over one sort."""
    order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    along = Window.partitionBy(*_cols(by)).orderBy(order)
    return F.rank().over(along).cast("long"), F.count(F.lit(1)).over(along.rangeBetween(Window.currentRow, Window.currentRow))


def pct_rank_column(by: Sequence[str] | None, c: Column) -> Column:
    """Average-tie rank / number of non-missing values, as windows of the group."""
    low, ties = place(by, c)
    return F.when(c.isNotNull(), (2 * low + ties - 1) / F.lit(2.0) / F.count(c).over(Window.partitionBy(*_cols(by))))


def pct_rank(df: DataFrame, by: Sequence[str] | None, col: str, name: str,
             ranks: DataFrame | None = None) -> DataFrame:
    """Average-tie rank / number of non-missing values; missing stays missing.

    ``ranks`` may pass an ascending ``distinct_value_ranks`` table to share it."""
    def large(rows: DataFrame) -> DataFrame:
        v = ranks if ranks is not None else distinct_value_ranks(rows, by, col, ascending=True)
        v = v.select(*_cols(by), col, (((F.col("_cum") - F.col("_cnt") + 1 + F.col("_cum")) / 2.0)
                                       / F.col("_n")).alias(name))
        return attach(rows, v, [*_cols(by), col])
    if ranks is not None:
        return large(df)
    return both(df, by, lambda rows: rows.withColumn(name, pct_rank_column(by, F.col(f"`{col}`"))), large)


def min_rank(df: DataFrame, by: Sequence[str] | None, col: str, name: str,
             ascending: bool = False) -> DataFrame:
    """Rank with ties sharing the lowest rank (descending: 1 = highest value)."""
    c = F.col(f"`{col}`")

    def large(rows: DataFrame) -> DataFrame:
        v = distinct_value_ranks(rows, by, col, ascending=ascending)
        return attach(rows, v.select(*_cols(by), col, (F.col("_cum") - F.col("_cnt") + 1).alias(name)), [*_cols(by), col])
    return both(df, by, lambda rows: rows.withColumn(name, F.when(c.isNotNull(), place(by, c, ascending)[0])), large)


def percentiles(df: DataFrame, by: Sequence[str] | None, col: str,
                qs: Mapping[str, float], ranks: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles per group, as a stats table.

    Equivalent to ``percentile(col, q)``.  A group of up to ``HOT_ROWS`` rows is one sorted array; the
    values of a hot group are never gathered: only the (at most two) distinct values
    that bracket each position survive the filter before the final aggregate.
    """
    by, c = _cols(by), F.col(f"`{col}`")

    def small(rows: DataFrame) -> DataFrame:
        # like the other way, a group without values has no row (the whole table has one of nulls)
        values = group_stats(rows.where(c.isNotNull()), by, F.sort_array(F.collect_list(c)).alias("_v"))
        at = {n: (F.size("_v") - 1) * F.lit(float(q)) for n, q in qs.items()}
        get = lambda i: F.get(F.col("_v"), i.cast("int"))
        return values.select(*by, *[(get(F.floor(h)) + (h - F.floor(h)) * (get(F.ceil(h)) - get(F.floor(h)))).alias(n) for n, h in at.items()])

    def large(rows: DataFrame) -> DataFrame:
        return _bracketed(by, col, qs, ranks if ranks is not None else distinct_value_ranks(rows, by, col, ascending=True))
    return large(df) if ranks is not None else both(df, by, small, large)


def _bracketed(by: list[str], col: str, qs: Mapping[str, float], v: DataFrame) -> DataFrame:
    c = F.col(f"`{col}`")
    lo_start = F.col("_cum") - F.col("_cnt")

    def holds(pos: Column) -> Column:
        return (lo_start < pos) & (pos <= F.col("_cum"))

    aggs, keep = [], []
    for name, q in qs.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h) + 1, F.ceil(h) + 1
        keep += [holds(lo), holds(hi)]
        aggs += [F.max(F.when(holds(lo), c)).alias(f"_lo_{name}"),
                 F.max(F.when(holds(hi), c)).alias(f"_hi_{name}"),
                 F.max(h - F.floor(h)).alias(f"_fr_{name}")]
    cond = keep[0]
    for k in keep[1:]:
        cond = cond | k
    s = group_stats(v.where(cond), by, *aggs)
    return s.select(*by, *[
        (F.col(f"_lo_{n}") + F.col(f"_fr_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
        for n in qs])


def zscore(df: DataFrame, by: Sequence[str] | None, col: str, name: str) -> DataFrame:
    """(x - mean) / population std; NULL when the std is 0."""
    by = _cols(by)
    s = group_stats(df, by, F.avg(col).alias("_zm"), F.stddev_pop(col).alias("_zs"))
    out = attach(df, s, by)
    return out.withColumn(name, F.try_divide(F.col(col) - F.col("_zm"), F.col("_zs"))).drop("_zm", "_zs")


def is_duplicated(df: DataFrame, by: Sequence[str] | None, col: Column | str, name: str,
                  source: DataFrame | None = None) -> DataFrame:
    """True if another row of the group has the same value (missing equals missing).

    A window of ordinary groups.  In hot ones counts per (group, value) are an aggregate
    (pre-aggregated per map task), taken from ``source`` when given (the rows before other
    columns were joined on; all groups go this way then).
    """
    by = _cols(by)
    c = F.col(col) if isinstance(col, str) else col

    def large(rows: DataFrame) -> DataFrame:
        src = (source if source is not None else rows).withColumn("_dupkey", c)
        cnt = materialize(src.groupBy(*by, "_dupkey").agg(F.count(F.lit(1)).alias("_dupn")))
        out = attach(rows.withColumn("_dupkey", c), cnt, [*by, "_dupkey"])
        return out.withColumn(name, F.col("_dupn") > 1).drop("_dupkey", "_dupn")
    if source is not None:
        return large(df)
    return both(df, by, lambda rows: rows.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by, c)) > 1), large)


def top_k(df: DataFrame, by: Sequence[str] | None, order: Sequence[Column], k: int,
          rn: str = "_rn", salts: int = 64, salt_key: str = "offer_id") -> DataFrame:
    """The first ``k`` rows per group in ``order`` (total order), numbered 1..k.

    Two stages: the best ``k`` per (group, salt) and then per group, so a hot
    group is cut down on many tasks before the final, at most ``k * salts``
    rows per group, ranking.  ``by=[]``: ``orderBy().limit(k)``.
    """
    by = _cols(by)
    if not by:
        return df.orderBy(*order).limit(k).withColumn(
            rn, F.row_number().over(Window.orderBy(*order)).cast("long"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_key)), F.lit(salts)))
    first = salted.withColumn("_r1", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)))
    first = first.where(F.col("_r1") <= k).drop("_r1", "_salt")
    second = first.withColumn(rn, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return second.where(F.col(rn) <= k)
