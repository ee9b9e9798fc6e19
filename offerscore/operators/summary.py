"""Aggregations and KPIs.

Every aggregate is a ``groupBy(by).agg`` (partial + final), every ordered
output uses the skew-safe ``running`` numbering, and shares of a total are a
join with the group totals rather than a window over the tender.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscore.operators.prepare import require
from offerscore.operators.stats import attach, group_stats, percentiles, running


def _by(by):
    return list(by or [])


def mean_of(col: str, decimals: int | None = None):
    """``avg(col)``; with ``decimals`` the mean is taken in decimal with that many
    places (an exact sum), so it does not depend on the order in which
    partitions are summed.  Choose more places than the column has."""
    if decimals is None:
        return F.avg(col)
    return F.avg(F.col(col).cast(f"decimal(38,{decimals})")).cast("double")


def price_summary(df: DataFrame, by: Sequence[str] | None = None, col: str = "price",
                  decimals: int | None = None) -> DataFrame:
    """A1: min, max, mean, exact median and sample standard deviation."""
    by = _by(by)
    require(df, [col], "price_summary")
    base = group_stats(df, by, F.min(col).alias(f"{col}_min"), F.max(col).alias(f"{col}_max"),
                       mean_of(col, decimals).alias(f"{col}_mean"), F.stddev_samp(col).alias(f"{col}_std"))
    med = percentiles(df, by, col, {f"{col}_median": 0.5})
    return attach(base, med, by) if by else base.crossJoin(med)


def delivery_kpis(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """A2: mean lead time and minimum delivery time."""
    require(df, ["lead_time_days", "delivery_time_days"], "delivery_kpis")
    return group_stats(df, _by(by), F.avg("lead_time_days").alias("avg_lead_time_days"),
                       F.min("delivery_time_days").alias("min_delivery_time_days"))


def with_share(counts: DataFrame, by: Sequence[str] | None = None, count_col: str = "count",
               name: str = "share_pct") -> DataFrame:
    """A5: percent of the group total (joined totals, not a window)."""
    by = _by(by)
    tot = group_stats(counts, by, F.sum(count_col).alias("_total"))
    out = attach(counts, tot, by)
    return out.withColumn(name, 100.0 * F.col(count_col) / F.col("_total")).drop("_total")


def value_counts(df: DataFrame, col: str, by: Sequence[str] | None = None,
                 dropna: bool = False) -> DataFrame:
    by = _by(by)
    src = df.where(F.col(col).isNotNull()) if dropna else df
    counts = src.groupBy(*by, col).agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, by)


def compliance_counts(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """A3 (+A5): rows per compliance value, missing counted."""
    require(df, ["compliance"], "compliance_counts")
    return value_counts(df, "compliance", by, dropna=False)


def supplier_type_counts(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """A4 (+A5): rows per supplier type, missing excluded."""
    require(df, ["supplier_type"], "supplier_type_counts")
    return value_counts(df, "supplier_type", by, dropna=True)


def payment_terms_kpis(df: DataFrame, by: Sequence[str] | None = None,
                       col: str = "payment_terms") -> DataFrame:
    """Most common term (ties: smallest), its count, number of distinct terms.
    A group without any term keeps its row: NULL, 0 and 0.

    Counts per (group, term) are a partial aggregate; the mode is then a
    ``min`` over ``(-count, term)`` structs, so no group's values are gathered.
    """
    by = _by(by)
    require(df, [col], "payment_terms_kpis")
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    best = F.min(F.when(F.col(col).isNotNull(), F.struct((-F.col("_c")).alias("neg"), F.col(col).alias("term"))))
    s = group_stats(counts, by, best.alias("_b"), F.count(F.col(col)).alias("n_payment_terms"))
    return s.select(*by, F.col("_b.term").alias("top_payment_term"),
                    F.coalesce(-F.col("_b.neg"), F.lit(0)).alias("top_payment_term_count"), "n_payment_terms")


def distinct_supplier_types(df: DataFrame, by: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """A7; ``approx`` estimates the number from a sketch (one shuffle of fixed-size sketches
    instead of one by value)."""
    require(df, ["supplier_type"], "distinct_supplier_types")
    if approx:
        return distinct_sketch(df, "supplier_type", by).drop("sketch").withColumnRenamed("n_distinct", "n_supplier_types")
    return group_stats(df, _by(by), F.count_distinct("supplier_type").alias("n_supplier_types"))


#: log2 of a sketch's buckets: at most 10 KB each, relative error about 0.8 %; exact up to some hundreds of values.
SKETCH_BITS = 14


def distinct_sketch(df: DataFrame, col: str, by: Sequence[str] | None = None) -> DataFrame:
    """``by``, sketch (a HyperLogLog sketch of the column's values, missing ones left out) and n_distinct, its
    estimate.  Sketches can be stored, and merged over any groups or days by ``merge_sketches``."""
    require(df, [col], "distinct_sketch")
    out = group_stats(df, by, F.hll_sketch_agg(F.col(col).cast("string"), F.lit(SKETCH_BITS)).alias("sketch"))
    return out.withColumn("n_distinct", F.hll_sketch_estimate("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """``by``, sketch and n_distinct of the union of the groups' sketches."""
    require(sketches, ["sketch"], "merge_sketches")
    return group_stats(sketches, by, F.hll_union_agg("sketch").alias("sketch")).withColumn("n_distinct", F.hll_sketch_estimate("sketch"))


def compliance_by_supplier(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Rows per (supplier, compliance), missing keys dropped."""
    require(df, ["supplier", "compliance"], "compliance_by_supplier")
    return (df.dropna(subset=["supplier", "compliance"])
              .groupBy(*_by(by), "supplier", "compliance").agg(F.count(F.lit(1)).alias("count")))


def correlation(df: DataFrame, cols: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair of columns, long format (``by``, var_a, var_b, corr),
    for the table or each group.

    Two scans: the smallest value of each column, and one aggregate of the sums and products of what
    the columns exceed it by, by (group, which columns are missing): rows with the same columns present
    share the sums of all their pairs.  The sums are plain, so they are merged on every map task
    first; a pair then adds up those of the patterns that have both columns.  A pair without two rows, or
    with a column that is constant where both are present, gives NULL.
    """
    by, cols = _by(by), list(cols)
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    least = group_stats(df, by, *[F.min(F.col(f"`{c}`").cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)])
    above = attach(df.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]), least, by) \
        .select(*by, *[(F.col(f"_x{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in range(d)])
    x = [F.col(f"_x{i}") for i in range(d)]
    patterns = above.withColumn("_p", F.array(*[c.isNotNull() for c in x])).groupBy(*by, "_p").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs],
        *[f(c).alias(f"{name}{i}") for i, c in enumerate(x) for name, f in (("lo", F.min), ("hi", F.max))])
    listed = F.array(*[F.when(F.col("_p")[i] & F.col("_p")[j], F.struct(
        F.lit(k).alias("k"), F.col("n"), *[F.col(f"{c}{i}").alias(f"{c}x") for c in ("s", "lo", "hi")], *[F.col(f"{c}{j}").alias(f"{c}y") for c in ("s", "lo", "hi")],
        F.col(f"s{i}_{i}").alias("sxx"), F.col(f"s{j}_{j}").alias("syy"), F.col(f"s{i}_{j}").alias("sxy"))) for k, (i, j) in enumerate(pairs)])
    sums = patterns.select(*by, F.inline(F.filter(listed, lambda p: p.isNotNull()))).groupBy(*by, "k").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
        ((F.min("lox") < F.max("hix")) & (F.min("loy") < F.max("hiy"))).alias("varies"))
    part = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    ratio = F.try_divide(part("sx", "sy", "sxy"), F.sqrt(part("sx", "sx", "sxx") * part("sy", "sy", "syy")))
    corr = F.when(F.col("varies") & ratio.isNotNull(), F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0)))      # both skip nulls
    every = (least.select(*by) if by else df.sparkSession.range(1).select()).select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("k"))
    out = attach(every, sums.select(*by, "k", corr.alias("corr")), [*by, "k"])
    names = lambda side: F.element_at(F.array(*[F.lit(cols[p[side]]) for p in pairs]), F.col("k") + 1)
    both_sides = F.array(F.struct(names(0).alias("var_a"), names(1).alias("var_b")), F.struct(names(1).alias("var_a"), names(0).alias("var_b")))
    return out.select(*by, F.explode(F.array_distinct(both_sides)).alias("_p"), "corr").select(*by, "_p.*", "corr")


def pareto(df: DataFrame, by: Sequence[str] | None = None, col: str = "price") -> DataFrame:
    """A10 + W3: total per supplier (0 without a price), largest first, running
    percent of the total (NULL where the total is 0)."""
    by = _by(by)
    require(df, ["supplier", col], "pareto")
    tot = df.groupBy(*by, "supplier").agg(F.coalesce(F.sum(col), F.lit(0.0)).alias(col))
    ordered = running(tot, by, [F.col(col).desc(), F.col("supplier").asc()],
                      sums={"_cum": F.col(col)}, rn="position")
    grand = group_stats(tot, by, F.sum(col).alias("_grand"))
    out = attach(ordered, grand, by)
    return out.withColumn("cum_pct", F.try_divide(F.col("_cum"), F.col("_grand")) * 100.0).drop("_cum", "_grand")


def box_stats(df: DataFrame, by: Sequence[str] | None = None, col: str = "price") -> DataFrame:
    """Quartiles (linear), 1.5 IQR fences, whiskers = extreme values inside them."""
    by = _by(by)
    q = percentiles(df, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr")) \
         .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))
    x = F.col(col)
    inside = (x >= F.col("lower_fence")) & (x <= F.col("upper_fence"))
    w = group_stats(attach(df.where(x.isNotNull()), q.select(*by, "lower_fence", "upper_fence"), by), by,
                    F.min(F.when(inside, x)).alias("whisker_low"),
                    F.max(F.when(inside, x)).alias("whisker_high"),
                    F.sum(F.when(~inside, 1).otherwise(0)).cast("long").alias("n_outliers"))
    return attach(q, w, by) if by else q.crossJoin(w)


def histogram(df: DataFrame, col: str = "price", bins: int = 20,
              by: Sequence[str] | None = None, decimals: int | None = None) -> DataFrame:
    """Equal-width bins between the group's min and max, plus the mean."""
    by = _by(by)
    s = group_stats(df, by, F.min(col).alias("_lo"), F.max(col).alias("_hi"),
                    mean_of(col, decimals).alias("mean"))
    x = attach(df.where(F.col(col).isNotNull()), s, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins)))
    x = x.withColumn("bin", b.cast("long"))
    return (x.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"),
                                      F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
                                      F.first("mean").alias("mean"))
             .withColumn("bin_low", F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins)
             .withColumn("bin_high", F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins)
             .drop("_lo", "_hi"))


def density(df: DataFrame, col: str = "price", by: Sequence[str] | None = None, points: int = 50,
            bins: int | None = None) -> DataFrame:
    """The violin's curve, a Gaussian kernel density at ``points`` even places of each group.

    The bandwidth h is Silverman's, 1.059 min(s, IQR / 1.349) n^(-1/5), at least a hundredth of
    the span (1 if the span is 0); the curve runs from 2 h below the smallest to 2 h above the
    largest value.  Returns ``by``, point (from 1), x, density, height (share of the group's largest
    density), bandwidth and n.  Missing values are left out; a group without any has no rows.

    Every distinct value adds its kernels to the group's points next to where it is counted, in one row of sums for
    each group and task, and only these are shuffled then, so a hot group is summed by many tasks.  With ``bins`` the values are
    first shared linearly between the two nearest of that many even places, so that a group
    has at most ``bins`` values, whatever its rows; the curve is then an approximation.
    """
    by = _by(by)
    require(df, [col], "density")
    if points < 2 or (bins is not None and bins < 2):
        raise ValueError("a density needs at least 2 points and 2 bins")
    rows = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))
    base = group_stats(rows, by, F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_s"), F.count("_v").alias("n"))
    quartiles = percentiles(rows, by, "_v", {"_q1": 0.25, "_q3": 0.75})
    span = F.col("_hi") - F.col("_lo")
    width = 1.059 * F.least(F.col("_s"), (F.col("_q3") - F.col("_q1")) / 1.349) * F.pow(F.col("n"), F.lit(-0.2))
    grid = (attach(base, quartiles, by) if by else base.crossJoin(quartiles)) \
        .withColumn("bandwidth", F.when(span > 0, F.greatest(width, span / 100)).otherwise(F.lit(1.0))) \
        .withColumn("_from", F.col("_lo") - 2 * F.col("bandwidth")) \
        .withColumn("_step", (span + 4 * F.col("bandwidth")) / (points - 1)).select(*by, "_lo", "_hi", "_from", "_step", "bandwidth", "n").where("n > 0")
    if bins is None:
        values = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).cast("double").alias("_w"))
        placed = attach(values, grid, by, how="inner")
    else:
        at = F.coalesce(F.try_divide((F.col("_v") - F.col("_lo")) * (bins - 1), span), F.lit(0.0))
        shares = F.array(*[F.struct((F.floor("_at") + k).alias("_bin"), w.alias("_w")) for k, w in
                           enumerate([1 - (F.col("_at") - F.floor("_at")), F.col("_at") - F.floor("_at")])])
        shared = attach(rows, grid, by, how="inner").withColumn("_at", at).select(*by, F.explode(shares).alias("_b")) \
            .groupBy(*by, F.col("_b._bin").alias("_bin")).agg(F.sum("_b._w").alias("_w"))
        placed = attach(shared, grid, by, how="inner").withColumn("_v", F.col("_lo") + F.col("_bin") * span / (bins - 1))
    kernel = lambda p: F.exp(-0.5 * F.pow((F.col("_from") + F.lit(p) * F.col("_step") - F.col("_v")) / F.col("bandwidth"), F.lit(2.0)))
    # a sum for each point: no row is copied, and a group is one row from here on
    sums = group_stats(placed, [*by, "_from", "_step", "bandwidth", "n"], F.array(*[F.sum(F.col("_w") * kernel(p)) for p in range(points)]).alias("_sums"))
    out = sums.select("*", F.array_max("_sums").alias("_top"), F.posexplode("_sums").alias("_p", "_k"))
    return out.select(*by, (F.col("_p") + 1).cast("long").alias("point"), (F.col("_from") + F.col("_p") * F.col("_step")).alias("x"),
                      (F.col("_k") / (F.col("n") * F.col("bandwidth") * F.sqrt(F.lit(2 * math.pi)))).alias("density"),
                      F.try_divide(F.col("_k"), F.col("_top")).alias("height"), "bandwidth", "n")


def supplier_totals(df: DataFrame, col: str, ascending: bool = False,
                    by: Sequence[str] | None = None) -> DataFrame:
    """Sum of a column per supplier with its sort position."""
    by = _by(by)
    tot = df.groupBy(*by, "supplier").agg(F.sum(col).alias(f"total_{col}"))
    c = F.col(f"total_{col}")
    order = [c.asc_nulls_last() if ascending else c.desc_nulls_last(), F.col("supplier").asc()]
    return running(tot, by, order, rn="position")


def distinct_suppliers(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """A14."""
    return df.select(*_by(by), "supplier").distinct()


def variable_ranges(df: DataFrame, variables: Sequence[str], by: Sequence[str] | None = None,
                    sequential: bool = True) -> DataFrame:
    """P10: (variable, lo, hi, step) per group.

    ``sequential=True`` follows the filter view: each variable's bounds are
    taken over the rows that survive the full-range filters of the variables
    before it, i.e. rows where those variables are present.  One aggregate.
    """
    by = _by(by)
    aggs = []
    present = None
    for i, v in enumerate(variables):
        c = F.col(v) if (present is None or not sequential) else F.when(present, F.col(v))
        aggs += [F.min(c).alias(f"_lo_{i}"), F.max(c).alias(f"_hi_{i}")]
        present = F.col(v).isNotNull() if present is None else (present & F.col(v).isNotNull())
    s = group_stats(df, by, *aggs)
    rows = [F.struct(F.lit(v).alias("variable"),
                     F.coalesce(F.col(f"_lo_{i}"), F.lit(0.0)).alias("lo"),
                     F.coalesce(F.col(f"_hi_{i}"), F.lit(1.0)).alias("hi")) for i, v in enumerate(variables)]
    out = s.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")
    return out.withColumn("step", F.when(F.col("hi") - F.col("lo") > 10, 1.0).otherwise(0.01))


def total_cost(df: DataFrame) -> DataFrame:
    """Price - discount + shipping cost."""
    require(df, ["price", "discount", "shipping_cost"], "total_cost")
    return df.withColumn("total_cost", F.col("price") - F.col("discount") + F.col("shipping_cost"))
