"""What-if re-scoring.

A change overrides variables on one supplier's rows; the table is re-scored
(negotiation score, or the sum of eps-normalised top variables) and re-ranked
with ties sharing the lowest rank.  Per-group statistics come from one
aggregate; ranks use the skew-safe ``min_rank``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscore.operators.negotiation import negotiation_score
from offerscore.operators.scoring import minmax_eps
from offerscore.operators.stats import attach, group_stats, min_rank

NEGOTIATION_VARS = ("price", "quality", "delivery_time_days")


def simulate(df: DataFrame, supplier: str, changes: Mapping[str, float]) -> DataFrame:
    """Set each changed variable to its new value on every row of ``supplier``."""
    hit = F.col("supplier") == F.lit(supplier)
    out = df
    for v, val in changes.items():
        out = out.withColumn(v, F.when(hit, F.lit(float(val))).otherwise(F.col(v)))
    return out


def rescore(df: DataFrame, top_vars: Sequence[str], by: Sequence[str] | None = None,
            name: str = "score") -> DataFrame:
    """Negotiation score if every top variable is one of its three inputs,
    else the sum of ``(x - min)/(max - min + 1e-9)`` over the top variables,
    missing counted as 0 (price is not inverted, as coded)."""
    top = list(top_vars)
    if all(v in NEGOTIATION_VARS for v in top):
        return negotiation_score(df, name)
    out = minmax_eps(df, top, by=by, suffix="_norm")
    total = None
    for v in top:
        term = F.coalesce(F.col(f"{v}_norm"), F.lit(0.0))
        total = term if total is None else total + term
    return out.withColumn(name, total)


def whatif(df: DataFrame, supplier: str, changes: Mapping[str, float], top_vars: Sequence[str],
           by: Sequence[str] | None = None) -> DataFrame:
    """Simulate, re-score, and rank (1 = best, ties share the lowest rank)."""
    sim = simulate(df, supplier, changes)
    scored = rescore(sim, top_vars, by=by)
    return min_rank(scored, by, "score", "rank", ascending=False)


def supplier_result(result: DataFrame, supplier: str, by: Sequence[str] | None = None) -> DataFrame:
    """The supplier's new score and rank per group (its best-ranked row)."""
    by = list(by or [])
    rows = result.where(F.col("supplier") == F.lit(supplier))
    pick = F.min_by(F.struct("score", "rank", "offer_id"), F.struct("rank", "offer_id"))
    return group_stats(rows, by, pick.alias("_r")).select(*by, "_r.*")


def whatif_impact(before: DataFrame, after: DataFrame, key: str = "offer_id",
                  by: Sequence[str] | None = None) -> DataFrame:
    """Score and rank change per offer (inner join on the group and key, which
    together must be unique)."""
    by = list(by or [])
    b = before.select(*by, key, F.col("score").alias("score_before"), F.col("rank").alias("rank_before"))
    a = after.select(*by, key, "supplier", F.col("score").alias("score_after"), F.col("rank").alias("rank_after"))
    out = attach(a, b, [*by, key], how="inner")
    return out.withColumn("score_change", F.col("score_after") - F.col("score_before")) \
              .withColumn("rank_change", F.col("rank_before") - F.col("rank_after"))


def impact(df: DataFrame, supplier: str, changes: Mapping[str, float], top_vars: Sequence[str],
           by: Sequence[str] | None = None, key: str = "offer_id") -> DataFrame:
    """X1 to X4 in one frame: the rows with their score and rank before and after the change.

    The same columns as ``whatif_impact`` of two ``whatif`` results, without a join by key, so
    rows may share a key."""
    by = list(by or [])
    both = rescore(simulate(rescore(df, top_vars, by=by, name="score_before"), supplier, changes), top_vars, by=by, name="score_after")
    both = both.select(*by, key, "supplier", "score_before", "score_after")
    for when in ("before", "after"):
        both = min_rank(both, by, f"score_{when}", f"rank_{when}", ascending=False)
    return both.withColumn("score_change", F.col("score_after") - F.col("score_before")) \
               .withColumn("rank_change", F.col("rank_before") - F.col("rank_after"))


def sensitivity(df: DataFrame, supplier: str, top_vars: Sequence[str], points: int = 5,
                by: Sequence[str] | None = None) -> DataFrame:
    """The supplier's score and rank as each top variable moves over its range.

    The grid is ``points`` evenly spaced values between each variable's global
    min and max (``len(top_vars) * points`` scenarios, fixed by the caller).
    Each scenario is a grouping key next to ``by``, so one job re-scores all of
    them, in the groups that the supplier is in.  The supplier's rank is ``1 + rows with a higher score`` in its group,
    a filter-and-count, not a sort.
    """
    by = list(by or [])
    if points < 2:
        raise ValueError("points must be at least 2")
    bounds = df.agg(*[F.min(v).alias(f"lo_{i}") for i, v in enumerate(top_vars)],
                    *[F.max(v).alias(f"hi_{i}") for i, v in enumerate(top_vars)]).first()
    grid = []
    for i, v in enumerate(top_vars):
        lo, hi = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
        if lo is None:
            continue
        # a constant variable has one grid point
        grid += [(v, x) for x in dict.fromkeys(float(lo + (hi - lo) * j / (points - 1)) for j in range(points))]
    if not grid:
        raise ValueError("every top variable is missing")
    hit = F.col("supplier") == F.lit(supplier)
    if by:
        # only groups that the supplier is in can change
        names = {c: f"_in_{c}" for c in by}
        within = df.where(hit).select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).distinct()
        df = df.join(within, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in names.items()], "left_semi")
    scen = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(x).alias("value")) for v, x in grid])
    exploded = df.withColumn("_s", F.explode(scen)).select("*", "_s.variable", "_s.value").drop("_s")
    for v in top_vars:
        exploded = exploded.withColumn(
            v, F.when(hit & (F.col("variable") == F.lit(v)), F.col("value")).otherwise(F.col(v)))
    keys = [*by, "variable", "value"]
    scored = rescore(exploded, top_vars, by=keys)
    mine = group_stats(scored.where(hit), keys, F.max("score").alias("supplier_score"))
    cmp = attach(scored, mine, keys, how="inner")
    counts = group_stats(cmp, keys,
                         F.max("supplier_score").alias("supplier_score"),
                         F.sum(F.when(F.col("score") > F.col("supplier_score"), 1).otherwise(0))
                          .cast("long").alias("_higher"))
    return counts.withColumn("supplier_rank", F.col("_higher") + 1).drop("_higher")
