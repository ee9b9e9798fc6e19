"""Negotiation benchmark.

Winners are the first ``k`` offers per group by the negotiation score; the
benchmark values (lowest price, highest quality, fastest delivery) are an
aggregate over the winners only, at most ``k`` rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscore.operators.prepare import resolve_columns
from offerscore.operators.scoring import score_order
from offerscore.operators.stats import attach, group_stats, running


def negotiation_score(df: DataFrame, name: str = "score") -> DataFrame:
    """G1: quality / (price * (1 + 0.01 * delivery)); NULL where the divisor is 0."""
    c = resolve_columns(df)
    denom = F.col(c["price"]) * (1 + 0.01 * F.col(c["delivery"]))
    return df.withColumn(name, F.try_divide(F.col(c["quality"]), denom))


def negotiation_table(df: DataFrame, k: int = 3, by: Sequence[str] | None = None,
                      tiebreak: str = "offer_id") -> DataFrame:
    """G2 + K3: negotiation score, position and ``winner`` (position <= k) per group."""
    if k < 1:
        raise ValueError("k must be at least 1")
    scored = negotiation_score(df)
    ranked = running(scored, by, score_order("score", tiebreak), rn="position")
    return ranked.withColumn("winner", F.col("position") <= F.lit(k))


def acceptance_threshold(table: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """K4: score of the last winner per group, with the winners' names in order."""
    by = list(by or [])
    w = table.where(F.col("winner"))
    return group_stats(
        w, by,
        F.max_by(F.col("score"), F.col("position")).alias("threshold_score"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "supplier"))),
                    lambda x: x["supplier"]).alias("winners"),
        F.count(F.lit(1)).alias("n_winners"))


def _fmt(x):
    return F.format_string("%.2f", F.bround(x, 2))


def negotiation_advice(table: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Per winner, gaps to the winners' best terms and one advice sentence."""
    by = list(by or [])
    c = resolve_columns(table)
    p, q, d = F.col(c["price"]), F.col(c["quality"]), F.col(c["delivery"])
    w = table.where(F.col("winner"))
    best = group_stats(w, by, F.min(c["price"]).alias("best_price"), F.max(c["quality"]).alias("best_quality"),
                       F.min(c["delivery"]).alias("best_delivery"))
    out = attach(w, best, by)
    pg = F.when(p > F.col("best_price"), p - F.col("best_price"))
    qg = F.when(q < F.col("best_quality"), F.col("best_quality") - q)
    dg = F.when(d > F.col("best_delivery"), d - F.col("best_delivery"))
    out = out.withColumn("price_gap", F.coalesce(pg, F.lit(0.0))) \
             .withColumn("quality_gap", F.coalesce(qg, F.lit(0.0))) \
             .withColumn("delivery_gap", F.coalesce(dg, F.lit(0.0)))
    # The sentences and their parts.
    tips = F.concat_ws(
        ", and ",
        F.when(pg.isNotNull(), F.concat(F.lit("reduce price by €"), _fmt(pg),
                                        F.lit(" to match the lowest winner's price"))),
        F.when(qg.isNotNull(), F.concat(F.lit("increase quality by "), _fmt(qg),
                                        F.lit(" to match the highest winner's quality"))),
        F.when(dg.isNotNull(), F.concat(F.lit("reduce delivery time by "), _fmt(dg),
                                        F.lit(" days to match the fastest winner's delivery"))))
    advice = F.when(tips == "", F.concat(F.col("supplier"), F.lit(": Already matches the best terms among winners.")))\
        .otherwise(F.concat(F.col("supplier"), F.lit(": "), tips, F.lit(".")))
    return out.withColumn("advice", advice)


def tradeoff(table: DataFrame, keys: Sequence[str] = ("offer_id", "supplier")) -> DataFrame:
    """Price, quality, delivery with the winner flag (the 3-D trade-off view)."""
    c = resolve_columns(table)
    return table.select(*keys, F.col(c["price"]).alias("price"), F.col(c["quality"]).alias("quality"),
                        F.col(c["delivery"]).alias("delivery"), "winner")
