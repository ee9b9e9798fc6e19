"""Bid-risk indicators.

``risk_scores`` adds the seven indicators and their mean to the input, from windows of
each group.  Groups too large for one task take their percentiles and percent ranks from
the skew-safe distinct-value tables of ``stats`` (shared between the price
percentile and the price rank, and between the score median and score rank).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscore.functions.exprs import flag
from offerscore.session import track
from offerscore.operators.prepare import quality_column, require
from offerscore.operators.stats import (attach, both, group_stats, is_duplicated, materialize,
                                        multi_value_ranks, pct_rank, pct_rank_column, percentiles)

RISK_COLUMNS = ["lowball_risk", "drip_pricing_risk", "drip_pricing_flag", "signaling_risk",
                "cover_bid_risk", "decoy_bid_risk", "bid_similarity_risk"]

# The meaning of each indicator, as the reference words them.
RISK_EXPLANATIONS = {
    "Lowballing": "A bid much lower than the average, possibly unsustainable.",
    "Drip Pricing": "Price appears low but may increase with hidden costs.",
    "Drip Pricing Flag": "Supplier has high price and low quality/technical score.",
    "Market Signaling": "High price and high score, possibly signaling to competitors.",
    "Cover Bidding": "High price and low score, possibly not a serious bid.",
    "Decoy Bidding": "Bid is an outlier in price or score, possibly to distract.",
    "Bid Similarity": "Multiple bids with very similar price or score, may indicate collusion.",
}
RISK_LABELS = dict(zip(RISK_COLUMNS, RISK_EXPLANATIONS))


def risk_scores(df: DataFrame, by: Sequence[str] | None = None, price: str = "price",
                score: str = "score", lowball_share: float = 0.85) -> DataFrame:
    """R1-R8 per group.  A NULL comparison counts as 0.0; division by zero is NULL.

    Ordinary groups are one exchange on ``by``: statistics, ranks, percentiles and repeated
    values are windows of the group.  Groups that are too large for one task (``hot_groups``)
    get the same columns from joined tables of statistics and value ranks."""
    by = list(by or [])
    require(df, [price, score], "risk_scores")
    q = quality_column(df)
    measured = both(df, by, lambda rows: _measured_by_windows(rows, by, price, score, q),
                    lambda rows: _measured_by_joins(rows, by, price, score, q))
    return _risks(measured, price, score, q, lowball_share)


def _statistics(price: str, score: str, q: str | None) -> dict[str, Column]:
    out = {"_pmean": F.avg(price), "_pmin": F.min(price), "_pmax": F.max(price), "_smean": F.avg(score),
           "_pstd": F.stddev_pop(price), "_sstd": F.stddev_pop(score)}
    return out | ({"_qmin": F.min(q), "_qmax": F.max(q)} if q else {})


def _duplicate_keys(price: str, score: str) -> dict[str, Column]:
    return {"_pdup": F.bround(F.col(price), -2), "_sdup": F.bround(F.col(score), 0)}


def _measured_by_windows(df: DataFrame, by: list[str], price: str, score: str, q: str | None) -> DataFrame:
    group = Window.partitionBy(*by)
    cuts = {"_p75": (price, 0.75), "_smed": (score, 0.5)} | ({"_q25": (q, 0.25)} if q else {})
    return df.select("*", *[c.over(group).alias(n) for n, c in _statistics(price, score, q).items()],
                     *[F.percentile(F.col(c), share).over(group).alias(n) for n, (c, share) in cuts.items()],
                     pct_rank_column(by, F.col(price)).alias("_prank"), pct_rank_column(by, F.col(score)).alias("_srank"),
                     *[(F.count(F.lit(1)).over(Window.partitionBy(*by, c)) > 1).alias(n) for n, c in _duplicate_keys(price, score).items()])


def _measured_by_joins(df: DataFrame, by: list[str], price: str, score: str, q: str | None) -> DataFrame:
    # read by a dozen branches (stats, three value-rank tables, duplicates)
    df = track(df.persist(StorageLevel.MEMORY_AND_DISK))
    stats = group_stats(df, by, *[c.alias(n) for n, c in _statistics(price, score, q).items()])

    # value-rank tables of price, score (and quality) from one ordering job
    ranks = multi_value_ranks(df, by, [price, score, *([q] if q else [])])
    price_ranks, score_ranks = ranks[price], ranks[score]
    # every per-group scalar in one small table, computed once
    stats = attach(stats, percentiles(df, by, price, {"_p75": 0.75}, ranks=price_ranks), by)
    stats = attach(stats, percentiles(df, by, score, {"_smed": 0.5}, ranks=score_ranks), by)
    if q:
        stats = attach(stats, percentiles(df, by, q, {"_q25": 0.25}, ranks=ranks[q]), by)
    out = attach(df, materialize(stats), by)
    out = pct_rank(out, by, price, "_prank", ranks=price_ranks)
    out = pct_rank(out, by, score, "_srank", ranks=score_ranks)
    for name, key in _duplicate_keys(price, score).items():
        out = is_duplicated(out, by, key, name, source=df)
    return out


def _risks(out: DataFrame, price: str, score: str, q: str | None, lowball_share: float) -> DataFrame:
    p, s = F.col(price), F.col(score)
    mean = F.col("_pmean")
    out = out.withColumn("lowball_risk", F.when(p < F.lit(lowball_share) * mean,
                                                 F.try_divide(mean - p, mean)).otherwise(F.lit(0.0)))
    if q:
        pn = F.try_divide(p - F.col("_pmin"), F.col("_pmax") - F.col("_pmin"))
        qn = F.try_divide(F.col(q) - F.col("_qmin"), F.col("_qmax") - F.col("_qmin"))
        out = out.withColumn("drip_pricing_risk", pn * (1 - qn))
        out = out.withColumn("drip_pricing_flag", flag((p > F.col("_p75")) & (F.col(q) < F.col("_q25"))))
    else:
        out = out.withColumn("drip_pricing_risk", F.lit(0.0)).withColumn("drip_pricing_flag", F.lit(0.0))
    out = out.withColumn("signaling_risk", flag((F.col("_srank") > 0.8) & (F.col("_prank") > 0.8)))
    out = out.withColumn("cover_bid_risk", flag((p > F.col("_p75")) & (s < F.col("_smed"))))
    zp = F.try_divide(p - F.col("_pmean"), F.col("_pstd"))
    zs = F.try_divide(s - F.col("_smean"), F.col("_sstd"))
    out = out.withColumn("decoy_bid_risk", flag((F.abs(zp) > 2) | (F.abs(zs) > 2)))
    out = out.withColumn("bid_similarity_risk", flag(F.col("_pdup") | F.col("_sdup")))
    present = sum((F.col(c).isNotNull().cast("int") for c in RISK_COLUMNS), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in RISK_COLUMNS), F.lit(0.0))
    out = out.withColumn("total_risk", F.try_divide(total, present.cast("double")))
    tmp = ["_pmean", "_pmin", "_pmax", "_smean", "_pstd", "_sstd", "_qmin", "_qmax", "_p75", "_smed",
           "_q25", "_prank", "_srank", "_pdup", "_sdup"]
    return out.drop(*[c for c in tmp if c in out.columns])


def risk_table(risk: DataFrame, keys: Sequence[str] = ("offer_id", "supplier")) -> DataFrame:
    """Keys, total and the seven risks."""
    return risk.select(*keys, "total_risk", *RISK_COLUMNS)


def explain_risks(risk: DataFrame, keys: Sequence[str] = ("offer_id", "supplier")) -> DataFrame:
    """One row per (offer, risk) with the risk's meaning.

    The meanings are a fixed seven-row table, so broadcasting it is bounded.
    """
    spark = risk.sparkSession
    meanings = spark.createDataFrame(
        [(c, RISK_LABELS[c], RISK_EXPLANATIONS[RISK_LABELS[c]]) for c in RISK_COLUMNS],
        "risk string, risk_name string, meaning string")
    long = risk.unpivot(list(keys), RISK_COLUMNS, "risk", "value")
    return long.join(F.broadcast(meanings), "risk", "left")


def red_flags(df: DataFrame, by: Sequence[str] | None = None, score: str = "score",
              risk_col: str = "total_risk", risk_limit: float = 0.7, tiebreak: str = "offer_id") -> DataFrame:
    """``[BEST]`` on the group's one highest score (ties: smallest
    ``tiebreak``), else ``[RISK]`` above the limit."""
    by = list(by or [])
    scored = F.when(F.col(score).isNotNull(), F.struct(-F.col(score), F.col(tiebreak)))
    best = {"_best": F.min_by(F.col(tiebreak), scored), "_smax": F.max(score)}
    group = Window.partitionBy(*by)
    out = both(df, by, lambda rows: rows.select("*", *[c.over(group).alias(n) for n, c in best.items()]),
               lambda rows: attach(rows, group_stats(rows, by, *[c.alias(n) for n, c in best.items()]), by))
    status = (F.when((F.col(score) == F.col("_smax")) & (F.col(tiebreak) == F.col("_best")), F.lit("[BEST]"))
               .when(F.col(risk_col) > F.lit(risk_limit), F.lit("[RISK]"))
               .otherwise(F.lit("")))
    return out.withColumn("status", status).drop("_smax", "_best")


def comparison_summary(risk: DataFrame, by: Sequence[str] | None = None, key: str = "offer_id",
                       delivery: str = "delivery_time_days", quality: str = "quality") -> DataFrame:
    """Supplier, Score, Risk, Price, Delivery, Quality, Status per offer.

    The scored frame already holds every column, so this is a projection: a
    repeated key keeps its rows as they are."""
    by = list(by or [])
    out = risk.select(key, *by, "supplier", "score", F.col("total_risk").alias("risk"), "price",
                      F.col(delivery).alias("delivery"), F.col(quality).alias("quality"))
    return red_flags(out, by, score="score", risk_col="risk", tiebreak=key)
