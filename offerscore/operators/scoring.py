"""Normalisation, weights, weighted score, ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscore.operators.stats import attach, both, group_stats, running

SCENARIOS = ("equal", "price-focused", "quality-focused")


def _norm_expr(c: Column, lo: Column, hi: Column, minimize: bool) -> Column:
    # a column with exactly one distinct value is 1.0 on every row, missing rows included
    span = hi - lo
    body = (hi - c) / span if minimize else (c - lo) / span
    return F.when(lo == hi, F.lit(1.0)).otherwise(body)


def _with_ranges(df: DataFrame, cols: Sequence[str], by: list[str]) -> DataFrame:
    """Add each column's min (``_mn_i``) and max (``_mx_i``) in its group: windows of ordinary groups, so that
    what follows by group needs no further exchange; one aggregate joined back for hot ones and the table."""
    ranges = {f"_{n}_{i}": f(c) for n, f in (("mn", F.min), ("mx", F.max)) for i, c in enumerate(cols)}

    def large(rows: DataFrame) -> DataFrame:
        return attach(rows, group_stats(rows, by, *[c.alias(n) for n, c in ranges.items()]), by)
    if not by:
        return large(df)
    group = Window.partitionBy(*by)
    return both(df, by, lambda rows: rows.select("*", *[c.over(group).alias(n) for n, c in ranges.items()]), large)


def minmax(df: DataFrame, cols: Sequence[str], minimize: Sequence[str] = ("price",),
           by: Sequence[str] | None = None, suffix: str = "") -> DataFrame:
    """Min-max scale each column within its group; minimised columns inverted.

    ``suffix=""`` replaces the columns in place.
    """
    by = list(by or [])
    mins = {c.lower() for c in minimize}
    out = _with_ranges(df, cols, by)
    for i, c in enumerate(cols):
        out = out.withColumn(c + suffix, _norm_expr(F.col(c), F.col(f"_mn_{i}"), F.col(f"_mx_{i}"),
                                                     c.lower() in mins))
    return out.drop(*[f"_mn_{i}" for i in range(len(cols))], *[f"_mx_{i}" for i in range(len(cols))])


def minmax_eps(df: DataFrame, cols: Sequence[str], by: Sequence[str] | None = None,
               suffix: str = "_norm", eps: float = 1e-9) -> DataFrame:
    """``(x - min) / (max - min + eps)``, never inverted (what-if rescoring)."""
    out = _with_ranges(df, cols, list(by or []))
    for i, c in enumerate(cols):
        lo, hi = F.col(f"_mn_{i}"), F.col(f"_mx_{i}")
        out = out.withColumn(c + suffix, (F.col(c) - lo) / (hi - lo + F.lit(eps)))
    return out.drop(*[f"_mn_{i}" for i in range(len(cols))], *[f"_mx_{i}" for i in range(len(cols))])


#: Variable that a focused scenario favours.
FOCUS = {"price-focused": "price", "quality-focused": "quality"}


def scenario_weights(variables: Sequence[str], scenario: str = "equal",
                     rest_share: float = 0.2, focus_weight: float = 0.6) -> dict[str, float]:
    """Equal weights, or ``focus_weight`` on the scenario's variable and ``rest_share``
    spread evenly over the others.  A table without that variable is weighted equally."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}")
    if not variables:
        raise ValueError("no variables to weight")
    others = [v for v in variables if v != FOCUS.get(scenario)]
    if len(others) == len(variables):
        return {v: 1 / len(variables) for v in variables}
    return {v: rest_share / len(others) if v in others else focus_weight for v in variables}


def custom_weights(weights: Mapping[str, float], tolerance: float = 0.01) -> dict[str, float]:
    """As given if they sum to 1 within ``tolerance``, else shares of their sum (all 0
    if that is not positive)."""
    total = float(sum(weights.values()))
    scale = 1.0 if abs(total - 1.0) <= tolerance else (1.0 / total if total > 0 else 0.0)
    return {v: w * scale for v, w in weights.items()}


def weighted_score(df: DataFrame, variables: Sequence[str], weights: Mapping[str, float],
                   name: str = "score") -> DataFrame:
    """Sum of value x weight; a missing value gives a missing score."""
    if not variables:
        raise ValueError("no variables to score")
    expr = None
    for v in variables:
        term = F.col(f"`{v}`") * F.lit(float(weights.get(v, 0.0)))
        expr = term if expr is None else expr + term
    return df.withColumn(name, expr)


def score_offers(df: DataFrame, variables: Sequence[str], weights: Mapping[str, float],
                 by: Sequence[str] | None = None, minimize: Sequence[str] = ("price",),
                 suffix: str = "") -> DataFrame:
    """N1 + N5.  ``suffix=""`` replaces the variables by their normalised values
    (the reference's ranked table); an input ``score`` variable is then scored
    as ``score_norm`` so the final ``score`` does not overwrite it (quirk Q3).
    A non-empty suffix keeps the raw columns next to ``<v><suffix>``."""
    out = minmax(df, variables, minimize=minimize, by=by, suffix=suffix)
    vars_ = [v + suffix for v in variables]
    w = {v + suffix: weights.get(v, 0.0) for v in variables}
    if not suffix and "score" in vars_:
        out = out.withColumnRenamed("score", "score_norm")
        vars_ = ["score_norm" if v == "score" else v for v in vars_]
        w["score_norm"] = w.pop("score")
    return weighted_score(out, vars_, w)


def score_order(score: str = "score", tiebreak: str = "offer_id") -> list[Column]:
    return [F.col(score).desc_nulls_last(), F.col(tiebreak).asc()]


def rank_offers(df: DataFrame, by: Sequence[str] | None = None, score: str = "score",
                name: str = "rank", tiebreak: str = "offer_id") -> DataFrame:
    """Position by score descending, missing last, within each group."""
    return running(df, by, score_order(score, tiebreak), rn=name)


def best_offer(df: DataFrame, by: Sequence[str] | None = None, score: str = "score",
               tiebreak: str = "offer_id") -> DataFrame:
    """The first offer per group after sorting by score (missing last, ties
    on ``tiebreak``).  One ``min_by`` aggregate over the key
    ``(score is null, -score, tiebreak)``: partial aggregation keeps one
    candidate per group and map task, so a hot tender costs no sort."""
    by = list(by or [])
    other = [c for c in df.columns if c not in by]
    pick = F.min_by(F.struct(*[F.col(f"`{c}`") for c in other]),
                    F.struct(F.col(score).isNull(), -F.col(score), F.col(tiebreak)))
    best = (df.groupBy(*by).agg(pick.alias("_best")) if by else df.agg(pick.alias("_best")))
    return best.select(*by, "_best.*").withColumn("highlight", F.lit("Best"))


def flag_best(ranked: DataFrame, rank_col: str = "rank") -> DataFrame:
    """N7 on a ranked table: ``Best`` on rank 1, ``Other`` elsewhere."""
    return ranked.withColumn("highlight", F.when(F.col(rank_col) == 1, "Best").otherwise("Other"))


def score_composition(scored: DataFrame, variables: Sequence[str], weights: Mapping[str, float],
                      ids: Sequence[str] = ("offer_id", "supplier")) -> DataFrame:
    """Per offer and variable, normalised value x weight (long format)."""
    long = scored.unpivot(list(ids), list(variables), "variable", "normalized")
    wmap = F.create_map(*[x for v in variables for x in (F.lit(v), F.lit(float(weights.get(v, 0.0))))])
    return long.withColumn("weight", wmap[F.col("variable")]) \
        .withColumn("contribution", F.col("normalized") * F.col("weight"))


# The variables of the dashboard's radar, and whether a small value is good.
DASHBOARD_PROFILE = {"price": True, "delivery_time_days": True, "warranty_months": False, "quality": False}


def supplier_profile(df: DataFrame, cols: Mapping[str, bool] | None = None,
                     by: Sequence[str] | None = None,
                     ids: Sequence[str] = ("offer_id", "supplier")) -> DataFrame:
    """Normalised values in long format; ``cols`` maps column -> minimised."""
    cols = dict(cols or DASHBOARD_PROFILE)
    present = [c for c in cols if c in df.columns]
    if len(present) < 3:
        raise ValueError("a supplier profile needs at least 3 variables")
    norm = minmax(df, present, minimize=[c for c in present if cols[c]], by=by)
    return norm.unpivot(list(ids), present, "variable", "value")


def cheapest_first(df: DataFrame, by: Sequence[str] | None = None, name: str = "price_order",
                   col: str = "price", tiebreak: str = "offer_id") -> DataFrame:
    """K1 (and K2 with ``col="lead_time_days"``): ascending position per group."""
    return running(df, by, [F.col(col).asc_nulls_last(), F.col(tiebreak).asc()], rn=name)
