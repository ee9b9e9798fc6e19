"""The reference's two flows as functions.

Flow 1 (upload -> ranked CSV): read, keep compliant offers, coerce numbers,
pick variables, weight, normalise, score, rank, optionally write.
Flow 2 (ranked -> analytics): anomalies, PCA, price importance, risk.
Flow 3 (scored -> what-if): top variables, simulated change, impact, sensitivity.

Every step is one library operator; the cleaned offers are persisted once
because every later step reads them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from offerscore.session import track
from offerscore.operators import prepare as P
from offerscore.operators import scoring as S
from offerscore.sources.offers import read_offers, write_results


@dataclass
class Ranking:
    original: DataFrame
    cleaned: DataFrame
    ranked: DataFrame
    variables: list[str]
    weights: dict[str, float]
    missing: DataFrame = field(repr=False, default=None)


def rank_pipeline(spark: SparkSession, source: str | DataFrame, scenario: str = "equal",
                  weights: Mapping[str, float] | None = None, by: Sequence[str] | None = None,
                  fmt: str = "csv", rest_share: float = 0.2, out_path: str | None = None,
                  keys: Sequence[str] = ("offer_id",)) -> Ranking:
    """Flow 1.  ``weights`` (custom scenario) are rescaled when they do not sum to 1."""
    by = list(by or [])
    original = read_offers(spark, source, fmt) if isinstance(source, str) else source
    cleaned = track(P.coerce_numeric(P.compliant_only(original), keep=[*keys, *by])
                    .persist(StorageLevel.MEMORY_AND_DISK))
    variables = P.variable_list(cleaned, exclude=[*keys, *by])
    if not variables:
        raise ValueError("no numeric variables to score")
    w = S.custom_weights(weights) if weights else S.scenario_weights(variables, scenario, rest_share)
    ranked = S.rank_offers(S.score_offers(cleaned, variables, w, by=by), by=by)
    if out_path:
        write_results(ranked, variables, out_path, keys=(*keys, *by, "supplier", "score"))
    return Ranking(original, cleaned, ranked, variables, w, P.missing_report(cleaned, variables))


def analytics(ranking: Ranking, by: Sequence[str] | None = None, key: str = "offer_id") -> dict[str, DataFrame]:
    """Flow 2: the advanced-analytics tables, key-aligned (not by position, quirk Q6), for the
    table or for each group of ``by``; ``outlier_view`` has the two variables to plot."""
    from offerscore.operators.iforest import anomalies, outlier_view
    from offerscore.operators.ml import complete_rows, pca2, pca_by, price_importance
    from offerscore.operators.risk import risk_scores, risk_table
    by, data, variables = list(by or []), ranking.cleaned, ranking.variables
    labelled = anomalies(data, variables, key=key, by=by)
    out = {"anomalies": labelled, "outlier_view": outlier_view(labelled, variables, ids=(*by, key, "supplier"))}
    out["pca"] = pca_by(data, variables, by, keys=(key, "supplier")) if by else pca2(data, variables, keys=(key, "supplier"))[0]
    out["pca_dropped"] = complete_rows(data, variables)[1]
    if "price" in variables:
        out["price_importance"] = price_importance(data, variables, by=by, key=key)
    out["risk"] = risk_table(risk_scores(ranking.ranked, by=by), keys=(key, "supplier"))
    return out


def whatif_flow(scored: DataFrame, variables: Sequence[str], supplier: str, changes: Mapping[str, float],
                by: Sequence[str] | None = None, top: int = 5, points: int = 5, **forest) -> dict[str, DataFrame]:
    """Flow 3: the ``top`` variables that matter most for the score (M5, K5) are those that
    the change is re-scored by (X1-X3), compared with the table as it is (X4) and varied (X5).

    Returns ``importance``, ``result`` (the re-ranked table), ``supplier_result``, ``impact``
    and ``sensitivity``.  ``forest`` goes to the importances (trees, max_depth, ...).  A
    variable of ``changes`` that is not among the top ones does not move the score.
    """
    from offerscore.operators import whatif as X
    from offerscore.operators.ml import score_importance
    scored = track(scored.persist(StorageLevel.MEMORY_AND_DISK))
    # one list of variables for all tenders, as the change is the same for all
    importance = track(score_importance(scored, variables, top=top, **forest).persist(StorageLevel.MEMORY_AND_DISK))
    names = [r["variable"] for r in importance.orderBy("rank").collect()]       # at most ``top``
    after = X.whatif(scored, supplier, changes, names, by=by)
    before = X.whatif(scored, supplier, {}, names, by=by)
    return {"importance": importance, "result": after, "supplier_result": X.supplier_result(after, supplier, by=by),
            "impact": X.whatif_impact(before, after, by=by), "sensitivity": X.sensitivity(scored, supplier, names, points=points, by=by)}
