"""Named queries over the offers view: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query runs the library's operators on the whole offers view derived
from the driver tables (FIXTURES section 3), scoring every tender at once
(``by=["tender_id"]``) unless the operator is a whole-table one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscore.functions.exprs import r6
from offerscore.operators import prepare as P
from offerscore.operators import scoring as S
from offerscore.session import track
from offerscore.sources.view import offers_view

BY = ["tender_id"]
KEYS = ["offer_id", "tender_id", "supplier"]

# Fixed query parameters (not data-derived).
CUSTOM_WEIGHTS = {"price": 0.3, "discount": 0.05, "quantity": 0.0, "shipping_cost": 0.05,
                  "lead_time_days": 0.05, "delivery_time_days": 0.2, "quality": 0.25,
                  "technical": 0.05, "warranty_months": 0.15, "experience_years": 0.1}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned offers for queries that read them once: column pruning reaches the scan."""
    return P.compliant_only(offers_view(spark, sf))


def _even(rows: DataFrame) -> DataFrame:
    return track(rows.hint("rebalance", F.col("offer_id")).persist(StorageLevel.MEMORY_AND_DISK))


def compliant(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned offers, persisted for queries that read them from several branches, in
    even partitions (a source may come in few or uneven files)."""
    return _even(offers(spark, sf))


def narrow(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and numeric columns of the cleaned offers."""
    rows = offers(spark, sf)
    return rows.select(*KEYS, *P.numeric_columns(rows, exclude=KEYS))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """The same, persisted, for queries that need the keys and numeric columns only: no pruning reaches
    behind a persisted frame, so the texts would be shuffled and stored for nothing."""
    return _even(narrow(spark, sf))


def _scored(spark, sf, scenario=None, weights=None, rest_share=0.2):
    c = measured(spark, sf)
    variables = P.variable_list(c)
    w = S.custom_weights(weights) if weights else S.scenario_weights(variables, scenario, rest_share)
    return S.score_offers(c, variables, w, by=BY), variables, w


def _ranked(spark, sf, scenario=None, weights=None, rest_share=0.2):
    """Ranked keys and scores: only what a query returns is ordered and written."""
    scored, variables, w = _scored(spark, sf, scenario, weights, rest_share)
    return S.rank_offers(scored.select(*KEYS, "score"), by=BY), variables, w


def _rank_out(ranked: DataFrame) -> DataFrame:
    return ranked.select(*KEYS, r6(F.col("score")).alias("score"), "rank")


@query("rank_equal")
def rank_equal(spark, sf):
    return _rank_out(_ranked(spark, sf, "equal")[0])


@query("rank_price_focused")
def rank_price_focused(spark, sf):
    return _rank_out(_ranked(spark, sf, "price-focused")[0])


@query("rank_quality_focused")
def rank_quality_focused(spark, sf):
    return _rank_out(_ranked(spark, sf, "quality-focused")[0])


@query("rank_quality_focused_documented")
def rank_quality_focused_documented(spark, sf):
    """The documented 0.4 share for the non-focus variables (quirk Q1)."""
    return _rank_out(_ranked(spark, sf, "quality-focused", rest_share=0.4)[0])


@query("rank_custom")
def rank_custom(spark, sf):
    return _rank_out(_ranked(spark, sf, weights=CUSTOM_WEIGHTS)[0])


# ---------------------------------------------------------------- scoring views
@query("best_offer")
def best_offer(spark, sf):
    scored, _, _ = _scored(spark, sf, "equal")
    best = S.best_offer(scored.select(*KEYS, "score"), by=BY)
    return best.select("tender_id", "offer_id", "supplier", r6(F.col("score")).alias("score"), "highlight")


@query("best_flags")
def best_flags(spark, sf):
    """Every ranked offer, flagged Best or Other."""
    return S.flag_best(_ranked(spark, sf, "equal")[0]).select(*KEYS, "rank", "highlight")


@query("cheapest_first")
def cheapest_first(spark, sf):
    out = S.cheapest_first(offers(spark, sf).select(*KEYS, "price"), by=BY)
    return out.select(*KEYS, "price", "price_order")


@query("by_lead_time")
def by_lead_time(spark, sf):
    out = S.cheapest_first(offers(spark, sf).select(*KEYS, "lead_time_days"), by=BY, name="lead_time_order", col="lead_time_days")
    return out.select(*KEYS, "lead_time_days", "lead_time_order")


@query("score_composition")
def score_composition(spark, sf):
    c = measured(spark, sf)
    variables = P.variable_list(c)
    w = S.scenario_weights(variables, "equal")
    scored = S.score_offers(c, variables, w, by=BY)
    comp = S.score_composition(scored, variables, w, ids=KEYS)
    return comp.select(*KEYS, "variable", r6(F.col("normalized")).alias("normalized"),
                       r6(F.col("contribution")).alias("contribution"))


@query("supplier_profile")
def supplier_profile(spark, sf):
    prof = S.supplier_profile(compliant(spark, sf), by=BY, ids=KEYS)
    return prof.select(*KEYS, "variable", r6(F.col("value")).alias("value"))


@query("supplier_profile_ranked")
def supplier_profile_ranked(spark, sf):
    """The scoring form: every ranked variable, as the ranking normalises it."""
    c = compliant(spark, sf)
    prof = S.supplier_profile(c, {v: v == "price" for v in P.variable_list(c)}, by=BY, ids=KEYS)
    return prof.select(*KEYS, "variable", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------- preparation
SUBSET = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000003"]
RANGE_BOUNDS = {"price": (5000.0, 60000.0), "quality": (60.0, 95.0), "delivery_time_days": (5.0, 40.0)}


@query("compliant_only")
def compliant_only(spark, sf):
    return offers(spark, sf).select(*KEYS, "compliance")


@query("coerce_numeric")
def coerce_numeric(spark, sf):
    dirty = offers_view(spark, sf, dirty=True)
    return P.coerce_numeric(dirty).select("offer_id", "price", "quality", "remarks", "country")


@query("missing_report")
def missing_report(spark, sf):
    c = compliant(spark, sf)
    return P.missing_report(c, P.variable_list(c))


@query("variable_ranges")
def variable_ranges(spark, sf):
    from offerscore.operators.summary import variable_ranges as vr
    c = compliant(spark, sf)
    return vr(c, P.variable_list(c), by=BY)


@query("range_filter")
def range_filter(spark, sf):
    from offerscore.operators.filters import range_filter as rf
    out = rf(compliant(spark, sf), RANGE_BOUNDS)
    return out.select(*KEYS, "price", "quality", "delivery_time_days")


@query("supplier_subset")
def supplier_subset(spark, sf):
    from offerscore.operators.filters import supplier_subset as ss
    return ss(compliant(spark, sf), SUBSET).select(*KEYS, "price")


@query("total_cost")
def total_cost(spark, sf):
    from offerscore.operators.summary import total_cost as tc
    return tc(offers(spark, sf)).select(*KEYS, r6(F.col("total_cost")).alias("total_cost"))


@query("missing_certifications")
def missing_certifications(spark, sf):
    return P.missing_certifications(offers(spark, sf)).select("offer_id", "supplier", "certifications")


@query("numeric_table")
def numeric_table(spark, sf):
    return P.numeric_table(compliant(spark, sf), keys=("offer_id", "tender_id"))


@query("compliance_overview")
def compliance_overview(spark, sf):
    return P.compliance_overview(offers(spark, sf))


@query("terms_overview")
def terms_overview(spark, sf):
    return P.terms_overview(offers(spark, sf))


@query("view_columns")
def view_columns(spark, sf):
    return P.view_columns(offers(spark, sf), "lead_delivery")


def _view_query(view: str):
    @query(f"view_{view}")
    def run(spark, sf):
        return P.view_columns(offers(spark, sf), view)
    run.__doc__ = f"The projection behind the {view} view."


for _view in ("price_quality", "price_quality_delivery", "price_delivery", "experience", "warranty", "price_points"):
    _view_query(_view)


@query("view_experience_score")
def view_experience_score(spark, sf):
    scored, _ = _scored_raw(spark, sf)                  # the raw columns beside the score: no join by id
    return P.view_columns(scored.withColumn("score", r6(F.col("score"))), "experience_score")


@query("view_price_technical")
def view_price_technical(spark, sf):
    """A table without quality: the technical mark takes its place."""
    return P.view_columns(offers(spark, sf).drop("quality"), "price_quality")


@query("supplier_row")
def supplier_row(spark, sf):
    row = P.supplier_row(offers(spark, sf), SUBSET[0], by=BY)
    return row.select("tender_id", "offer_id", "supplier", "price", "quality", "delivery_time_days")


# ---------------------------------------------------------------- summaries
def _summary():
    from offerscore.operators import summary as A
    return A


@query("price_summary")
def price_summary(spark, sf):
    out = _summary().price_summary(compliant(spark, sf), by=BY, decimals=10)
    return out.select("tender_id", "price_min", "price_max", r6(F.col("price_mean")).alias("price_mean"),
                      r6(F.col("price_median")).alias("price_median"),
                      r6(F.col("price_std")).alias("price_std"))


@query("delivery_kpis")
def delivery_kpis(spark, sf):
    out = _summary().delivery_kpis(offers(spark, sf), by=BY)
    return out.select("tender_id", r6(F.col("avg_lead_time_days")).alias("avg_lead_time_days"),
                      "min_delivery_time_days")


@query("compliance_counts")
def compliance_counts(spark, sf):
    """Counted on the unfiltered offers (quirk Q9)."""
    out = _summary().compliance_counts(offers_view(spark, sf))
    return out.select("compliance", "count", r6(F.col("share_pct")).alias("share_pct"))


@query("supplier_type_counts")
def supplier_type_counts(spark, sf):
    out = _summary().supplier_type_counts(compliant(spark, sf))
    return out.select("supplier_type", "count", r6(F.col("share_pct")).alias("share_pct"))


@query("payment_terms_kpis")
def payment_terms_kpis(spark, sf):
    return _summary().payment_terms_kpis(offers(spark, sf), by=BY)


@query("distinct_supplier_types")
def distinct_supplier_types(spark, sf):
    return _summary().distinct_supplier_types(offers(spark, sf), by=BY)


@query("supplier_sketch")
def supplier_sketch(spark, sf):
    """Estimated suppliers of each country and type, from sketches of the tenders merged by union."""
    A = _summary()
    by_tender = A.distinct_sketch(offers(spark, sf), "supplier", by=["tender_id", "country", "supplier_type"])
    return A.merge_sketches(by_tender, by=["country", "supplier_type"]).select("country", "supplier_type", "n_distinct")


@query("compliance_by_supplier")
def compliance_by_supplier(spark, sf):
    return _summary().compliance_by_supplier(offers_view(spark, sf))


@query("correlation")
def correlation(spark, sf):
    c = compliant(spark, sf)
    out = _summary().correlation(c, P.variable_list(c))
    return out.select("var_a", "var_b", r6(F.col("corr")).alias("corr"))


@query("correlation_by_tender")
def correlation_by_tender(spark, sf):
    """Correlations of four variables in each tender."""
    out = _summary().correlation(compliant(spark, sf), CORRELATED, by=BY)
    return out.select("tender_id", "var_a", "var_b", r6(F.col("corr")).alias("corr"))


CORRELATED = ["price", "quality", "delivery_time_days", "warranty_months"]


@query("pareto")
def pareto(spark, sf):
    out = _summary().pareto(offers(spark, sf).select(*KEYS, "price"), by=BY)
    return out.select("tender_id", "supplier", r6(F.col("price")).alias("price"), "position",
                      r6(F.col("cum_pct")).alias("cum_pct"))


@query("box_stats")
def box_stats(spark, sf):
    out = _summary().box_stats(compliant(spark, sf), by=BY)
    cols = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]
    return out.select("tender_id", *[r6(F.col(c)).alias(c) for c in cols], "n_outliers")


@query("price_density")
def price_density(spark, sf):
    """The violin's curve of each tender's prices."""
    out = _summary().density(compliant(spark, sf), by=BY)
    return out.select("tender_id", "point", r6(F.col("x")).alias("x"), r6(F.col("height")).alias("height"),
                      r6(F.col("bandwidth")).alias("bandwidth"), "n")


@query("price_histogram")
def price_histogram(spark, sf):
    out = _summary().histogram(compliant(spark, sf), "price", bins=10, by=BY, decimals=10)
    return out.select("tender_id", "bin", "count", r6(F.col("mean")).alias("mean"),
                      r6(F.col("bin_low")).alias("bin_low"), r6(F.col("bin_high")).alias("bin_high"))


@query("supplier_totals")
def supplier_totals(spark, sf):
    out = _summary().supplier_totals(offers(spark, sf), "price", ascending=True, by=BY)
    return out.select("tender_id", "supplier", r6(F.col("total_price")).alias("total_price"), "position")


def _totals_query(col: str, ascending: bool):
    @query(f"supplier_totals_{col}")
    def run(spark, sf):
        out = _summary().supplier_totals(offers(spark, sf), col, ascending=ascending, by=BY)
        return out.select("tender_id", "supplier", r6(F.col(f"total_{col}")).alias(f"total_{col}"), "position")
    run.__doc__ = f"Sum of {col} per supplier, {'smallest' if ascending else 'largest'} first."


for _col, _ascending in (("quality", False), ("lead_time_days", True), ("delivery_time_days", True), ("experience_years", False)):
    _totals_query(_col, _ascending)


@query("supplier_totals_risk")
def supplier_totals_risk(spark, sf):
    """Sum of the total risk per supplier, smallest first."""
    _, risk = _risk(spark, sf, "raw")
    out = _summary().supplier_totals(risk.withColumn("total_risk", r6(F.col("total_risk"))), "total_risk", ascending=True, by=BY)
    return out.select("tender_id", "supplier", r6(F.col("total_total_risk")).alias("total_risk"))


@query("distinct_suppliers")
def distinct_suppliers(spark, sf):
    return _summary().distinct_suppliers(offers(spark, sf), by=BY)


# ---------------------------------------------------------------- windows
@query("pct_rank")
def pct_rank(spark, sf):
    from offerscore.operators.stats import pct_rank as pr
    out = pr(compliant(spark, sf), BY, "price", "price_pct_rank")
    return out.select("offer_id", "tender_id", r6(F.col("price_pct_rank")).alias("price_pct_rank"))


@query("min_rank")
def min_rank(spark, sf):
    from offerscore.operators.stats import min_rank as mr
    out = mr(compliant(spark, sf), BY, "quality", "quality_rank")
    return out.select("offer_id", "tender_id", "quality", "quality_rank")


@query("zscore")
def zscore(spark, sf):
    from offerscore.operators.stats import zscore as z
    out = z(compliant(spark, sf), BY, "price", "price_z")
    return out.select("offer_id", "tender_id", r6(F.col("price_z")).alias("price_z"))


@query("duplicated")
def duplicated(spark, sf):
    from offerscore.operators.stats import is_duplicated
    out = is_duplicated(compliant(spark, sf), BY, F.bround(F.col("price"), -2), "price_dup")
    return out.select("offer_id", "tender_id", "price_dup")


# ---------------------------------------------------------------- risk
def _risk(spark, sf, mode="raw"):
    from offerscore.operators import risk as R
    c = compliant(spark, sf)
    variables = P.variable_list(c)
    w = S.scenario_weights(variables, "equal")
    if mode == "raw":
        src = S.score_offers(c, variables, w, by=BY, suffix="_n")
    else:  # the reference's call on the ranked (normalised, inverted) table, quirk Q5
        src = S.score_offers(c, variables, w, by=BY)
    return R, R.risk_scores(src, by=BY)


def _risk_out(risk: DataFrame) -> DataFrame:
    from offerscore.operators.risk import RISK_COLUMNS
    return risk.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ["total_risk", *RISK_COLUMNS]])


@query("risk_raw")
def risk_raw(spark, sf):
    return _risk_out(_risk(spark, sf, "raw")[1])


@query("risk_ranked")
def risk_ranked(spark, sf):
    return _risk_out(_risk(spark, sf, "ranked")[1])


@query("risk_explained")
def risk_explained(spark, sf):
    R, risk = _risk(spark, sf, "raw")
    out = R.explain_risks(risk, keys=("offer_id", "supplier"))
    return out.select("offer_id", "supplier", "risk", r6(F.col("value")).alias("value"), "risk_name", "meaning")


@query("risk_table")
def risk_table(spark, sf):
    R, risk = _risk(spark, sf, "raw")
    out = R.risk_table(risk, keys=KEYS)
    return out.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ["total_risk", *R.RISK_COLUMNS]])


@query("red_flags")
def red_flags(spark, sf):
    R, risk = _risk(spark, sf, "raw")
    out = R.red_flags(risk, by=BY)
    return out.select(*KEYS, r6(F.col("score")).alias("score"), r6(F.col("total_risk")).alias("total_risk"),
                      "status")


@query("comparison_summary")
def comparison_summary(spark, sf):
    R, risk = _risk(spark, sf, "raw")
    out = R.comparison_summary(risk, by=BY)
    return out.select("offer_id", "tender_id", "supplier", r6(F.col("score")).alias("score"),
                      r6(F.col("risk")).alias("risk"), "price", "delivery", "quality", "status")


# ---------------------------------------------------------------- negotiation
K_WINNERS = 3


def _negotiation(spark, sf):
    from offerscore.operators import negotiation as G
    return G, G.negotiation_table(
        offers(spark, sf).select(*KEYS, "price", "quality", "delivery_time_days"), k=K_WINNERS, by=BY)


@query("negotiation_table")
def negotiation_table(spark, sf):
    _, t = _negotiation(spark, sf)
    return t.select(*KEYS, "price", "quality", "delivery_time_days", r6(F.col("score")).alias("score"),
                    "position", "winner")


@query("acceptance_threshold")
def acceptance_threshold(spark, sf):
    G, t = _negotiation(spark, sf)
    out = G.acceptance_threshold(t, by=BY)
    return out.select("tender_id", r6(F.col("threshold_score")).alias("threshold_score"),
                      F.concat_ws(", ", "winners").alias("winners"), "n_winners")


@query("negotiation_advice")
def negotiation_advice(spark, sf):
    G, t = _negotiation(spark, sf)
    out = G.negotiation_advice(t, by=BY)
    return out.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ("price_gap", "quality_gap", "delivery_gap")],
                      "advice")


@query("tradeoff")
def tradeoff(spark, sf):
    G, t = _negotiation(spark, sf)
    return G.tradeoff(t)


@query("negotiation_importance")
def negotiation_importance(spark, sf):
    """One forest for the whole table (rows-only check)."""
    from offerscore.operators.ml import negotiation_importance as ni
    from offerscore.operators.negotiation import negotiation_score
    return ni(negotiation_score(compliant(spark, sf)))


@query("negotiation_importance_by_tender")
def negotiation_importance_by_tender(spark, sf):
    """One forest for each tender (rows-only check)."""
    from offerscore.operators.ml import negotiation_importance as ni
    from offerscore.operators.negotiation import negotiation_score
    return ni(negotiation_score(offers(spark, sf)), by=BY)


# ---------------------------------------------------------------- what-if
WHATIF_SUPPLIER = SUBSET[0]
WHATIF_CHANGES = {"price": 1000.0, "quality": 100.0}
TOP_VARS = ["price", "quality", "warranty_months", "experience_years", "lead_time_days"]
NEG_VARS = ["price", "quality", "delivery_time_days"]


def _whatif(spark, sf, top=TOP_VARS, changes=WHATIF_CHANGES):
    from offerscore.operators import whatif as X
    return X, X.whatif(compliant(spark, sf), WHATIF_SUPPLIER, changes, top, by=BY)


@query("whatif")
def whatif(spark, sf):
    _, out = _whatif(spark, sf)
    return out.select(*KEYS, r6(F.col("score")).alias("score"), "rank")


@query("whatif_negotiation")
def whatif_negotiation(spark, sf):
    """Top variables within the negotiation inputs: the negotiation score path."""
    _, out = _whatif(spark, sf, top=NEG_VARS)
    return out.select(*KEYS, r6(F.col("score")).alias("score"), "rank")


@query("supplier_result")
def supplier_result(spark, sf):
    """The changed supplier's new score and best rank in each of its tenders."""
    X, out = _whatif(spark, sf)
    return X.supplier_result(out, WHATIF_SUPPLIER, by=BY).select("tender_id", r6(F.col("score")).alias("score"), "rank", "offer_id")


@query("whatif_impact")
def whatif_impact(spark, sf):
    from offerscore.operators import whatif as X
    out = X.impact(compliant(spark, sf), WHATIF_SUPPLIER, WHATIF_CHANGES, TOP_VARS, by=BY)
    return out.select("offer_id", "supplier", r6(F.col("score_before")).alias("score_before"),
                      r6(F.col("score_after")).alias("score_after"), "rank_before", "rank_after",
                      r6(F.col("score_change")).alias("score_change"), "rank_change")


@query("whatif_flow")
def whatif_flow(spark, sf):
    """Importances, change and impact in one flow: the five variables that matter most for the
    score re-score the change (MLlib random forest, rows-only check)."""
    from offerscore.plans.pipeline import whatif_flow as flow
    scored, variables = _scored_raw(spark, sf)
    out = flow(scored, variables, WHATIF_SUPPLIER, WHATIF_CHANGES, by=BY)["impact"]
    return out.select("offer_id", "supplier", "rank_before", "rank_after", r6(F.col("score_change")).alias("score_change"), "rank_change")


@query("sensitivity")
def sensitivity(spark, sf):
    from offerscore.operators.whatif import sensitivity as sens
    out = sens(compliant(spark, sf), WHATIF_SUPPLIER, TOP_VARS, points=3, by=BY)
    return out.select("tender_id", "variable", r6(F.col("value")).alias("value"),
                      r6(F.col("supplier_score")).alias("supplier_score"), "supplier_rank")


def _scored_raw(spark, sf):
    """Keys, variables and score.  Nothing is stored: a query's forest, or its what-if flow, keeps what it reads again."""
    c = narrow(spark, sf)
    variables = P.variable_list(c)
    w = S.scenario_weights(variables, "equal")
    return S.score_offers(c, variables, w, by=BY, suffix="_n").select(*KEYS, *variables, "score"), variables


@query("score_importance")
def score_importance(spark, sf):
    """Top-5 variables for the score, one forest for the whole table (rows-only check)."""
    from offerscore.operators.ml import score_importance as si
    scored, variables = _scored_raw(spark, sf)
    return si(scored, variables)


@query("score_importance_by_tender")
def score_importance_by_tender(spark, sf):
    """Top-5 variables for the score in each tender (rows-only check)."""
    from offerscore.operators.ml import score_importance as si
    scored, variables = _scored_raw(spark, sf)
    return si(scored, variables, by=BY)


# ---------------------------------------------------------------- ML
@query("pca2_two_vars")
def pca2_two_vars(spark, sf):
    from offerscore.operators.ml import pca2
    out, _ = pca2(compliant(spark, sf), ["price", "quality"])
    return out.select("offer_id", "supplier", r6(F.col("pc1")).alias("pc1"), r6(F.col("pc2")).alias("pc2"))


@query("pca2")
def pca2_all(spark, sf):
    """All variables on the whole table (rows-only check)."""
    from offerscore.operators.ml import pca2
    c = compliant(spark, sf)
    out, _ = pca2(c, P.variable_list(c))
    return out.select("offer_id", "supplier", r6(F.col("pc1")).alias("pc1"), r6(F.col("pc2")).alias("pc2"))


@query("pca2_by_tender")
def pca2_by_tender(spark, sf):
    """Price and quality on the principal components of each tender."""
    from offerscore.operators.ml import pca_by
    out = pca_by(compliant(spark, sf), ["price", "quality"], BY, keys=KEYS)
    return out.select(*KEYS, r6(F.col("pc1")).alias("pc1"), r6(F.col("pc2")).alias("pc2"))


@query("price_importance")
def price_importance(spark, sf):
    from offerscore.operators.ml import price_importance as pi
    c = compliant(spark, sf)
    return pi(c, P.variable_list(c))


@query("price_importance_by_tender")
def price_importance_by_tender(spark, sf):
    """The variables that explain the price in each tender (rows-only check)."""
    from offerscore.operators.ml import price_importance as pi
    c = offers(spark, sf)
    return pi(c, P.variable_list(c), by=BY)


def _bulk(spark, sf):
    """Offers with a target that is a step of the quantity: its importances are known."""
    return offers(spark, sf).withColumn("bulk", F.when(F.col("quantity") >= 25, 100.0).when(F.col("quantity") < 25, 1.0))


@query("step_importance")
def step_importance(spark, sf):
    """Importances of a step function: the first split settles it, whatever else varies."""
    from offerscore.operators.forest import importances
    out = importances(_bulk(spark, sf), "bulk", ["quantity", "quality", "technical", "delivery_time_days"])
    return out.select("variable", r6(F.col("importance")).alias("importance"), "rank", "n_rows", "n_dropped")


@query("step_importance_by_tender")
def step_importance_by_tender(spark, sf):
    """The same in each tender; a tender without the step has importances 0."""
    from offerscore.operators.forest import importances
    out = importances(_bulk(spark, sf), "bulk", ["quantity", "quality", "technical", "delivery_time_days"], by=BY)
    return out.select("tender_id", "variable", r6(F.col("importance")).alias("importance"), "rank", "n_rows", "n_dropped")


@query("anomalies")
def anomalies(spark, sf):
    """Isolation Forest over the whole table (rows-only check)."""
    from offerscore.operators.iforest import anomalies as an
    c = measured(spark, sf)
    out = an(c, P.variable_list(c))
    return out.select("offer_id", "supplier", r6(F.col("anomaly_score")).alias("anomaly_score"),
                      "anomaly", "anomaly_label")


@query("outlier_view")
def outlier_view(spark, sf):
    """The two variables that the outlier view plots, for every offer, with its label (rows-only check)."""
    from offerscore.operators.iforest import anomalies as an, outlier_view as view
    c = measured(spark, sf)
    variables = P.variable_list(c)
    return view(an(c, variables), variables)


@query("anomalies_by_tender")
def anomalies_by_tender(spark, sf):
    """One Isolation Forest per tender (rows-only check)."""
    from offerscore.operators.iforest import anomalies as an
    c = narrow(spark, sf)
    out = an(c, P.variable_list(c), by=BY)
    return out.select("offer_id", "tender_id", "supplier",
                      r6(F.col("anomaly_score")).alias("anomaly_score"), "anomaly", "anomaly_label")


@query("outliers")
def outliers(spark, sf):
    """The offers that the whole-table forest labels as outliers, with their variables (rows-only check)."""
    from offerscore.operators.iforest import anomalies as an, outliers as listed
    c = measured(spark, sf)
    variables = P.variable_list(c)
    return listed(an(c, variables)).select("offer_id", "supplier", r6(F.col("anomaly_score")).alias("anomaly_score"), *variables)


# ---------------------------------------------------------------- sources / sinks
@query("offers_csv_roundtrip")
def offers_csv_roundtrip(spark, sf):
    """Write the ranked results as CSV under the shared checkpoint folder and read them back."""
    from offerscore.session import scratch_dir
    from offerscore.sources.offers import read_offers, write_results
    scored, variables, _ = _scored(spark, sf, "equal")
    path = write_results(scored, variables, scratch_dir(spark, "csv"),
                         keys=("offer_id", "tender_id", "supplier", "score"), compression="gzip", **{"zlib.compress.level": "BEST_SPEED"})
    back = P.coerce_numeric(read_offers(spark, path), keep=("offer_id", "tender_id"))
    return back.select("offer_id", F.col("tender_id").cast("long").alias("tender_id"), "supplier",
                       r6(F.col("score")).alias("score"))


@query("offers_csv_split")
def offers_csv_split(spark, sf):
    """Offers with line breaks in quoted remarks, written as CSV and read back by many tasks."""
    from offerscore.session import scratch_dir
    from offerscore.sources.offers import read_offers
    path = scratch_dir(spark, "quoted")
    noted = offers(spark, sf).select("offer_id", "supplier", F.format_string('%s\n"%s", %s', "compliance_notes", "country", "delivery_terms").alias("remarks"),
                                     "payment_terms")
    noted.write.option("header", True).option("escape", '"').csv(path)
    return read_offers(spark, path, split=True)
