"""Golden values on the reference's 7-row sample (FIXTURES.md section 1)."""

import pytest

from offerscore.operators import negotiation as G
from offerscore.operators import prepare as P
from offerscore.operators import risk as R
from offerscore.operators import scoring as S
from offerscore.operators import summary as A

EXPECTED_VARS = ["price", "discount", "quantity", "min_order_quantity", "lead_time_days", "quality",
                 "technical", "warranty_months", "delivery_time_days", "shipping_cost", "experience_years",
                 "score"]


def by_letter(df, col):
    return {r["offer_id"]: r[col] for r in df.select("offer_id", col).collect()}


def approx(d, expected, tol=1e-6):
    assert set(d) == set(expected), (d, expected)
    for k, v in expected.items():
        assert d[k] == pytest.approx(v, abs=tol), (k, d[k], v)


def test_filter_and_variables(cleaned):
    assert sorted(r["offer_id"] for r in cleaned.collect()) == list("ACDEG")
    assert P.variable_list(cleaned) == EXPECTED_VARS
    # text columns the reference would destroy stay text (quirk Q4)
    assert dict(cleaned.dtypes)["country"] == "string"


@pytest.mark.parametrize("scenario,rest,expected", [
    ("equal", 0.2, {"G": 0.752570, "D": 0.554293, "A": 0.499116, "E": 0.320103, "C": 0.278373}),
    ("price-focused", 0.2, {"A": 0.690716, "E": 0.384992, "G": 0.285409, "C": 0.254675, "D": 0.120937}),
    ("price-focused", 0.4, {"A": 0.781433, "G": 0.445819, "E": 0.444984, "C": 0.309351, "D": 0.241873}),
    ("quality-focused", 0.2, {"G": 0.746015, "D": 0.508815, "E": 0.263780, "A": 0.205868, "C": 0.060736}),
    ("quality-focused", 0.4, {"G": 0.892031, "D": 0.617631, "E": 0.327560, "A": 0.311736, "C": 0.121472}),
])
def test_scenarios(cleaned, scenario, rest, expected):
    variables = P.variable_list(cleaned)
    w = S.scenario_weights(variables, scenario, rest)
    ranked = S.rank_offers(S.score_offers(cleaned, variables, w))
    approx(by_letter(ranked, "score"), expected)
    order = [r["offer_id"] for r in ranked.orderBy("rank").collect()]
    assert order == list(expected)


def test_normalised_price_and_delivery(cleaned):
    n = S.minmax(cleaned, ["price", "delivery_time_days"], minimize=["price", "delivery_time_days"])
    approx(by_letter(n, "price"), {"A": 1, "C": 0.333333, "D": 0, "E": 0.541667, "G": 0.208333})
    approx(by_letter(n, "delivery_time_days"), {"A": 0.818182, "C": 1, "D": 0, "E": 0.454545, "G": 0.272727})


def _flags(risk):
    return {r["offer_id"]: r for r in risk.collect()}


def test_risk_raw_price_with_equal_score(cleaned):
    variables = P.variable_list(cleaned)
    src = S.score_offers(cleaned, variables, S.scenario_weights(variables, "equal"), suffix="_n")
    risk = _flags(R.risk_scores(src))
    drip = {"A": 0, "C": 0.666667, "D": 0.333333, "E": 0.305556, "G": 0}
    total = {"A": 0.142857, "C": 0.238095, "D": 0.190476, "E": 0.186508, "G": 0.142857}
    for k in "ACDEG":
        assert risk[k]["drip_pricing_risk"] == pytest.approx(drip[k], abs=1e-6)
        assert risk[k]["total_risk"] == pytest.approx(total[k], abs=1e-6)
        assert risk[k]["bid_similarity_risk"] == 1.0
        for c in ("lowball_risk", "drip_pricing_flag", "signaling_risk", "cover_bid_risk", "decoy_bid_risk"):
            assert risk[k][c] == 0.0


def test_risk_on_ranked_table(cleaned):
    variables = P.variable_list(cleaned)
    ranked = S.score_offers(cleaned, variables, S.scenario_weights(variables, "equal"))
    risk = _flags(R.risk_scores(ranked))
    low = {"G": 0.5, "D": 1.0, "A": 0, "E": 0, "C": 0.2}
    drip = {"G": 0, "D": 0, "A": 0.833333, "E": 0.361111, "C": 0.333333}
    total = {"G": 0.214286, "D": 0.285714, "A": 0.261905, "E": 0.194444, "C": 0.219048}
    for k in "ACDEG":
        assert risk[k]["lowball_risk"] == pytest.approx(low[k], abs=1e-6)
        assert risk[k]["drip_pricing_risk"] == pytest.approx(drip[k], abs=1e-6)
        assert risk[k]["total_risk"] == pytest.approx(total[k], abs=1e-6)


def test_risk_all_rows_input_score(raw_all):
    risk = _flags(R.risk_scores(raw_all))
    drip = {"A": 0, "B": 0, "C": 0.390244, "D": 0.250871, "E": 0.191638, "F": 0.571429, "G": 0.066202}
    cover = {"A": 0, "B": 1, "C": 0, "D": 0, "E": 0, "F": 1, "G": 0}
    total = {"A": 0.142857, "B": 0.285714, "C": 0.198606, "D": 0.178696, "E": 0.170234, "F": 0.367347,
             "G": 0.152315}
    for k in "ABCDEFG":
        assert risk[k]["drip_pricing_risk"] == pytest.approx(drip[k], abs=1e-6)
        assert risk[k]["cover_bid_risk"] == cover[k]
        assert risk[k]["total_risk"] == pytest.approx(total[k], abs=1e-6)


def test_negotiation(cleaned):
    t = G.negotiation_table(cleaned, k=3)
    approx(by_letter(t, "score"), {"A": 0.059259, "E": 0.055235, "G": 0.055054, "C": 0.054999, "D": 0.051463})
    th = G.acceptance_threshold(t).first()
    assert th["winners"] == ["Supplier A", "Supplier E", "Supplier G"]
    assert th["threshold_score"] == pytest.approx(0.055054, abs=1e-6)
    adv = {r["offer_id"]: r["advice"] for r in G.negotiation_advice(t).collect()}
    assert adv["A"].startswith("Supplier A: increase quality by 5.00")
    assert "reduce price by €55.00" in adv["E"]


def test_price_summary_and_kpis(cleaned, raw_all):
    s = A.price_summary(cleaned).first()
    assert (s["price_min"], s["price_max"], s["price_mean"], s["price_median"]) == (1000, 1120, 1070, 1080)
    assert s["price_std"] == pytest.approx(45.689167, abs=1e-6)
    k = A.delivery_kpis(cleaned).first()
    assert (k["avg_lead_time_days"], k["min_delivery_time_days"]) == (34.0, 33)
    from offerscore.operators.stats import percentiles
    assert percentiles(raw_all, [], "price", {"p75": 0.75}).first()["p75"] == 1147.5


def test_pareto_total_cost_correlation(cleaned):
    p = {r["supplier"][-1]: r["cum_pct"] for r in A.pareto(cleaned).collect()}
    approx(p, {"D": 20.934579, "G": 41.401869, "C": 61.588785, "E": 81.308411, "A": 100})
    approx(by_letter(A.total_cost(cleaned), "total_cost"), {"A": 1050, "C": 1140, "D": 1230, "E": 1140, "G": 1180})
    corr = {(r["var_a"], r["var_b"]): r["corr"] for r in
            A.correlation(cleaned, ["price", "quality", "lead_time_days"]).collect()}
    assert corr[("price", "quality")] == pytest.approx(0.568006, abs=1e-6)
    assert corr[("price", "lead_time_days")] == pytest.approx(0.671599, abs=1e-6)
    assert corr[("quality", "price")] == corr[("price", "quality")]


def test_counts_and_terms(sample, cleaned):
    cc = {r["compliance"]: (r["count"], r["share_pct"]) for r in A.compliance_counts(sample).collect()}
    assert cc["Yes"][0] == 5 and cc["No"][0] == 2
    kp = A.payment_terms_kpis(cleaned).first()
    assert (kp["top_payment_term"], kp["top_payment_term_count"], kp["n_payment_terms"]) == ("Net 30", 3, 3)
    assert A.distinct_supplier_types(cleaned).first()["n_supplier_types"] == 2


def test_red_flags(cleaned):
    variables = P.variable_list(cleaned)
    src = S.score_offers(cleaned, variables, S.scenario_weights(variables, "equal"), suffix="_n")
    out = {r["offer_id"]: r["status"] for r in R.red_flags(R.risk_scores(src), risk_limit=0.2).collect()}
    assert out["G"] == "[BEST]"
    assert out["C"] == "[RISK]"
    assert out["A"] == ""
