"""Properties on the driver's smallest tables (sf0.001 offers view)."""

import pytest
from pyspark.sql import functions as F

from offerscore.operators import prepare as P
from offerscore.operators import risk as R
from offerscore.operators import scoring as S
from offerscore.operators import summary as A
from offerscore.sources.view import offers_view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def offers(spark):
    c = P.compliant_only(offers_view(spark, SF)).cache()
    return c


@pytest.fixture(scope="module")
def variables(offers):
    return P.variable_list(offers)


def test_scores_bounded_and_composition_sums(offers, variables):
    w = S.scenario_weights(variables, "quality-focused")
    scored = S.score_offers(offers, variables, w, by=["tender_id"])
    bad = scored.where((F.col("score") < -1e-12) | (F.col("score") > sum(w.values()) + 1e-12)).count()
    assert bad == 0
    comp = S.score_composition(scored, variables, w, ids=["offer_id"]) \
        .groupBy("offer_id").agg(F.sum("contribution").alias("total"))
    # the sf0.001 lineitem table repeats one (order, line, part, supplier) key
    unique = scored.groupBy("offer_id").count().where("count = 1").select("offer_id")
    joined = comp.join(scored.select("offer_id", "score"), "offer_id").join(unique, "offer_id")
    assert joined.where(F.abs(F.col("total") - F.col("score")) > 1e-9).count() == 0


def test_by_equals_per_tender_loop(offers, variables):
    w = S.scenario_weights(variables, "equal")
    ranked = S.rank_offers(S.score_offers(offers, variables, w, by=["tender_id"]), by=["tender_id"])
    tenders = [r["tender_id"] for r in offers.select("tender_id").distinct().orderBy("tender_id").limit(3).collect()]
    for t in tenders:
        one = offers.where(F.col("tender_id") == t)
        alone = S.rank_offers(S.score_offers(one, variables, w))
        a = {r["offer_id"]: (r["score"], r["rank"]) for r in alone.collect()}
        b = {r["offer_id"]: (r["score"], r["rank"]) for r in ranked.where(F.col("tender_id") == t).collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k][1] == b[k][1]
            assert (a[k][0] is None and b[k][0] is None) or a[k][0] == pytest.approx(b[k][0])


def test_risk_flags_binary(offers, variables):
    src = S.score_offers(offers, variables, S.scenario_weights(variables, "equal"), by=["tender_id"], suffix="_n")
    risk = R.risk_scores(src, by=["tender_id"])
    flags = ["drip_pricing_flag", "signaling_risk", "cover_bid_risk", "decoy_bid_risk", "bid_similarity_risk"]
    for c in flags:
        assert risk.where(~F.col(c).isin(0.0, 1.0)).count() == 0
    assert risk.where((F.col("total_risk") < 0) | (F.col("total_risk") > 1)).count() == 0


def test_pareto_ends_at_100(offers):
    p = A.pareto(offers, by=["tender_id"])
    last = p.groupBy("tender_id").agg(F.max_by("cum_pct", "position").alias("last"))
    assert last.where(F.abs(F.col("last") - 100.0) > 1e-9).count() == 0


def test_partition_count_independence(spark, offers, variables):
    w = S.scenario_weights(variables, "equal")
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("2", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            r = S.rank_offers(S.score_offers(offers, variables, w, by=["tender_id"]), by=["tender_id"])
            results.append(sorted((x["offer_id"], x["rank"]) for x in r.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
