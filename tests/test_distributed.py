"""Skew-safety and partition independence of the ordered primitives, checked
against pandas/numpy brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerscore.operators import stats as ST


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    # one hot tender holds a third of the rows; the rest spread over 200 tenders
    tender = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 200, n))
    price = rng.integers(1, 50, n).astype(float)  # many ties
    price[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"offer_id": [f"o{i:05d}" for i in range(n)], "tender_id": tender, "price": price})
    df = spark.createDataFrame(pdf).withColumn("price", F.when(F.isnan("price"), None).otherwise(F.col("price")))
    return df, pdf


@pytest.mark.parametrize("parts", ["3", "16"])
def test_running_matches_pandas(spark, skewed, parts):
    df, pdf = skewed
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = ST.running(df, ["tender_id"], [F.col("price").desc_nulls_last(), F.col("offer_id").asc()],
                         sums={"cum": F.coalesce(F.col("price"), F.lit(0.0))}, rn="rn").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    exp = pdf.copy()
    exp["p"] = exp["price"].fillna(-np.inf)
    exp = exp.sort_values(["tender_id", "p", "offer_id"], ascending=[True, False, True])
    exp["rn"] = exp.groupby("tender_id").cumcount() + 1
    exp["cum"] = exp["price"].fillna(0).groupby(exp["tender_id"]).cumsum()
    m = out.merge(exp[["offer_id", "rn", "cum"]], on="offer_id", suffixes=("", "_e"))
    assert len(m) == len(pdf)
    assert (m["rn"] == m["rn_e"]).all()
    assert np.allclose(m["cum"], m["cum_e"])


def test_pct_rank_and_min_rank(skewed):
    df, pdf = skewed
    pr = ST.pct_rank(df, ["tender_id"], "price", "pr").toPandas().set_index("offer_id")
    mr = ST.min_rank(df, ["tender_id"], "price", "mr").toPandas().set_index("offer_id")
    exp_pr = pdf.groupby("tender_id")["price"].rank(pct=True)
    exp_mr = pdf.groupby("tender_id")["price"].rank(ascending=False, method="min")
    exp_pr.index = pdf["offer_id"]
    exp_mr.index = pdf["offer_id"]
    assert np.allclose(pr.loc[exp_pr.index, "pr"].astype(float), exp_pr, equal_nan=True)
    assert np.allclose(mr.loc[exp_mr.index, "mr"].astype(float), exp_mr, equal_nan=True)


def test_percentiles_match_numpy(skewed):
    df, pdf = skewed
    got = ST.percentiles(df, ["tender_id"], "price", {"p25": 0.25, "p50": 0.5, "p90": 0.9}).toPandas()
    got = got.set_index("tender_id").sort_index()
    for q, name in [(0.25, "p25"), (0.5, "p50"), (0.9, "p90")]:
        exp = pdf.groupby("tender_id")["price"].quantile(q)
        exp = exp.dropna()
        assert np.allclose(got.loc[exp.index, name], exp)


def test_duplicated_null_equals_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", None), ("d", 2.0)], "offer_id string, v double")
    out = {r["offer_id"]: r["d"] for r in ST.is_duplicated(df, [], "v", "d").collect()}
    assert out == {"a": False, "b": True, "c": True, "d": False}


def test_top_k_salted(skewed):
    df, pdf = skewed
    top = ST.top_k(df, ["tender_id"], [F.col("price").desc_nulls_last(), F.col("offer_id")], 2).toPandas()
    exp = pdf.assign(p=pdf["price"].fillna(-np.inf)).sort_values(
        ["tender_id", "p", "offer_id"], ascending=[True, False, True]).groupby("tender_id").head(2)
    assert sorted(top["offer_id"]) == sorted(exp["offer_id"])


def test_no_window_on_tender_alone(skewed):
    """The ordered primitive never puts a hot tender in one window partition: those are cut into
    slices, and the windows of the others read what is left without them."""
    df, _ = skewed
    order = [F.col("price").desc(), F.col("offer_id")]

    def plan_of(out):
        return out._jdf.queryExecution().executedPlan().toString()
    sliced = plan_of(ST.running_in_slices(df, ["tender_id"], order))
    # the range exchange ran in the eager checkpoint; the plan reads its files
    assert "Scan ExistingRDD" in sliced
    assert "row_number() windowspecdefinition(_pid" in sliced
    assert "row_number() windowspecdefinition(tender_id" not in sliced
    plan = plan_of(ST.running(df, ["tender_id"], order))
    assert "Scan ExistingRDD" in plan and "LeftAnti" in plan
    cold, hot = ST.split_hot(df, ["tender_id"], ST.hot_groups(df, ["tender_id"]))
    assert cold.where("tender_id = 0").count() == 0 and hot.where("tender_id <> 0").count() == 0


def test_multi_value_ranks_equal_single(spark, skewed):
    df, _ = skewed
    df2 = df.withColumn("other", (F.col("price") * 3) % 7)
    multi = ST.multi_value_ranks(df2, ["tender_id"], ["price", "other"])
    for c in ("price", "other"):
        single = ST.distinct_value_ranks(df2, ["tender_id"], c)
        a = sorted(tuple(r) for r in multi[c].select("tender_id", c, "_cnt", "_cum", "_n").collect())
        b = sorted(tuple(r) for r in single.select("tender_id", c, "_cnt", "_cum", "_n").collect())
        assert a == b


def both_ways(monkeypatch, run):
    """The rows of ``run()`` by windows alone, and with all large groups cut."""
    monkeypatch.setattr(ST, "hot_groups", lambda df, by: None)
    small = sorted(map(str, run().collect()))
    monkeypatch.undo()
    monkeypatch.setattr(ST, "FAIR_ROWS", 5)
    monkeypatch.setattr(ST, "HOT_ROWS", 30)
    return small, sorted(map(str, run().collect()))


def test_hot_groups_are_found(skewed, spark, monkeypatch):
    df, pdf = skewed
    sizes = pdf.groupby("tender_id").size()
    unfair = set(sizes[(sizes > ST.FAIR_ROWS) & (sizes * 8 > 2 * len(pdf))].index)
    assert {r[0] for r in ST.hot_groups(df, ["tender_id"]).collect()} == unfair != set()
    assert ST.hot_groups(df, []).count() == 1 and ST.hot_groups(df.limit(10), []) is None
    assert ST.hot_groups(df.where("tender_id > 5"), ["tender_id"]) is None
    monkeypatch.setattr(ST, "HOT_ROWS", 10)
    assert {r[0] for r in ST.hot_groups(df, ["tender_id"]).collect()} == set(sizes[sizes > 10].index) | unfair
    cold, hot = ST.split_hot(df, ["tender_id"], ST.hot_groups(df, ["tender_id"]))
    assert cold.count() + hot.count() == len(pdf)


@pytest.mark.parametrize("by", [["tender_id"], []])
def test_both_ways_give_the_same_rows(skewed, spark, by, monkeypatch):
    df = skewed[0].unionByName(spark.createDataFrame([("n1", None, 5.0), ("n2", None, None), ("n3", None, 5.0), ("n4", 777, None)],
                                                     "offer_id string, tender_id long, price double"))
    order = [F.col("price").desc_nulls_last(), F.col("offer_id").asc()]
    for run in (lambda: ST.running(df, by, order, sums={"cum": F.col("price")}), lambda: ST.pct_rank(df, by, "price", "p"),
                lambda: ST.min_rank(df, by, "price", "p"), lambda: ST.min_rank(df, by, "price", "p", ascending=True),
                lambda: ST.percentiles(df, by, "price", {"a": 0.0, "b": 0.33, "c": 1.0}),
                lambda: ST.is_duplicated(df, by, F.bround("price", -1), "d")):
        small, large = both_ways(monkeypatch, run)
        assert small == large and small


def test_risks_both_ways(spark, monkeypatch):
    from offerscore.operators.risk import comparison_summary, risk_scores
    rows = [(f"o{i}", t, f"s{i % 7}", float(100 + (i * 37) % 50), float((i * 11) % 9) if i % 13 else None, float((i * 5) % 30), 3.0)
            for t, n in (("a", 40), ("b", 9), ("c", 1), (None, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "offer_id string, tender_id string, supplier string, price double, score double, quality double, delivery_time_days double")
    for by in (["tender_id"], []):
        small, large = both_ways(monkeypatch, lambda: risk_scores(df, by=by))
        assert small == large and len(small) == len(rows)
        monkeypatch.undo()
        small, large = both_ways(monkeypatch, lambda: comparison_summary(risk_scores(df, by=by), by=by))
        assert small == large and len(small) == len(rows)
        monkeypatch.undo()


def test_a_larger_table_goes_to_more_tasks(spark, monkeypatch):
    """Ordinary groups are dealt to as many tasks as the rows need, hot ones or not, with the same rows."""
    from offerscore.operators import risk, scoring, stats
    rows = spark.range(4000).selectExpr("cast(id as string) offer_id", "nullif(id % 100, 7) tender_id", "concat('s', id % 9) supplier",
                                        "cast(id * 37 % 1009 as double) price", "cast(id * 11 % 53 as double) quality")

    def flags():
        scored = scoring.score_offers(rows, ["price", "quality"], {"price": 0.5, "quality": 0.5}, by=["tender_id"], suffix="_n")
        return risk.red_flags(risk.risk_scores(scored, by=["tender_id"]), by=["tender_id"])
    want = flags()
    assert stats.hot_groups_and_rows(rows, ["tender_id"]) == (None, 4000) and stats.hot_groups_and_rows(rows.limit(0), []) == (None, 0)
    monkeypatch.setattr(stats, "TASK_ROWS", 100)
    got = flags()
    assert got.rdd.getNumPartitions() == 40
    # one exchange by tender serves the scores, the risks and the flags
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("REPARTITION_BY_NUM") == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("by", [["tender"], ["tender", "kind"]])
def test_ranges_both_ways(spark, by, monkeypatch):
    from offerscore.operators import scoring, stats
    rows = spark.range(600).selectExpr("id offer_id", "if(id % 3 = 0, 'hot', nullif(concat('t', id % 40), 't5')) tender", "nullif(id % 2, 1) kind",
                                       "nullif(cast(id * 7 % 101 as double), 14) price", "cast(null as double) none")
    want = scoring.minmax(rows, ["price", "none"], by=by)
    monkeypatch.setattr(stats, "FAIR_ROWS", 20)
    monkeypatch.setattr(stats, "HOT_ROWS", 20)
    got = scoring.minmax(rows, ["price", "none"], by=by)
    assert want.count() == 600 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
