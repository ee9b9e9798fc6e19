"""Edge cases, sources/sinks, what-if and ML checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerscore.operators import prepare as P
from offerscore.operators import scoring as S
from offerscore.operators import whatif as X
from offerscore.operators.filters import range_filter, supplier_subset
from offerscore.session import scratch_dir
from offerscore.sources.offers import read_offers, write_results


def test_parse_rules(spark):
    vals = ["12", " 12 ", "1e3", "1d", "0x10", "1,000", "abc", "", "NaN", "inf", "-3.5", ".5"]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(vals)], "offer_id string, x string")
    out = P.coerce_numeric(df, keep=("offer_id",))
    got = [r["x"] for r in out.orderBy(F.col("offer_id").cast("int")).collect()]
    assert got == [12.0, 12.0, 1000.0, None, None, None, None, None, None, None, -3.5, 0.5]


def test_minmax_constant_and_missing(spark):
    df = spark.createDataFrame([("a", 5.0, None), ("b", 5.0, None), ("c", None, None)],
                               "offer_id string, v double, allnull double")
    out = {r["offer_id"]: (r["v"], r["allnull"]) for r in S.minmax(df, ["v", "allnull"]).collect()}
    # one distinct value: 1.0 on every row, missing rows included; all missing stays missing
    assert out == {"a": (1.0, None), "b": (1.0, None), "c": (1.0, None)}
    assert P.variable_list(df) == ["v"]


def test_missing_score_sorts_last_and_empty_variables(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 1.0), ("c", 3.0, 2.0)],
                               "offer_id string, price double, quality double")
    ranked = S.rank_offers(S.score_offers(df, ["price", "quality"], {"price": 0.5, "quality": 0.5}))
    order = [r["offer_id"] for r in ranked.orderBy("rank").collect()]
    assert order[-1] == "a"
    with pytest.raises(ValueError):
        S.scenario_weights([], "equal")


def test_custom_weights_rescaled():
    w = S.custom_weights({"a": 0.5, "b": 1.0})
    assert w == pytest.approx({"a": 1 / 3, "b": 2 / 3})
    assert S.custom_weights({"a": 0.0}) == {"a": 0.0}


def test_certifications_blank_and_null(spark):
    df = spark.createDataFrame([("a", None), ("b", " \t"), ("c", "CE"), ("d", "")],
                               "offer_id string, certifications string")
    assert sorted(r["offer_id"] for r in P.missing_certifications(df).collect()) == ["a", "b", "d"]


def test_mixed_case_compliance_and_empty(spark):
    df = spark.createDataFrame([("a", "YES"), ("b", " yes"), ("c", None), ("d", "yes")],
                               "offer_id string, compliance string")
    assert sorted(r["offer_id"] for r in P.compliant_only(df).collect()) == ["a", "d"]
    empty = P.compliant_only(df.where("compliance = 'none'"))
    assert empty.count() == 0


def test_range_filter_drops_missing(cleaned):
    rows = range_filter(cleaned, {"price": (0, 1e9)}).count()
    assert rows == 5
    assert range_filter(cleaned, {"price": (1000, 1080)}).count() == 3
    assert supplier_subset(cleaned, ["Supplier A", "Supplier C"]).count() == 2


def test_zero_price_negotiation(spark):
    from offerscore.operators.negotiation import negotiation_score
    df = spark.createDataFrame([("a", 0.0, 80.0, 10.0)],
                               "offer_id string, price double, quality double, delivery_time_days double")
    assert negotiation_score(df).first()["score"] is None


def test_variable_ranges_sequential(spark):
    from offerscore.operators.summary import variable_ranges
    df = spark.createDataFrame([("a", None, 1.0), ("b", 2.0, 50.0), ("c", 4.0, 30.0)],
                               "offer_id string, x double, y double")
    r = {row["variable"]: (row["lo"], row["hi"], row["step"]) for row in variable_ranges(df, ["x", "y"]).collect()}
    # y's bounds are taken after x's full-range filter dropped row a
    assert r == {"x": (2.0, 4.0, 0.01), "y": (30.0, 50.0, 1.0)}


def test_csv_roundtrip(spark, cleaned):
    variables = P.variable_list(cleaned)
    ranked = S.score_offers(cleaned, variables, S.scenario_weights(variables, "equal"))
    path = write_results(ranked, variables, scratch_dir(spark, "test"), keys=("offer_id", "supplier", "score"))
    back = P.coerce_numeric(read_offers(spark, path), keep=("offer_id",))
    assert back.columns[:3] == ["offer_id", "supplier", "score"]
    got = {r["offer_id"]: r["score"] for r in back.collect()}
    want = {r["offer_id"]: r["score"] for r in ranked.collect()}
    assert got == want


def test_whatif_and_impact(cleaned):
    top = ["price", "quality", "warranty_months"]
    before = X.whatif(cleaned, "Supplier C", {}, top)
    after = X.whatif(cleaned, "Supplier C", {"quality": 100.0, "warranty_months": 30.0}, top)
    res = X.supplier_result(after, "Supplier C").first()
    assert res["rank"] == 1
    imp = {r["offer_id"]: r for r in X.whatif_impact(before, after).collect()}
    assert imp["C"]["rank_change"] > 0
    # the negotiation path: all top variables among its inputs
    neg = X.whatif(cleaned, "Supplier D", {"price": 900.0}, ["price", "quality"])
    assert X.supplier_result(neg, "Supplier D").first()["rank"] == 1


def test_sensitivity_grid(cleaned):
    out = X.sensitivity(cleaned, "Supplier C", ["price", "quality"], points=3).collect()
    assert len(out) == 6
    best_quality = [r for r in out if r["variable"] == "quality" and r["value"] == 85.0][0]
    worst_quality = [r for r in out if r["variable"] == "quality" and r["value"] == 79.0][0]
    assert best_quality["supplier_score"] > worst_quality["supplier_score"]
    assert best_quality["supplier_rank"] <= worst_quality["supplier_rank"]


def test_pca_two_variable_closed_form(spark):
    from offerscore.operators.ml import pca2
    rng = np.random.default_rng(3)
    a = rng.normal(size=300)
    b = 0.6 * a + rng.normal(size=300)
    pdf = pd.DataFrame({"offer_id": [str(i) for i in range(300)], "supplier": "s", "a": a, "b": b})
    out, _ = pca2(spark.createDataFrame(pdf), ["a", "b"])
    got = out.toPandas().set_index("offer_id").loc[pdf["offer_id"]]
    z1 = (a - a.mean()) / a.std()
    z2 = (b - b.mean()) / b.std()
    assert np.allclose(got["pc1"], (z1 + z2) / math.sqrt(2))
    assert np.allclose(got["pc2"], (z1 - z2) / math.sqrt(2))


def test_isolation_forest_flags_planted_outlier(spark):
    from offerscore.operators.iforest import anomalies
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({"offer_id": [f"o{i:04d}" for i in range(n)], "supplier": "s",
                        "price": rng.normal(1000, 20, n), "quality": rng.normal(80, 2, n)})
    pdf.loc[0, ["price", "quality"]] = [5000.0, 10.0]
    out = anomalies(spark.createDataFrame(pdf), ["price", "quality"]).toPandas().set_index("offer_id")
    assert out.loc["o0000", "anomaly"] == -1
    assert out.loc["o0000", "anomaly_label"] == "Outlier"
    share = (out["anomaly"] == -1).mean()
    assert 0.05 <= share <= 0.1


def test_random_forest_planted_driver(spark):
    from offerscore.operators.forest import importances as rf_importance
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"offer_id": [str(i) for i in range(n)], "x1": rng.normal(size=n),
                        "x2": rng.normal(size=n), "x3": rng.normal(size=n)})
    pdf["price"] = 10 * pdf["x2"] + rng.normal(scale=0.1, size=n)
    imp = rf_importance(spark.createDataFrame(pdf), "price", ["x1", "x2", "x3"], trees=10, max_depth=5).toPandas()
    assert imp.sort_values("rank").iloc[0]["variable"] == "x2"
    assert imp["importance"].sum() == pytest.approx(1.0)
    assert int(imp["n_dropped"].iloc[0]) == 0


def test_entry_contract():
    import __spark_entry__ as E
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert {"rank_equal", "risk_raw", "negotiation_advice", "whatif", "anomalies"} <= set(q)


def test_pipeline_and_stream(spark, sample, tmp_path):
    from offerscore.plans.pipeline import analytics, rank_pipeline
    from offerscore.streaming import rank_arriving_files
    r = rank_pipeline(spark, sample)
    order = [row["offer_id"] for row in r.ranked.orderBy("rank").collect()]
    assert order == list("GDAEC")
    a = analytics(r)
    assert a["risk"].count() == 5 and a["pca"].count() == 5
    # stream: two files arrive, each a tender; results equal the batch ranking
    pdf = sample.toPandas().astype(str)
    pdf.insert(1, "tender_id", "t1")
    in_dir = tmp_path / "in"
    in_dir.mkdir()
    pdf.to_csv(in_dir / "f1.csv", index=False)
    pdf.assign(tender_id="t2").to_csv(in_dir / "f2.csv", index=False)
    q = rank_arriving_files(spark, str(in_dir), str(tmp_path / "out"), list(pdf.columns),
                            checkpoint=str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 10
    top = {row["tender_id"]: row["offer_id"] for row in out.where("rank = 1").collect()}
    assert top == {"t1": "G", "t2": "G"}


def test_isolation_forest_per_tender(spark):
    from offerscore.operators.iforest import anomalies
    rng = np.random.default_rng(2)
    frames = []
    for t, n in [("t1", 60), ("t2", 300), ("t3", 1)]:
        pdf = pd.DataFrame({"offer_id": [f"{t}-{i:04d}" for i in range(n)], "tender_id": t, "supplier": "s",
                            "price": rng.normal(1000, 20, n), "quality": rng.normal(80, 2, n)})
        if n > 1:
            pdf.loc[0, ["price", "quality"]] = [3000.0, 20.0]
        frames.append(pdf)
    df = spark.createDataFrame(pd.concat(frames, ignore_index=True))
    out = anomalies(df, ["price", "quality"], by=["tender_id"]).toPandas().set_index("offer_id")
    assert len(out) == 361
    assert out.loc["t1-0000", "anomaly"] == -1
    assert out.loc["t2-0000", "anomaly"] == -1
    assert out.loc["t3-0000", "anomaly"] == 1
    for t in ("t1", "t2"):
        share = (out[out["tender_id"] == t]["anomaly"] == -1).mean()
        assert 0.05 <= share <= 0.1
    again = anomalies(df, ["price", "quality"], by=["tender_id"]).toPandas().set_index("offer_id")
    assert (again.loc[out.index, "anomaly_score"] == out["anomaly_score"]).all()


def test_best_offer_min_by(spark, cleaned):
    variables = P.variable_list(cleaned)
    scored = S.score_offers(cleaned, variables, S.scenario_weights(variables, "equal"))
    assert S.best_offer(scored).first()["offer_id"] == "G"
    df = spark.createDataFrame([("t", "a", None), ("t", "b", 0.5), ("t", "c", 0.5), ("u", "d", None)],
                               "tender_id string, offer_id string, score double")
    got = {r["tender_id"]: r["offer_id"] for r in S.best_offer(df, by=["tender_id"]).collect()}
    assert got == {"t": "b", "u": "d"}


def test_isolation_forest_parts_agree(spark, monkeypatch):
    """A tender cut into many parts is scored as one, and the number of rows decides nothing else."""
    from offerscore.operators import iforest
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"offer_id": [f"o{i:04d}" for i in range(900)], "tender_id": ["a"] * 257 + ["b"] * 256 + [None] * 387,
                        "price": rng.normal(100, 9, 900), "quality": rng.normal(8, 2, 900)})
    df = spark.createDataFrame(pdf, "offer_id string, tender_id string, price double, quality double")

    def scores(by):
        out = iforest.anomalies(df, ["price", "quality"], keep=[], by=by).toPandas()
        return out.set_index("offer_id")["anomaly_score"].sort_index()
    whole, table = scores(["tender_id"]), scores([])
    monkeypatch.setattr(iforest, "PART", 50)
    pd.testing.assert_series_equal(scores(["tender_id"]), whole)
    pd.testing.assert_series_equal(scores([]), table)
    assert len(whole) == len(table) == 900


def test_isolation_forest_path_lengths():
    """The heap walk against a plain descent of each tree."""
    from offerscore.operators.iforest import grow, mean_paths
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)).round(1)
    feature, threshold, path = grow(x, 7, 64, np.random.default_rng(1))

    def walk(tree, row):
        k = 1
        while feature[tree, k] >= 0:
            k = 2 * k + int(row[feature[tree, k]] > threshold[tree, k])
        return path[tree, k]
    want = [np.mean([walk(t, row) for t in range(7)]) for row in x]
    np.testing.assert_allclose(mean_paths(x, (feature, threshold, path)), want)


def test_isolation_forest_small_tenders_grow_together():
    """where the trees take in all rows, a row's path is its leaf's; many tenders to a call, as one by one."""
    from offerscore.operators.iforest import grow, mean_paths, own_paths
    rng = np.random.default_rng(8)
    sizes = np.array([2, 7, 64, 65, 3, 20])
    x = rng.normal(size=(sizes.sum(), 4)).round(1)
    x[:, 3] = 1.0                                                       # a constant variable
    x[9:14] = x[9]                                                      # copies, never told apart
    starts = np.cumsum(sizes) - sizes
    want = [mean_paths(x[a:a + n], grow(x[a:a + n], 9, n, np.random.default_rng(u))) for u, (a, n) in enumerate(zip(starts, sizes))]
    got = own_paths(x, sizes, [np.random.default_rng(u) for u in range(len(sizes))], 9)
    np.testing.assert_array_equal(got, np.concatenate(want))


def test_isolation_forest_scores_do_not_depend_on_the_call(spark, monkeypatch):
    from offerscore.operators import iforest
    rng = np.random.default_rng(9)
    rows = [(f"o{i}", None if i % 9 == 8 else i % 9, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(170, 2)).round(1))]
    rows += [("one", 50, 1.0, 2.0)] + rows[:5]
    df = spark.createDataFrame(rows, "offer_id string, tender_id long, price double, quality double")

    def scores():
        return sorted(map(tuple, iforest.anomalies(df, ["price", "quality"], keep=[], by=["tender_id"]).select("offer_id", "anomaly_score").collect()))
    together = scores()
    monkeypatch.setattr(iforest, "CALL", 10)
    monkeypatch.setattr(iforest, "WALK", 300)
    assert scores() == together and len(together) == 176 and ("one", 0.5) in together


def test_pca_by_group_matches_numpy(spark):
    from offerscore.operators.ml import pca_by
    rng = np.random.default_rng(3)
    rows = []
    for t in ("x", "y", None):
        base = rng.normal(size=(30, 3))
        base[:, 1] += {"x": 2, "y": -3, None: 1}[t] * base[:, 0]
        rows += [(f"{t}{i}", t, *map(float, r)) for i, r in enumerate(base)]
    rows += [("one", "single", 1.0, 2.0, 3.0), ("gap", "x", None, 1.0, 1.0)]
    rows += [(f"flat{i}", "flat", 5.0, float(i), 1.0) for i in range(4)]           # two constant variables
    df = spark.createDataFrame(rows, "offer_id string, tender string, a double, b double, c double").repartition(4)
    got = {r["offer_id"]: (r["pc1"], r["pc2"]) for r in pca_by(df, ["a", "b", "c"], ["tender"], keys=["offer_id"]).collect()}
    assert len(got) == len(rows) - 1 and "gap" not in got
    for t in ("x", "y", None):
        mine = [r for r in rows if r[1] == t and r[2] is not None]
        m = np.array([r[2:] for r in mine])
        z = (m - m.mean(axis=0)) / m.std(axis=0)
        w, v = np.linalg.eigh(z.T @ z / len(z))
        v = v[:, np.argsort(-w)][:, :2]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), [0, 1]])
        assert np.allclose([got[r[0]] for r in mine], z @ v)
    assert got["one"] == (0.0, 0.0)
    z = (np.arange(4) - 1.5) / np.arange(4).std()
    assert np.allclose([got[f"flat{i}"] for i in range(4)], np.stack([z, np.zeros(4)], axis=1))


def test_whatif_flow_rescores_by_the_variables_that_matter(spark):
    from offerscore.plans.pipeline import whatif_flow
    rng = np.random.default_rng(4)
    rows = [(f"o{i}", f"s{i % 20}", float(a), float(b), float(5 * a + 0.1 * b)) for i, (a, b) in enumerate(rng.random((200, 2)))]
    df = spark.createDataFrame(rows, "offer_id string, supplier string, a double, b double, score double")
    out = whatif_flow(df, ["a", "b"], "s3", {"a": 2.0}, top=1, points=3, trees=5, max_depth=4)
    assert [(r["variable"], r["max_depth"]) for r in out["importance"].collect()] == [("a", 4)]
    assert out["supplier_result"].first()["rank"] == 1                  # the change puts the supplier above all others
    moved = {r["offer_id"]: r["rank_change"] for r in out["impact"].collect()}
    assert len(moved) == 200 and all(moved[f"o{i}"] >= 0 for i in range(3, 200, 20))
    assert sorted({r["variable"] for r in out["sensitivity"].collect()}) == ["a"]


def test_anomalies_of_ordinary_groups_are_shuffled_once_and_not_kept(spark, monkeypatch):
    """The same rows as by pool, parts and a percentile of stored scores, which hot groups go through."""
    import random
    from offerscore import session
    from offerscore.operators import stats
    from offerscore.operators.iforest import anomalies
    rng = random.Random(12)
    rows = [(g, f"{g}-{i}", "s", rng.random(), float(rng.randint(0, 5)), None if rng.random() < 0.1 else rng.random())
            for g, n in [("a", 1), ("b", 2), ("c", 31), (None, 12), ("e", 70), ("f", 45)] for i in range(n)] + [("b", "b-0", "s", 1.0, 2.0, 3.0)] * 2
    df = spark.createDataFrame(rows, "tender string, offer_id string, supplier string, x double, y double, z double").repartition(4)
    kw = dict(variables=["x", "y", "z"], by=["tender"], trees=20, max_samples=40)
    monkeypatch.setattr(stats, "FAIR_ROWS", 10_000)
    tracked = len(session._TRACKED)
    together = anomalies(df, **kw)
    assert len(session._TRACKED) == tracked
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 1 and "Join" not in plan
    monkeypatch.setattr(stats, "HOT_ROWS", 0)            # every group is hot
    apart = anomalies(df, **kw)
    key = lambda r: tuple(str(v) for v in r)
    assert together.columns == apart.columns
    assert sorted(map(key, together.collect())) == sorted(map(key, apart.collect()))
    assert together.where("anomaly = -1").count() > 10
