"""Inputs that the shared tables lack: missing keys, zero totals, ties, repeated ids, quoted text."""

import pytest
from pyspark.sql import functions as F

from offerscore.operators import risk as R
from offerscore.operators import summary as A
from offerscore.operators import whatif as X
from offerscore.operators.iforest import anomalies
from offerscore.plans.pipeline import rank_pipeline
from offerscore.session import ensure_checkpoint_dir
from offerscore.sources.offers import read_offers, write_results

BY = ["tender_id"]


@pytest.mark.parametrize("parts", [1, 8])
def test_pareto_of_zero_and_missing_totals(spark, parts):
    rows = [("a", "s1", 0.0), ("b", "s1", 30.0), ("b", "s2", None), ("b", "s3", 10.0), (None, "s1", 5.0)]
    df = spark.createDataFrame(rows, "tender_id string, supplier string, price double").repartition(parts)
    got = {(r["tender_id"], r["supplier"]): (r["position"], r["cum_pct"]) for r in A.pareto(df, by=BY).collect()}
    assert got == {("a", "s1"): (1, None), ("b", "s1"): (1, 75.0), ("b", "s3"): (2, 100.0), ("b", "s2"): (3, 100.0),
                   (None, "s1"): (1, 100.0)}


def test_tenders_without_payment_terms_stay(spark):
    df = spark.createDataFrame([("t", "x"), ("t", "x"), ("t", None), ("u", None)], "tender_id string, payment_terms string")
    got = {r[0]: tuple(r)[1:] for r in A.payment_terms_kpis(df, by=BY).collect()}
    assert got == {"t": ("x", 2, 1), "u": (None, 0, 0)}


def test_one_best_offer_among_ties(spark):
    rows = [("o2", "t", 5.0, 0.9), ("o1", "t", 5.0, 0.1), ("o3", "t", 1.0, 0.8), ("o4", "u", None, 0.9), ("o5", None, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "offer_id string, tender_id string, score double, total_risk double")
    got = {r["offer_id"]: r["status"] for r in R.red_flags(df, by=BY).collect()}
    assert got == {"o1": "[BEST]", "o2": "[RISK]", "o3": "[RISK]", "o4": "[RISK]", "o5": "[BEST]"}


def test_summary_keeps_repeated_ids(spark):
    rows = [("o", "t", "s", 5.0, 0.9, 1.0, 2.0, 3.0), ("o", "u", "s", 4.0, 0.1, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "offer_id string, tender_id string, supplier string, score double, total_risk double, "
                                     "price double, delivery_time_days double, quality double")
    assert R.comparison_summary(df, by=BY).count() == 2
    ranked = df.withColumnRenamed("total_risk", "rank")
    assert X.whatif_impact(ranked, ranked, by=BY).count() == 2


def test_sensitivity_of_a_constant_variable(spark):
    rows = [("o1", "s1", 1.0, 7.0), ("o2", "s2", 2.0, 7.0), ("o3", "s3", 3.0, 7.0)]
    df = spark.createDataFrame(rows, "offer_id string, supplier string, warranty_months double, experience_years double")
    got = X.sensitivity(df, "s1", ["warranty_months", "experience_years"], points=3).collect()
    assert sorted((r["variable"], r["value"]) for r in got) == [("experience_years", 7.0)] + [("warranty_months", float(k)) for k in (1, 2, 3)]
    assert all(1 <= r["supplier_rank"] <= 3 for r in got)


def test_tender_keys_keep_their_text(spark):
    rows = [("o1", "007", "s1", "3", "yes"), ("o2", "7", "s2", "4", "yes")]
    df = spark.createDataFrame(rows, "offer_id string, tender_id string, supplier string, price string, compliance string")
    got = {r["tender_id"]: r["rank"] for r in rank_pipeline(spark, df, by=BY).ranked.collect()}
    assert got == {"007": 1, "7": 1}


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "in.csv").write_text('supplier,score,note\ns1,1,"say ""hi"", ok"\n"two\nlines",2,x\n')
    df = read_offers(spark, str(tmp_path / "in.csv"))
    want = [("s1", "1", 'say "hi", ok'), ("two\nlines", "2", "x")]
    assert sorted(map(tuple, df.collect())) == want
    path = write_results(df, ["note"], str(tmp_path / "out"))
    assert sorted(map(tuple, read_offers(spark, path).select("supplier", "score", "note").collect())) == want


def test_csv_may_be_compressed(spark, tmp_path):
    """F16: compressed files hold the same rows."""
    df = spark.createDataFrame([("s1", 0.25, 1.0), ("two\nlines", None, -0.5)], "supplier string, score double, price double")
    path = write_results(df, ["price"], str(tmp_path / "out"), compression="gzip")
    assert list((tmp_path / "out").glob("*.csv.gz"))
    assert sorted(map(tuple, read_offers(spark, path).collect())) == [("s1", "0.25", "1.0"), ("two\nlines", None, "-0.5")]


def test_scoring_stores_no_texts(spark, tmp_path):
    """The frame that scoring persists has the keys and the numbers, nothing else."""
    from offerscore.plans.catalog import compliant, measured
    sf = "/root/testdata/sf0.001"
    narrow, wide = measured(spark, sf), compliant(spark, sf)
    assert [c for c, t in narrow.dtypes if t == "string"] == ["offer_id", "supplier"]
    assert narrow.exceptAll(wide.select(*narrow.columns)).count() == 0 and narrow.count() == wide.count() > 0


def test_rounding_is_that_of_decimals(spark):
    """the short way to 6 digits is ``round``'s result, at halves, beyond a million and without a value too."""
    import numpy as np
    from pyspark.sql import functions as F
    from offerscore.functions.exprs import r6
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=2000), rng.normal(size=500) * 1e6, rng.normal(size=500) * 1e-6, (rng.integers(-10**7, 10**7, 500) + 0.5) / 1e6,
                        [0.0, -0.0, 1e-7, -1e-7, 0.0000005, -0.0000005, 999999.9999995, 1e6, 1e300, float("inf"), float("-inf"), float("nan")]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    near = r6(F.col("x"))
    assert "rint" in near._jc.toString().lower()
    got = df.select(near.alias("a"), (F.round("x", 6) + F.lit(0.0)).alias("b"))
    assert got.where("not (a <=> b)").count() == 0 and got.where("a is null").count() == 1


def test_large_tender_without_key_keeps_its_offers(spark):
    rows = [(f"o{k}", None if k < 300 else "t", float(k % 17), float(k % 5)) for k in range(320)]
    df = spark.createDataFrame(rows, "offer_id string, tender_id string, price double, quality double")
    out = anomalies(df, ["price", "quality"], by=BY, keep=[])
    assert out.count() == 320 and out.filter("anomaly_score is null").count() == 0


def test_checkpoint_dir_must_be_shared_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_correlation_by_group_matches_numpy(spark):
    import numpy as np

    from offerscore.operators import summary as A
    rng = np.random.default_rng(3)
    groups = {"a": 30, None: 12, "two": 2, "one": 1}
    rows = [(g, float(1e6 + v), None if k % 5 == 4 else float(v * 2 + w), 7.5, float(w) if k % 3 else None)
            for g, n in groups.items() for k, (v, w) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "tender string, a double, b double, c double, d double").repartition(4)
    for by in (["tender"], []):
        got = {(r["tender"] if by else 0, r["var_a"], r["var_b"]): r["corr"] for r in A.correlation(df, ["a", "b", "c", "d"], by=by).collect()}
        assert len(got) == 16 * (len(groups) if by else 1)
        for g in groups if by else [0]:
            mine = [r for r in rows if not by or r[0] == g]
            for i, x in enumerate("abcd"):
                for j, y in enumerate("abcd"):
                    p = np.array([(r[1 + i], r[1 + j]) for r in mine if r[1 + i] is not None and r[1 + j] is not None], dtype=float)
                    if len(p) < 2 or (p.min(axis=0) == p.max(axis=0)).any():
                        assert got[g, x, y] is None
                    else:
                        assert got[g, x, y] == pytest.approx(np.corrcoef(p.T)[0, 1], abs=1e-9)
    assert A.correlation(df.where("a < 0"), ["a", "b"], by=["tender"]).collect() == []


def test_sensitivity_reads_only_the_suppliers_groups(spark):
    from offerscore.operators.whatif import sensitivity
    rows = [(f"o{t}{i}", t, f"s{i}", float(10 * i + len(t or "")), float(i % 4), 1.0) for t in ("a", "bb", None) for i in range(6)]
    rows += [("x", "other", "s9", 1000.0, -50.0, 1.0)]
    df = spark.createDataFrame(rows, "offer_id string, tender string, supplier string, price double, quality double, experience double")
    out = sensitivity(df, "s2", ["price", "experience"], points=3, by=["tender"]).collect()
    assert {r["tender"] for r in out} == {"a", "bb", None}
    assert {r["value"] for r in out if r["variable"] == "price"} == {0.0, 500.0, 1000.0}     # the range of the whole table
    assert all(r["supplier_rank"] == 1 for r in out if r["value"] == 1000.0)


def test_column_helpers(spark):
    from offerscore.operators import prepare as P
    df = spark.createDataFrame([("s", "a", 1.0, 2)], "supplier string, country string, price double, quantity int")
    assert P.categorical_columns(df) == ["country"] and P.categorical_columns(df, exclude=["country"]) == []
    assert P.unique_columns(["b", "a", "b", "a", "c"]) == ["b", "a", "c"] and P.unique_columns([]) == []
    raw = df.withColumn("extra", F.lit(1))
    assert P.scope(df, raw) is df and P.scope(df, raw, use_filtered=False) is raw
    P.require(df, ["price"])
    with pytest.raises(ValueError, match="x view needs column.s. quality, score; the table has supplier, country, price, quantity"):
        P.require(df, ["price", "quality", "score"], "x view")
    with pytest.raises(ValueError, match="view 'warranty' needs"):
        P.view_columns(df.withColumn("offer_id", F.lit("o")), "warranty")


def test_sketches_merge(spark):
    rows = [(f"t{i % 40}", f"d{i % 3}", None if i % 11 == 0 else f"s{(i * 7919) % 9000}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "tender string, day string, supplier string").repartition(6)
    by_tender = A.distinct_sketch(df, "supplier", by=["tender", "day"])
    exact = {r["day"]: r["n"] for r in df.groupBy("day").agg(F.count_distinct("supplier").alias("n")).collect()}
    for r in A.merge_sketches(by_tender, by=["day"]).collect():
        assert r["n_distinct"] == pytest.approx(exact[r["day"]], rel=0.03)
    total = len({r[2] for r in rows if r[2]})
    assert A.merge_sketches(by_tender).first()["n_distinct"] == pytest.approx(total, rel=0.03)
    types = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", None)], "tender string, supplier_type string")
    for approx in (False, True):
        got = {r["tender"]: r["n_supplier_types"] for r in A.distinct_supplier_types(types, by=["tender"], approx=approx).collect()}
        assert got == {"a": 2, "b": 0}


@pytest.mark.parametrize("top", [["price", "quality"], ["price", "experience", "warranty"]])
def test_impact_in_one_frame_matches_two_results(spark, top):
    rows = [(f"o{t}{i}", t, f"s{i % 4}", float(100 + 7 * i % 31), float(i % 5 * 20) if i % 6 else None, float(1 + i % 9), float(i % 3), float(i))
            for t in ("a", "b", None) for i in range(12)]
    df = spark.createDataFrame(rows, "offer_id string, tender string, supplier string, price double, quality double, "
                                     "delivery_time_days double, experience double, warranty double").repartition(3)
    for by in (["tender"], []):
        before, after = (X.whatif(df, "s2", c, top, by=by) for c in ({}, {"price": 10.0, "experience": 50.0}))
        want = X.whatif_impact(before, after, by=by)
        got = X.impact(df, "s2", {"price": 10.0, "experience": 50.0}, top, by=by)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert got.count() == len(rows) and got.where("rank_change <> 0").count() > 0
    twice = df.unionByName(df.where("offer_id = 'oa1'"))
    assert X.impact(twice, "s2", {"price": 90.0}, top, by=["tender"]).count() == len(rows) + 1
