"""The violin's curve against the sum of kernels."""

import math

import numpy as np
import pytest

from offerscore.operators import summary as A


def curve(values, points):
    v = np.asarray(values, dtype=float)
    span = v.max() - v.min()
    q1, q3 = np.quantile(v, [0.25, 0.75])
    h = max(1.059 * min(v.std(ddof=1), (q3 - q1) / 1.349) * len(v) ** -0.2, span / 100) if span else 1.0
    x = np.linspace(v.min() - 2 * h, v.max() + 2 * h, points)
    return x, np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi)), h


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(8)
    return {"a": rng.normal(100, 5, 60).round(1).tolist(), "b": [5.0], "c": [2.0, 2.0, 2.0], "d": [1.0, 9.0, 9.0, 9.0, 9.0, 9.0],
            None: rng.gamma(2, 50, 40).tolist(), "hot": rng.choice([10.0, 20.0, 21.5], 300).tolist()}


@pytest.fixture(scope="module")
def prices(spark, groups):
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs] + [("a", None, 1), ("none", None, 1)]
    return spark.createDataFrame(rows, "tender string, price double, n int").repartition(4)


def test_density_by_group(prices, groups):
    out = A.density(prices, by=["tender"], points=21).orderBy("tender", "point").toPandas()
    assert set(map(str, out["tender"])) == set(map(str, groups))
    for g, values in groups.items():
        mine = out[out["tender"].isna()] if g is None else out[out["tender"] == g]
        x, k, h = curve(values, 21)
        assert mine["point"].tolist() == list(range(1, 22)) and mine["n"].tolist() == [len(values)] * 21
        assert mine["x"].to_numpy() == pytest.approx(x) and mine["density"].to_numpy() == pytest.approx(k)
        assert mine["height"].max() == 1.0 and mine["bandwidth"].to_numpy() == pytest.approx(h)


def test_density_of_the_table_and_odd_tables(prices, groups):
    every = [v for vs in groups.values() for v in vs]
    out = A.density(prices, points=9).orderBy("point").toPandas()
    assert out["density"].to_numpy() == pytest.approx(curve(every, 9)[1])
    assert A.density(prices.where("price is null"), by=["tender"]).collect() == []
    assert A.density(prices.where("price is null")).collect() == []
    with pytest.raises(ValueError):
        A.density(prices, points=1)


def test_binned_density_is_close(prices, groups):
    exact = {(r["tender"], r["point"]): r for r in A.density(prices, by=["tender"], points=15).collect()}
    for r in A.density(prices, by=["tender"], points=15, bins=400).collect():
        want = exact[r["tender"], r["point"]]
        assert r["height"] == pytest.approx(want["height"], abs=0.02) and r["n"] == want["n"]


def test_density_copies_no_row(prices, groups):
    """A sum for each point: neither values nor points are exploded before they are summed."""
    plan = A.density(prices, by=["tender"], points=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan and "explode(_sums" in plan
    assert A.density(prices, by=["tender"], points=7).count() == 7 * len(groups)
