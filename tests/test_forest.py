"""Importances: one forest for each group, full depth, no row left out."""

import numpy as np
import pandas as pd
import pytest

from offerscore.operators import forest


def plain_tree(x, y, rows, times):
    """Falls by variable of one tree, grown by plain recursion."""
    out = np.zeros(x.shape[1])

    def grow(rows, w):
        if y[rows].min() == y[rows].max():
            return
        total, mass = w.sum(), (w * y[rows]).sum()
        best = (0.0, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= v
                n, s = w[left].sum(), (w[left] * y[rows[left]]).sum()
                gain = s * s / n + (mass - s) ** 2 / (total - n)
                if best[1] is None or gain > best[0] + 1e-9 * (w * y[rows] ** 2).sum():
                    best = (gain, f, left)
        if best[1] is not None:
            out[best[1]] += best[0] - mass ** 2 / total
            grow(rows[best[2]], w[best[2]])
            grow(rows[~best[2]], w[~best[2]])
    grow(rows, times.astype(float))
    return out


def test_falls_match_plain_recursion():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 6, 80), rng.normal(size=80), rng.integers(0, 2, 80), np.ones(80)]).astype(float)
    y = x[:, 0] ** 2 + np.sin(3 * x[:, 1]) + rng.normal(scale=0.1, size=80)
    y -= y.mean()
    sizes, seeds = np.array([50, 1, 29]), np.array([3, 4, 5], dtype=np.uint64)
    row, unit, times = forest.bootstrap(seeds, sizes, np.array([0, 0, 7]))
    assert [times[unit == u].sum() for u in range(3)] == [50, 1, 29]
    got = forest.falls(x, y, row, unit, times, 3)
    for u in range(3):
        assert got[u] == pytest.approx(plain_tree(x, y, row[unit == u], times[unit == u]))
    assert got[:, 3].sum() == 0 and got[1].sum() == 0
    shallow = forest.falls(x, y, row, unit, times, 3, max_depth=1)
    assert ((shallow > 0).sum(axis=1) <= 1).all() and (shallow <= got + 1e-9).all()


def test_bootstrap_draws_evenly():
    row, unit, times = forest.bootstrap(np.arange(1, 401, dtype=np.uint64), np.full(400, 50), np.zeros(400, dtype=int))
    drawn = np.bincount(row % 50, times, 50)
    assert drawn.sum() == 20_000 and abs(drawn - 400).max() < 100        # 5 standard deviations
    assert 0.62 < len(row) / 20_000 < 0.645
    none = forest.bootstrap(np.array([1], dtype=np.uint64), np.array([5]), np.array([-1]))
    assert len(none[0]) == 0


@pytest.fixture(scope="module")
def offers(spark):
    """Groups of many sizes, each driven by a variable of its own; a hot one holds a third of the rows."""
    rng = np.random.default_rng(2)
    frames = []
    for g, n, driver in [("a", 30, 0), ("b", 40, 1), ("c", 35, 2), (None, 30, 1), ("hot", 400, 2), ("one", 1, 0), ("flat", 20, None)]:
        x = rng.normal(size=(n, 3))
        y = 10 * np.sign(x[:, driver]) + x[:, driver] if driver is not None else np.zeros(n)
        frames.append(pd.DataFrame({"tender": g, "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "price": y}))
    pdf = pd.concat(frames, ignore_index=True).astype({"tender": object})
    pdf["offer_id"] = [f"o{i}" for i in range(len(pdf))]
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    rows += [("a", None, 1.0, 1.0, 5.0, "gap"), ("a", 1.0, 1.0, 1.0, None, "gap2"), ("gone", None, 1.0, 1.0, 5.0, "gap3")]
    return spark.createDataFrame(rows, "tender string, x0 double, x1 double, x2 double, price double, offer_id string").repartition(5)


def table(df):
    return {(r["tender"], r["variable"]): r for r in df.collect()}


def test_each_group_has_its_own_driver(offers):
    got = table(forest.importances(offers, "price", ["x0", "x1", "x2", "price"], by=["tender"], trees=25))
    for g, lead in [("a", "x0"), ("b", "x1"), ("c", "x2"), (None, "x1"), ("hot", "x2")]:
        assert got[g, lead]["rank"] == 1 and got[g, lead]["importance"] > 0.9
        assert sum(got[g, v]["importance"] for v in ("x0", "x1", "x2")) == pytest.approx(1.0)
    assert (got["a", "x0"]["n_rows"], got["a", "x0"]["n_dropped"], got["a", "x0"]["max_depth"]) == (30, 2, None)
    assert [got["flat", v]["importance"] for v in ("x0", "x1", "x2")] == [0, 0, 0] and got["one", "x2"]["rank"] == 3
    assert not any(k[0] == "gone" for k in got)


def test_results_do_not_depend_on_the_cut(offers, monkeypatch):
    want = table(forest.importances(offers, "price", ["x0", "x1", "x2"], by=["tender"], trees=10))
    monkeypatch.setattr(forest, "WORK", 100)             # a call for a few trees of a group
    got = table(forest.importances(offers.repartition(3), "price", ["x0", "x1", "x2"], by=["tender"], trees=10))
    assert got.keys() == want.keys()
    for k in got:
        assert got[k]["importance"] == pytest.approx(want[k]["importance"], abs=1e-12)


def test_a_hot_group_is_many_parts(offers, monkeypatch):
    monkeypatch.setattr(forest, "PART", 60)
    got = forest.importances(offers, "price", ["x0", "x1", "x2"], by=["tender"], trees=12)
    hot = {r["variable"]: r for r in got.collect() if r["tender"] == "hot"}
    assert hot["x2"]["importance"] > 0.9 and hot["x2"]["n_rows"] == 400
    whole = {r["variable"]: r["importance"] for r in forest.importances(offers, "price", ["x0", "x1", "x2"], trees=12).collect()}
    assert sum(whole.values()) == pytest.approx(1.0) and min(whole.values()) > 0.05


def test_odd_tables(offers, spark):
    none = forest.importances(offers.where("tender = 'no such'"), "price", ["x0", "x1"], trees=3)
    assert none.collect() == []
    text = spark.createDataFrame([("1", "2")] * 5 + [("3", "9")] * 5, "a string, price string")
    same = forest.importances(text.selectExpr("cast(a as double) a", "cast(price as double) price"), "price", ["a"], trees=3).collect()
    assert [(r["variable"], r["importance"], r["n_rows"]) for r in same] == [("a", 1.0, 10)]
    with pytest.raises(ValueError):
        forest.importances(offers, "price", ["price"])


def test_analytics_by_tender(offers):
    from offerscore.operators.iforest import outlier_view
    from offerscore.plans.pipeline import analytics, rank_pipeline
    table_ = offers.selectExpr("offer_id", "coalesce(tender, 'none') tender", "offer_id supplier", "price", "x0", "x1", "x2", "'Yes' compliance")
    ranking = rank_pipeline(offers.sparkSession, table_, by=["tender"])
    out = analytics(ranking, by=["tender"])
    lead = {r["tender"]: r["variable"] for r in out["price_importance"].where("rank = 1").collect()}
    assert (lead["a"], lead["b"], lead["c"], lead["hot"]) == ("x0", "x1", "x2", "x2")
    assert "tender" in out["pca"].columns and "tender" in out["anomalies"].columns and out["pca_dropped"].first()[0] == 3
    view = out["outlier_view"]
    assert view.columns == ["tender", "offer_id", "supplier", "x_variable", "x", "y_variable", "y", "anomaly_label"]
    assert view.first()["x_variable"] == ranking.variables[0] and view.count() == table_.count()
    priced = outlier_view(out["anomalies"].selectExpr("*", "x0 as technical"), ["x1", "technical", "price"], ids=["offer_id"]).first()
    assert (priced["x_variable"], priced["y_variable"]) == ("price", "technical")
    with pytest.raises(ValueError):
        outlier_view(out["anomalies"], ["price"])


def test_equal_falls_go_to_the_first_threshold_whatever_trees_are_around():
    """Few distinct targets, so that many thresholds of a node have equal falls."""
    rng = np.random.default_rng(6)
    n, trees = 7, 400
    x = np.column_stack([rng.integers(0, 4, n * trees), rng.integers(0, 3, n * trees), rng.permutation(n * trees)]).astype(float)
    y = rng.integers(0, 4, n * trees) / 3 + 0.1
    row, times = np.arange(n * trees), rng.integers(1, 3, n * trees)
    tree = row // n
    got = forest.falls(x, y, row, tree, times, trees)
    for t in range(trees):
        own = tree == t
        assert got[t] == pytest.approx(plain_tree(x, y, row[own], times[own]), abs=1e-7), t
        alone = forest.falls(x[own], y[own], np.arange(n), np.zeros(n, dtype=int), times[own], 1)
        assert (alone[0] == got[t]).all()


def test_many_steps_and_large_numbers_grow_the_same_trees(monkeypatch):
    rng = np.random.default_rng(5)
    sizes, seeds, trees = np.array([40, 1, 17, 2]), np.array([3, 4, 5, 6], dtype=np.uint64), [np.arange(7), np.arange(7), np.arange(2, 5), np.arange(1)]
    x = np.column_stack([rng.integers(0, 5, 60), rng.normal(size=60), np.ones(60)]).astype(float)
    y = x[:, 0] + rng.normal(size=60)
    want, head = forest._shares(x, y, sizes, seeds, trees, None), np.cumsum(sizes) - sizes
    monkeypatch.setattr(forest, "STEP", 16)
    monkeypatch.setattr(forest, "GROW", 100)
    got = forest._shares(x, y, sizes, seeds, trees, None)
    assert got == pytest.approx(want, abs=1e-12)
    for u, (a, n) in enumerate(zip(head, sizes)):
        alone = forest._shares(x[a:a + n], y[a:a + n], sizes[u:u + 1], seeds[u:u + 1], trees[u:u + 1], None)
        assert got[u] == pytest.approx(alone[0], abs=1e-12)
    tree, rank = rng.integers(0, 3, 50), rng.integers(0, 9, 50)
    places = forest._ordered(tree, rank) & (1 << 32) - 1
    assert (places == np.lexsort((rank, tree))).all()
    assert (forest._ordered(tree << 56, rank) & (1 << 32) - 1 == places).all()


def test_score_importance_stores_and_shuffles_no_texts(spark, tmp_path):
    """The offers behind the score's forests are keys and numbers, and no copy of them is stored."""
    from offerscore import session
    from offerscore.plans import catalog
    lines = [(o, 1 + o % 3, 1 + o % 2, k, float(5 + o % 7), 100.0 + o * k, 0.01 * (o % 9), 0.02 * k, "AN"[o % 2], "O", f"2024-01-{1 + o % 28:02d}")
             for o in range(1, 31) for k in (1, 2)]
    tables = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                  "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"),
              "orders": ([(o, "2023-12-20", "2-HIGH") for o in range(1, 31)], "o_orderkey long, o_orderdate string, o_orderpriority string"),
              "supplier": ([(1, "one", 0), (2, "two", 0)], "s_suppkey long, s_name string, s_nationkey long"), "nation": ([(0, "X")], "n_nationkey long, n_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    tracked = len(session._TRACKED)
    scored, variables = catalog._scored_raw(spark, str(tmp_path))
    assert len(session._TRACKED) == tracked
    assert scored.columns == [*catalog.KEYS, *variables, "score"] and len(variables) == 10
    assert scored.count() == len(lines) and scored.where("score is null").count() == 0
