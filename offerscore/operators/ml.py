"""Principal components and variable importances.

The components of the whole table are MLlib's (a d x 2 loading matrix comes back to the
driver, the projection is a column expression); per group they come from the group's moments
(one aggregate), so no group's rows are gathered.  Importances are ``forest.importances``.
Rows with a missing variable are dropped and counted (quirk Q12).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscore.operators.forest import importances
from offerscore.operators.prepare import resolve_columns
from offerscore.operators.stats import attach, group_stats


def complete_rows(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every column present, and a one-row count of the dropped ones."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    kept = df.where(cond)
    dropped = df.agg(F.sum(F.when(cond, 0).otherwise(1)).cast("long").alias("n_dropped"))
    return kept, dropped


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """z-scores with the population std; a constant column scores 0 (unit scale)."""
    stats = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(stats))
    for i, c in enumerate(cols):
        scale = F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0))
        out = out.withColumn(c + suffix, (F.col(c) - F.col(f"_m{i}")) / scale)
    return out.drop(*[f"_m{i}" for i in range(len(cols))], *[f"_s{i}" for i in range(len(cols))])


def _fix_signs(matrix: list[list[float]]) -> list[list[float]]:
    """Make each component's largest-magnitude loading positive (first on ties)."""
    cols = len(matrix[0])
    out = [row[:] for row in matrix]
    for j in range(cols):
        col = [row[j] for row in matrix]
        big = max(abs(x) for x in col)
        lead = next(x for x in col if abs(x) >= big - 1e-9)
        if lead < 0:
            for row in out:
                row[j] = -row[j]
    return out


def pca2(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("offer_id", "supplier"),
         k: int = 2) -> tuple[DataFrame, list[list[float]]]:
    """M2: project standardised variables on the first ``k`` principal components.

    MLlib computes the covariance distributedly; the projection is a linear
    column expression per component (no Python on the rows).
    """
    kept, _ = complete_rows(df, variables)
    z = standardize(kept, variables)
    zcols = [v + "_z" for v in variables]
    vec = VectorAssembler(inputCols=zcols, outputCol="_features").transform(z.select(*zcols))
    model = PCA(k=k, inputCol="_features").fit(vec)
    pc = model.pc.toArray().tolist()
    loadings = _fix_signs(pc)
    comps = []
    for j in range(k):
        expr = None
        for i, c in enumerate(zcols):
            term = F.col(c) * F.lit(float(loadings[i][j]))
            expr = term if expr is None else expr + term
        comps.append(expr.alias(f"pc{j + 1}"))
    return z.select(*keys, *comps), loadings


def pca_by(df: DataFrame, variables: Sequence[str], by: Sequence[str],
           keys: Sequence[str] = ("offer_id", "supplier"), k: int = 2) -> DataFrame:
    """M2 per group: ``by``, ``keys`` and pc1..pck of every row without a missing variable.

    Means, deviations and covariances of all groups are one aggregate; the components of a
    group's correlation matrix (d x d, whatever its size) are found next to it and joined
    back.  A constant variable scores 0; correlations below 1e-9 count as 0; components with
    equal variance follow the order of ``variables``; each one's largest loading (the first
    on ties) is positive.  A missing key is a group of its own.
    """
    variables, by = list(variables), list(by)
    d = len(variables)
    if not 1 <= k <= d:
        raise ValueError("k must be between 1 and the number of variables")
    kept, _ = complete_rows(df, variables)
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    x = [F.col(v) for v in variables]
    moments = group_stats(kept, by, F.array(*[F.avg(c) for c in x]).alias("_mean"), F.array(*[F.stddev_pop(c) for c in x]).alias("_std"),
                          F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).cast("array<double>").alias("_cov"))

    def components(batches):
        rows, cols = [p[0] for p in pairs], [p[1] for p in pairs]
        for batch in batches:
            n = batch.num_rows
            std = np.array(batch.column("_std").to_pylist(), dtype=float).reshape(n, d)
            corr = np.zeros((n, d, d))
            corr[:, range(d), range(d)] = std > 0
            if pairs:
                cov = np.array(batch.column("_cov").to_pylist(), dtype=float).reshape(n, len(pairs))
                scale = std[:, rows] * std[:, cols]
                r = np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0)
                corr[:, rows, cols] = corr[:, cols, rows] = np.where(np.abs(r) < 1e-9, 0.0, r)
            values, vectors = np.linalg.eigh(corr)
            first = np.argsort(-values.round(12), axis=1, kind="stable")[:, :k]
            loads = np.take_along_axis(vectors, first[:, None, :], axis=2)
            lead = (np.abs(loads) >= np.abs(loads).max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)
            loads = loads * np.where(np.take_along_axis(loads, lead[:, None, :], axis=1) < 0, -1.0, 1.0)
            out = pa.array(loads.reshape(n, d * k).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "_load"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields)
    found = moments.mapInArrow(components, f"{kind}, _load array<double>")
    out = attach(kept.select(*dict.fromkeys([*by, *keys, *variables])), found, by)
    z = [F.when(F.col("_std")[i] > 0, (c - F.col("_mean")[i]) / F.col("_std")[i]).otherwise(F.lit(0.0)) for i, c in enumerate(x)]
    comps = [sum((z[i] * F.col("_load")[i * k + j] for i in range(d)), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(k)]
    return out.select(*dict.fromkeys([*by, *keys]), *comps)


def price_importance(df: DataFrame, variables: Sequence[str], by: Sequence[str] | None = None, **kw) -> DataFrame:
    """M3: importances of the other variables for price."""
    return importances(df, "price", [v for v in variables if v != "price"], by=by, **kw)


def negotiation_importance(table: DataFrame, by: Sequence[str] | None = None, **kw) -> DataFrame:
    """M4: importances of price, quality and delivery for the negotiation score."""
    c = resolve_columns(table)
    return importances(table, "score", [c["price"], c["quality"], c["delivery"]], by=by, **kw)


def score_importance(df: DataFrame, features: Sequence[str], top: int = 5, by: Sequence[str] | None = None, **kw) -> DataFrame:
    """M5 + K5: importances of the numeric columns for ``score``; the top ``top`` kept."""
    return importances(df, "score", [f for f in features if f != "score"], by=by, **kw).where(F.col("rank") <= top)
