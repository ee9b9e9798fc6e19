"""Isolation Forest anomaly labels (M1), built as Spark jobs.

Algorithm: Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008), with the
reference's settings (100 trees, 256 samples per tree, contamination 0.1,
seed 42).  Bit-for-bit parity with any particular library is not a goal.

The same steps serve one forest for the whole table and one per tender, of any size:

1. *Pool*: the ``trees * max_samples`` offers of a tender with the smallest content
   hash (all, if there are no more).  Spark filters by a threshold on the hash, so only
   a little more than the pool is shuffled, and the result does not depend on partitions.
2. *Parts*: a tender's offers are spread by hash over parts of about ``PART`` rows; its
   pool goes to each of them.  A hot tender is many parts, never one task.
3. *Growing and scoring*: in a cogroup of a part with its pool, the trees (each a sample
   of the pool) are grown level by level, all at once, and the part's offers walk them.
   The random stream depends on the tender alone, so all its parts grow the same forest.
4. *Small tenders*: where ``max_samples`` takes in all offers, every tree grows on every offer, so an
   offer's path is known when its leaf is and nothing is walked.  Such tenders need no pool; many of
   them share a call and grow together.
5. *Labelling*: an offer is an outlier when its score is above the exact
   ``1 - contamination`` percentile of its tender's scores (skew-safe percentile).
6. *Tenders that fit a task* (``stats.hot_groups``) are scored and labelled in one call each, from one shuffle of their
   offers; only hot ones, and the whole table, take the way of pool, parts and a percentile of stored scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from offerscore.session import track
from offerscore.operators.stats import attach, group_stats, hot_groups_and_rows, num_partitions, percentiles, split_hot

EULER_GAMMA = 0.5772156649015329
#: Offers of a large tender scored by one call, on average.
PART = 1 << 17
#: Offers of small tenders scored by one call, on average.
CALL = 1 << 13
#: Steps of one vectorised walk or growth (rows times trees): its arrays fit the cache.
WALK = 1 << 15
#: Content hashes lie below this.
SPACE = 1 << 62


def avg_path(n) -> np.ndarray:
    """c(n): average unsuccessful-search path length in a binary search tree."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _levels(x: np.ndarray, rows: np.ndarray, sizes: np.ndarray, unit: np.ndarray, rngs: list[np.random.Generator], deepest: np.ndarray):
    """Grow trees level by level, all at once.

    ``rows`` lists the rows of ``x`` in every tree (``sizes`` of them, 2 or more, each tree's together); ``unit`` is
    each tree's forest (ascending), with its random stream in ``rngs`` and its depth limit in ``deepest``.  Yields for
    each level: the depth, the nodes (as numbers among the level before's children: left and right of each split in
    turn), their row counts, which of them split, at which variables and thresholds; and the samples (places in
    ``rows``) that end in a leaf here or right below, with their path lengths.  A single row needs no more steps.
    """
    d, flat, leaf = x.shape[1], x.ravel(), avg_path(np.arange(int(sizes.max()) + 1))
    place, count, number, offset = np.arange(len(rows)), sizes, np.arange(len(sizes)), rows * d
    depth = 0
    while len(count):
        alive = np.bincount(unit, minlength=len(rngs)) * (depth < deepest)
        node = np.flatnonzero((count > 1) & (depth < deepest)[unit])      # the samples left are theirs, in order
        if not len(node):
            yield depth, number, count, node, node, np.zeros(0), node, np.zeros(0)
            return
        # a random usable feature and a uniform threshold; x <= threshold goes left
        chance, share = np.empty((len(count), d)), np.empty(len(count))
        ends = np.cumsum(np.bincount(unit, minlength=len(rngs)))
        for u in np.flatnonzero(alive).tolist():
            own = slice(ends[u] - alive[u], ends[u])
            rngs[u].random(out=chance[own])
            rngs[u].random(out=share[own])
        chance, n = chance.take(node, axis=0), count.take(node)
        head = np.cumsum(n) - n
        pick = chance.argmax(axis=1)
        values = flat.take(offset + np.repeat(pick, n))
        lo, hi = np.minimum.reduceat(values, head), np.maximum.reduceat(values, head)
        bad = np.flatnonzero(~(hi > lo))
        while len(bad):                             # the likeliest feature that the node's rows differ in
            chance[bad, pick[bad]] = -1.0
            bad = bad[chance[bad].max(axis=1) >= 0]
            if not len(bad):
                break
            pick[bad] = chance[bad].argmax(axis=1)
            first = np.cumsum(n[bad]) - n[bad]
            at = np.repeat(head[bad] - first, n[bad]) + np.arange(int(n[bad].sum()))
            values[at] = part = flat.take(offset[at] + np.repeat(pick[bad], n[bad]))
            lo[bad], hi[bad] = np.minimum.reduceat(part, first), np.maximum.reduceat(part, first)
            bad = bad[~(hi[bad] > lo[bad])]
        good = hi > lo
        cut = lo + share.take(node) * (hi - lo)
        left = ~(values > np.repeat(cut, n))
        n_left = np.add.reduceat(left, head, dtype=np.int64)
        # the two children's rows that go on; a leaf's go nowhere
        each = np.column_stack([n_left, n - n_left])
        go = (each > 1) & (good & (depth + 1 < deepest)[unit.take(node)])[:, None]
        child = np.repeat(np.arange(0, 2 * len(node), 2), n) + ~left
        ended = np.where(good[:, None], depth + 1 + leaf[each], (depth + leaf[n])[:, None]).ravel()
        on = go.ravel().take(child)
        out, stay = np.flatnonzero(~on), np.flatnonzero(on)
        yield depth, number, count, node[good], pick[good], cut[good], place.take(out), ended.take(child.take(out))
        stay = stay.take(np.argsort(child.take(stay), kind="stable"))
        place, offset = place.take(stay), offset.take(stay)
        count, unit = each[good].ravel(), np.repeat(unit.take(node[good]), 2)
        number = np.flatnonzero(count > 0)
        count, unit, depth = count.take(number), unit.take(number), depth + 1


def _depth(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


def grow(x: np.ndarray, trees: int, psi: int, rng: np.random.Generator):
    """Feature (-1 in a leaf), threshold and path length of every node, a row for each tree.

    Nodes are numbered as in a heap: the root is 1, the children of ``k`` are ``2k`` and
    ``2k + 1``.  Every tree grows on ``psi`` rows of ``x`` drawn without replacement.
    """
    deepest = _depth(psi)
    width = 2 << deepest
    feature = np.full(trees * width, -1, dtype=np.int64)
    threshold = np.zeros(trees * width)
    path = np.tile(np.floor(np.log2(np.maximum(np.arange(width), 1))), trees)
    rows = np.concatenate([rng.choice(len(x), psi, replace=False) for _ in range(trees)])
    node = np.arange(trees) * width + 1
    levels = _levels(x, rows, np.full(trees, psi), np.zeros(trees, dtype=np.int64), [rng], np.array([deepest]))
    for depth, number, count, split, pick, cut, _, _ in levels:
        at = node[number]
        path[at] = depth + avg_path(count)
        feature[at[split]], threshold[at[split]] = pick, cut
        first = at[split] + at[split] % width
        node = np.column_stack([first, first + 1]).ravel()
    return feature.reshape(trees, width), threshold.reshape(trees, width), path.reshape(trees, width)


def own_paths(x: np.ndarray, sizes: np.ndarray, rngs: list[np.random.Generator], trees: int) -> np.ndarray:
    """Mean path length of each row in the forest of its unit (``sizes`` rows each, one after another), whose
    trees grow on all of them: as ``mean_paths`` with what ``grow`` makes of each unit, for many units at once."""
    first = np.cumsum(sizes) - sizes
    for n, rng in zip(sizes.tolist(), rngs):
        # a tree's sample is all rows, so which order they are drawn in is of no use: only the
        # stream moves on (by the numbers that ``choice`` takes)
        rng.integers(0, np.tile(np.concatenate([np.arange(n), np.arange(n - 1, 0, -1)]), trees), endpoint=True)
    count = np.repeat(sizes, trees)
    start = np.cumsum(count) - count
    rows = np.repeat(np.repeat(first, trees) - start, count) + np.arange(int(count.sum()))
    tree = np.repeat(np.tile(np.arange(trees), len(sizes)), count)
    slot, out = tree * len(x) + rows, np.empty(trees * len(x))
    deepest = np.array([_depth(n) for n in sizes.tolist()])
    for *_, ended, length in _levels(x, rows, count, np.repeat(np.arange(len(sizes)), trees), rngs, deepest):
        out[slot[ended]] = length
    return out.reshape(trees, len(x)).mean(axis=0)


def mean_paths(x: np.ndarray, forest) -> np.ndarray:
    """Mean path length of each row of ``x`` over the trees."""
    feature, threshold, path = forest
    trees, width = feature.shape
    nodes, inner = np.arange(trees * width), feature.ravel() >= 0
    # a leaf leads to itself: nothing is greater than its threshold
    child = np.where(inner, nodes + nodes % width, nodes)
    cut = np.where(inner, threshold.ravel(), np.inf)
    column = np.maximum(feature, 0).ravel()
    root, length = (np.arange(trees) * width + 1)[:, None], path.ravel()
    out = np.empty(len(x))
    step = max(1, WALK // trees)
    for a in range(0, len(x), step):
        part = x[a:a + step]
        values, first = part.ravel(), np.arange(len(part)) * x.shape[1]
        node = np.repeat(root, len(part), axis=1)
        for _ in range(width.bit_length() - 2):
            at = column.take(node)
            at += first
            right = values.take(at) > cut.take(node)
            node = child.take(node)
            node += right
        out[a:a + step] = length.take(node).mean(axis=0)
    return out


def _matrix(table: pa.Table, variables: list[str]) -> np.ndarray:
    return np.column_stack([table.column(v).to_numpy() for v in variables]).astype(float)


def _stream(seed: int, keys) -> np.random.Generator:
    """The random stream of a tender: it depends on its keys alone."""
    return np.random.default_rng([seed, zlib.crc32("\x1f".join(str(k) for k in keys).encode())])


def _from_pool(x: np.ndarray, pool: np.ndarray, trees: int, max_samples: int, rng: np.random.Generator) -> np.ndarray:
    """Scores of the rows of ``x`` in a forest grown on samples of ``pool``."""
    psi = min(max_samples, len(pool))
    if psi < 2:
        return np.full(len(x), 0.5)
    return np.power(2.0, -mean_paths(x, grow(pool, trees, psi, rng)) / float(avg_path([psi])[0]))


def _by_unit(call: pa.Table, variables: list[str], by: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, list]:
    """The call ordered by ``_unit``, its variables, where each unit begins, the units' sizes and keys."""
    call = call.take(pa.array(np.argsort(call.column("_unit").to_numpy(), kind="stable")))
    unit = call.column("_unit").to_numpy()
    head = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    keys = list(zip(*(call.column(c).take(pa.array(head)).to_pylist() for c in by))) if by else [()]
    return call, _matrix(call, variables), head, np.diff(np.append(head, len(unit))), keys


def _few_scores(x: np.ndarray, head: np.ndarray, sizes: np.ndarray, keys: list, trees: int, seed: int) -> np.ndarray:
    """Scores of small units (``sizes`` rows each, one after another from ``head``), whose trees grow on all their rows."""
    values, size = np.full(len(x), 0.5), np.repeat(sizes, sizes)
    done, a = np.cumsum(sizes) * trees, 0
    while a < len(head):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + WALK, side="right")))
        grown = [u for u in range(a, b) if sizes[u] > 1]
        if grown:
            at = np.flatnonzero(size[head[a]:head[a] + sizes[a:b].sum()] > 1) + head[a]
            path = own_paths(x[at], sizes[grown], [_stream(seed, keys[u]) for u in grown], trees)
            values[at] = np.power(2.0, -path / avg_path(size[at]))
        a = b
    return values


def score(df: DataFrame, variables: Sequence[str], by: Sequence[str], key: str, trees: int, max_samples: int, seed: int,
          name: str = "anomaly_score") -> DataFrame:
    """Add ``2 ** (-mean path length / c(samples))`` of each row in its group's forest; a group
    of one row scores 0.5.  Rows with equal keys and variables share their hash."""
    by, variables, columns = list(by), list(variables), df.columns
    space, most = SPACE, trees * max_samples
    stats = group_stats(df, by, F.count(F.lit(1)).alias("_n")).withColumn("_unit", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in by]))
    calls = stats.agg(F.expr(f"greatest(cast(ceil(sum(if(_n <= {max_samples}, _n, 0)) / {CALL}) as long), 1)").alias("_calls"))
    every = attach(df, stats, by)
    few = every.where(F.col("_n") <= max_samples).crossJoin(F.broadcast(calls)) \
        .withColumn("_call", F.pmod("_unit", "_calls")).drop("_n", "_calls")
    sized = every.where(F.col("_n") > max_samples).drop("_unit") \
        .withColumn("_h", F.pmod(F.xxhash64(key, *variables, F.lit(seed)), F.lit(space))) \
        .withColumn("_parts", F.ceil(F.col("_n") / PART))
    rows = sized.withColumn("_part", F.pmod(F.xxhash64("_h"), F.col("_parts"))).drop("_n", "_h", "_parts")
    pool = sized.where(F.col("_h") <= F.lit(float(space)) * (1.25 * most) / F.col("_n")) \
        .select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[F.col(v).alias(f"_x{i}") for i, v in enumerate(variables)],
                F.col("_h").alias("_hash"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_pool"))

    def run_few(call: pa.Table) -> pa.Table:
        call, x, head, sizes, keys = _by_unit(call, variables, by)
        return call.select(columns).append_column(name, pa.array(_few_scores(x, head, sizes, keys, trees, seed)))

    def run(part: pa.Table, pool: pa.Table) -> pa.Table:
        if not part.num_rows:
            return part.select(columns).append_column(name, pa.array([], pa.float64()))
        drawn = np.argsort(pool.column("_hash").to_numpy(), kind="stable")[:most]
        values = _from_pool(_matrix(part, variables), _matrix(pool, [f"_x{i}" for i in range(len(variables))])[drawn], trees, max_samples,
                            _stream(seed, [part.column(c)[0].as_py() for c in by]))
        return part.select(columns).append_column(name, pa.array(values))

    out_schema = StructType(df.schema.fields + [StructField(name, DoubleType())])
    large = rows.groupBy(*by, "_part").cogroup(pool.groupBy(*[f"_by{i}" for i in range(len(by))], "_pool")).applyInArrow(run, out_schema)
    # a fixed number of tasks: the calls are few bytes and much work, so they are not to be merged by size
    return few.repartition(num_partitions(df), "_call").groupBy("_call").applyInArrow(run_few, out_schema).unionByName(large)


def label_together(df: DataFrame, variables: Sequence[str], by: Sequence[str], key: str, trees: int, max_samples: int, seed: int,
                   cut: float, n_rows: int) -> DataFrame:
    """Scores and labels of groups that fit a task: a call has all rows of its groups, so they are shuffled once and
    nothing is kept.  The same scores as ``score``, and the labels of the exact ``cut`` percentile."""
    by, variables, columns, most = list(by), list(variables), df.columns, trees * max_samples
    rows = df.withColumn("_unit", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in by])) \
        .withColumn("_h", F.pmod(F.xxhash64(key, *variables, F.lit(seed)), F.lit(SPACE))) \
        .withColumn("_call", F.pmod("_unit", F.lit(max(1, -(-n_rows // CALL)))))

    def run(call: pa.Table) -> pa.Table:
        call, x, head, sizes, keys = _by_unit(call, variables, by)
        values, hashes = np.full(len(x), 0.5), call.column("_h").to_numpy()
        few = np.flatnonzero(sizes <= max_samples)
        small = np.repeat(sizes <= max_samples, sizes)
        values[small] = _few_scores(x[small], np.cumsum(sizes[few]) - sizes[few], sizes[few], [keys[u] for u in few], trees, seed)
        for u in np.flatnonzero(sizes > max_samples).tolist():
            own = slice(head[u], head[u] + sizes[u])
            pool = x[own][np.argsort(hashes[own], kind="stable")[:most]]
            values[own] = _from_pool(x[own], pool, trees, max_samples, _stream(seed, keys[u]))
        # the percentile between two ranks of each group's scores
        ordered = values[np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))]
        place = (sizes - 1) * cut
        low, high = (ordered[head + f(place).astype(np.int64)] for f in (np.floor, np.ceil))
        out = values > np.repeat(low + (place - np.floor(place)) * (high - low), sizes)
        return call.select(columns).append_column("anomaly_score", pa.array(values)) \
            .append_column("anomaly", pa.array(np.where(out, -1, 1).astype(np.int32)))

    schema = StructType(df.schema.fields + [StructField("anomaly_score", DoubleType()), StructField("anomaly", IntegerType())])
    # a fixed number of tasks: the calls are few bytes and much work, so they are not to be merged by size
    return rows.repartition(num_partitions(df), "_call").groupBy("_call").applyInArrow(run, schema)


def anomalies(df: DataFrame, variables: Sequence[str], contamination: float = 0.1,
              key: str = "offer_id", keep: Sequence[str] = ("supplier",), trees: int = 100,
              max_samples: int = 256, seed: int = 42, by: Sequence[str] | None = None) -> DataFrame:
    """M1: Isolation Forest on the variables (missing as 0); label -1 outlier, 1 normal.

    ``by``: one forest per group (a missing key is a group of its own), else one for the table."""
    by, variables = list(by or []), list(variables)
    base = df.select(*by, key, *keep, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v)
                                        for v in variables])
    label = F.when(F.col("anomaly") == -1, "Outlier").otherwise("Normal")
    hot, n_rows = hot_groups_and_rows(base, by) if by else (None, 0)
    ordinary, rows = split_hot(base, by, hot) if by else (None, base)
    parts = []
    if ordinary is not None:
        parts.append(label_together(ordinary, variables, by, key, trees, max_samples, seed, 1.0 - contamination, n_rows))
    if rows is not None:
        # read twice (the percentile and the labels): score the rows once
        scored = track(score(rows, variables, by, key, trees, max_samples, seed).persist(StorageLevel.MEMORY_AND_DISK))
        out = attach(scored, percentiles(scored, by, "anomaly_score", {"_cut": 1.0 - contamination}), by)
        parts.append(out.withColumn("anomaly", F.when(F.col("anomaly_score") > F.col("_cut"), -1).otherwise(1)).drop("_cut"))
    return reduce(DataFrame.unionByName, parts).withColumn("anomaly_label", label)


def outliers(labelled: DataFrame) -> DataFrame:
    """The offers labelled as outliers, with their variables."""
    return labelled.where(F.col("anomaly") == -1)


def outlier_view(labelled: DataFrame, variables: Sequence[str], ids: Sequence[str] = ("offer_id", "supplier")) -> DataFrame:
    """M1's view: ``ids``, the two variables to plot (as x and y, with their names) and the label.

    Price against quality (else technical), if both are variables; otherwise the first two."""
    second = next((v for v in ("quality", "technical") if v in variables), None)
    if "price" in variables and second:
        pair = ("price", second)
    elif len(variables) >= 2:
        pair = tuple(variables[:2])
    else:
        raise ValueError("an outlier view needs at least 2 variables")
    return labelled.select(*dict.fromkeys(ids), F.lit(pair[0]).alias("x_variable"), F.col(f"`{pair[0]}`").alias("x"),
                           F.lit(pair[1]).alias("y_variable"), F.col(f"`{pair[1]}`").alias("y"), "anomaly_label")
