"""Variable importances from random forests of full depth, for every group in one job (M3-M5).

The forest is the usual one for regression: each tree grows on a bootstrap sample, every split
takes the variable and threshold with the largest fall in squared error, and a tree
grows until its leaves are pure (or ``max_depth``).  A variable's importance is its share
of the falls of a tree, averaged over the trees; the shares add up to 1.

1. *Parts*: a group's rows are dealt by hash over parts of about ``PART`` rows, so a hot group is
   many parts and no row is left out.  Each part grows its share of the trees (at least one) on
   bootstrap samples of its own rows.
2. *Blocks*: the trees of a part are cut into blocks of about ``WORK`` sampled rows, and small
   groups share a call, so the tasks are even whatever the sizes.
3. *Growing*: trees grow together, level by level, as many as fit a core's cache.  The samples are
   ordered by (tree, value) of every variable once; a level deals each node's samples to its children in the same
   order, and running sums of whole numbers give the fall at each distinct value, so thresholds are exact.
4. The falls, d numbers for each block, are summed by group.  No model leaves its task.

The draws depend on the seed, the group, the tree and the row's place in the order of row hashes,
not on partitions or on which groups share a call.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from offerscore.operators.stats import attach, group_stats, num_partitions

#: Rows of a part, on average.
PART = 1 << 16
#: Sampled rows (rows times trees) of a block.
WORK = 1 << 19
#: Sampled rows times variables that grow together ...
GROW = 1 << 19
#: ... and that one step of numpy takes: its arrays fit the cache.
STEP = 1 << 15
_UNIT, _LOW = float(1 << 50), (1 << 32) - 1


def _random(*words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words, element by element."""
    with np.errstate(over="ignore"):
        x = np.uint64(0x9E3779B97F4A7C15)
        for w in words:
            x = (x ^ w) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
        return x


def bootstrap(seeds: np.ndarray, sizes: np.ndarray, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, unit, times drawn) of one tree for each unit; ``trees`` has its number, -1 for none."""
    unit = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = (np.arange(len(unit)) - first).astype(np.uint64)
    draw = _random(seeds[unit], trees[unit].astype(np.uint64), place)
    row = first + ((draw >> np.uint64(32)) * sizes[unit].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    times = np.bincount(row[trees[unit] >= 0], minlength=len(unit))
    row = np.flatnonzero(times)
    return row, unit[row], times[row]


def _heads(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _ordered(tree: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The samples in the order of (tree, rank): a rank in the high half of a number, its sample in the low half."""
    bits, most = max(len(tree), 1).bit_length(), int(rank.max(initial=0)) + 1
    if (int(tree.max(initial=0) + 1) * most).bit_length() + bits > 63:
        order = np.lexsort((rank, tree))
    else:
        # key and place in one number: numbers sort several times faster than places by their key
        order = (tree * most + rank) << bits | np.arange(len(tree))
        order.sort()
        order &= (1 << bits) - 1
    return rank[order] << 32 | order


def falls(x: np.ndarray, y: np.ndarray, row: np.ndarray, tree: np.ndarray, weight: np.ndarray, n_trees: int,
          max_depth: int | None = None) -> np.ndarray:
    """The fall in squared error by tree and variable.

    ``row``, ``tree`` and ``weight`` list the sampled rows of every tree.  Equal falls go to the
    first variable and the smallest threshold: the sums they come from do not depend on the trees around."""
    d = x.shape[1]
    out = np.zeros(n_trees * d)
    y = y[row]
    rank = np.stack([np.unique(x[:, f], return_inverse=True)[1].take(row) for f in range(d)])
    order = np.stack([_ordered(tree, r) for r in rank])
    light, heavy = weight.astype(np.int32), weight.astype(float)
    part, side = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int8)
    # arrays are used again: new ones cost as much as what is done with them
    held = max(STEP, len(row))
    own, spare, gains, places = order.ravel(), np.empty(order.size, dtype=np.int64), np.empty(order.size), np.empty(held, dtype=np.int64)
    few, sums, lefts_, rights = np.empty(held, dtype=np.int32), np.empty(held, dtype=np.int64), np.empty(held), np.empty(held)
    sides, whole_ = np.empty(held, dtype=np.int8), np.empty(held, dtype=bool)
    now = order[0] & _LOW                      # the samples, node after node; the nodes are the roots first
    heads = _heads(tree[now])
    owner, count = tree[now[heads]], np.diff(np.append(heads, len(now)))
    lefts, depth, size = len(owner), 0, len(row)
    while len(now) and (max_depth is None or depth < max_depth):
        # a node of equal targets is done
        start = np.cumsum(count) - count
        node = np.repeat(np.arange(len(count)), count)
        values = y.take(now)
        open_ = np.zeros(len(count), dtype=bool)
        open_[node[values != values.take(start).take(node)]] = True
        # a node of two samples has one fall, by the first variable that they differ in
        two = np.flatnonzero(open_ & (count == 2))
        a, b = now[start[two]], now[start[two] + 1]
        differ = rank.take(a, axis=1) != rank.take(b, axis=1)
        fall = heavy[a] * heavy[b] / (heavy[a] + heavy[b]) * (y[a] - y[b]) ** 2 * differ.any(axis=0)
        out += np.bincount(owner[two] * d + differ.argmax(axis=0), fall, n_trees * d)
        open_[two] = False
        goes = np.where(np.arange(len(count)) < lefts, 1, 2).astype(np.int8)
        goes[~open_] = 0
        side[now] = goes.take(node)
        first = int(count[:lefts][open_[:lefts]].sum())
        owner, count = owner[open_], count[open_]
        n, was, size = len(count), order.shape[1], int(count.sum())
        if not n:
            break
        new = spare[:d * size].reshape(d, size)
        step = max(1, STEP // was)
        for f in range(0, d, step):
            o = order[f:f + step]
            at, to = places[:o.size].reshape(o.shape), sides[:o.size].reshape(o.shape)
            np.bitwise_and(o, _LOW, out=at)
            side.take(at, out=to, mode="clip")
            for which, a, b in ((1, 0, first), (2, first, size)):
                new[f:f + step, a:b] = o.ravel().take(np.flatnonzero(np.equal(to, which, out=whole_[:o.size].reshape(o.shape)))).reshape(len(o), b - a)
        order, own, spare = new, spare, own
        side[now] = 0
        start, node = np.cumsum(count) - count, np.repeat(np.arange(n), count)
        now = order[0] & _LOW
        w, values = heavy.take(now), y.take(now)
        total, mass = np.bincount(node, w, n), np.bincount(node, w * values, n)
        least = 1e-9 * np.maximum(np.bincount(node, w * values * values, n), 1e-300)
        # distances from the mean as whole numbers, which sum to 0 in each node: sums of them are exact
        apart = w * (values - (mass / total).take(node))
        scale = np.bincount(node, np.abs(apart), n)
        apart = np.rint(apart * (_UNIT / scale).take(node)).astype(np.int64)
        last = start + count - 1
        apart[start] -= np.diff(np.cumsum(apart)[last], prepend=0)
        part[now] = apart
        before, whole = (np.cumsum(total) - total).astype(np.int32).take(node), total.take(node)
        gain = gains[:d * size].reshape(d, size)
        step = max(1, STEP // size)
        for f in range(0, d, step):
            o, g = order[f:f + step], gain[f:f + step]
            at, left, up, l, r = (v[:o.size].reshape(o.shape) for v in (places, few, sums, lefts_, rights))
            np.bitwise_and(o, _LOW, out=at)
            light.take(at, out=left, mode="clip")
            np.cumsum(left, axis=1, out=left)
            left -= before
            np.copyto(l, left)
            np.subtract(whole, l, out=r)
            r *= l
            r[:, last] = 1.0
            part.take(at, out=up, mode="clip")
            np.cumsum(up, axis=1, out=up)
            np.copyto(g, up)
            g *= g
            g /= r
            # a threshold lies where the node's next sample has another value
            g += 1e-300
            np.bitwise_xor(o[:, 1:], o[:, :-1], out=at[:, 1:])
            g[:, :-1] *= at[:, 1:] > _LOW
            g[:, last] = 0.0
        top = np.maximum.reduceat(gain.max(axis=0), start)
        back = total * (scale / _UNIT) ** 2
        # the places that come near the largest fall, and the first variable of these
        enough = np.maximum(np.where(top > 0, top - 1.001 * least / back, np.inf), 1e-301).take(node)
        hit = np.flatnonzero(gain >= enough)
        if not len(hit):
            break
        variable, at = np.divmod(hit, size)
        of = node.take(at)
        chosen = np.zeros(n, dtype=np.int64)
        chosen[of[::-1]] = variable[::-1]
        near = np.zeros(n, dtype=bool)
        near[of[gains.take(hit) < (top * (1 - 1e-9)).take(of)]] = True
        if near.any():
            # not all equal: a later variable has to be better by more than rounding
            tops = np.maximum.reduceat(gain.take(np.flatnonzero(near.take(node)), axis=1), np.cumsum(count[near]) - count[near], axis=1)
            tops = np.where(tops > 0, tops * back[near], -np.inf)
            best, first = np.full(tops.shape[1], -np.inf), np.zeros(tops.shape[1], dtype=np.int64)
            for f in range(d):
                better = tops[f] > best + least[near]
                best[better], first[better] = tops[f][better], f
            chosen[near] = first
        mine = np.flatnonzero(variable == chosen.take(of))
        hit, of = hit[mine], of[mine]
        value, heads = gains.take(hit), _heads(of)
        top = np.maximum.reduceat(value, heads)
        here = np.flatnonzero(value >= np.repeat(top * (1 - 1e-9), np.diff(np.append(heads, len(of)))))
        here, of = here[_heads(of[here])], of[heads]
        split, cut = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        split[of] = True
        cut[of] = order.ravel().take(hit[here]) >> 32
        out += np.bincount(owner[of] * d + chosen[of], top * back[of], n_trees * d)
        if not split.all():
            go = split.take(node)
            now, node = now[go], node[go]
        right = rank.take(chosen.take(node) * len(row) + now) > cut.take(node)
        n_right = np.bincount(node[right], minlength=n)[split]
        now = np.concatenate([now[~right], now[right]])
        lefts = len(n_right)
        count = np.concatenate([count[split] - n_right, n_right])
        owner = np.concatenate([owner[split], owner[split]])
        depth += 1
    return out.reshape(n_trees, d)


def _shares(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, trees: list[np.ndarray], max_depth: int | None) -> np.ndarray:
    """By unit and variable: the shares of the falls, summed over the unit's trees."""
    unit = np.repeat(np.arange(len(sizes)), sizes)
    n = np.maximum(sizes, 1)
    y = y - (np.bincount(unit, y, len(sizes)) / n)[unit]
    spread = np.sqrt(np.bincount(unit, y ** 2, len(sizes)) / n)
    y = y / np.where(spread > 0, spread, 1.0)[unit]
    rounds = max(len(t) for t in trees)
    number = np.full((rounds, len(sizes)), -1)
    for u, t in enumerate(trees):
        number[:len(t), u] = t
    out = np.zeros((len(sizes), x.shape[1]))
    step = max(1, GROW // (len(unit) * x.shape[1]))
    for a in range(0, rounds, step):
        some = number[a:a + step]
        row, tree, times = bootstrap(np.tile(seeds, len(some)), np.tile(sizes, len(some)), some.ravel())
        fall = falls(x, y, row % len(unit), tree, times, some.size, max_depth)
        all_ = fall.sum(axis=1, keepdims=True)
        out += np.divide(fall, all_, out=np.zeros_like(fall), where=all_ > 0).reshape(len(some), len(sizes), -1).sum(axis=0)
    return out


def importances(df: DataFrame, target: str, features: Sequence[str], by: Sequence[str] | None = None, trees: int = 100,
                max_depth: int | None = None, seed: int = 42, key: str = "offer_id") -> DataFrame:
    """Importances of ``features`` for ``target``, ranked 1..d (W6), for the table or each group.

    Returns ``by``, variable, importance, rank (equal importances in the order of ``features``),
    n_rows, n_dropped (rows left out for a missing value) and max_depth (null: none).  A missing
    key is a group of its own; a group without a complete row has no rows in the result; one
    whose target is constant has importances 0.  ``key`` spreads the rows of a large group, if
    there is such a column; without it rows that are equal in all variables share a part."""
    by, names = list(by or []), [f for f in dict.fromkeys(features) if f != target]
    if not names:
        raise ValueError("no variables to weigh")
    columns = [f"_x{i}" for i in range(len(names))]
    spread = [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in [*([key] if key in df.columns else []), *names, target]]).alias("_hash")]
    rows = df.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{f}`").cast("double").alias(c) for f, c in zip(names, columns)],
                     F.col(f"`{target}`").cast("double").alias("_y"), *spread)
    complete = ~F.greatest(*[F.col(c).isNull() | F.isnan(c) for c in [*columns, "_y"]])
    counts = group_stats(rows, by, F.count(F.when(complete, True)).alias("n_rows"), F.count(F.when(~complete, True)).alias("n_dropped")) \
        .where("n_rows > 0").withColumn("_parts", F.expr(f"cast(ceil(n_rows / {PART}) as long)")) \
        .withColumn("_each", F.expr(f"cast(ceil({trees} / _parts) as long)")) \
        .withColumn("_blocks", F.expr(f"least(_each, cast(ceil(n_rows / _parts * _each / {WORK}) as long))"))
    calls = counts.agg(F.expr(f"cast(ceil(sum(n_rows * _each) / {WORK}) as long)").alias("_calls"))
    units = attach(rows.where(complete), counts.drop("n_dropped", "n_rows"), by, how="inner").crossJoin(F.broadcast(calls)) \
        .withColumn("_part", F.pmod("_hash", "_parts")) \
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))) \
        .withColumn("_seed", F.xxhash64(F.lit(seed), F.lit("tree"), *[F.col(f"`{c}`") for c in by], "_part")) \
        .withColumn("_unit", F.xxhash64("_seed", "_block")) \
        .withColumn("_call", F.pmod("_unit", F.greatest(F.col("_calls"), F.lit(1)))).drop("_calls", "_parts", "_part")

    def run(call: pa.Table) -> pa.Table:
        np.empty(31 << 17)      # once so large a block was freed, glibc keeps smaller ones for the next arrays, without page faults
        get = lambda c: call.column(c).to_numpy()
        order = np.lexsort((get("_hash"), get("_unit")))
        unit = get("_unit")[order]
        x, y = np.column_stack([get(c) for c in columns])[order], get("_y")[order]
        head = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        sizes = np.diff(np.concatenate([head, [len(unit)]]))
        first = order[head]
        seeds = get("_seed")[first].astype(np.int64).view(np.uint64)
        each = [np.arange(b, e, n) for b, e, n in zip(*(get(c)[first].tolist() for c in ("_block", "_each", "_blocks")))]
        work, a, sums = np.cumsum(sizes * np.array([len(t) for t in each])), 0, []
        while a < len(head):
            done = work[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(work, done + GROW // len(columns), side="right")))
            rows_ = slice(head[a], head[b] if b < len(head) else len(unit))
            sums.append(_shares(x[rows_], y[rows_], sizes[a:b], seeds[a:b], each[a:b], max_depth))
            a = b
        out = pa.array(list(np.concatenate(sums)), pa.list_(pa.float64()))
        return pa.table([*(call.column(c).take(pa.array(first)) for c in by), out], names=[*by, "_sums"])

    schema = StructType([df.schema[c] for c in by] + [StructField("_sums", ArrayType(DoubleType()))])
    # a fixed number of tasks: the calls are few bytes and much work, so they are not to be merged by size
    part = units.repartition(num_partitions(df), "_call").groupBy("_call").applyInArrow(run, schema)
    summed = group_stats(part, by, F.array(*[F.sum(F.col("_sums")[i]) for i in range(len(names))]).alias("_sums"))
    summed = attach(summed, counts.select(*by, "n_rows", "n_dropped"), by)
    whole = F.aggregate("_sums", F.lit(0.0), lambda a, b: a + b)
    share = F.transform("_sums", lambda s, i: F.struct((-F.coalesce(F.try_divide(s, F.col("_all")), F.lit(0.0))).alias("less"), i.alias("i")))
    out = summed.withColumn("_all", whole).select(*by, "n_rows", "n_dropped", F.posexplode(F.sort_array(share)).alias("_pos", "_s"))
    return out.select(*by, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_s.i") + 1).alias("variable"),
                      F.abs(F.col("_s.less")).alias("importance"), (F.col("_pos") + 1).cast("long").alias("rank"),
                      F.col("n_rows"), "n_dropped", F.lit(max_depth).cast("int").alias("max_depth"))
