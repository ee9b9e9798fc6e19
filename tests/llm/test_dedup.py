import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from offerscore.llm import graph, simhash, substring_dedup, suffix_dedup, textops
from offerscore.llm.exchange import Store, pack, pack_texts, unpack

from . import brute
from .conftest import prose, same


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    given = {"a_d": np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64)), "b": rng.random(7), "c": np.zeros(0, np.int32), "d_d": np.array([5, 3, -9])}
    for name, values in unpack(pack(**given)).items():
        assert values.dtype == given[name].dtype and (values == given[name]).all()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    passage = rng.integers(97, 101, 300).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 101, 57).astype(np.uint8), passage, rng.integers(97, 101, 90).astype(np.uint8), passage])
    ends = np.array([57 + 300 + 90, len(data)])
    at, low, top = textops.winnow(suffix_dedup.gram_hash(data), ends, 16, 85)
    anchor = {s: a - s for a, lo, hi in zip(at, low, top) for s in range(lo, hi + 1)}
    assert sorted(anchor) == [*range(447 - 99), *range(447, 747 - 99)]
    assert all(0 <= x <= 84 for x in anchor.values())
    assert all(anchor[57 + k] == anchor[447 + k] for k in range(201))


def test_suffix_array_is_sorted_order():
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice([1, 2, 3, 9])
        text = [rng.randint(1, letters) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    group, previous, order = suffix_dedup.lyndon_groups([2, 1, 2, 1, 2, 0])
    assert group[0] == group[2] == group[4] and group[1] == group[3] and previous[2] == 1 and len(order) >= 3


def test_rank_strings_orders_bytes():
    rng = random.Random(4)
    strings = [bytes(rng.choice([0, 97, 98]) for _ in range(rng.randint(1, 70))) for _ in range(200)]
    lengths = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    rank = suffix_dedup.rank_strings(data, np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(rank)
    assert [strings[i] for i in order] == sorted(strings)


@pytest.mark.parametrize("sketch_bits", [None, 10])        # a crowded sketch lets more through, with the same result
def test_substring_dedup(docs, rows, none, sketch_bits):
    out = substring_dedup.dedup(docs, 13, sketch_bits=sketch_bits)
    same(out.select("doc_id", "n_words", "n_removed", "kept_sha256"), brute.substrings(rows, 13))
    if sketch_bits is None:
        assert out.filter("n_removed > 0").count() > 20
        assert substring_dedup.dedup(none).collect() == []


def test_substring_windows_take_little_memory():
    rng = random.Random(6)
    words = [prose(rng, 1) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(3000)]
    payload = pack_texts(pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}))
    size = sum(map(len, texts))
    assert size > 4 << 20
    tracemalloc.start()
    try:
        n = sum(len(piece[5]) for piece in substring_dedup._windows(payload, 13))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 3000 * 488
    assert peak < size + (20 << 20)         # the unpacked texts, and one piece's hashes


def test_substring_dedup_stores_chunks_only(spark, docs, monkeypatch):
    stores = []
    monkeypatch.setattr(substring_dedup.X, "Store", lambda *a: stores.append(Store(*a)) or stores[-1])
    assert substring_dedup.dedup(docs, 13).filter("n_removed > 0").count() > 20
    assert os.listdir(stores[0].dir.removeprefix("file:")) == ["chunks"]     # replies go to the chunks by the shuffle alone


def test_suffix_dedup(docs, rows, none):
    out = suffix_dedup.dedup(docs, 100, carry=("source", "fp")).collect()
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(str, [tuple(r[c] for c in cols) for r in out])) == sorted(map(str, brute.byte_strings(rows, 100)))
    texts = {}
    for (i, t), n in zip(rows, range(len(rows))):
        texts[n] = (i, t or "")
    for r in out:                       # the carried columns belong to the row: fp is its number
        assert texts[r["fp"]][0] == r["doc_id"] and r["source"] == [None, "a", "b", "é"][r["fp"] % 4]
        assert r["kept"].decode("utf-8", "ignore") in r["kept_text"] or r["n_removed"]
        if not r["n_removed"]:
            assert r["kept_text"] == texts[r["fp"]][1]
    assert suffix_dedup.dedup(none).collect() == []


@pytest.mark.parametrize("crowded", [suffix_dedup.CROWDED, 3, 1])       # windows of crowded anchors are spread, with the same result
def test_suffix_dedup_random(spark, crowded):
    rng = random.Random(6)
    parts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 60))) for _ in range(14)]
    rows = [(k // 2 if k < 6 else k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    out = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50, crowded=crowded)
    same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.byte_strings(rows, 50))


def test_suffix_dedup_of_a_line_in_many_contexts(spark):
    rng = random.Random(9)
    line = "all rights reserved, see the terms of use and the privacy notice"
    letters = "abcdefghij klmno"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) + line[: rng.choice([30, 64])]
             + rng.choice(["", "abc", "xyz"]) + "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 90])))) for k in range(80)]
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(3, rows[7][1])]
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for crowded in (2, suffix_dedup.CROWDED):
        out = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 70, crowded=crowded)
        same(out.select(*cols), brute.byte_strings(rows, 70))


def test_simhash(docs, rows, none):
    same(simhash.components(docs), brute.components(rows))
    assert simhash.components(none).collect() == []
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    groups = {}
    for n, _, c in brute.components([(n, t) for n, (_, t) in enumerate(rows)]):
        groups.setdefault(c, []).append(brute.key(rows[n][0]))
    assert sorted(brute.key(r["doc_id"]) for r in kept.collect()) == sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("most", [1 << 14, 64])        # crowded blocks are split by finer ones
def test_links_of_dense_and_sparse_groups(spark, most):
    rng = np.random.default_rng(7)
    center = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    near = {int(center ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))) for _ in range(300)}
    far = {int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)}
    values = sorted(near | far)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(Store(spark, "test"), spark.createDataFrame(signed, "fp long"), 4, most)
    roots = {r["u"]: r["v"] for r in graph.components(Store(spark, "test"), edges).collect()}
    got = {}
    for (v,) in signed:
        got.setdefault(roots.get(v, v), set()).add(v)
    group = {v: v for (v,) in signed}
    for a, (x,) in enumerate(signed):
        for (y,) in signed[:a]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4 and group[x] != group[y]:
                old, new = group[x], group[y]
                group = {k: new if g == old else g for k, g in group.items()}
    want = {}
    for v, g in group.items():
        want.setdefault(g, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    if most > len(values):
        assert edges.count() < 40 * len(values)        # no pairs of a whole group


def test_finer_masks_keep_every_close_pair():
    rng = np.random.default_rng(8)
    for mask in simhash._masks(4)[::6]:
        free = [k for k in range(64) if not mask >> k & 1]
        finer = simhash._finer(mask, 4)
        for _ in range(100):
            x = sum(1 << int(b) for b in rng.choice(free, rng.integers(0, 5), replace=False))
            assert any(not x & m for m in finer)
        assert all(m & mask == mask and m != mask for m in finer)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101)], "u long, v long")
    got = {r["u"]: r["v"] for r in graph.components(Store(spark, "test"), edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}
