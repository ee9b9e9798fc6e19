import re
from pathlib import Path

import numpy as np
import pytest

from offerscore.llm import katz, license_scan, mixing, quality_rules

from . import brute
from .conftest import prose, same


def test_katz(docs, rows, none, monkeypatch):
    same(katz.score(docs), brute.katz(rows, katz.good_turing))
    assert katz.score(none).collect() == []
    monkeypatch.setattr(katz, "HOT", 1)                # hot contexts are split over shards
    monkeypatch.setattr(katz.X, "SHARD_BYTES", 1000)
    many = katz.X.shards_for
    monkeypatch.setattr(katz.X, "shards_for", lambda n: many(n, 20_000))
    same(katz.score(docs), brute.katz(rows, katz.good_turing))


def katz_by_recursion(rows, order):
    """score of each (doc_id, text) from a plain recursion over counts of every order."""
    tokens = [[x.translate(brute.LOWER) for x in brute.WORD.findall(t or "")] + ["\0end"] for _, t in rows]
    train = [katz.in_training(i) for i, _ in rows]
    after = [{} for _ in range(order + 1)]
    for t, use in zip(tokens, train):
        padded = ["\0start"] * (order - 1) + t
        for k in range(order - 1, len(padded)):
            for n in range(1, order + 1):
                if use:
                    words = after[n].setdefault(tuple(padded[k - n + 1:k]), {})
                    words[padded[k]] = words.get(padded[k], 0) + 1
    found = []
    for n in range(1, order + 1):
        values = [c for words in after[n].values() for c in words.values()]
        found.append(katz.good_turing(np.array([0.0, *(values.count(r) for r in range(1, katz.TOP + 2))])))
    known = {}

    def p(context, w):
        if (context, w) not in known:
            words, d = after[len(context) + 1].get(context, {}), found[len(context)]
            total = sum(words.values())
            kept = sum(d[min(c, katz.TOP + 1)] * c for c in words.values())
            norm = total if kept < total - 1e-9 else total + 1
            if w in words:
                known[context, w] = d[min(words[w], katz.TOP + 1)] * words[w] / norm
            elif not context:
                known[context, w] = 1 - kept / norm
            elif not words:
                known[context, w] = p(context[1:], w)
            else:
                if (context, None) not in known:
                    known[context, None] = (1 - kept / norm) / (1 - sum(p(context[1:], x) for x in words))
                known[context, w] = known[context, None] * p(context[1:], w)
        return known[context, w]
    for context in list(after[order])[:10]:
        assert abs(sum(p(context, w) for w in [*after[1][()], "\0unknown"]) - 1) < 1e-9
    out = []
    for t in tokens:
        padded = ["\0start"] * (order - 1) + t
        out.append(sum(np.log10(p(tuple(padded[k - order + 1:k]), padded[k])) for k in range(order - 1, len(padded))))
    return [(i, float(x)) for (i, _), x in zip(rows, out)]


def test_katz_backs_off_through_every_order(docs, rows, none, monkeypatch):
    for order in (3, 4):
        same(katz.score(docs, order=order).select("doc_id", "score"), katz_by_recursion(rows, order))
    assert katz.score(none, order=3).collect() == []
    monkeypatch.setattr(katz, "HOT", 1)
    monkeypatch.setattr(katz.X, "SHARD_BYTES", 1000)
    many = katz.X.shards_for
    monkeypatch.setattr(katz.X, "shards_for", lambda n: many(n, 20_000))
    same(katz.score(docs, order=3).select("doc_id", "score"), katz_by_recursion(rows, 3))


def test_katz_word_numbers_tell_counts():
    rng = np.random.default_rng(4)
    n_shards = 5
    shards = [np.floor(rng.pareto(0.8, 300)).astype(np.int64) for _ in range(n_shards)]     # counts, with 0
    for top in (0, 3, 40, 10 ** 9):
        held = [(int(c), s, int(n)) for s, counts in enumerate(shards) for c, n in zip(*np.unique(counts, return_counts=True))]
        rows = [r for r in held if r[0] > top]
        rows += [(c, -1, max(n for k, _, n in held if k == c)) for c in {r[0] for r in held if r[0] <= top}]
        numbering = katz.Numbering(rows, n_shards, top)
        number, count = [], []
        for s, counts in enumerate(shards):
            place = np.array([np.count_nonzero(counts[:k] == c) for k, c in enumerate(counts)])
            number.append(numbering.number(counts, place, s))
            count.append(counts)
        number, count = np.concatenate(number), np.concatenate(count)
        assert len(np.unique(number)) == len(number) and 1 <= number.min() and number.max() < numbering.end
        assert (numbering.count_of(number) == count).all()
        assert (np.diff(count[np.argsort(number)]) <= 0).all()     # common words have small numbers


def test_katz_replies_are_short():
    rest = np.concatenate([[0.0, 1.0, 1e-300], np.random.default_rng(2).random(1000) ** 9])
    assert (katz._short(rest) < 1 << 48).all() and (abs(katz._long(katz._short(rest)) - rest) <= 1e-11 * rest).all()
    numbering = katz.Numbering([(30, -1, 1), (20, -1, 1), (2, -1, 1), (0, -1, 1)], 1, 100)
    unigrams = katz.Unigrams(52, 3, np.array([1, 0, 1, 0, 0, 0, 0]))
    # context 1 saw all its words, context 2 not
    request = katz.X.pack(left_d=np.array([1, 1, 2, 2, 2]), right=np.array([1, 2, 1, 3, 4]), n=np.array([9, 2, 3, 2, 0], dtype=np.uint32),
                          alone=np.packbits(np.zeros(5, bool)), hot=np.packbits(np.zeros(5, bool)), single=np.zeros(0, np.uint32))
    got = katz.X.unpack(katz._gram_reply([request], [], unigrams, numbering, None, True)[1][0])
    assert got["count"].tolist() == [9, 2, 3, 2, 0] and "total" not in got and "seen" not in got
    assert [got[f"m{r}"].tolist() for r in range(1, 6)] == [[1, 0], [0, 1], [0, 1], [0, 0], [0, 0]]
    assert got["unseen"][0] == 0 and abs(katz._long(got["unseen"])[1] - 1 + unigrams.p(np.array([30, 2])).sum()) < 1e-10


def test_katz_keeps_and_sends_little(docs, monkeypatch):
    """Word hashes and counts are neither kept nor sent once words are numbered."""
    stores = []
    made = katz.X.Store.__init__
    monkeypatch.setattr(katz.X.Store, "__init__", lambda self, *a: (made(self, *a), stores.append(self))[0])
    assert katz.score(docs, order=3).count() == docs.count()
    kept = {p.name for p in Path(stores[0].dir.removeprefix("file:")).iterdir()}
    assert kept == {"numbered", "grams2", "grams3"}
    payloads = [r["payload"] for r in stores[0].spark.table(stores[0].tables["numbered"]).collect()]
    assert payloads and all("vocabulary_d" not in katz.X.unpack(p) for p in payloads)


def test_katz_without_training(spark):
    held = [(i, "a b") for i in range(200) if not katz.in_training(i)]
    for r in katz.score(spark.createDataFrame(held, "doc_id long, text string")).collect():
        assert (r["held_out"], r["n_known"], r["train_tokens"], r["score"]) == (True, 0, 0, 0.0)


def test_good_turing():
    n = np.array([0, 1000, 300, 140, 80, 50, 35])
    d = katz.good_turing(n)
    assert ((0 < d[1:6]) & (d[1:6] < 1)).all() and d[6] == 1
    # the freed counts are the singletons'
    assert abs(sum(n[r] * r * (1 - d[r]) for r in range(1, 6)) - n[1]) < 1e-6
    assert (katz.good_turing(np.zeros(7)) <= 1).all()


def test_licenses(spark, docs, rows, none):
    more = [(300, "Released under the MIT License.\nMIT license"), (301, "this work is licensed under the GNU general public license, CC-BY"),
            (302, "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software"),
            (303, "mit licence cc xby gnu general license"), (303, "mit licence cc xby gnu general license"), (304, "CC BY" + " cc by" * 500), (305, "mit license")]
    table = docs.select("doc_id", "text", "w").unionByName(spark.createDataFrame([(i, t, 0) for i, t in more], "doc_id long, text string, w int"))
    want = []
    for i, t in rows + more:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
        at = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    out = license_scan.scan(table)
    same(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), want)
    found = {r["doc_id"]: r for r in out.filter("doc_id >= 300").collect()}
    assert found[302]["labels"] == "mit" and found[302]["base_labels"] == "" and 0.9 <= found[302]["score"] <= 1
    assert found[301]["labels"] == "cc-by,gpl" and found[303]["labels"] == "" and found[303]["score"] == 0
    assert license_scan.scan(none).collect() == []


def test_mixing(docs, rows, none):
    out = mixing.mix(docs)
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    sizes = {s: sum(len(brute.WORD.findall(t or "")) for k, (_, t) in enumerate(rows) if [None, "a", "b", "é"][k % 4] == s) for s in (None, "a", "b", "é")}
    total = sum(sizes.values())
    weight = {"a": 3, "b": 1, "é": 2, None: 3}
    target, free = {}, dict(weight)
    while True:                        # capped sources leave the round one by one
        level = (1.5 * total - sum(target.values())) / sum(free.values())
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            del free[s]
    target |= {s: level * w for s, w in free.items()}
    largest = max(r["size"] for r in got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 2 * largest
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got) and sum(r["taken"] for r in got) <= 1.5 * total
    same(mixing.mix(docs.repartition(3)), got)
    assert mixing.mix(none).collect() == []
    assert all(r["taken"] == 0 for r in mixing.mix(docs.filter("text is null")).collect())


def test_mixing_of_many_equal_sources(spark, monkeypatch):
    """Sources of one document each tie in finish time; the cut is that of the sorted queue, also in many rounds."""
    rows = [(k, "word " * 4, f"s{k:04d}") for k in range(600)] + [(1000 + k, "more words here", f"t{k % 3}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs, weights=(1,), ratio=0.8).collect()
    # the queue by plain sorting: finish time, then source; documents of a source in their shuffled order
    order = {r["doc_id"]: r["order_key"] for r in docs.select("doc_id", mixing.order_key(17).alias("order_key")).collect()}
    names = sorted({r["source"] for r in got})
    queue = []
    for s in names:
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: order[r["doc_id"]])
        for copy in range(2):
            upto = copy * mine[0]["source_size"]
            for r in mine:
                upto += r["size"]
                queue.append((upto / 1.0, names.index(s), r["doc_id"], r["size"]))
    budget, total, taken = int(0.8 * sum(r["size"] for r in got)), 0, {}
    for _, _, doc, size in sorted(queue):
        total += size
        if total > budget:
            break
        taken[doc] = taken.get(doc, 0) + size
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == taken
    monkeypatch.setattr(mixing, "LAST", 5)
    same(mixing.mix(docs, weights=(1,), ratio=0.8), got)


def test_mixing_takes_all_where_the_budget_allows(docs):
    assert all(r["taken"] == 2 * r["size"] for r in mixing.mix(docs, ratio=2.0).collect())


def test_quality_counts(docs, rows, none):
    out = quality_rules.judge(docs)
    want = []
    for i, t in rows:
        c = brute.quality_counts(t)
        want.append((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    same(out.select("doc_id", *quality_rules.COUNTS, "base_failed"), want)
    assert not out.filter("base_failed and kept").count()
    assert quality_rules.judge(none).collect() == []
    assert quality_rules.keep(none).collect() == []


@pytest.mark.parametrize("text", ["a\n\na\na \n", "\n", "x\r\nx\r\n", "<a> a|b\n<a> a|b", "a b c d e f g h " * 3, "é\né\n é"])
def test_quality_counts_of_odd_lines(text):
    data = np.frombuffer(("z" + text).encode(), np.uint8)
    got = quality_rules.counts(data, np.array([1, len(data), len(data)]))
    assert tuple(int(got[n][1]) for n in quality_rules.COUNTS) == brute.quality_counts(text)
    assert all(int(got[n][2]) == 0 for n in quality_rules.COUNTS)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(8)
    data = np.frombuffer(prose(__import__("random").Random(9), 3000).encode(), np.uint8)
    key, _ = quality_rules.symbols(data, np.array([len(data)]))
    model = quality_rules.build(*np.unique(key, return_counts=True))
    for context in rng.integers(0, 32 ** 3, 30).tolist() + (key[:30] >> 5).tolist():
        assert abs(quality_rules.probability(model, (context << 5) + np.arange(32)).sum() - 1) < 1e-9


def test_perplexity_bands_reject_junk(spark):
    import random
    rng = random.Random(10)
    rows = [(k, prose(rng, rng.randint(60, 120)), "en") for k in range(300)]
    junk = [(1000 + k, " ".join(rng.choice(["THE!!", "ONER!!", "a###", "|", "$$$b"]) + rng.choice("qzxj") for _ in range(80)), "en") for k in range(20)]
    table = spark.createDataFrame(rows + junk + [(2000, prose(rng, 80), None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality_rules.judge(table).filter("kept").collect()}
    assert kept == {k for k, _, _ in rows} | {2000}
    assert {r["doc_id"] for r in quality_rules.keep(table).collect()} == kept


def test_junk_beyond_ascii_is_rejected(spark):
    """Random letters of a script are told from prose in it."""
    import random
    rng = random.Random(31)
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    parts = ["ст", "но", "то", "на", "ен", "ов", "ни", "ра", "во", "ко", "при", "ого"]

    def text(words, piece):
        return " ".join("".join(piece() for _ in range(rng.randint(1, 3))) for _ in range(words))
    rows = [(k, text(rng.randint(60, 120), lambda: rng.choice(parts)), "ru") for k in range(200)]
    junk = [(1000 + k, text(90, lambda: "".join(rng.choice(letters) for _ in rng.choice(parts))), "ru") for k in range(20)]
    # junk that is no reference document, since a line of it repeats
    junk = [(i, "\n".join([" ".join(t.split()[:9])] * 2 + [" ".join(t.split()[9:])]), lang) for i, t, lang in junk]
    table = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality_rules.judge(table).filter("kept").collect()}
    assert kept == {k for k, _, _ in rows}
    assert {r["doc_id"] for r in quality_rules.keep(table).collect()} == kept


def test_wide_symbols():
    texts = ["aé", "", "жx€𝄞", "z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    key, upto = quality_rules.wide_symbols(data, np.cumsum([len(t.encode()) for t in texts]))
    assert upto.tolist() == [1, 1, 4, 4]
    mask = (1 << 21) - 1
    assert [(int(k) >> 42, int(k) >> 21 & mask, int(k) & mask) for k in key] == [(0, 1, ord("é")), (0, 0, ord("ж")), (ord("ж"), 24, ord("€")), (24, ord("€"), ord("𝄞"))]
    model = quality_rules.build(*np.unique(key, return_counts=True), 3, 21)
    total = quality_rules.probability(model, (int(key[0]) >> 21 << 21) + np.arange(1 << 21), 3, 21).sum()
    assert abs(total - 1) < 1e-9


def kneser_ney(texts, order, size, read):
    """Probability function p(context, symbol) of a modified Kneser-Ney model over ``read(text)``'s n-grams, by plain counting."""
    levels = {order: {}}
    for t in texts:
        for gram in read(t):
            levels[order][gram] = levels[order].get(gram, 0) + 1
    for n in range(order - 1, 0, -1):
        levels[n] = {}
        for gram in levels[n + 1]:
            levels[n][gram[1:]] = levels[n].get(gram[1:], 0) + 1
    cut = {n: quality_rules._discounts(np.array(list(levels[n].values()) or [0])) for n in levels}
    after = {}
    for n in levels:
        for gram, c in levels[n].items():
            after.setdefault(gram[:-1], []).append(c)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / size
        there = after.get(gram[:-1])
        if not there:
            return p(gram[1:])
        spare = sum(cut[n][min(c, 3) - 1] for c in there) / sum(there)
        c = levels[n].get(gram, 0)
        return max(c - (cut[n][min(c, 3) - 1] if c else 0), 0) / sum(there) + spare * p(gram[1:])
    return p


def test_scores_against_plain_kneser_ney(spark, monkeypatch):
    """Scores are those of interpolated models by plain recursion, also of rare languages and in several passes."""
    import random
    rng = random.Random(41)
    accents = str.maketrans({"e": "é", "o": "ö"})
    rows = [(k, prose(rng, rng.randint(50, 70)), "en") for k in range(30)] + [(100 + k, prose(rng, 60).translate(accents), "xx") for k in range(7)]
    rows += [(200, prose(rng, 60), None), (201, "Short é text 12!", "en"), (202, prose(rng, 30), "zz"), (203, "жя", "xx"), (204, prose(rng, 55), "one")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = quality_rules.judge(table).collect()
    classes = lambda ch: 31 if ord(ch) >= 128 else int(quality_rules._CLASS[ord(ch)])                 # noqa: E731
    points = lambda ch: ord(ch) if ord(ch) >= 128 else classes(ch)                                    # noqa: E731

    def plain(t):
        x = [0, 0, 0] + [classes(ch) for ch in t]
        return [tuple(x[i:i + 4]) for i in range(len(t))]

    def wide(t):
        x = [0, 0] + [points(ch) for ch in t]
        return [tuple(x[i:i + 3]) for i, ch in enumerate(t) if ord(ch) >= 128]
    data = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([len(t.encode())]))               # noqa: E731
    good = [(t, lang) for _, t, lang in rows if quality_rules.reference(quality_rules.counts(*data(t)), *data(t))[0]]
    assert len(good) > 30
    models = {lang: [kneser_ney([t for t, x in good if lang in (x, "")], 4, 32, plain), kneser_ney([t for t, x in good if lang in (x, "")], 3, 1 << 21, wide)]
              for lang in ("", "en", "xx", "one")}
    docs = {lang: sum(x == lang for _, x in good) for lang in models}
    for r in got:
        _, t, lang = next(x for x in rows if x[0] == r["doc_id"])
        own = docs.get(lang, 0) / (docs.get(lang, 0) + quality_rules.PRIOR)
        total = 0.0
        for k, read in enumerate((plain, wide)):
            for gram in read(t):
                p = models[""][k](gram)
                total += np.log10(own * models[lang][k](gram) + (1 - own) * p if own else p)
        assert abs(r["score"] - total / len(t)) < 1e-5, (r, total / len(t))
    monkeypatch.setattr(quality_rules, "PASS_BYTES", 1)          # a pass for each language
    same(quality_rules.judge(table), got)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {r["doc_id"] for r in quality_rules.keep(table).collect()} == kept
    monkeypatch.setattr(quality_rules, "PASS_BYTES", 64 << 20)
    monkeypatch.setattr(quality_rules, "DENSE", 1)               # others are searched n-gram by n-gram
    same(quality_rules.judge(table), got)


def test_no_number_of_documents_switches_the_model(spark):
    """A language's scores move little from one reference document to the next."""
    import random
    rng = random.Random(42)
    rows = [(k, prose(rng, 60), "en") for k in range(250)] + [(1000 + k, prose(rng, 60)[::-1], "xx") for k in range(101)]
    at = {}
    for n in (99, 100, 101):
        table = spark.createDataFrame([r for r in rows if r[0] < 1000 + n], "doc_id long, text string, lang string")
        at[n] = {r["doc_id"]: (r["score"], r["kept"]) for r in quality_rules.judge(table).collect()}
    for n in (100, 101):
        for doc, (score, kept) in at[99].items():
            assert abs(score - at[n][doc][0]) < 0.01 and kept == at[n][doc][1], (n, doc)
