import random

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had".split()


def prose(rng, n):
    """Invented words among common ones."""
    out = [rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4)))
           for _ in range(n)]
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): null, blank, short and very long texts, repeated rows, missing ids,
    exact and near copies, shared passages and accents."""
    rng = random.Random(5)
    shared = [prose(rng, 40) for _ in range(3)]
    base = [prose(rng, rng.randint(30, 90)) for _ in range(12)]
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "é" * 30 + " ü\x0bß"), (6, prose(rng, 30_000)), (None, base[0]), (None, None)]
    for k, text in enumerate(base):
        out.append((10 + k, text))
    out += [(40 + k, base[k % 4]) for k in range(6)]                                   # copies
    out += [(60 + k, base[5].replace(" the ", f" the{k} ", 1) + f" {k}") for k in range(40)]   # near copies
    out += [(120 + k, prose(rng, 15) + "\n" + shared[k % 3] + "\n" + prose(rng, 15)) for k in range(9)]
    out += [(10, base[0]), (10, base[0]), (11, base[2]), (200, "Éa èb " * 30), (201, "x" + "Éa èb " * 30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with the columns of documents and extra ones whose names operators use inside."""
    extra = ["fp", "size", "row_id", "text_key", "key", "n", "payload", "chunk_id", "carried_0", "w", "finish", "number", "model", "score", "item_id", "u"]
    lang = ["en", None, "fr"]
    data = [(i, t, lang[k % 3], [None, "a", "b", "é"][k % 4], 0 if t is None else len(t), *[k] * len(extra)) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)
    return spark.createDataFrame(data, schema).repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("doc_id = -1")


def same(df, expected):
    """Rows without regard to order; doubles to 6 digits."""
    def line(row):
        return tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)
    got, want = sorted(map(line, df.collect())), sorted(map(line, expected))
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
