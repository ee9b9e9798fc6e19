import re

from offerscore.llm import catalog, quality_rules, simhash

import corpus_pipeline

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage's result on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if n < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{n}")
        kept.append((docs, spark.read.parquet(f"{tmp_path}/{n}")))
        docs = kept[-1][1]
    before, after = [[{r["doc_id"]: r for r in x.collect()} for x in side] for side in zip(*kept)]
    # quality rules: the verdict of judge
    assert set(after[0]) == {r["doc_id"] for r in quality_rules.judge(kept[0][0]).filter("kept").collect()}
    # near duplicates: the smallest id of each component
    rows = [(i, r["text"]) for i, r in before[1].items()]
    assert set(after[1]) == {c for _, _, c in brute.components(rows)}
    # repeated strings: every document stays, with its remaining characters
    rows = [(i, r["text"]) for i, r in before[2].items()]
    for i, _, removed, _, _ in brute.byte_strings(rows, 100):
        new, old = after[2][i]["text"], before[2][i]["text"]
        assert len(old.encode()) - removed <= len(new.encode()) <= len(old.encode()) - removed + 3 * 50
        assert after[2][i]["n_chars"] == len(new) and after[2][i]["source"] == before[2][i]["source"]
    # leaks: no text that holds an item is left, all others are
    def fold(t):
        return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", t.translate(brute.LOWER)).strip()
    items = [fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after[3]) == {i for i, r in before[3].items() if not any(x in fold(r["text"]) for x in items)}
    # mixing: whole documents, at most twice
    total = sum(len(brute.WORD.findall(r["text"])) for r in before[4].values())
    assert 0 < sum(r["taken"] for r in after[4].values()) <= 1.5 * total
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] in (1, 2) for r in after[4].values())
    # run() gives the same
    again = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == {i: r["taken"] for i, r in after[4].items()}


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark, docs):
    texts = simhash.keep(docs.select(*corpus_pipeline.COLUMNS))
    assert corpus_pipeline.repeated_text(spark, texts, SF).count() == texts.count()


def test_queries_are_registered():
    assert [re.match(r"op(\d+)_", q)[1] for q in catalog.QUERIES] == [str(n) for n in range(1, 14)]
