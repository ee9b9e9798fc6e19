"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result of each is
written and read again as the docs of the next, so that every stage starts from committed
files.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerscore.llm import decontaminate, mixing, quality_rules, simhash, suffix_dedup
from offerscore.llm.exchange import Store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 10)."""
    return quality_rules.keep(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 4-word shingles, at most 4 bits apart (operator 4)."""
    return simhash.keep(docs.select(*COLUMNS))


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier (operator 8); a character goes
    when all its bytes do.  Every document stays, if with an empty text."""
    out = suffix_dedup.dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item (operator 9)."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once or twice (operator 6)."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", repeated_text),
          ("benchmark decontamination", benchmark_leaks), ("mixing", mixture)]

#: Perplexity bands, components and suffix arrays have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs, store = spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = store.write(stage(spark, docs, sf_dir), f"stage{n}")
        if n:
            store.drop(f"stage{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
