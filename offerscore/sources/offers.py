"""Read offer files and write ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscore.functions.exprs import NULL_TOKENS
from offerscore.operators.prepare import unique_columns
from offerscore.sources.records import read_records


def read_offers(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True, split: bool = False) -> DataFrame:
    """Read an offer table.

    CSV is read with a header and every column as text (no inference pass over
    the data); the reader's missing-value tokens become NULL.  Numbers are made
    later by ``coerce_numeric`` so that one path serves every source.
    Parquet/ORC/JSON keep their own types.  A quote inside a quoted field is
    doubled; ``multi_line`` allows line breaks inside quotes.  A file is then one task, unless
    ``split`` has it cut at its true record ends by many (``sources.records``; quotes as in RFC 4180).
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("nullValue", None).option("emptyValue", "")
           .option("escape", '"').option("multiLine", multi_line).csv(path))
    if split and multi_line and raw.columns:
        raw = read_records(spark, path, raw.columns)
    return raw.select(*[
        F.when(F.col(f"`{c}`").isin(*NULL_TOKENS), F.lit(None).cast("string"))
         .otherwise(F.col(f"`{c}`")).alias(c)
        for c in raw.columns
    ])


def write_results(ranked: DataFrame, variables: list[str], path: str,
                  keys: tuple[str, ...] = ("supplier", "score"), mode: str = "overwrite",
                  partition_by: list[str] | None = None, **options: str) -> str:
    """Write ``supplier, score, variables`` as CSV with a header (duplicates dropped).

    ``options`` go to the CSV writer (``compression``, for instance; ``read_offers`` knows it by the file names)."""
    cols = unique_columns(list(keys) + list(variables))
    w = ranked.select(*cols).write.mode(mode).option("header", True).option("escape", '"').options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path
