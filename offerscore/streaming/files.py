"""Re-rank offer files as they arrive.

The reference has no streaming engine: its "real-time" analysis re-runs the
whole evaluation on each uploaded file.  The Spark form of that is a file
stream whose micro-batches are scored with the batch operators in
``foreachBatch``: each batch holds whole files, and a file carries whole
tenders, so per-batch ranking with ``by`` keys equals ranking the file.
No state is kept across batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from offerscore.functions.exprs import NULL_TOKENS
from offerscore.session import scratch_dir


def rank_arriving_files(spark: SparkSession, in_dir: str, out_dir: str, columns: Sequence[str],
                        by: Sequence[str] = ("tender_id",), scenario: str = "equal",
                        checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Rank every new CSV offer file in ``in_dir`` and append results to ``out_dir`` (Parquet).

    ``columns`` is the header of the offer files (a stream needs its schema up
    front; all columns are read as text and coerced like the batch path).
    """
    from offerscore.plans.pipeline import rank_pipeline

    schema = StructType([StructField(c, StringType()) for c in columns])
    stream = spark.readStream.option("header", True).schema(schema).csv(in_dir)
    stream = stream.select(*[F.when(F.col(c).isin(*NULL_TOKENS), None).otherwise(F.col(c)).alias(c)
                             for c in columns])

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        r = rank_pipeline(batch.sparkSession, batch, scenario=scenario, by=list(by))
        keep = [c for c in ("offer_id", *by, "supplier", "score", "rank") if c in r.ranked.columns]
        r.ranked.select(*keep).withColumn("batch_id", F.lit(batch_id)) \
            .write.mode("append").parquet(out_dir)
        r.cleaned.unpersist()

    writer = stream.writeStream.foreachBatch(score_batch) \
        .option("checkpointLocation", checkpoint or scratch_dir(spark, "stream"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
