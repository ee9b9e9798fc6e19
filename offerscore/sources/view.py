"""Offer tables derived from the TPC-H-style driver tables.

One row per line item; the part is the tender.  The derivation is pure
column arithmetic plus three key joins (orders, supplier, nation), so it
scales with ``lineitem``.  ``supplier`` and ``nation`` are dimension tables;
Catalyst/AQE broadcasts them when their measured size allows and keeps a
shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("lineitem", "orders", "supplier", "nation")


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def offers_view(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """The offers view (FIXTURES section 3); ``dirty=True`` gives the text variant
    used to exercise numeric coercion (price/quality as text, a ``remarks`` column)."""
    t = load_tables(spark, sf_dir)
    l = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                             "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                             "l_returnflag", "l_linestatus", "l_shipdate")
    o = t["orders"].select("o_orderkey", "o_orderdate", "o_orderpriority")
    s = t["supplier"].select("s_suppkey", "s_name", "s_nationkey")
    n = t["nation"].select("n_nationkey", "n_name")
    j = (l.join(o, l.l_orderkey == o.o_orderkey)
          .join(s, l.l_suppkey == s.s_suppkey)
          .join(n, s.s_nationkey == n.n_nationkey))
    ok, ln, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("s_suppkey")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    quality = F.when(ok % 97 == 0, F.lit(None)).otherwise(
        (50 + (ok * 31 + ln * 17 + F.col("l_suppkey")) % 51).cast("double"))
    cols = [
        F.concat_ws("-", ok.cast("string"), ln.cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("offer_id"),
        F.col("l_partkey").alias("tender_id"),
        F.col("s_name").alias("supplier"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("shipping_cost"),
        (1 + F.abs(days) % 60).cast("double").alias("lead_time_days"),
        (5 + (ok * 3 + F.col("l_suppkey") * 5 + ln) % 56).cast("double").alias("delivery_time_days"),
        quality.alias("quality"),
        (60 + (ok * 13 + F.col("l_suppkey") * 7) % 41).cast("double").alias("technical"),
        (6 * (1 + ln % 6)).cast("double").alias("warranty_months"),
        (1 + sk % 20).cast("double").alias("experience_years"),
        F.when(F.col("l_returnflag") == "R", "No").when(F.col("l_returnflag") == "A", "YES")
         .otherwise("Yes").alias("compliance"),
        F.when(F.col("l_returnflag") == "R", "Missing docs").otherwise("All docs provided")
         .alias("compliance_notes"),
        F.when(sk % 4 == 0, "ISO9001,CE").when(sk % 4 == 1, "ISO14001").when(sk % 4 == 2, " ")
         .alias("certifications"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Net 15")
         .when(F.col("o_orderpriority") == "2-HIGH", "Net 30")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "Net 45")
         .when(F.col("o_orderpriority") == "5-LOW", "Net 60").alias("payment_terms"),
        F.when(F.col("l_linestatus") == "O", "FOB").otherwise("CIF").alias("delivery_terms"),
        F.col("n_name").alias("country"),
        F.when(sk % 2 == 0, "Manufacturer").otherwise("Distributor").alias("supplier_type"),
    ]
    if dirty:
        bad = ok % 53 == 0
        cols[3] = F.when(bad, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("price")
        cols[9] = F.when(bad, "n/a").otherwise(quality.cast("string")).alias("quality")
        cols.append(F.concat(F.lit("see note "), F.col("l_partkey").cast("string")).alias("remarks"))
    return j.select(*cols)
