"""License scans: find licence notices in whole texts, with built-in functions only.

Method: diagonal voting.  Every rolling word 2-gram of a document is hashed; those that
also occur in a template are joined to the template's positions, and each pair of positions
votes for a diagonal (document position minus template position).  Votes are aggregated by
diagonal, diagonals at most ``gap`` apart are merged (words added to or missing from a
notice shift it), and a merged span is verified by the share of the template's words that
it covers, compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening sentences of common notices (at most 64 words), and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _templates(spark, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row for each 2-gram of each template: the caller's list, so its size is known."""
    rows = []
    for t, (phrase, label, is_base) in enumerate([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in notices.items()]):
        parts = phrase.split()
        if not 2 <= len(parts) <= 63:
            raise ValueError(f"a template has 2 to 63 words: {phrase}")
        rows += [(t, label, is_base, len(parts), p, parts[p], parts[p + 1]) for p in range(len(parts) - 1)]
    return spark.createDataFrame(rows, "t int, label string, is_base boolean, t_words int, t_pos int, a string, b string") \
        .withColumn("h", F.xxhash64("a", "b"))


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None,
         gap: int = 3, share: float = 0.9) -> DataFrame:
    """Licence labels of every document.

    ``docs`` needs doc_id and text; other columns are ignored.  Returns one row per input row:
    doc_id, n_words, n_base (places where a base phrase's words stand consecutively),
    first_word and last_word (their smallest and largest start, null without one),
    base_labels, labels (the method's too; distinct, sorted, comma-joined, empty without
    one), score (largest verified share of a template, 0 to 1).  A null text is empty;
    repeated rows give equal rows; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    templates = _templates(spark, BASE if base is None else base, NOTICES if notices is None else notices)
    grams = [r["h"] for r in templates.select("h").distinct().collect()]     # as many as the caller's templates have
    w = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    at = lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1))
    hits = F.when(F.size("w") >= 2, F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda i: at(i).isin(grams))) \
        .otherwise(F.array().cast("array<int>"))
    hits = F.transform(hits, lambda i: F.struct((i - 1).alias("pos"), at(i).alias("h"), F.element_at("w", i).alias("a"),
                                                F.element_at("w", i + 1).alias("b")))
    kind = "array<struct<pos:int,h:bigint,a:string,b:string>>"
    # position -1 stands for the document itself, so that every row comes back
    rows = w.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"),
                    F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("h"),
                                                        F.lit("").alias("a"), F.lit("").alias("b"))).cast(kind), hits.cast(kind))).alias("g"))
    rows = rows.select("doc_id", "text_key", "n_words", "g.*")
    voted = rows.join(F.broadcast(templates), ["h", "a", "b"], "left").filter("pos < 0 or t is not null")
    key = ["doc_id", "text_key", "n_words"]
    diagonal = voted.groupBy(*key, "t", "label", "is_base", "t_words", (F.col("pos") - F.col("t_pos")).alias("d")).agg(
        F.count(F.lit(1)).alias("votes"),
        # the template words that a vote covers, as bits
        F.bit_or(F.expr("shiftleft(3L, coalesce(t_pos, 0))")).alias("bits"))
    along = Window.partitionBy(*key, "t").orderBy("d")
    merged = diagonal.withColumn("new", F.coalesce((F.col("d") - F.lag("d").over(along) > gap).cast("int"), F.lit(1))) \
        .withColumn("span", F.sum("new").over(along))
    spans = merged.groupBy(*key, "t", "label", "is_base", "t_words", "span").agg(
        F.max(F.when(F.col("t").isNull(), F.col("votes"))).alias("copies"),
        F.bit_or("bits").alias("bits"),
        # a base phrase stands where one diagonal covers all of it
        F.min(F.when(F.expr("is_base and bit_count(bits) = t_words"), F.col("d"))).alias("first"),
        F.max(F.when(F.expr("is_base and bit_count(bits) = t_words"), F.col("d"))).alias("last"),
        F.count(F.when(F.expr("is_base and bit_count(bits) = t_words"), True)).alias("places"))
    covers = F.expr("bit_count(bits) / t_words")
    by_label = F.when(covers >= share, F.col("label"))
    out = spans.groupBy(*key).agg(
        F.max("copies").alias("copies"),
        F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("places") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("places") > 0, F.col("label")).otherwise(F.when(~F.col("is_base"), by_label)))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("t").isNotNull() & ((covers >= share) | (F.col("places") > 0)), covers)), F.lit(0.0)).alias("score"))
    return out.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "*") \
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
