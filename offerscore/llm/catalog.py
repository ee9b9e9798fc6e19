"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (collocations, decontaminate, html_extract, katz, lexical_search, license_scan, mixing, quality_rules,
               secret_scan, simhash, substring_dedup, suffix_dedup, warc)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document, by diagonal voting."""
    return license_scan.scan(_docs(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows repeated from an earlier document, removed from every document."""
    return substring_dedup.dedup(_docs(spark, sf_dir), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff trigram scores of all texts, learned from those not held out."""
    return katz.score(_docs(spark, sf_dir), order=3)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 4-word shingles and components of those at most 4 bits apart."""
    return simhash.components(_docs(spark, sf_dir))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the maximum-scoring region of words and tags."""
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed to weights 3, 1, 2 at 150% of all words, by weighted fair queueing."""
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response record."""
    derived = warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), "page_id")
    return derived.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier, removed from every document."""
    return suffix_dedup.dedup(_docs(spark, sf_dir), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, with those items."""
    return decontaminate.scan(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and n-gram perplexity verdict of every document."""
    return quality_rules.judge(_docs(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, by a broadcast index of the items."""
    return lexical_search.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language, by Toivonen mining."""
    return collocations.collocations(_docs(spark, sf_dir))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document stands for a repository, its source for the owner."""
    return secret_scan.scan(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_lm_scoring, op4_simhash, op5_html_extraction,
                              op6_mixing, op7_warc_derivatives, op8_suffix_dedup, op9_decontamination, op10_quality_rules,
                              op11_lexical_search, op12_collocations, op13_secret_scan)
}

SQL: dict[str, str] = {}

SQL["op1_license_scan"] = r"""
WITH phrases(phrase, label, is_base) AS (VALUES
  ('gnu general public license', 'gpl', true), ('apache license', 'apache', true),
  ('cc by', 'cc-by', true), ('mit license', 'mit', true),
  ('permission is hereby granted free of charge to any person obtaining a copy of this software', 'mit', false),
  ('licensed under the apache license version 2 0', 'apache', false),
  ('redistribution and use in source and binary forms with or without modification are permitted', 'bsd', false),
  ('this source code form is subject to the terms of the mozilla public license', 'mpl', false),
  ('this program is free software you can redistribute it and or modify it', 'gpl', false),
  ('gnu lesser general public license', 'lgpl', false), ('gnu affero general public license', 'agpl', false),
  ('licensed under cc by nc 4 0', 'cc-by-nc', false), ('licensed under cc by sa 4 0', 'cc-by-sa', false),
  ('this is free and unencumbered software released into the public domain', 'unlicense', false),
  ('permission to use copy modify and or distribute this software for any purpose', 'isc', false)),
t AS (SELECT phrase, label, is_base, len(string_split(phrase, ' ')) AS n, unnest(generate_series(1, len(string_split(phrase, ' ')) - 1)) AS tp,
             string_split(phrase, ' ') AS tw FROM phrases),
tg AS (SELECT phrase, label, is_base, n, tp - 1 AS tp, tw[tp] || ' ' || tw[tp + 1] AS g FROM t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, p - 1 AS p, w[p] || ' ' || w[p + 1] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS p FROM d)),
diag AS (SELECT doc_id, phrase, label, is_base, n, p - tp AS d, bit_or(3::BIGINT << tp) AS bits
         FROM g JOIN tg USING (g) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, phrase ORDER BY d) <= 3 THEN 0 ELSE 1 END AS new FROM diag),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, phrase ORDER BY d) AS run FROM steps),
spans AS (SELECT doc_id, label, is_base, n, bit_count(bit_or(bits)) / n AS cover,
                 count(*) FILTER (WHERE is_base AND bit_count(bits) = n) AS places,
                 min(d) FILTER (WHERE is_base AND bit_count(bits) = n) AS lo, max(d) FILTER (WHERE is_base AND bit_count(bits) = n) AS hi
          FROM runs GROUP BY doc_id, phrase, label, is_base, n, run),
found AS (SELECT doc_id, sum(places) AS n_base, min(lo) AS first_word, max(hi) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE places > 0) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE places > 0 OR (NOT is_base AND cover >= 0.9)) AS labels,
                 max(cover) FILTER (WHERE places > 0 OR cover >= 0.9) AS score FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""

SQL["op6_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(concat_ws(':', '17', doc_id)), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CASE number % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
total AS (SELECT sum(ss) AS n FROM s),
levels AS (SELECT 2 * ss / weight AS ratio, (n * 1.5::DOUBLE - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY 2 * ss / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w, total),
level AS (SELECT level FROM levels WHERE ratio > level ORDER BY ratio LIMIT 1),
q AS (SELECT d.*, ss, number, weight, least(2.0::DOUBLE * ss, level * weight) AS target,
             sum(size) OVER (PARTITION BY number ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, level),
passes AS (SELECT q.*, (upto + e * ss)::DOUBLE / weight AS time FROM q, (VALUES (0), (1)) AS t(e)),
cut AS (SELECT doc_id, size, sum(size) OVER (ORDER BY time, number ROWS UNBOUNDED PRECEDING) <= floor(n * 1.5) AS taken FROM passes, total WHERE size > 0),
n AS (SELECT doc_id, sum(size) FILTER (WHERE taken) AS taken FROM cut GROUP BY doc_id)
SELECT q.doc_id, size, ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN n USING (doc_id)
"""

SQL["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d)),
least_id AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
gone AS (SELECT DISTINCT win.doc_id, p + k AS p FROM win JOIN least_id USING (g), generate_series(0, 12) AS t(k)
         WHERE lo < win.doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS k, count(gone.p) AS n
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op11_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
it AS (SELECT item_id, unnest(w) AS term FROM i),
size AS (SELECT r, doc_id, len(w) AS n FROM d),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM size WHERE n > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, nd),
scored AS (SELECT item_id, tf.r, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size.n * nd) // nt))))::BIGINT AS score
           FROM it JOIN tf USING (term) JOIN weight USING (term) JOIN size ON size.r = tf.r, total GROUP BY item_id, tf.r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM scored JOIN size USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SQL["op12_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
x AS (SELECT lang, p, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM w),
e AS (SELECT lang, x, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4, lead(x, 4) OVER o AS x5 FROM x WINDOW o AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS k, x AS phrase FROM e UNION ALL SELECT lang, 2, x || ' ' || x2 FROM e WHERE x2 IS NOT NULL
      UNION ALL SELECT lang, 3, x || ' ' || x2 || ' ' || x3 FROM e WHERE x3 IS NOT NULL
      UNION ALL SELECT lang, 4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM e WHERE x4 IS NOT NULL
      UNION ALL SELECT lang, 5, x || ' ' || x2 || ' ' || x3 || ' ' || x4 || ' ' || x5 FROM e WHERE x5 IS NOT NULL),
f AS (SELECT lang, k AS words, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE words >= 2 AND a >= 100),
cut AS (SELECT c.*, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp
        FROM c, generate_series(1, 4) AS t(k) WHERE k < words),
s AS (SELECT cut.lang, cut.phrase, cut.words, cut.a, k, x.a AS l, y.a AS r, n,
             ((1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.words > b.words AND c.a >= b.a
                                                AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

_ASSIGN = secret_scan.ASSIGN.replace("'", "''")
_FORMS = secret_scan.FORMS

SQL["op13_secret_scan"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS (SELECT id, doc_id, source, 0 AS kind, regexp_extract_all(text, '{_ASSIGN}') AS found, string_split_regex(text, '{_ASSIGN}') AS gaps FROM d
      UNION ALL SELECT id, doc_id, source, 1, regexp_extract_all(text, '{secret_scan.ACCESS}'), string_split_regex(text, '{secret_scan.ACCESS}') FROM d
      UNION ALL SELECT id, doc_id, source, 2, regexp_extract_all(text, '{secret_scan.HEX}'), string_split_regex(text, '{secret_scan.HEX}') FROM d
      UNION ALL SELECT id, doc_id, source, 3, regexp_extract_all(text, '{_FORMS}'), string_split_regex(text, '{_FORMS}') FROM d),
h AS (SELECT id, doc_id, source, kind, unnest(generate_series(1, len(found))) AS i, unnest(found) AS x, unnest(gaps[1:len(found)]) AS gap FROM m WHERE len(found) > 0),
p AS (SELECT *, sum(length(gap) + length(x)) OVER (PARTITION BY id, kind ORDER BY i) AS e,
             CASE WHEN kind = 0 THEN regexp_extract(x, '{_ASSIGN}', 2) ELSE x END AS v FROM h),
looked AS (SELECT *, length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(lower(v), '{secret_scan.PLACEHOLDER}')
                  AND len(list_distinct(string_split(v, ''))) >= 8 AS looks FROM p WHERE kind > 0 OR length(v) >= 6),
value AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners, bool_or(looks) AS looks FROM looked WHERE kind < 3 OR looks GROUP BY v),
judged AS (SELECT v, CASE WHEN owners >= 3 THEN 4 WHEN looks THEN 3 END AS verdict FROM value),
spans AS (SELECT id, e - length(x) AS s, kind, e FROM looked WHERE kind < 3
          UNION ALL SELECT DISTINCT id, e - length(looked.v), verdict, e FROM looked JOIN judged USING (v) WHERE verdict IS NOT NULL AND (kind < 3 OR looks)),
named AS (SELECT *, ['assign', 'access', 'hex', 'live', 'example'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS t FROM spans),
per AS (SELECT id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
               string_agg(t, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind, e) AS spans,
               count(*) FILTER (WHERE kind = 3) AS n_live, count(*) FILTER (WHERE kind = 4) AS n_example FROM named GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN per USING (id)
"""
