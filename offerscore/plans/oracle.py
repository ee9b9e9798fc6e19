"""DuckDB SQL for each catalogued query (the driver's correctness oracle).

Every text starts from the same offers CTE (FIXTURES section 3, DuckDB dialect)
and aliases every computed column exactly as the Spark query does.  Computed
doubles are rounded to 6 digits in both engines.
"""

from __future__ import annotations

VARIABLES = ["price", "discount", "quantity", "shipping_cost", "lead_time_days",
             "delivery_time_days", "quality", "technical", "warranty_months", "experience_years"]

OFFERS_CTE = """offers AS (
SELECT concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
                      CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR)) AS offer_id,
  l.l_partkey AS tender_id, s.s_name AS supplier,
  l.l_extendedprice AS price,
  l.l_extendedprice * l.l_discount AS discount,
  l.l_quantity AS quantity,
  l.l_extendedprice * l.l_tax AS shipping_cost,
  CAST(1 + abs(date_diff('day', l.l_shipdate, o.o_orderdate)) % 60 AS DOUBLE) AS lead_time_days,
  CAST(5 + (l.l_orderkey*3 + l.l_suppkey*5 + l.l_linenumber) % 56 AS DOUBLE) AS delivery_time_days,
  CASE WHEN l.l_orderkey % 97 = 0 THEN NULL
       ELSE CAST(50 + (l.l_orderkey*31 + l.l_linenumber*17 + l.l_suppkey) % 51 AS DOUBLE) END AS quality,
  CAST(60 + (l.l_orderkey*13 + l.l_suppkey*7) % 41 AS DOUBLE) AS technical,
  CAST(6 * (1 + l.l_linenumber % 6) AS DOUBLE) AS warranty_months,
  CAST(1 + s.s_suppkey % 20 AS DOUBLE) AS experience_years,
  CASE l.l_returnflag WHEN 'R' THEN 'No' WHEN 'A' THEN 'YES' ELSE 'Yes' END AS compliance,
  CASE WHEN l.l_returnflag = 'R' THEN 'Missing docs' ELSE 'All docs provided' END AS compliance_notes,
  CASE s.s_suppkey % 4 WHEN 0 THEN 'ISO9001,CE' WHEN 1 THEN 'ISO14001' WHEN 2 THEN ' ' ELSE NULL END AS certifications,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Net 15' WHEN '2-HIGH' THEN 'Net 30' WHEN '3-MEDIUM' THEN 'Net 45'
                         WHEN '5-LOW' THEN 'Net 60' ELSE NULL END AS payment_terms,
  CASE l.l_linestatus WHEN 'O' THEN 'FOB' ELSE 'CIF' END AS delivery_terms,
  n.n_name AS country,
  CASE WHEN s.s_suppkey % 2 = 0 THEN 'Manufacturer' ELSE 'Distributor' END AS supplier_type
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
),
compliant AS (SELECT * FROM offers WHERE lower(compliance) = 'yes')"""


def with_offers(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {OFFERS_CTE}{extra}\n{body}"


def d(x: float) -> str:
    """A double literal (DuckDB reads bare decimals as DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def norm_ctes(src: str, variables, minimize=("price",), by="tender_id", name="normed") -> str:
    """min-max normalised variables per tender, as a CTE ``name``."""
    mins = {m.lower() for m in minimize}
    part = f"PARTITION BY {by}" if by else ""
    stats = ", ".join(f"min({v}) OVER ({part}) AS _mn_{i}, max({v}) OVER ({part}) AS _mx_{i}"
                      for i, v in enumerate(variables))
    exprs = []
    for i, v in enumerate(variables):
        body = (f"(_mx_{i} - {v}) / (_mx_{i} - _mn_{i})" if v.lower() in mins
                else f"({v} - _mn_{i}) / (_mx_{i} - _mn_{i})")
        exprs.append(f"CASE WHEN _mn_{i} = _mx_{i} THEN {d(1.0)} ELSE {body} END AS {v}")
    others = "offer_id, tender_id, supplier"
    return (f"_st_{name} AS (SELECT *, {stats} FROM {src}),\n"
            f"{name} AS (SELECT {others}, {', '.join(exprs)} FROM _st_{name})")


def money_mean(col: str) -> str:
    """Exact mean of a cents column, HALF_UP at 6 decimals, as a double."""
    cents = f"sum(CAST(round({col} * 100) AS HUGEINT))"
    n = f"count({col})"
    return f"CAST(({cents} * 20000 + {n}) // nullif(2 * {n}, 0) AS DOUBLE) / 1000000.0"


def score_expr(variables, weights) -> str:
    return " + ".join(f"{v} * {d(weights[v])}" for v in variables)


# ---------------------------------------------------------------- scoring

CUSTOM_WEIGHTS = {"price": 0.3, "discount": 0.05, "quantity": 0.0, "shipping_cost": 0.05,
                  "lead_time_days": 0.05, "delivery_time_days": 0.2, "quality": 0.25,
                  "technical": 0.05, "warranty_months": 0.15, "experience_years": 0.1}

SQL: dict[str, str] = {}


def _rank_sql(weights) -> str:
    body = """SELECT offer_id, tender_id, supplier, round(score, 6) AS score,
  row_number() OVER (PARTITION BY tender_id ORDER BY score DESC NULLS LAST, offer_id) AS rank
FROM scored"""
    return with_offers(body, norm_ctes("compliant", VARIABLES),
                       f"scored AS (SELECT *, {score_expr(VARIABLES, weights)} AS score FROM normed)")


# literal weights: ten variables, equal or 0.6 on one and the rest on nine; the custom ones sum to 1.2
EQUAL = dict.fromkeys(VARIABLES, 0.1)


def _focused(name: str, rest: float) -> dict[str, float]:
    return {v: 0.6 if v == name else rest / 9 for v in VARIABLES}


SQL["rank_equal"] = _rank_sql(EQUAL)
SQL["rank_price_focused"] = _rank_sql(_focused("price", 0.2))
SQL["rank_quality_focused"] = _rank_sql(_focused("quality", 0.2))
SQL["rank_quality_focused_documented"] = _rank_sql(_focused("quality", 0.4))
SQL["rank_custom"] = _rank_sql({v: w / 1.2 for v, w in CUSTOM_WEIGHTS.items()})


# ---------------------------------------------------------------- scoring views
KEYS = "offer_id, tender_id, supplier"

SQL["best_offer"] = with_offers(
    """SELECT tender_id, offer_id, supplier, round(score, 6) AS score, 'Best' AS highlight FROM (
  SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY score DESC NULLS LAST, offer_id) AS rn
  FROM scored) WHERE rn = 1""",
    norm_ctes("compliant", VARIABLES),
    f"scored AS (SELECT *, {score_expr(VARIABLES, EQUAL)} AS score FROM normed)")

SQL["cheapest_first"] = with_offers(
    f"""SELECT {KEYS}, price,
  row_number() OVER (PARTITION BY tender_id ORDER BY price ASC NULLS LAST, offer_id) AS price_order
FROM compliant""")

SQL["by_lead_time"] = with_offers(
    f"""SELECT {KEYS}, lead_time_days,
  row_number() OVER (PARTITION BY tender_id ORDER BY lead_time_days ASC NULLS LAST, offer_id) AS lead_time_order
FROM compliant""")

SQL["score_composition"] = with_offers(
    " UNION ALL ".join(
        f"SELECT {KEYS}, '{v}' AS variable, round({v}, 6) AS normalized, "
        f"round({v} * {d(EQUAL[v])}, 6) AS contribution FROM normed" for v in VARIABLES),
    norm_ctes("compliant", VARIABLES))

_PROFILE = ["price", "delivery_time_days", "warranty_months", "quality"]
SQL["supplier_profile"] = with_offers(
    " UNION ALL ".join(f"SELECT {KEYS}, '{v}' AS variable, round({v}, 6) AS value FROM prof" for v in _PROFILE),
    norm_ctes("compliant", _PROFILE, minimize=("price", "delivery_time_days"), name="prof"))

# ---------------------------------------------------------------- preparation
SUBSET = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000003"]

SQL["compliant_only"] = with_offers(f"SELECT {KEYS}, compliance FROM compliant")

SQL["coerce_numeric"] = with_offers(
    """SELECT offer_id, TRY_CAST(price AS DOUBLE) AS price, TRY_CAST(quality AS DOUBLE) AS quality, remarks, country
FROM dirty""",
    """dirty AS (SELECT offer_id,
  CASE WHEN CAST(split_part(offer_id, '-', 1) AS BIGINT) % 53 = 0 THEN 'n/a' ELSE CAST(price AS VARCHAR) END AS price,
  CASE WHEN CAST(split_part(offer_id, '-', 1) AS BIGINT) % 53 = 0 THEN 'n/a' ELSE CAST(quality AS VARCHAR) END AS quality,
  'see note ' || CAST(tender_id AS VARCHAR) AS remarks, country FROM offers)""")

SQL["missing_report"] = with_offers(" UNION ALL ".join(
    f"SELECT '{v}' AS variable, count(*) - count({v}) AS n_missing, count(*) - count({v}) > 0 AS has_missing "
    f"FROM compliant" for v in VARIABLES))


def _ranges_sql():
    parts = []
    for i, v in enumerate(VARIABLES):
        prior = " AND ".join(f"{p} IS NOT NULL" for p in VARIABLES[:i])
        x = f"CASE WHEN {prior} THEN {v} END" if prior else v
        parts.append(f"SELECT tender_id, '{v}' AS variable, coalesce(min({x}), {d(0)}) AS lo, "
                     f"coalesce(max({x}), {d(1)}) AS hi FROM compliant GROUP BY tender_id")
    body = ("SELECT tender_id, variable, lo, hi, CASE WHEN hi - lo > 10 THEN " + d(1.0) + " ELSE " + d(0.01)
            + " END AS step FROM (" + " UNION ALL ".join(parts) + ")")
    return with_offers(body)


SQL["variable_ranges"] = _ranges_sql()

SQL["range_filter"] = with_offers(
    f"""SELECT {KEYS}, price, quality, delivery_time_days FROM compliant
WHERE price BETWEEN 5000 AND 60000 AND quality BETWEEN 60 AND 95 AND delivery_time_days BETWEEN 5 AND 40""")

SQL["supplier_subset"] = with_offers(
    f"SELECT {KEYS}, price FROM compliant WHERE supplier IN ({', '.join(repr(s) for s in SUBSET)})")

SQL["total_cost"] = with_offers(f"SELECT {KEYS}, round(price - discount + shipping_cost, 6) AS total_cost FROM compliant")

SQL["missing_certifications"] = with_offers(
    r"""SELECT offer_id, supplier, certifications FROM compliant
WHERE certifications IS NULL OR regexp_full_match(certifications, '\s*')""")

SQL["numeric_table"] = with_offers(f"SELECT offer_id, tender_id, supplier, {', '.join(VARIABLES)} FROM compliant")

SQL["compliance_overview"] = with_offers(
    "SELECT offer_id, supplier, compliance, compliance_notes, certifications FROM compliant")

SQL["terms_overview"] = with_offers("SELECT offer_id, supplier, payment_terms, supplier_type FROM compliant")

SQL["view_columns"] = with_offers(
    "SELECT offer_id, supplier, lead_time_days, delivery_time_days, quantity FROM compliant")

SQL["supplier_row"] = with_offers(
    f"""SELECT tender_id, offer_id, supplier, price, quality, delivery_time_days FROM (
  SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY offer_id) AS rn
  FROM compliant WHERE supplier = '{SUBSET[0]}') WHERE rn = 1""")

# ---------------------------------------------------------------- summaries
SQL["price_summary"] = with_offers(
    f"""SELECT tender_id, min(price) AS price_min, max(price) AS price_max, {money_mean('price')} AS price_mean,
  round(quantile_cont(price, 0.5), 6) AS price_median, round(stddev_samp(price), 6) AS price_std
FROM compliant GROUP BY tender_id""")

SQL["delivery_kpis"] = with_offers(
    """SELECT tender_id, round(avg(lead_time_days), 6) AS avg_lead_time_days,
  min(delivery_time_days) AS min_delivery_time_days FROM compliant GROUP BY tender_id""")

SQL["compliance_counts"] = with_offers(
    """SELECT compliance, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
FROM offers GROUP BY compliance""")

SQL["supplier_type_counts"] = with_offers(
    """SELECT supplier_type, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
FROM compliant WHERE supplier_type IS NOT NULL GROUP BY supplier_type""")

SQL["payment_terms_kpis"] = with_offers(
    """SELECT tender_id, top_payment_term, coalesce(c, 0) AS top_payment_term_count, coalesce(n, 0) AS n_payment_terms
FROM (SELECT DISTINCT tender_id FROM compliant) LEFT JOIN (SELECT tender_id, payment_terms AS top_payment_term, c, n FROM (
  SELECT tender_id, payment_terms, c,
    row_number() OVER (PARTITION BY tender_id ORDER BY c DESC, payment_terms) AS rn,
    count(*) OVER (PARTITION BY tender_id) AS n
  FROM (SELECT tender_id, payment_terms, count(*) AS c FROM compliant
        WHERE payment_terms IS NOT NULL GROUP BY tender_id, payment_terms)) WHERE rn = 1) USING (tender_id)""")

SQL["distinct_supplier_types"] = with_offers(
    "SELECT tender_id, count(DISTINCT supplier_type) AS n_supplier_types FROM compliant GROUP BY tender_id")

SQL["compliance_by_supplier"] = with_offers(
    """SELECT supplier, compliance, count(*) AS count FROM offers
WHERE supplier IS NOT NULL AND compliance IS NOT NULL GROUP BY supplier, compliance""")


def _corr_sql():
    parts = []
    for a in VARIABLES:
        for b in VARIABLES:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(
                f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(covar_pop({a}, {b}) / nullif("
                f"stddev_pop({a}) FILTER (WHERE {both}) * stddev_pop({b}) FILTER (WHERE {both}), 0), 6) AS corr "
                f"FROM compliant")
    return with_offers(" UNION ALL ".join(parts))


SQL["correlation"] = _corr_sql()

SQL["pareto"] = with_offers(
    """SELECT tender_id, supplier, round(price, 6) AS price,
  row_number() OVER w AS position,
  round(sum(price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        / nullif(sum(price) OVER (PARTITION BY tender_id), 0) * 100.0, 6) AS cum_pct
FROM (SELECT tender_id, supplier, coalesce(sum(price), 0) AS price FROM compliant GROUP BY tender_id, supplier)
WINDOW w AS (PARTITION BY tender_id ORDER BY price DESC, supplier)""")

SQL["box_stats"] = with_offers(
    """SELECT q.tender_id, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
  round(min(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END), 6) AS whisker_low,
  round(max(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END), 6) AS whisker_high,
  sum(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN 0 ELSE 1 END) AS n_outliers
FROM q JOIN compliant c ON c.tender_id = q.tender_id AND c.price IS NOT NULL
GROUP BY q.tender_id, q1, median, q3, iqr, lower_fence, upper_fence""",
    """q0 AS (SELECT tender_id, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
  quantile_cont(price, 0.75) AS q3 FROM compliant GROUP BY tender_id),
q AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q0)""")

SQL["price_histogram"] = with_offers(
    """SELECT tender_id, bin, count(*) AS count, round(any_value(mean), 6) AS mean,
  round(any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / 10, 6) AS bin_low,
  round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 10, 6) AS bin_high
FROM (SELECT c.tender_id, lo, hi, mean,
        CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((price - lo) / (hi - lo) * 10) + 1, 10) END AS BIGINT) AS bin
      FROM compliant c JOIN s ON c.tender_id = s.tender_id WHERE price IS NOT NULL)
GROUP BY tender_id, bin""",
    f"s AS (SELECT tender_id, min(price) AS lo, max(price) AS hi, {money_mean('price')} AS mean "
    "FROM compliant GROUP BY tender_id)")

SQL["supplier_totals"] = with_offers(
    """SELECT tender_id, supplier, round(total_price, 6) AS total_price,
  row_number() OVER (PARTITION BY tender_id ORDER BY total_price ASC NULLS LAST, supplier) AS position
FROM (SELECT tender_id, supplier, sum(price) AS total_price FROM compliant GROUP BY tender_id, supplier)""")

for _col, _order in (("quality", "DESC"), ("lead_time_days", "ASC"), ("delivery_time_days", "ASC"), ("experience_years", "DESC")):
    SQL[f"supplier_totals_{_col}"] = with_offers(
        f"""SELECT tender_id, supplier, round(total, 6) AS total_{_col},
  row_number() OVER (PARTITION BY tender_id ORDER BY total {_order} NULLS LAST, supplier) AS position
FROM (SELECT tender_id, supplier, sum({_col}) AS total FROM compliant GROUP BY tender_id, supplier)""")

for _view, _cols in (("price_quality", "price, quality"), ("price_quality_delivery", "price, quality, delivery_time_days"),
                     ("price_delivery", "price, delivery_time_days"), ("experience", "experience_years"),
                     ("warranty", "warranty_months"), ("price_points", "price"), ("price_technical", "price, technical")):
    SQL[f"view_{_view}"] = with_offers(f"SELECT offer_id, supplier, {_cols} FROM compliant")

SQL["view_experience_score"] = with_offers(
    "SELECT c.offer_id, c.supplier, c.experience_years, round(s.score, 6) AS score FROM compliant c JOIN scored s ON s.offer_id = c.offer_id",
    norm_ctes("compliant", VARIABLES), f"scored AS (SELECT *, {score_expr(VARIABLES, EQUAL)} AS score FROM normed)")

SQL["best_flags"] = SQL["rank_equal"].replace("round(score, 6) AS score,\n  row_number()", "row_number()")
SQL["best_flags"] = f"SELECT *, CASE WHEN rank = 1 THEN 'Best' ELSE 'Other' END AS highlight FROM ({SQL['best_flags']})"

SQL["distinct_suppliers"] = with_offers("SELECT DISTINCT tender_id, supplier FROM compliant")

# ---------------------------------------------------------------- windows
SQL["pct_rank"] = with_offers(
    """SELECT offer_id, tender_id,
  round(CASE WHEN price IS NULL THEN NULL ELSE
    CAST(2 * (rank() OVER (PARTITION BY tender_id ORDER BY price)) + count(*) OVER (PARTITION BY tender_id, price) - 1 AS DOUBLE)
      / 2.0 / count(price) OVER (PARTITION BY tender_id) END, 6) AS price_pct_rank
FROM compliant""")

SQL["min_rank"] = with_offers(
    """SELECT offer_id, tender_id, quality,
  CASE WHEN quality IS NULL THEN NULL ELSE rank() OVER (PARTITION BY tender_id ORDER BY quality DESC NULLS LAST) END
    AS quality_rank
FROM compliant""")

SQL["zscore"] = with_offers(
    """SELECT offer_id, tender_id,
  round((price - avg(price) OVER t) / nullif(stddev_pop(price) OVER t, 0), 6) AS price_z
FROM compliant WINDOW t AS (PARTITION BY tender_id)""")

SQL["duplicated"] = with_offers(
    """SELECT offer_id, tender_id,
  count(*) OVER (PARTITION BY tender_id, round_even(price, -2)) > 1 AS price_dup FROM compliant""")


# ---------------------------------------------------------------- risk
RISKS = ["lowball_risk", "drip_pricing_risk", "drip_pricing_flag", "signaling_risk",
         "cover_bid_risk", "decoy_bid_risk", "bid_similarity_risk"]


def _risk_ctes(mode: str) -> list[str]:
    if mode == "raw":
        src = [norm_ctes("compliant", VARIABLES),
               f"sc AS (SELECT offer_id, {score_expr(VARIABLES, EQUAL)} AS score FROM normed)",
               "rin AS (SELECT c.offer_id, c.tender_id, c.supplier, c.price, c.quality, sc.score "
               "FROM compliant c JOIN sc ON c.offer_id = sc.offer_id)"]
    else:
        src = [norm_ctes("compliant", VARIABLES),
               f"rin AS (SELECT offer_id, tender_id, supplier, price, quality, "
               f"{score_expr(VARIABLES, EQUAL)} AS score FROM normed)"]
    flag = lambda c: f"CASE WHEN {c} THEN {d(1.0)} ELSE {d(0.0)} END"
    pr = ("CASE WHEN {x} IS NULL THEN NULL ELSE CAST(2 * (rank() OVER (PARTITION BY tender_id ORDER BY {x})) "
          "+ count(*) OVER (PARTITION BY tender_id, {x}) - 1 AS DOUBLE) / 2.0 "
          "/ count({x}) OVER (PARTITION BY tender_id) END")
    src += [
        """st AS (SELECT tender_id, avg(price) AS pmean, min(price) AS pmin, max(price) AS pmax,
  avg(score) AS smean, stddev_pop(price) AS pstd, stddev_pop(score) AS sstd, min(quality) AS qmin,
  max(quality) AS qmax, quantile_cont(price, 0.75) AS p75, quantile_cont(score, 0.5) AS smed,
  quantile_cont(quality, 0.25) AS q25 FROM rin GROUP BY tender_id)""",
        f"""rk AS (SELECT *, {pr.format(x='price')} AS prank, {pr.format(x='score')} AS srank,
  count(*) OVER (PARTITION BY tender_id, round_even(price, -2)) > 1 AS pdup,
  count(*) OVER (PARTITION BY tender_id, round_even(score, 0)) > 1 AS sdup FROM rin)""",
        f"""rs AS (SELECT rk.offer_id, rk.tender_id, rk.supplier, rk.score, rk.price, rk.quality,
  CASE WHEN price < {d(0.85)} * pmean THEN (pmean - price) / nullif(pmean, 0) ELSE {d(0.0)} END AS lowball_risk,
  ((price - pmin) / nullif(pmax - pmin, 0)) * (1 - (quality - qmin) / nullif(qmax - qmin, 0)) AS drip_pricing_risk,
  {flag('price > p75 AND quality < q25')} AS drip_pricing_flag,
  {flag('srank > 0.8 AND prank > 0.8')} AS signaling_risk,
  {flag('price > p75 AND score < smed')} AS cover_bid_risk,
  {flag('abs((price - pmean) / nullif(pstd, 0)) > 2 OR abs((score - smean) / nullif(sstd, 0)) > 2')}
    AS decoy_bid_risk,
  {flag('pdup OR sdup')} AS bid_similarity_risk
FROM rk JOIN st ON rk.tender_id = st.tender_id)""",
        "risk AS (SELECT *, (" + " + ".join(f"coalesce({c}, 0)" for c in RISKS) + ") / CAST(("
        + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in RISKS) + ") AS DOUBLE) AS total_risk FROM rs)",
    ]
    return src


def _risk_sql(mode: str) -> str:
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in ["total_risk", *RISKS])
    return with_offers(f"SELECT offer_id, tender_id, supplier, {cols} FROM risk", *_risk_ctes(mode))


SQL["risk_raw"] = _risk_sql("raw")
SQL["risk_ranked"] = _risk_sql("ranked")

# literal copies of the fixed labels and texts that must come out
RISK_LABELS = {
    'lowball_risk': 'Lowballing',
    'drip_pricing_risk': 'Drip Pricing',
    'drip_pricing_flag': 'Drip Pricing Flag',
    'signaling_risk': 'Market Signaling',
    'cover_bid_risk': 'Cover Bidding',
    'decoy_bid_risk': 'Decoy Bidding',
    'bid_similarity_risk': 'Bid Similarity',
}
RISK_EXPLANATIONS = {
    'Lowballing': 'A bid much lower than the average, possibly unsustainable.',
    'Drip Pricing': 'Price appears low but may increase with hidden costs.',
    'Drip Pricing Flag': 'Supplier has high price and low quality/technical score.',
    'Market Signaling': 'High price and high score, possibly signaling to competitors.',
    'Cover Bidding': 'High price and low score, possibly not a serious bid.',
    'Decoy Bidding': 'Bid is an outlier in price or score, possibly to distract.',
    'Bid Similarity': 'Multiple bids with very similar price or score, may indicate collusion.',
}

SQL["risk_explained"] = with_offers(
    " UNION ALL ".join(
        f"SELECT offer_id, supplier, '{c}' AS risk, round({c}, 6) AS value, '{RISK_LABELS[c]}' AS risk_name, "
        f"'{RISK_EXPLANATIONS[RISK_LABELS[c]]}' AS meaning FROM risk" for c in RISKS),
    *_risk_ctes("raw"))

_STATUS = ("CASE WHEN score IS NOT NULL AND row_number() OVER (PARTITION BY tender_id ORDER BY score DESC NULLS LAST, offer_id) = 1 THEN '[BEST]' "
           "WHEN {r} > 0.7 THEN '[RISK]' ELSE '' END")
SQL["red_flags"] = with_offers(
    f"""SELECT offer_id, tender_id, supplier, round(score, 6) AS score, round(total_risk, 6) AS total_risk,
  {_STATUS.format(r='total_risk')} AS status FROM risk""", *_risk_ctes("raw"))

SQL["comparison_summary"] = with_offers(
    f"""SELECT offer_id, tender_id, supplier, round(score, 6) AS score, round(total_risk, 6) AS risk, price,
  delivery_time_days AS delivery, quality, {_STATUS.format(r='total_risk')} AS status
FROM risk JOIN (SELECT offer_id AS oid, delivery_time_days FROM compliant) o ON o.oid = risk.offer_id""",
    *_risk_ctes("raw"))


# ---------------------------------------------------------------- negotiation
NEG_CTE = """neg AS (SELECT *, quality / nullif(price * (1 + 0.01 * delivery_time_days), 0) AS score FROM compliant),
negr AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY score DESC NULLS LAST, offer_id) AS position
         FROM neg),
negt AS (SELECT *, position <= 3 AS winner FROM negr)"""

SQL["negotiation_table"] = with_offers(
    f"SELECT {KEYS}, price, quality, delivery_time_days, round(score, 6) AS score, position, winner FROM negt",
    NEG_CTE)

SQL["acceptance_threshold"] = with_offers(
    """SELECT tender_id, round(arg_max(score, position), 6) AS threshold_score,
  string_agg(supplier, ', ' ORDER BY position) AS winners, count(*) AS n_winners
FROM negt WHERE winner GROUP BY tender_id""", NEG_CTE)


def _f2(x):
    return f"printf('%.2f', round_even({x}, 2))"


SQL["negotiation_advice"] = with_offers(
    f"""SELECT {KEYS},
  round(coalesce(CASE WHEN price > bp THEN price - bp END, 0), 6) AS price_gap,
  round(coalesce(CASE WHEN quality < bq THEN bq - quality END, 0), 6) AS quality_gap,
  round(coalesce(CASE WHEN delivery_time_days > bd THEN delivery_time_days - bd END, 0), 6) AS delivery_gap,
  CASE WHEN tips = '' THEN supplier || ': Already matches the best terms among winners.'
       ELSE supplier || ': ' || tips || '.' END AS advice
FROM (SELECT *, concat_ws(', and ',
    CASE WHEN price > bp THEN 'reduce price by €' || {_f2('price - bp')} || ' to match the lowest winner''s price' END,
    CASE WHEN quality < bq THEN 'increase quality by ' || {_f2('bq - quality')}
         || ' to match the highest winner''s quality' END,
    CASE WHEN delivery_time_days > bd THEN 'reduce delivery time by ' || {_f2('delivery_time_days - bd')}
         || ' days to match the fastest winner''s delivery' END) AS tips
  FROM (SELECT w.*, bp, bq, bd FROM negt w JOIN
        (SELECT tender_id AS tid, min(price) AS bp, max(quality) AS bq, min(delivery_time_days) AS bd
         FROM negt WHERE winner GROUP BY tender_id) b ON w.tender_id = b.tid WHERE w.winner))""",
    NEG_CTE)

SQL["tradeoff"] = with_offers(
    "SELECT offer_id, supplier, price, quality, delivery_time_days AS delivery, winner FROM negt", NEG_CTE)

# ---------------------------------------------------------------- what-if
WHATIF_SUPPLIER = SUBSET[0]
TOP_VARS = ["price", "quality", "warranty_months", "experience_years", "lead_time_days"]


def _sim_cte(changes, name="sim") -> str:
    cols = []
    for v in VARIABLES:
        if v in changes:
            cols.append(f"CASE WHEN supplier = '{WHATIF_SUPPLIER}' THEN {d(changes[v])} ELSE {v} END AS {v}")
        else:
            cols.append(v)
    return f"{name} AS (SELECT offer_id, tender_id, supplier, {', '.join(cols)} FROM compliant)"


def _eps_score_cte(src, top, keys="tender_id", name="wsc") -> str:
    stats = ", ".join(f"min({v}) OVER (PARTITION BY {keys}) AS _mn_{i}, max({v}) OVER (PARTITION BY {keys}) AS _mx_{i}"
                      for i, v in enumerate(top))
    total = " + ".join(f"coalesce(({v} - _mn_{i}) / (_mx_{i} - _mn_{i} + {d(1e-9)}), 0)" for i, v in enumerate(top))
    return (f"_st_{name} AS (SELECT *, {stats} FROM {src}),\n"
            f"{name} AS (SELECT *, {total} AS score FROM _st_{name})")


RANK_SQL = ("CASE WHEN score IS NULL THEN NULL ELSE rank() OVER (PARTITION BY tender_id ORDER BY score DESC NULLS LAST)"
            " END")
CHANGES = {"price": 1000.0, "quality": 100.0}

SQL["whatif"] = with_offers(
    f"SELECT {KEYS}, round(score, 6) AS score, {RANK_SQL} AS rank FROM wsc",
    _sim_cte(CHANGES), _eps_score_cte("sim", TOP_VARS))

SQL["supplier_result"] = with_offers(
    f"""SELECT tender_id, score, rank, offer_id FROM (
  SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY rank, offer_id) AS n FROM (
    SELECT {KEYS}, round(score, 6) AS score, {RANK_SQL} AS rank FROM wsc) WHERE supplier = '{WHATIF_SUPPLIER}') WHERE n = 1""",
    _sim_cte(CHANGES), _eps_score_cte("sim", TOP_VARS))

SQL["whatif_negotiation"] = with_offers(
    f"""SELECT {KEYS}, round(score, 6) AS score, {RANK_SQL} AS rank FROM (
  SELECT *, quality / nullif(price * (1 + 0.01 * delivery_time_days), 0) AS score FROM sim)""",
    _sim_cte(CHANGES))

SQL["whatif_impact"] = with_offers(
    """SELECT a.offer_id, a.supplier, round(b.score, 6) AS score_before, round(a.score, 6) AS score_after,
  b.rank AS rank_before, a.rank AS rank_after, round(a.score - b.score, 6) + 0.0 AS score_change,
  b.rank - a.rank AS rank_change
FROM aft a JOIN bef b ON a.offer_id = b.offer_id AND a.tender_id = b.tender_id""",
    _sim_cte(CHANGES), _eps_score_cte("sim", TOP_VARS),
    f"aft AS (SELECT offer_id, tender_id, supplier, score, {RANK_SQL} AS rank FROM wsc)",
    _sim_cte({}, name="sim0"), _eps_score_cte("sim0", TOP_VARS, name="wsc0"),
    f"bef AS (SELECT offer_id, tender_id, score, {RANK_SQL} AS rank FROM wsc0)")


def _sensitivity_sql(points=3) -> str:
    bounds = " UNION ALL ".join(f"SELECT '{v}' AS variable, min({v}) AS lo, max({v}) AS hi FROM compliant"
                                for v in TOP_VARS)
    grid = (f"grid AS (SELECT DISTINCT b.variable, b.lo + (b.hi - b.lo) * CAST(t.j AS DOUBLE) / {d(points - 1)} AS value "
            f"FROM ({bounds}) b, range({points}) t(j) WHERE b.lo IS NOT NULL)")
    hit = f"supplier = '{WHATIF_SUPPLIER}'"
    cols = ", ".join(f"CASE WHEN {hit} AND g.variable = '{v}' THEN g.value ELSE c.{v} END AS {v}" for v in TOP_VARS)
    ex = f"ex AS (SELECT c.offer_id, c.tender_id, c.supplier, g.variable, g.value, {cols} FROM compliant c, grid g)"
    return with_offers(
        f"""SELECT m.tender_id, m.variable, round(m.value, 6) AS value, round(m.supplier_score, 6) AS supplier_score,
  1 + sum(CASE WHEN s.score > m.supplier_score THEN 1 ELSE 0 END) AS supplier_rank
FROM mine m JOIN ssc s ON s.tender_id = m.tender_id AND s.variable = m.variable AND s.value = m.value
GROUP BY m.tender_id, m.variable, m.value, m.supplier_score""",
        grid, ex, _eps_score_cte("ex", TOP_VARS, keys="tender_id, variable, value", name="ssc"),
        f"mine AS (SELECT tender_id, variable, value, max(score) AS supplier_score FROM ssc WHERE {hit} "
        f"GROUP BY tender_id, variable, value)")


SQL["sensitivity"] = _sensitivity_sql()

# ---------------------------------------------------------------- ML (closed form)
SQL["pca2_two_vars"] = with_offers(
    """SELECT offer_id, supplier,
  round(CASE WHEN r >= 0 THEN (z1 + z2) ELSE (z1 - z2) END / sqrt(2), 6) AS pc1,
  round(CASE WHEN r >= 0 THEN (z1 - z2) ELSE (z1 + z2) END / sqrt(2), 6) AS pc2
FROM (SELECT offer_id, supplier,
        (price - avg(price) OVER ()) / coalesce(nullif(stddev_pop(price) OVER (), 0), 1) AS z1,
        (quality - avg(quality) OVER ()) / coalesce(nullif(stddev_pop(quality) OVER (), 0), 1) AS z2,
        corr(price, quality) OVER () AS r
      FROM compliant WHERE price IS NOT NULL AND quality IS NOT NULL)""")

SQL["pca2_by_tender"] = with_offers(
    """SELECT offer_id, tender_id, supplier,
  round(CASE WHEN abs(c) >= 1e-9 THEN (z1 + sign(c) * z2) / sqrt(2) WHEN s1 = 0 THEN z2 ELSE z1 END, 6) + 0.0 AS pc1,
  round(CASE WHEN abs(c) >= 1e-9 THEN (z1 - sign(c) * z2) / sqrt(2) WHEN s1 = 0 THEN z1 ELSE z2 END, 6) + 0.0 AS pc2
FROM (SELECT *, avg(z1 * z2) OVER (PARTITION BY tender_id) AS c
      FROM (SELECT offer_id, tender_id, supplier, stddev_pop(price) OVER w AS s1,
                   CASE WHEN stddev_pop(price) OVER w > 0 THEN (price - avg(price) OVER w) / stddev_pop(price) OVER w ELSE 0.0 END AS z1,
                   CASE WHEN stddev_pop(quality) OVER w > 0 THEN (quality - avg(quality) OVER w) / stddev_pop(quality) OVER w ELSE 0.0 END AS z2
            FROM compliant WHERE price IS NOT NULL AND quality IS NOT NULL
            WINDOW w AS (PARTITION BY tender_id)))""")

# ---------------------------------------------------------------- sources / sinks
SQL["offers_csv_roundtrip"] = with_offers(
    "SELECT offer_id, tender_id, supplier, round(score, 6) AS score FROM scored",
    norm_ctes("compliant", VARIABLES),
    f"scored AS (SELECT *, {score_expr(VARIABLES, EQUAL)} AS score FROM normed)")

SQL["risk_table"] = SQL["risk_raw"]

# A step of one variable: the first split of every tree settles it, so its importance is 1 (0 without a step).
_STEP = """WITH {offers},
b AS (SELECT tender_id, CASE WHEN quantity >= 25 THEN 100 WHEN quantity < 25 THEN 1 END AS bulk, quality, technical, delivery_time_days FROM compliant),
g AS (SELECT {by} count(*) FILTER (WHERE ok) AS n_rows, count(*) FILTER (WHERE NOT ok) AS n_dropped, count(DISTINCT bulk) FILTER (WHERE ok) AS steps
      FROM (SELECT *, bulk IS NOT NULL AND quality IS NOT NULL AND technical IS NOT NULL AND delivery_time_days IS NOT NULL AS ok FROM b) {group})
SELECT {by} variable, CASE WHEN rank = 1 AND steps > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS importance, rank::BIGINT AS rank, n_rows, n_dropped
FROM g, (VALUES ('quantity', 1), ('quality', 2), ('technical', 3), ('delivery_time_days', 4)) AS v(variable, rank) WHERE n_rows > 0"""
SQL["step_importance"] = _STEP.format(offers=OFFERS_CTE, by="", group="")
SQL["step_importance_by_tender"] = _STEP.format(offers=OFFERS_CTE, by="tender_id,", group="GROUP BY tender_id")

SQL["price_density"] = with_offers(
    """SELECT tender_id, p + 1 AS point, round(x, 6) AS x, round(k / max(k) OVER (PARTITION BY tender_id), 6) AS height, round(h, 6) AS bandwidth, n
FROM (SELECT h.tender_id, p, lo - 2 * h + p * (hi - lo + 4 * h) / 49 AS x, h, n,
             sum(exp(-0.5 * power((lo - 2 * h + p * (hi - lo + 4 * h) / 49 - price) / h, 2))) AS k
      FROM h JOIN compliant c ON c.tender_id = h.tender_id AND price IS NOT NULL, generate_series(0, 49) AS t(p)
      GROUP BY h.tender_id, p, lo, hi, h, n)""",
    """b AS (SELECT tender_id, min(price) AS lo, max(price) AS hi, count(price) AS n, stddev_samp(price) AS s,
  quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM compliant WHERE price IS NOT NULL GROUP BY tender_id),
h AS (SELECT *, CASE WHEN hi > lo THEN greatest(1.059 * least(s, iqr / 1.349) * power(n, -0.2), (hi - lo) / 100) ELSE 1.0 END::DOUBLE AS h FROM b)""")

SQL["supplier_profile_ranked"] = with_offers(
    " UNION ALL ".join(f"SELECT {KEYS}, '{v}' AS variable, round({v}, 6) AS value FROM prof" for v in VARIABLES),
    norm_ctes("compliant", VARIABLES, name="prof"))

SQL["supplier_totals_risk"] = with_offers(
    "SELECT tender_id, supplier, round(sum(round(total_risk, 6)), 6) AS total_risk FROM risk GROUP BY tender_id, supplier", *_risk_ctes("raw"))

CORRELATED = ["price", "quality", "delivery_time_days", "warranty_months"]
SQL["correlation_by_tender"] = with_offers(" UNION ALL ".join(
    f"""SELECT tender_id, '{a}' AS var_a, '{b}' AS var_b,
  round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN greatest(least(corr(x, y), 1.0), -1.0) END, 6) + 0.0 AS corr
FROM (SELECT tender_id, CASE WHEN {b} IS NOT NULL THEN {a} END AS x, CASE WHEN {a} IS NOT NULL THEN {b} END AS y FROM compliant)
GROUP BY tender_id""" for a in CORRELATED for b in CORRELATED))

# Sketches of up to some hundreds of values are exact.
SQL["supplier_sketch"] = with_offers(
    "SELECT country, supplier_type, count(DISTINCT supplier) AS n_distinct FROM compliant GROUP BY country, supplier_type")

SQL["offers_csv_split"] = with_offers(
    """SELECT offer_id, supplier, compliance_notes || chr(10) || '"' || country || '", ' || delivery_terms AS remarks, payment_terms FROM compliant""")
