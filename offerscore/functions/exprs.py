"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Lower-cased column names that are never coerced to numbers:
TEXT_COLUMNS = ("supplier", "name", "id", "compliance", "certifications",
                "compliance_notes", "payment_terms", "supplier_type")

# The text tokens a CSV reader of the reference's stack turns
# into "missing" by default (public pandas ``read_csv`` na_values list).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null")

# A plain decimal number, optionally signed, with optional exponent; surrounding
# whitespace allowed.  Anything else (``1d``, ``0x10``, ``1,000``, ``inf``) is missing.
_NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields NULL on a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(a, b)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def parse_number(c: Column) -> Column:
    """Text to double with the strict grammar above; failures become NULL."""
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER_RE), F.trim(s).try_cast("double"))


def flag(cond: Column) -> Column:
    """Boolean condition to a 0.0/1.0 flag; a NULL comparison counts as 0.0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def r6(c: Column) -> Column:
    """Round a computed double to 6 digits for stable cross-engine comparison
    (adding 0.0 turns a rounded -0.0 into 0.0).

    ``round`` goes through a decimal of the value's digits.  Where the millionths of a value below a
    million are not near a half, a product and a division give the same double much sooner."""
    millionths = c * F.lit(1e6)
    near = F.rint(millionths)
    plain = (F.abs(c) < F.lit(1e6)) & (F.abs(millionths - near) < F.lit(0.499))
    return F.when(plain, near / F.lit(1e6)).otherwise(F.round(c, 6)) + F.lit(0.0)
