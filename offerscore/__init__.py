"""offerscore: supplier-offer evaluation on Spark DataFrames.

Every operator takes an offer table (one row per offer) and an optional
``by`` list of grouping columns (e.g. ``["tender_id"]``) so that many
tenders are scored in one distributed job.  ``by=[]`` treats the whole
table as a single tender.
"""

from offerscore.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
