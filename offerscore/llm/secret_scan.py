"""Secret scans: credentials in whole texts, told apart from examples by who holds them.

Method: corpus-wide ownership frequency.  Every candidate value (of the base patterns and of
known token forms) is hashed; the hashes are aggregated by the distinct owners and
repositories that hold them.  A value that many owners hold is a copied example; one that
few hold and that looks random is a live credential.  Only built-in functions are used, and
values leave the scan as hashes alone.

Places come from ``split`` and ``regexp_extract_all``: lengths of gaps and matches, summed along
each document's matches.  An owner count is made of three aggregates, so that a value
which a third of all documents hold is spread by owner and repository first; the verdicts of
the few most frequent values (at most ``HOT``) are broadcast, the others are joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exchange import Store

# The base patterns, in the order in which spans of one start are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Known token forms, then any long run of letters and digits.
FORMS = "|".join([
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"[rs]k_live_[A-Za-z0-9]{20,}",
    r"eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}",
    r"[A-Za-z0-9+/_]{20,}={0,2}",
])
#: Values with one of these are never live.
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|your|test|xxxx|0000|1234|abcd"
KINDS = ["assign", "access", "hex", "live", "example"]
#: Values so frequent that their verdict is broadcast.
HOT = 10_000


def _hits(text: Column, kind: int, pattern: str) -> Column:
    """The matches of a pattern: gap before, length, start and hash of the value, its look."""
    def hit(found: Column, gap: Column) -> Column:
        value = F.regexp_extract(found, ASSIGN, 2) if kind == 0 else found
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(found).alias("size"),
                        F.length(value).alias("value_size"), F.substring(F.sha2(value, 256), 1, 32).alias("hash"), _live(value).alias("looks"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.greatest(F.size(found), F.lit(0))), hit)


def _live(value: Column) -> Column:
    """Whether a value looks random: 16 characters or more, 8 or more different ones, letters and
    digits, no placeholder word."""
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~F.lower(value).rlike(PLACEHOLDER) \
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def find(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (row_id, doc_id, n_hits), and every match as (row_id, owner,
    repository, kind, start, end, value_start, value_end, hash, looks); kind 3 is a known form.
    Both are written under the shared folder."""
    store = Store(docs.sparkSession, "secrets")
    rows = docs.select(F.col("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scanned = rows.select("doc_id", "owner", "repository", F.monotonically_increasing_id().alias("row_id"),
                          *[_hits(F.col("text"), k, p).alias(f"hits{k}") for k, p in enumerate([ASSIGN, ACCESS, HEX, FORMS])])
    scanned = store.write(scanned, "scanned")
    every = [F.transform(f"hits{k}", lambda x, i: F.struct(i.alias("number"), x.alias("hit"))) for k in range(4)]
    hits = scanned.select("row_id", "owner", "repository", F.explode(F.concat(*every)).alias("x")) \
        .select("row_id", "owner", "repository", "x.number", "x.hit.*")
    along = Window.partitionBy("row_id", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along))
    # a base assignment needs a value of 6 characters; the others have their least length in the pattern
    hits = hits.filter((F.col("kind") > 0) | (F.col("value_size") >= 6))
    hits = hits.select("row_id", "owner", "repository", "kind", (F.col("end") - F.col("size")).alias("start"), "end",
                       (F.col("end") - F.col("value_size")).alias("value_start"), F.col("end").alias("value_end"), "hash", "looks")
    size = sum(F.size(f"hits{k}") for k in range(4))
    return scanned.select("row_id", "doc_id", size.alias("n_hits")), store.write(hits, "hits")


def ownership(hits: DataFrame, wide: int = 3) -> DataFrame:
    """(hash, n_places, n_repositories, n_owners, looks, verdict) of every value.

    A repository is known by its owner and name.  The verdict is ``example`` from ``wide``
    owners on, else ``live`` if the value looks random, else null."""
    places = hits.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"), F.max("looks").alias("looks"))
    owners = places.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"), F.max("looks").alias("looks"))
    values = owners.groupBy("hash").agg(F.sum("n").alias("n_places"), F.sum("repositories").alias("n_repositories"),
                                        F.count(F.lit(1)).alias("n_owners"), F.max("looks").alias("looks"))
    return values.withColumn("verdict", F.when(F.col("n_owners") >= wide, F.lit("example")).when(F.col("looks"), F.lit("live")))


def _with_verdict(hits: DataFrame, values: DataFrame) -> DataFrame:
    """The hits whose value has a verdict, with it."""
    values = values.filter("verdict is not null").select("hash", "verdict", "n_places")
    # at most HOT values have more than 1/HOT of all places
    total = F.broadcast(values.agg(F.sum("n_places").alias("total")))
    marked = values.crossJoin(total).withColumn("hot", F.col("n_places") * HOT > F.col("total"))
    hot = F.broadcast(marked.filter("hot").select("hash", "verdict"))
    cold = marked.filter("not hot").select("hash", "verdict")
    return hits.join(hot, "hash").unionByName(hits.join(hot, "hash", "left_anti").join(cold, "hash"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide: int = 3) -> DataFrame:
    """Secrets of every document.

    ``docs`` needs doc_id, text and the columns named by ``owner`` and ``repository``; other
    columns are ignored.  Returns one row for each input row: doc_id, n_assign, n_access, n_hex
    (places of the base patterns), base_sha256 (of the list of base spans), spans (base spans, then
    the method's: the value of a base match or known form as ``live`` or ``example``, once
    for each place; a list of kind:start:end by start, then kind), n_live, n_example.
    Positions are code points, the end is exclusive.  A null text is empty; a null owner or
    repository is one of its own; repeated rows count as one repository but give a row each; an empty
    table gives an empty result.
    """
    rows, hits = find(docs, owner, repository)
    base = hits.filter("kind < 3").select("row_id", F.struct("start", "kind", "end").alias("span"))
    values = ownership(hits.filter("kind < 3 or looks"), wide)
    method = _with_verdict(hits.filter("kind < 3 or looks"), values).select(
        "row_id", F.struct(F.col("value_start").alias("start"), F.when(F.col("verdict") == "live", 3).otherwise(4).alias("kind"),
                           F.col("value_end").alias("end")).alias("span"))
    per_row = base.unionByName(method).groupBy("row_id").agg(
        *[F.count(F.when(F.col("span.kind") == k, True)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.collect_list(F.when(F.col("span.kind") < 3, F.col("span"))).alias("base"),
        F.collect_set(F.when(F.col("span.kind") >= 3, F.col("span"))).alias("method"))
    found = rows.filter("n_hits > 0").join(per_row, "row_id", "left")
    empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    clean = rows.filter("n_hits = 0").select("row_id", "doc_id", "n_hits", *[F.lit(None).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
                                             empty.alias("base"), empty.alias("method"))
    both = found.unionByName(clean).withColumn("base", F.coalesce("base", empty)).withColumn("method", F.coalesce("method", empty))
    n = lambda k: F.size(F.filter("method", lambda s: s["kind"] == k)).cast("long")
    return both.select("doc_id", *[F.coalesce(f"n_{KINDS[k]}", F.lit(0)).alias(f"n_{KINDS[k]}") for k in range(3)],
                       F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "method")).alias("spans"),
                       n(3).alias("n_live"), n(4).alias("n_example"))
