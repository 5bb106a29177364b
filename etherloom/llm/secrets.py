"""Secret scans with DataFrame functions only: spans by pattern, then corpus-wide ownership of each candidate.

A pattern's matches come from ``regexp_extract_all`` and the text between them from ``split``; running sums of
both lengths give the positions in code points. Candidates are long mixed tokens and the values of the other kinds.
Their hashes are counted over the whole corpus by distinct repositories and owners: one that many owners or many
repositories have is a copied example, one that stays with few of both looks live. Long mixed tokens that look live
become spans of kind ``live``; the spans of the other kinds stay as they are, with a verdict beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stash

# The kinds and their patterns, in the order of the report.
KINDS = ("assign", "access", "hex", "live")
PATTERNS = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"()(AKIA[A-Z0-9]{16,})",
    r"()([0-9a-f]{24,})",
    r"()([A-Za-z0-9+/_-]{20,})",
)
LEAST_VALUE = 6  #: characters of an assigned value
DISTINCT = 10  #: different characters of a candidate


def _found(text: Column, kind: int) -> Column:
    """Array of (kind, gap before, length, good, hash of the value) of the pattern's matches, in order."""
    pattern = F.lit(PATTERNS[kind])
    value = lambda x: x["v"]
    if kind == 0:
        good = lambda x: F.length(value(x)) >= LEAST_VALUE
    elif kind == 3:
        good = lambda x: value(x).rlike("[0-9]") & value(x).rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value(x), ""))) >= DISTINCT)  # noqa: E731, E501
    else:
        good = lambda x: F.lit(True)
    parts = F.arrays_zip(
        F.split(text, PATTERNS[kind], -1).alias("g"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"),
    )
    entries = F.transform(
        F.filter(parts, lambda x: x["m"].isNotNull()),  # the last gap has no match
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["g"]).alias("gap"),
            F.length(x["m"]).alias("len"),
            good(x).alias("good"),
            F.xxhash64(value(x)).alias("key"),
        ),
    )
    return F.when(text.rlike(PATTERNS[kind]), entries).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,good:boolean,key:bigint>>"))


def candidate_owners(candidates: DataFrame) -> DataFrame:
    """``key, repositories, owners, found`` from ``key, repository, owner, copy``: distinct counts in steps, each summed before its shuffle.

    Repositories that have a key only in exact copies (equal ``copy``) of another's document are not counted; all owners are.
    """
    owners = candidates.groupBy("key", "owner").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("owners"), F.sum("n").alias("found"))
    texts = candidates.groupBy("key", "copy").agg(F.min("repository").alias("repository"))
    distinct = texts.groupBy("key", "repository").agg(F.count("*").alias("n"))
    return distinct.groupBy("key").agg(F.count("*").alias("repositories")).join(owners, "key")


def secret_spans(
    docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = 2, text: str = "text",
    max_repositories: int = 10,
) -> DataFrame:
    """One row for each input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, verdicts, n_base_live``.

    Positions are code points, ends exclusive. A value found with at most ``max_owners`` distinct owners and in at most
    ``max_repositories`` distinct repositories, exact copies of a document counted once, is live, else an example; a null
    owner is one owner. ``spans`` and ``n_live`` have the long mixed tokens that are live; ``verdicts`` has every span as
    ``kind:start:end:verdict:repositories:owners``, tokens as kind ``token``, and ``n_base_live`` the live values of the
    other kinds. A null or empty text has no spans. Repeated rows are rows of their own and count once among the repositories.
    """
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col(repository).alias("repository"),
        F.col(owner).alias("owner"), body.alias("body"),
    ).select("row", "doc_id", "repository", "owner", F.xxhash64("body").alias("copy"), F.concat(*[_found(F.col("body"), k) for k in range(4)]).alias("found"))
    rows = stash(rows, "secrets")  # from here the row numbers are data, not a property of the scan
    each = rows.where(F.size("found") > 0).select("row", "repository", "owner", "copy", F.posexplode("found").alias("at", "x"))
    each = each.select("row", "repository", "owner", "copy", "at", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).where("good")
    owners = candidate_owners(each.where("good").select("key", "repository", "owner", "copy"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = spread_join(spans, owners, "key", "found").withColumn("live", live)  # a copied example may be in a third of all rows
    entry = F.struct(
        (F.col("end") - F.col("len")).alias("start"), F.when(~live & (F.col("kind") == 3), 4).otherwise(F.col("kind")).alias("kind"),
        "end", "live", "repositories", "owners",
    )
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    names = F.array(*map(F.lit, KINDS))
    written = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")  # noqa: E731, E501
    kinds = F.array(*map(F.lit, (*KINDS[:3], "token", "token")))
    verdict = lambda x: F.when(x["live"], "live").otherwise("example")
    told = lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"], verdict(x), x["repositories"], x["owners"])  # noqa: E731, E501
    number = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,repositories:bigint,owners:bigint>>")
    return rows.select("row", "doc_id").join(per_row, "row", "left").withColumn("all", F.coalesce("all", none)).select(
        "doc_id",
        number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(written(lambda x: x["kind"] < 3), 256).alias("base_sha256"),
        written(lambda x: x["kind"] < 4).alias("spans"),
        number(3).alias("n_live"), number(4).alias("n_example"),
        F.array_join(F.transform("all", told), ",").alias("verdicts"),
        F.size(F.filter("all", lambda x: (x["kind"] < 3) & x["live"])).cast("long").alias("n_base_live"),
    )
