"""Lines by how many pages of their host have them: the site-relative frequency behind line dedup and line rules.

A page is a distinct text of a host: exact copies of a page count once, so a mirrored page does not make its
own lines boilerplate. A host has at most (lines a page / share) lines above a share of its pages, whatever its
size; the list of a host's frequent lines is therefore an array with a bound that does not grow with the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, null_safe, spread_join


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def line_keys(text: Column) -> Column:
    """Hashes of the distinct non-empty lines of a text, spaces, tabs and CR cut from both ends."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def line_counts(pages: DataFrame) -> DataFrame:
    """From ``host, page, keys array<bigint>``: ``host, line, n, pages``, the distinct pages of the host that have the line, and all.

    Copies of a page meet in a (host, page) group; the counts of a (host, line) are summed in each task before the
    shuffle, so neither a hot host nor a hot line is one task's work.
    """
    once = pages.select("host", "page", "keys").dropDuplicates(["host", "page"])
    totals = once.groupBy("host").agg(F.count("*").alias("pages"))
    counts = once.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    return null_safe(counts, totals, "host", how="inner")


def frequent_lines(pages: DataFrame, share: float, least: int) -> DataFrame:
    """From ``host, page, keys array<bigint>`` the frequent line keys of each host: ``host, frequent array<bigint>``.

    A line is frequent if at least ``least`` distinct pages of the host, and more than ``share`` of them, have it.
    """
    found = line_counts(pages).where((F.col("n") >= least) & (F.col("n") > share * F.col("pages")))
    return found.groupBy("host").agg(F.collect_list("line").alias("frequent"))


def _marked(df: DataFrame, share: float, least: int, text: str, host: str) -> tuple[DataFrame, str]:
    """``df`` with one more column, and its name: the lines that stay, or null where the text is null."""
    page = F.xxhash64(F.coalesce(text, F.lit("")))
    pages = df.select(F.col(host).alias("host"), page.alias("page"), line_keys(F.col(text)).alias("keys"))
    frequent, stays, place, rows = (fresh(n, df) for n in ("__frequent", "__stays", "__host", "__rows"))
    hashed = lambda c: F.xxhash64(c).alias(place)  # noqa: E731  # the null host is one too
    found = frequent_lines(pages, share, least).select(hashed("host"), F.col("frequent").alias(frequent))
    hosts = df.groupBy(hashed(host)).agg(F.count("*").alias(rows)).join(found, place, "left")
    # a table on disk: the planner sees its size and sends it to all, or else joins by host, a hot one in many tasks
    joined = spread_join(df.withColumn(place, hashed(host)), hosts, place, rows)
    kept = F.filter(
        F.split(text, "\n", -1),
        lambda x: F.col(frequent).isNull() | (trimmed(x) == "") | ~F.array_contains(frequent, F.xxhash64(trimmed(x))),
    )
    return joined.withColumn(stays, kept), stays


def drop_frequent_lines(
    df: DataFrame, share: float = 0.05, least: int = 10, text: str = "text", host: str = "source"
) -> DataFrame:
    """``df`` with the lines of ``text`` gone that more than ``share`` of their host's distinct pages have.

    Every column stays; the text keeps its other lines in order, empty lines included. A null text stays null and
    has no lines; a null host is a host of its own; repeated rows are each cleaned alike.
    """
    marked, stays = _marked(df, share, least, text, host)
    return marked.withColumn(text, F.array_join(stays, "\n")).select(*[F.col(f"`{c}`") for c in df.columns])


def line_digest(df: DataFrame, share: float = 0.05, least: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_chars, kept_sha256`` of each document; for a null text 0, 0, 0, digest of ''.

    Repeated rows are each answered alike and are one page of their host; a null host is a host of its own.
    """
    marked, lines = _marked(df.select("doc_id", "text", "source"), share, least, "text", "source")
    kept = F.coalesce(F.array_join(lines, "\n"), F.lit(""))
    n = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    stays = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return marked.select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        (n - stays).cast("long").alias("n_removed"),
        F.length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT DISTINCT source, text, trim(line, e' \t\r') AS line
  FROM (SELECT source, text, unnest(string_split(text, e'\n')) AS line FROM documents WHERE text IS NOT NULL)
), pages AS (SELECT source, count(DISTINCT coalesce(text, '')) AS pages FROM documents GROUP BY source),
hot AS (
  SELECT l.source, l.line FROM l JOIN pages ON l.source IS NOT DISTINCT FROM pages.source
  WHERE line <> '' GROUP BY l.source, l.line, pages.pages HAVING count(*) >= 10 AND count(*) > 0.05 * pages.pages
), d AS (
  SELECT doc_id, source, text, string_split(coalesce(text, ''), e'\n') AS lines FROM documents
), x AS (
  SELECT doc_id, text, lines, generate_subscripts(lines, 1) AS k, unnest(lines) AS line, source FROM d
), y AS (
  SELECT x.*, hot.line IS NULL AS stays FROM x
  LEFT JOIN hot ON x.source IS NOT DISTINCT FROM hot.source AND trim(x.line, e' \t\r') = hot.line
), z AS (
  SELECT doc_id, any_value(text) IS NULL AS none, count(*) AS n, count(*) FILTER (NOT stays) AS gone,
         coalesce(string_agg(line, e'\n' ORDER BY k) FILTER (stays), '') AS kept
  FROM y GROUP BY doc_id
)
SELECT doc_id, CASE WHEN none THEN 0 ELSE n END::BIGINT AS n_lines, gone::BIGINT AS n_removed,
       length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM z
"""
