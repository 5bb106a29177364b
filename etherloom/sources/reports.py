"""Writers of results. Each writes a folder, a part for each task, in order where it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_value_labels(labels: DataFrame, path: str) -> None:
    """``value, labels`` as a CSV with ``;`` between the columns and the header ``Value;Labels``; a value of several parts has several lines."""
    named = labels.select(F.col("value").alias("Value"), F.col("labels").alias("Labels"))
    named.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_paths(paths: DataFrame, path: str) -> None:
    """A list of field paths in order: one column, no header."""
    paths.select("path").orderBy("path").write.mode("overwrite").csv(path)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def write_lines(listing: DataFrame, path: str, between: str = ": ", by: str | None = None) -> None:
    """A line of text for each row, its columns as text; nulls are empty. Sorted by a column over all parts if ``by`` names one."""
    rows = listing if by is None else listing.orderBy(by)
    rows.select(F.concat_ws(between, *map(_text, listing.columns)).alias("value")).write.mode("overwrite").text(path)


def write_by_scenario(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder for each ``scenario``, so that no scenario overwrites another's."""
    rows.write.mode("overwrite").partitionBy("scenario").json(path)


def report_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """``scenario, section, at, line``: each frame with a ``scenario`` as lines ``name: value, name: value``; numbers to six places.

    ``at`` is the text of the row's first column besides the scenario, by which lines of a section are ordered.
    """
    found = None
    for section, frame in sections.items():
        kinds = dict(frame.dtypes)
        shown = [c for c in frame.columns if c != "scenario"]
        value = lambda c: F.round(c, 6).cast("string") if kinds[c] == "double" else F.to_json(c) if kinds[c].startswith("map") else _text(c)  # noqa: B023, E731
        parts = [F.concat(F.lit(f"{c}: "), F.coalesce(value(c), F.lit("-"))) for c in shown]
        rows = frame.select("scenario", F.lit(section).alias("section"), _text(shown[0]).alias("at") if not kinds[shown[0]].startswith("map") else F.lit("").alias("at"), F.concat_ws(", ", *parts).alias("line"))
        found = rows if found is None else found.union(rows)
    return found


def write_report(lines: DataFrame, path: str) -> None:
    """A folder of text for each scenario, its sections and lines in order."""
    ordered = lines.repartition("scenario").sortWithinPartitions("scenario", "section", "at")
    ordered.select("scenario", F.concat(F.lit("["), "section", F.lit("] "), "line").alias("value")).write.mode("overwrite").partitionBy("scenario").text(path)
