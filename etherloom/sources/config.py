"""Readers of the configuration: which fields are active, and the weights of each scenario."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def active_fields(config: Mapping) -> list[str]:
    """The names in ``active_fields`` of a field set, white space cut, empty ones left out."""
    if not isinstance(config, Mapping):
        raise ValueError("a field set is a mapping")
    names = config.get("active_fields")
    if not isinstance(names, list):
        raise ValueError("a field set has a list of active_fields")
    found = [n for n in (str(x).strip() for x in names if x is not None) if n]
    if not found:
        raise ValueError("active_fields is empty")
    return found


def read_fields(spark: SparkSession, path: str) -> list[str]:
    """``active_fields`` of a YAML file, through Spark's reader, so that it may lie in any store."""
    text = spark.read.text(path, wholetext=True).first()
    lines = [] if text is None else text[0].splitlines()
    try:
        import yaml
    except ImportError:  # what a field set needs of YAML: top-level keys and a list of plain names
        return active_fields(_plain(lines))
    return active_fields(yaml.safe_load("\n".join(lines)))


def _plain(lines: list[str]) -> dict:
    found: dict = {}
    key = None
    for line in lines:
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare.lstrip().startswith("- ") and key is not None:
            if not isinstance(found[key], list):
                found[key] = []
            found[key].append(bare.lstrip()[2:].strip().strip("\"'"))
        elif ":" in bare and not bare[0].isspace():
            key, _, value = bare.partition(":")
            found[key] = value.strip().strip("\"'")
    return found


def read_scenarios(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``scenario, weights map<string,double>`` of a JSON file with a list of ``{name, weights}``; no file: one without weights."""
    if path is None:
        return spark.sql("SELECT 'default' AS scenario, CAST(map() AS map<string,double>) AS weights")
    rows = spark.read.schema("name string, weights map<string,double>").option("multiLine", True).json(path)
    return rows.where("name IS NOT NULL").select(F.col("name").alias("scenario"), F.coalesce("weights", F.create_map().cast("map<string,double>")).alias("weights"))
