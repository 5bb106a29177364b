"""Queries that write with a writer of the library and read it back: what the files hold is what the SQL says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etherloom.operators import fieldstats, observe, validate
from etherloom.sources import config, reports
from etherloom.sources.captures import read_captures
from etherloom.sources.storage import new_path
from etherloom.streaming.merge import MERGED, merge_stream

from . import adapters


LISTED = 500  #: addresses in a file, about: as many files as addresses would be the driver's work, one by one


def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses in JSON files, a list of them each, read as captures: the requests of an address in order."""
    days = F.map_from_entries(F.collect_list(F.struct("cap", "PROBE_REQs")))
    captures = adapters.captures(spark, sf_dir)
    whole = captures.groupBy("MAC").agg(days.alias("days"))
    requests = F.flatten(F.transform(F.array_sort(F.map_keys("days")), lambda k: F.element_at("days", k)))
    path = new_path(spark, "captures")
    lists = max(1, captures.select("MAC").distinct().count() // LISTED)
    one = whole.select(F.pmod(F.xxhash64("MAC"), F.lit(lists)).alias("list"), F.struct("MAC", requests.alias("PROBE_REQs")).alias("one"))
    text = one.groupBy("list").agg(F.to_json(F.collect_list("one")).alias("value"))
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = observe.probe_requests(read_captures(spark, path, files="*.txt"))
    return found.select("mac", "device", "pr_ord", "n_frames", observe.field_value("EVENT").alias("event"))


def scenario_weights(spark: SparkSession, weights: dict[str, dict[str, float]]) -> DataFrame:
    """Scenarios as they come from files of weights."""
    path = new_path(spark, "scenarios")
    spark.createDataFrame(list(weights.items()), "name string, weights map<string,double>").write.option("maxRecordsPerFile", 1).json(path)
    return config.read_scenarios(spark, path)


def path_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "paths")
    reports.write_paths(observe.key_paths(adapters.capture_requests(spark, sf_dir)), path)
    return spark.read.schema("path string").csv(path)


def merged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of the captures as a stream, a third of the files a batch, merged by address; a last row beyond all others lets every address end."""
    r = adapters.capture_requests(spark, sf_dir).withColumn("content", F.coalesce(F.to_json("data"), F.lit(""))).drop("data", "device", "n_frames")
    r = r.withColumn("ts", F.to_timestamp(F.col("cap").cast("string"), "yyyyMMdd"))
    source, out, state = (new_path(spark, x) for x in ("requests", "merged", "state"))
    r.write.parquet(source)
    whole = spark.read.schema(r.schema).parquet(source)
    last = whole.agg(F.max("ts").alias("ts")).select(F.lit("").alias("mac"), F.lit(0).cast("long").alias("cap"), F.lit(0).alias("pr_ord"), (F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"))
    third = str(max(1, -(-len(whole.inputFiles()) // 3)))
    for rows in (None, last):  # the watermark moves between runs
        if rows is not None:
            rows.write.mode("append").parquet(source)
        stream = merge_stream(spark.readStream.schema(r.schema).option("maxFilesPerTrigger", third).parquet(source), quiet="40 days", late="40 days")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
        query.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(MERGED).parquet(out).where("mac <> ''")
    return found.select("mac", "label", "device", "cap", "pr_ord", "n_frames", *[F.array_join(c, ",").alias(c) for c in ("time", "rssi")])


def value_label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "value-labels")
    reports.write_value_labels(fieldstats.value_labels(adapters.event_joint(spark, sf_dir).where("field = 'EVENT'")), path)
    return spark.read.option("sep", ";").option("header", True).csv(path)


def listing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "listing")
    n = fieldstats.distribution(adapters.event_joint(spark, sf_dir).where("field = 'EVENT'"))
    reports.write_lines(n.select("value", "n"), path, by="value")
    return spark.read.text(path)


def misassigned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misassigned members of two scenarios, with the noise and without it, in a folder each."""
    clusters, labels = adapters.customer_clusters(spark, sf_dir)
    of = lambda noise: validate.misassigned(clusters, labels, validate.contingency(clusters, labels, noise))
    path = new_path(spark, "misassigned")
    reports.write_by_scenario(of(True).withColumn("scenario", F.lit("all")).union(of(False).withColumn("scenario", F.lit("quiet"))), path)
    return spark.read.json(path)
