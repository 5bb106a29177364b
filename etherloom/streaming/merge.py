"""Addresses made one over a stream of probe requests, as ``merge_requests`` does for a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGED = "mac string, label string, device string, cap bigint, pr_ord int, n_frames int, time array<string>, rssi array<string>, content string"


def merge_stream(requests: DataFrame, time: str = "ts", quiet: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``MERGED`` rows of an address, one for each content, once it has had no request for ``quiet`` by the watermark.

    ``requests``: ``mac, label, cap, pr_ord, time, rssi``, ``content`` (DATA as JSON) and an event time. The requests of
    an address are a session that ends after ``quiet``; its state is dropped when its rows are given out, so what is
    held are the addresses that are about. An address that comes back later is merged anew, whatever the batches are.
    A null address is left out; a null content is an empty one.
    """
    rest = requests.where("mac IS NOT NULL").withColumn("content", F.coalesce("content", F.lit("")))
    one = F.struct("content", F.col("cap").cast("long").alias("cap"), F.col("pr_ord").cast("int").alias("pr_ord"), "label", *[F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")).alias(c) for c in ("time", "rssi")])
    sessions = rest.withWatermark(time, late).groupBy(F.session_window(time, quiet), "mac").agg(F.collect_list(one).alias("parts"))
    first = F.array_min(F.transform(F.filter("parts", lambda p: p["label"].isNotNull()), lambda p: F.struct(p["cap"], p["pr_ord"], p["label"])))
    held = sessions.select("mac", first["label"].alias("label"), F.array_sort("parts").alias("parts"))
    # a content's requests lie together: from where it begins to where the next one does
    begins = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: (k == 0) | (F.get("parts", k)["content"] != F.get("parts", k - 1)["content"]))
    held = held.withColumn("begins", begins)
    runs = F.transform("begins", lambda b, k: F.slice("parts", b + 1, F.coalesce(F.get("begins", k + 1), F.size("parts")) - b))
    each = held.select("mac", "label", F.explode(runs).alias("run"))
    joined = lambda c: F.flatten(F.transform("run", lambda p: p[c]))
    return each.select(
        "mac", "label", F.coalesce("label", "mac").alias("device"), F.col("run")[0]["cap"].alias("cap"), F.col("run")[0]["pr_ord"].alias("pr_ord"),
        F.size(joined("time")).alias("n_frames"), joined("time").alias("time"), joined("rssi").alias("rssi"), F.col("run")[0]["content"].alias("content"),
    )
