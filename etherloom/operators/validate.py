"""Clusters against labels. Every measure comes from one contingency table ``cluster, label, n``.

Clusters with a column ``scenario`` are judged scenario by scenario, all of them in one plan: the contingency table, its
margins and every measure then have that column too, and what is one row without it is a row for each scenario. A
scenario whose clusters hold no labelled address has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOISE = -1


def cluster_number(cluster: Column) -> Column:
    """The id as text, whole numbers in their plain form: `` 07`` and ``7`` are one cluster; other ids stay as they are."""
    text = cluster.cast("string")
    return F.coalesce(F.trim(text).try_cast("int").cast("string"), text)


def _by(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "scenario"]


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides together: one of each, or one of each for each scenario."""
    return left.join(right, _by(left)) if _by(left) else left.join(right)


def _margins(n: DataFrame, key: str, name: str) -> DataFrame:
    return n.groupBy(*_by(n), key).agg(F.sum("n").alias(name))


def contingency(clusters: DataFrame, labels: DataFrame, noise: bool = False, unlabelled: str | None = None) -> DataFrame:
    """``cluster, label, n, nk, nc, total`` over labelled members; noise is left out unless asked for.

    With ``unlabelled`` members without a label count as a class of that name. The margins are aggregates of the small
    table, joined back, so that a cluster with all labels is not one task's window.
    """
    known = labels.where("label IS NOT NULL")
    if unlabelled is None:
        rows = clusters.join(known, "mac")
    else:
        rows = clusters.join(known.withColumn("label", F.col("label").cast("string")), "mac", "left").fillna({"label": unlabelled})
    if not noise:
        rows = rows.where(F.col("cluster") != NOISE)
    by = _by(clusters)
    n = rows.groupBy(*by, "cluster", "label").agg(F.count("*").alias("n"))
    joined = n.join(_margins(n, "cluster", "nk"), [*by, "cluster"]).join(_margins(n, "label", "nc"), [*by, "label"])
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    total = total if by else F.broadcast(total)  # one row is sent
    return _beside(joined, total).select(*by, "cluster", "label", "n", "nk", "nc", "total")


def _zero(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def purity(ck: DataFrame) -> DataFrame:
    """``cluster, size, n_majority, n_labels, purity, majority`` of each cluster; of equal majorities the least label."""
    return ck.groupBy(*_by(ck), "cluster").agg(
        F.sum("n").alias("size"), F.max("n").alias("n_majority"), F.count("*").alias("n_labels"),
        (F.max("n") / F.sum("n")).alias("purity"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("majority"),
    )


def purity_summary(ck: DataFrame) -> DataFrame:
    """One row; zeros where no cluster has a labelled member."""
    pure = F.sum((F.col("n_labels") == 1).cast("long"))
    return purity(ck).groupBy(*_by(ck)).agg(
        F.count("*").alias("n_clusters"), _zero(F.avg("purity")).alias("macro_purity"),
        _share(F.sum("n_majority"), F.sum("size")).alias("weighted_purity"),
        _zero(pure).alias("n_pure"), _share(pure, F.count("*")).alias("pure_share"),
    )


def fragmentation(ck: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, n_detected, n_clusters, best_cluster, best_count, best_recall, single``; labels without a member keep zeros.

    Of clusters with equally many the least is the best.
    """
    by = _by(ck)
    found = ck.groupBy(*by, "label").agg(
        F.sum("n").alias("d"), F.count("*").alias("c"), F.max("n").alias("b"), F.min_by("cluster", F.struct(-F.col("n"), "cluster")).alias("best_cluster")
    )
    every = labels.where("label IS NOT NULL").select("label").distinct()
    if by:
        every = every.crossJoin(F.broadcast(ck.select(*by).distinct()))  # a handful of names
    return every.join(found, [*by, "label"], "left").select(
        *by, "label", _zero("d").alias("n_detected"), _zero("c").alias("n_clusters"), "best_cluster", _zero("b").alias("best_count"),
        _share(F.col("b"), F.col("d")).alias("best_recall"), (_zero("c") == 1).alias("single"),
    )


def fragmentation_summary(ck: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: devices, those detected, those in one cluster, their shares, and the recall of the best cluster."""
    seen = F.col("n_detected") > 0
    devices, detected, single = F.count("*"), F.count_if(seen), F.count_if(F.col("single"))
    return fragmentation(ck, labels).groupBy(*_by(ck)).agg(
        devices.alias("n_devices"), detected.alias("n_detected"), single.alias("n_single"),
        _share(detected, devices).alias("detected_share"), _share(single, devices).alias("single_share_all"),
        _share(single, detected).alias("single_share_detected"),
        _zero(F.avg(F.when(seen, F.col("best_recall")))).alias("macro_recall"),
        _share(F.sum("best_count"), F.sum("n_detected")).alias("weighted_recall"),
    )


def majority_accuracy(ck: DataFrame) -> DataFrame:
    """``correct, incorrect, total, accuracy``: members that have their cluster's most frequent label."""
    by = _by(ck)
    sums = purity(ck).groupBy(*by).agg(_zero(F.sum("n_majority")).alias("correct"), _zero(F.sum("size")).alias("total"))
    return sums.select(*by, "correct", (F.col("total") - F.col("correct")).alias("incorrect"), "total", _share(F.col("correct"), F.col("total")).alias("accuracy"))


def _pairs_of(ck: DataFrame) -> DataFrame:
    """One row: pairs that share both, the cluster, the label, and all: ``tp, pk, pc, pt``; zeros where there are none."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    by = _by(ck)
    tp = ck.groupBy(*by).agg(_zero(F.sum(two("n"))).alias("tp"), F.max("total").alias("t"))
    k = ck.groupBy(*by, "cluster").agg(F.max("nk").alias("m")).groupBy(*by).agg(_zero(F.sum(two("m"))).alias("pk"))
    c = ck.groupBy(*by, "label").agg(F.max("nc").alias("m")).groupBy(*by).agg(_zero(F.sum(two("m"))).alias("pc"))
    return _beside(_beside(tp, k), c).withColumn("pt", _zero(two("t")))


def pairwise(ck: DataFrame) -> DataFrame:
    """Zeros where no cluster or no label has a pair."""
    p, r = _share(F.col("tp"), F.col("pk")), _share(F.col("tp"), F.col("pc"))
    return _pairs_of(ck).select(
        *_by(ck), F.col("tp").cast("long").alias("tp"), (F.col("pk") - F.col("tp")).cast("long").alias("fp"),
        (F.col("pc") - F.col("tp")).cast("long").alias("fn"), p.alias("p"), r.alias("r"), f1(p, r).alias("f1"),
    )


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def bcubed(ck: DataFrame) -> DataFrame:
    """One row; zeros without a member."""
    part = lambda m: _zero(F.sum(F.col("n") * F.col("n") / F.col(m)) / F.max("total"))
    return ck.groupBy(*_by(ck)).agg(part("nk").alias("p"), part("nc").alias("r")).withColumn("f1", f1(F.col("p"), F.col("r")))


def best_match(ck: DataFrame, side: str) -> DataFrame:
    """``side, size, score, match, overlap, match_size, perfect``: the best F1 of a cluster with any label, or of a label with any cluster.

    Of equals the least id is the match; perfect is a cluster and a label of the same members.
    """
    own, other, their = ("nk", "label", "nc") if side == "cluster" else ("nc", "cluster", "nk")
    score = 2 * F.col("n") / (F.col("nk") + F.col("nc"))
    best = ck.groupBy(*_by(ck), side).agg(F.min(F.struct((-score).alias("s"), F.col(other).alias("match"), "n", F.col(own).alias("own"), F.col(their).alias("their"))).alias("x"))
    return best.select(
        *_by(ck), side, F.col("x.own").alias("size"), (-F.col("x.s")).alias("score"), "x.match", F.col("x.n").alias("overlap"),
        F.col("x.their").alias("match_size"), ((F.col("x.n") == F.col("x.own")) & (F.col("x.n") == F.col("x.their"))).alias("perfect"),
    )


def best_match_summary(ck: DataFrame) -> DataFrame:
    """``side, macro, weighted, n_perfect``: a row for clusters, one for labels."""

    def row(side: str) -> DataFrame:
        return best_match(ck, side).groupBy(*_by(ck)).agg(
            F.first(F.lit(side)).alias("side"), _zero(F.avg("score")).alias("macro"),
            _share(F.sum(F.col("score") * F.col("size")), F.sum("size")).alias("weighted"), F.count_if("perfect").alias("n_perfect"),
        )

    return row("cluster").union(row("label"))


def v_measure(ck: DataFrame, beta: float = 1.0) -> DataFrame:
    """``homogeneity, completeness, v, vi, n, n_classes, n_clusters``, natural logarithms; without a member NaN, vi 0."""
    n, t = F.col("n"), F.col("total")
    hck = F.sum(-n / t * F.ln(n / F.col("nk")))
    hkc = F.sum(-n / t * F.ln(n / F.col("nc")))
    hc, hk = F.sum(-n / t * F.ln(F.col("nc") / t)), F.sum(-n / t * F.ln(F.col("nk") / t))
    one = lambda part, of: F.when(F.col(of).isNull(), float("nan")).when(F.col(of) > 0, 1 - F.col(part) / F.col(of)).otherwise(1.0)
    h, c = one("hck", "hc"), one("hkc", "hk")
    base = ck.groupBy(*_by(ck)).agg(
        hck.alias("hck"), hkc.alias("hkc"), hc.alias("hc"), hk.alias("hk"), _zero(F.sum("n")).alias("n"),
        F.count_distinct("label").alias("n_classes"), F.count_distinct("cluster").alias("n_clusters"),
    )
    v = F.when(F.col("hc").isNull(), float("nan")).when(beta * h + c > 0, (1 + beta) * h * c / (beta * h + c)).otherwise(0.0)
    vi = _zero(F.col("hck") + F.col("hkc"))
    return base.select(*_by(ck), h.alias("homogeneity"), c.alias("completeness"), v.alias("v"), vi.alias("vi"), "n", "n_classes", "n_clusters")


def adjusted_rand(ck: DataFrame) -> DataFrame:
    """1 where both sides are the same partition, one member included; NaN without a member."""
    expected = _share(F.col("pk") * F.col("pc"), F.col("pt"))
    most = (F.col("pk") + F.col("pc")) / 2
    ari = F.when(F.col("t").isNull(), float("nan")).when(most == expected, 1.0)
    return _pairs_of(ck).select(*_by(ck), ari.otherwise(F.try_divide(F.col("tp") - expected, most - expected)).alias("ari"))


def external(ck: DataFrame) -> DataFrame:
    """One row: ``n, n_classes, n_clusters, ari, ami, nmi, homogeneity, completeness, v``; the nmi is by the mean of the entropies."""
    joined = _beside(_beside(v_measure(ck), adjusted_rand(ck)), adjusted_mutual_information(ck))
    return joined.select(*_by(ck), "n", "n_classes", "n_clusters", "ari", "ami", F.col("v").alias("nmi"), "homogeneity", "completeness", "v")


def misassigned(clusters: DataFrame, labels: DataFrame, ck: DataFrame) -> DataFrame:
    """``mac, label, cluster, expected``: members whose label is not their cluster's most frequent (of equals the least)."""
    by = _by(ck)
    major = purity(ck).select(*by, "cluster", F.col("majority").alias("expected"))
    rows = clusters.join(labels.where("label IS NOT NULL"), "mac").join(major, [*by, "cluster"])
    return rows.where("label <> expected").select(*by, "mac", "label", "cluster", "expected")


def missing_labelled(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    known, by = labels.where("label IS NOT NULL"), _by(clusters)
    if by:
        known = known.crossJoin(F.broadcast(clusters.select(*by).distinct()))  # a handful of names
    return known.join(clusters, [*by, "mac"], "left_anti").select(*by, *labels.columns)


def duplicates(clusters: DataFrame) -> DataFrame:
    """``mac, n``: addresses that stand more than once among the clusters."""
    return clusters.groupBy(*_by(clusters), "mac").agg(F.count("*").alias("n")).where("n > 1")


def coverage(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: labelled addresses, those present, missing and in the noise, their shares, and addresses that stand twice."""
    by = _by(clusters)
    once = clusters.groupBy(*by, "mac").agg(F.max((F.col("cluster") == NOISE).cast("int")).alias("noise"), F.count("*").alias("n"))
    known = labels.where("label IS NOT NULL").select("mac").distinct().withColumn("labelled", F.lit(True))
    if by:
        known = known.crossJoin(F.broadcast(clusters.select(*by).distinct()))  # a handful of names
    joined = known.join(once, [*by, "mac"], "full")
    own, there = F.col("labelled").isNotNull(), F.col("n").isNotNull()
    all_, present, noise = F.count_if(own), F.count_if(own & there), F.count_if(own & (F.col("noise") == 1))
    missing = F.count_if(own & ~there)
    return joined.groupBy(*by).agg(
        all_.alias("n_labelled"), present.alias("n_present"), missing.alias("n_missing"), noise.alias("n_noise"),
        F.count_if(F.col("n") > 1).alias("n_duplicates"), _share(missing, all_).alias("missing_share"),
        _share(noise, all_).alias("noise_share_all"), _share(noise, present).alias("noise_share_present"),
    )


def device_clusters(ck: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, n_detected, n_clusters, best_cluster, best_recall, clusters``: ``cluster:count`` by the text of the cluster, '-' if none."""
    entry = F.struct(F.col("cluster").cast("string").alias("c"), "n")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["c"], x["n"])), ", ")
    by = _by(ck)
    found = fragmentation(ck, labels).join(ck.groupBy(*by, "label").agg(listed.alias("clusters")), [*by, "label"], "left")
    return found.select(*by, "label", "n_detected", "n_clusters", "best_cluster", "best_recall", F.coalesce("clusters", F.lit("-")).alias("clusters"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """``cluster, n`` of all members, with a label or not."""
    return clusters.groupBy(*_by(clusters), "cluster").agg(F.count("*").alias("n"))


def cluster_members(clusters: DataFrame) -> DataFrame:
    """``cluster, mac, size``: the members of each cluster as rows, so that a large cluster is not one list."""
    by = _by(clusters)
    return clusters.join(cluster_sizes(clusters).withColumnRenamed("n", "size"), [*by, "cluster"]).select(*by, "cluster", "mac", "size")


def log_factorial(k: Column) -> Column:
    """ln(k!): exact up to 20, Stirling's series beyond, which is good to 1e-13 there."""
    x = k.cast("double")
    series = x * F.ln(x) - x + F.ln(2 * F.pi() * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(k <= 20, F.ln(F.factorial(k.cast("int")).cast("double"))).otherwise(series)


SPAN = 4096  #: summands that one row stands for


def adjusted_mutual_information(ck: DataFrame) -> DataFrame:
    """``emi, mi, ami`` in nats, adjusted by the mean of the two entropies; 1 where both sides are one group, NaN without a member.

    The expectation is over distinct pairs of margins, of which there are at most 2N however many the groups are; the
    summands of a pair are cut into spans, so that large groups are spread over rows.
    """
    n, t, by = F.col("n"), F.col("total"), _by(ck)
    sizes = lambda key, m: ck.groupBy(*by, key).agg(F.max(m).alias(m), F.max("total").alias("total")).groupBy(*by, m).agg(
        F.count("*").alias(f"{m}_times"), F.max("total").alias(f"{m}_total")
    )
    nk, nc, all_ = F.col("nk"), F.col("nc"), F.col("nk_total")
    cells = _beside(sizes("cluster", "nk"), sizes("label", "nc")).withColumns({"low": F.greatest(F.lit(1), nk + nc - all_), "high": F.least(nk, nc)})
    cells = cells.withColumn("from", F.explode(F.sequence("low", "high", F.lit(SPAN))))
    cells = cells.withColumn("x", F.explode(F.sequence("from", F.least("high", F.col("from") + SPAN - 1))))
    x, lf = F.col("x"), log_factorial
    chance = F.exp(lf(nk) + lf(nc) + lf(all_ - nk) + lf(all_ - nc) - lf(all_) - lf(x) - lf(nk - x) - lf(nc - x) - lf(all_ - nk - nc + x))
    expected = cells.groupBy(*by).agg(F.sum(F.col("nk_times") * F.col("nc_times") * x / all_ * F.ln(all_ * x / (nk * nc)) * chance).alias("emi"))
    seen = ck.groupBy(*by).agg(
        F.sum(n / t * F.ln(t * n / (nk * nc))).alias("mi"), (F.sum(-n / t * F.ln(nk / t)) + F.sum(-n / t * F.ln(nc / t))).alias("h2"),
    )
    room = F.col("h2") / 2 - F.col("emi")
    ami = F.when(F.col("mi").isNull(), float("nan")).when(F.abs(room) < 1e-15, 1.0).otherwise((F.col("mi") - F.col("emi")) / room)
    none = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    return _beside(expected, seen).select(*by, none("emi"), none("mi"), ami.alias("ami"))


def _top(df: DataFrame, top: int, *order: Column | str) -> DataFrame:
    """The first rows by an order, or the first of each scenario: each task keeps that many before anything is sorted together."""
    if not _by(df):
        return df.orderBy(*order).limit(top)
    rank = F.row_number().over(Window.partitionBy(*_by(df)).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= top).drop("__rank")


def worst_clusters(ck: DataFrame, top: int = 10) -> DataFrame:
    return _top(purity(ck), top, "purity", F.desc("size"), "cluster")


def most_fragmented(ck: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """Labels with a member, in the most clusters first, then the least recall."""
    return _top(fragmentation(ck, labels).where("n_detected > 0"), top, F.desc("n_clusters"), "best_recall", "label")


def weakest_match(ck: DataFrame, side: str, top: int = 10) -> DataFrame:
    return _top(best_match(ck, side), top, "score", side)
