"""Clusters between steep areas of a reachability plot, without a walk along the whole plot.

A steep area begins and ends in points whose reachability changes by a share ``xi``, all in one direction, with at most
``min_samples`` points in a row that are not steep. Whether a point begins or continues an area depends on what came
before only through a few states (in a falling or rising area, and for how many flat points), so each part of the plot
is a map from the state before it to the state after it: the maps are composed along the parts, and each part then marks
its areas on its own. The rest are joins of areas: a falling area stays open as long as no gap after it rises to its
beginning, which is looked up in maxima of 1, 2, 4, ... gaps; an open falling area and a rising one bound a cluster,
trimmed to equal heights within these areas and to an end that was reached from inside.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from etherloom.sources.storage import stash

PART = 100_000  #: points of a plot that a task scans
FALL, RISE, DOWN, UP, FLAT = range(5)  # of a point to the next: steep falls and rises, others, equal


def _step(state: int, kind: int, most: int) -> tuple[int, bool]:
    """The state after a point, and whether an area begins there. 0: none; 1 + n and 2 + most + n: falling and rising, n flat points."""
    falling, rising = 1, 2 + most
    if kind == FALL:
        return falling, not falling <= state < rising
    if kind == RISE:
        return rising, state < rising
    if not state:
        return 0, False
    base, against = (falling, UP) if state < rising else (rising, DOWN)
    return (0 if kind == against or state - base >= most else state + 1), False


def steep_areas(points: DataFrame, xi: float, min_samples: int, part: int = PART) -> DataFrame:
    """``scenario, area, rises, first, last`` of ``points`` with ``scenario, pos, r, ahead`` (``ahead``: r of the next point), areas from 0."""
    kind, states = dict(points.dtypes)["scenario"], 3 + 2 * min_samples
    share = F.lit(1.0 - xi)
    of = (
        F.when((F.col("r") > F.col("ahead")) & (F.col("r") * share >= F.col("ahead")), FALL).when((F.col("r") < F.col("ahead")) & (F.col("r") <= F.col("ahead") * share), RISE)
        .when(F.col("r") > F.col("ahead"), DOWN).when(F.col("r") < F.col("ahead"), UP).otherwise(FLAT)
    )
    marked = stash(points.select("scenario", "pos", F.floor(F.col("pos") / part).cast("long").alias("part"), of.alias("kind")), "plot")

    def passed(rows: pd.DataFrame) -> pd.DataFrame:
        ends = list(range(states))
        kinds = rows.sort_values("pos")["kind"].tolist()
        for k in kinds:
            ends = [_step(s, k, min_samples)[0] for s in ends]
        return pd.DataFrame({"scenario": rows["scenario"].iloc[:1], "part": rows["part"].iloc[:1], "ends": [ends]})

    maps = marked.groupBy("scenario", "part").applyInPandas(passed, f"scenario {kind}, part bigint, ends array<int>")
    # the state before a part: the maps of the parts before it, one after the other; a row a part
    earlier = F.collect_list("ends").over(Window.partitionBy("scenario").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = maps.select("scenario", "part", F.aggregate(earlier, F.lit(0), lambda s, m: F.get(m, s)).alias("before"))

    def scanned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        state, n, out = int(rows["before"].iloc[0]), 0, []
        for pos, k in zip(rows["pos"].tolist(), rows["kind"].tolist()):
            state, begins = _step(state, k, min_samples)
            n += begins
            if k in (FALL, RISE):
                out.append((pos, k == RISE, n))
        found = pd.DataFrame(out, columns=["pos", "rises", "own"])
        return found.assign(scenario=rows["scenario"].iloc[0], part=rows["part"].iloc[0])[["scenario", "part", "pos", "rises", "own"]]

    schema = f"scenario {kind}, part bigint, pos bigint, rises boolean, own bigint"
    own = stash(marked.join(before, ["scenario", "part"]).groupBy("scenario", "part").applyInPandas(scanned, schema), "steep")
    begun = own.groupBy("scenario", "part").agg(F.max("own").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("scenario").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begun = begun.select("scenario", "part", F.coalesce(earlier, F.lit(0)).alias("offset"))
    area = (F.col("own") + F.col("offset") - 1).alias("area")
    return own.join(begun, ["scenario", "part"]).groupBy("scenario", area).agg(F.first("rises").alias("rises"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _closed(areas: DataFrame) -> DataFrame:
    """``scenario, area, until`` of each falling area: the first area later whose gap rises above its ``limit``, or one beyond the last."""
    levels = [areas.select("scenario", "area", F.col("gap").alias("most"))]
    n = (areas.agg(F.max("area")).first()[0] or 0) + 1
    while 1 << len(levels) <= n:
        half = 1 << len(levels) - 1
        ahead = levels[-1].select("scenario", (F.col("area") - half).alias("area"), F.col("most").alias("then"))
        levels.append(stash(levels[-1].join(ahead, ["scenario", "area"]).select("scenario", "area", F.greatest("most", "then").alias("most")), "gaps"))
    now = areas.where("NOT rises").select("scenario", "area", "limit", (F.col("area") + 1).alias("until"))
    for k in range(len(levels) - 1, -1, -1):
        ahead = levels[k].select("scenario", F.col("area").alias("until"), "most")
        far = F.when(F.col("most") <= F.col("limit"), F.col("until") + (1 << k)).otherwise(F.col("until"))
        now = stash(now.join(ahead, ["scenario", "until"], "left").select("scenario", "area", "limit", far.alias("until")), "until")
    return now.select("scenario", "area", "until")


def xi_clusters(order: DataFrame, xi: float = 0.05, min_samples: int = 2, min_cluster_size: int = 15, part: int = PART) -> DataFrame:
    """``order`` (``scenario, pos, mac, reachability, predecessor``) with ``cluster``: the innermost clusters from 0 along the plot, or -1.

    A reachability that is null is infinite, and so is that behind the last point. A scenario of fewer points than
    ``min_cluster_size`` has no cluster. Points of equal reachability are flat, also at 0.
    """
    share, infinite = 1.0 - xi, F.lit(float("inf"))
    r = F.coalesce("reachability", infinite)
    where = order.select("scenario", F.col("mac").alias("predecessor"), F.col("pos").alias("from"))
    next_ = order.select("scenario", (F.col("pos") - 1).alias("pos"), r.alias("ahead"))
    back = order.select("scenario", (F.col("pos") + 1).alias("pos"), r.alias("back"))
    points = order.select("scenario", "pos", r.alias("r"), "predecessor").join(where, ["scenario", "predecessor"], "left")
    points = points.join(next_, ["scenario", "pos"], "left").join(back, ["scenario", "pos"], "left")
    points = stash(points.select("scenario", "pos", "r", "from", F.coalesce("ahead", infinite).alias("ahead"), F.coalesce("back", infinite).alias("back")), "points")
    areas = stash(steep_areas(points, xi, min_samples, part), "areas")

    # gaps: from behind the area before to the beginning of an area
    before = areas.select("scenario", (F.col("area") + 1).alias("area"), (F.col("last") + 1).alias("since"))
    gaps = areas.join(before, ["scenario", "area"], "left").select("scenario", "area", F.explode(F.sequence(F.coalesce("since", F.lit(0)), "first")).alias("pos"))
    highest = gaps.join(points, ["scenario", "pos"]).groupBy("scenario", "area").agg(F.max("r").alias("gap"))
    at = lambda c, of, name: points.select("scenario", F.col("pos").alias(c), F.col(of).alias(name))
    areas = areas.join(highest, ["scenario", "area"]).join(at("first", "r", "begins"), ["scenario", "first"]).join(at("last", "ahead", "ends"), ["scenario", "last"])
    # an infinite gap closes every area, one that begins at infinity too: NaN is above infinity
    closing = F.when(F.col("gap") == infinite, float("nan")).otherwise(F.col("gap"))
    areas = stash(areas.withColumn("gap", closing).withColumn("limit", F.col("begins") * share), "areas")

    # pairs of an open falling area and a rising one
    falls, rises = areas.where("NOT rises"), areas.where("rises")
    open_ = falls.join(_closed(areas), ["scenario", "area"]).where("until > area + 1")
    each = open_.select("scenario", "area", "first", "last", "begins", F.explode(F.sequence(F.col("area") + 1, F.col("until") - 1)).alias("up"))
    gap = areas.select("scenario", F.col("area").alias("up"), "gap", F.col("rises").alias("ends_it"), F.col("first").alias("up_first"), F.col("last").alias("up_last"), "ends")
    most = F.max("gap").over(Window.partitionBy("scenario", "area").orderBy("up")).alias("most")
    pairs = each.join(gap, ["scenario", "up"]).select("*", most).where(F.col("ends_it") & (F.col("ends") * share >= F.col("most")))
    pairs = stash(pairs.drop("gap", "most", "ends_it"), "pairs")
    # the side that is higher by xi is cut down to the other one
    names = ["scenario", "area", "up"]
    inner = lambda lo, hi: F.explode(F.sequence(lo, hi)).alias("pos")
    high = pairs.where(F.col("begins") * share >= F.col("ends")).select(*names, "ends", inner("first", "last")).join(points, ["scenario", "pos"])
    starts = high.where("ahead <= ends").groupBy(*names).agg(F.min("pos").alias("start"))
    low = pairs.where((F.col("begins") * share < F.col("ends")) & (F.col("ends") * share >= F.col("begins"))).select(*names, "begins", inner("up_first", "up_last"))
    stops = low.join(points, ["scenario", "pos"]).where("back <= begins").groupBy(*names).agg(F.max("pos").alias("stop"))
    start = F.when(F.col("begins") * share >= F.col("ends"), F.coalesce("start", "last")).otherwise(F.col("first"))
    stop = F.when((F.col("begins") * share < F.col("ends")) & (F.col("ends") * share >= F.col("begins")), F.coalesce("stop", "up_first")).otherwise(F.col("up_last"))
    cut = pairs.join(starts, names, "left").join(stops, names, "left").select(*names, start.alias("start"), "up_first", stop.alias("stop"))
    # the end goes back to a point below the beginning's height, or reached from inside
    height = points.select("scenario", F.col("pos").alias("start"), F.col("r").alias("height"))
    ends = cut.join(height, ["scenario", "start"]).select(*names, "start", "height", inner("up_first", "stop")).join(points, ["scenario", "pos"])
    good = ends.where((F.col("pos") > F.col("start")) & ((F.col("height") > F.col("r")) | (F.col("from") >= F.col("start"))))
    whole = good.groupBy(*names, "start").agg(F.max("pos").alias("stop")).where(F.col("stop") - F.col("start") + 1 >= min_cluster_size)
    # of clusters with one rising area the innermost counts; then the first that overlap nothing before them
    left = stash(whole.groupBy("scenario", "up").agg(F.max("start").alias("start"), F.max_by("stop", "start").alias("stop")), "clusters")
    taken = None
    along = Window.partitionBy("scenario").orderBy("up")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    while left.take(1):
        seen = left.withColumn("free", F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)))
        heads = F.max(F.when(F.col("free"), F.col("stop"))).over(before)
        seen = stash(seen.withColumn("clash", F.coalesce(F.col("start") <= heads, F.lit(False))), "clusters")
        free = seen.where("free").select("scenario", "up", "start", "stop")
        taken = free if taken is None else taken.unionByName(free)
        left = stash(seen.where("NOT free AND NOT clash").select("scenario", "up", "start", "stop"), "clusters")
    if taken is None:
        return order.withColumn("cluster", F.lit(-1))
    labels = taken.withColumn("cluster", F.row_number().over(along) - 1).select("scenario", "cluster", inner("start", "stop"))
    return order.join(labels, ["scenario", "pos"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def optics(matrix: DataFrame, min_samples: int = 2, xi: float = 0.05, min_cluster_size: int = 15) -> DataFrame:
    """``scenario, pos, mac, core, reachability, predecessor, cluster`` of all addresses of a matrix ``scenario, i, j, distance``, ``i <= j``.

    Weights are symmetric: the distance, or a core distance of either side if greater. They equal the usual ones, which
    take the core of one side only, wherever no address lies further from itself than from its nearest other one.
    """
    from . import density

    core = stash(density.core_distances(matrix, min_samples), "cores")
    return optics_of(density.reach_edges(matrix, core), core, min_samples, xi, min_cluster_size)


def optics_of(edges: DataFrame, core: DataFrame, min_samples: int = 2, xi: float = 0.05, min_cluster_size: int = 15) -> DataFrame:
    """``optics`` from the core distances and edges among which are those of the spanning tree."""
    from . import density

    tree = density.spanning_tree(edges)
    order = stash(density.visiting_order(tree, core), "order")
    found = xi_clusters(order, xi, min_samples, min_cluster_size)
    return found.join(core, ["scenario", "mac"]).select("scenario", "pos", "mac", "core", "reachability", "predecessor", "cluster")
