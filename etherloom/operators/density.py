"""Density clustering of a distance matrix: core distances, spanning tree, and the order in which a walk visits the addresses.

A walk begins at the least address and always takes the least edge, by (weight, i, j), from a visited address to another
one. Which address it reaches when is read off the tree of merges: a part that edges below some weight hold together is
visited whole before it is left. So the order is not walked: the spanning tree is cut by the rank of its edges into
slices of at most ``chunk`` edges; going up, each slice contracts what its edges connect; coming down, each slice splits
every part into the one that holds its entry and the one that the edge enters, and gives both their place. A task holds
one slice of one scenario going up, and one part of a slice coming down, whatever the number of addresses.

All functions take and return rows of any number of scenarios, which are worked on together.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from etherloom.sources.storage import stash

from . import matrix as matrix_
from .ordering import numbered

BLOCK = 2000  #: distances of an address that are listed together
CHUNK = 50_000  #: edges in a slice


def both_ways(matrix: DataFrame) -> DataFrame:
    """A row for each ordered pair of a matrix that has ``i <= j``."""
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return matrix.select("scenario", F.inline(sides), "distance")


def core_distances(matrix: DataFrame, min_samples: int = 2) -> DataFrame:
    """``scenario, mac, core``: the ``min_samples``-th least distance of each address, its own on the diagonal included.

    Null where there are fewer. The distances of an address are listed in blocks of a bounded size, of which each passes on its least few.
    """
    n = matrix.where("i = j").groupBy("scenario").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("j"), F.lit(max(1, -(-n // BLOCK)))).alias("block")
    few = lambda c: F.slice(F.array_sort(c), 1, min_samples)
    parts = both_ways(matrix).groupBy("scenario", F.col("i").alias("mac"), block).agg(few(F.collect_list("distance")).alias("least"))
    least = parts.groupBy("scenario", "mac").agg(few(F.flatten(F.collect_list("least"))).alias("least"))
    return least.select("scenario", "mac", F.get("least", F.lit(min_samples - 1)).alias("core"))


def reach_edges(matrix: DataFrame, core: DataFrame) -> DataFrame:
    """``scenario, i, j, weight`` of the pairs ``i < j``: the distance, or a core distance of either side if that is greater."""
    side = lambda c: core.select("scenario", F.col("mac").alias(c), F.col("core").alias(f"core_{c}"))
    joined = matrix.where("i < j").join(side("i"), ["scenario", "i"]).join(side("j"), ["scenario", "j"])
    return joined.select("scenario", "i", "j", F.greatest("distance", "core_i", "core_j").alias("weight"))


def grouped_core_distances(matrix: DataFrame, members: DataFrame, min_samples: int = 2) -> DataFrame:
    """``scenario, mac, core`` as ``core_distances``, from the matrix of representatives: each counts as often as it has members.

    ``members``: ``scenario, mac, first``; ``first`` is the least of the addresses at the same distances from all others
    and at its own from one another, and the only one of them in ``matrix``.
    """
    sizes = members.groupBy("scenario", F.col("first").alias("j")).agg(F.count("*").alias("n"))
    n = sizes.groupBy("scenario").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("j"), F.lit(max(1, -(-n // BLOCK)))).alias("block")
    few = lambda c: F.slice(F.array_sort(c), 1, min_samples)
    again = F.array_repeat("distance", F.least("n", F.lit(min_samples)).cast("int"))
    counted = both_ways(matrix).join(sizes, ["scenario", "j"])
    parts = counted.groupBy("scenario", "i", block).agg(few(F.flatten(F.collect_list(again))).alias("least"))
    least = parts.groupBy("scenario", F.col("i").alias("first")).agg(few(F.flatten(F.collect_list("least"))).alias("least"))
    return members.join(least, ["scenario", "first"]).select("scenario", "mac", F.get("least", F.lit(min_samples - 1)).alias("core"))


def grouped_reach_edges(matrix: DataFrame, members: DataFrame, core: DataFrame) -> DataFrame:
    """Of the edges of ``reach_edges`` those that can be in the spanning tree, from the matrix of representatives.

    Between two groups all edges weigh the same. In the order (weight, i, j) an edge is the last of a circle unless it
    ends in a group's least address, so only stars are left: within a group from its least address, and from the least
    address of another group. The other group's least address needs no edge to the members that hold together at less,
    or at the same weight where it is not the lesser of the two.
    """
    cores = members.where("mac = first").join(core, ["scenario", "mac"])
    many = members.groupBy("scenario", F.col("first").alias("mac")).agg((F.count("*") > 1).alias("several"))
    own = matrix.where("i = j").select("scenario", F.col("i").alias("mac"), F.col("distance").alias("own"))
    of = cores.join(many, ["scenario", "mac"]).join(own, ["scenario", "mac"]).select("scenario", "mac", "core", "several", F.greatest("own", "core").alias("inner"))
    of = stash(of, "groups")
    side = lambda c: of.select("scenario", F.col("mac").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("core", "several", "inner")])
    pairs = matrix.where("i < j").join(side("i"), ["scenario", "i"]).join(side("j"), ["scenario", "j"])
    pairs = stash(pairs.withColumn("weight", F.greatest("distance", "core_i", "core_j")), "group-pairs")
    # the least address of i is the lesser one: it reaches the members of j at equal weights too
    stars = pairs.where("several_i AND weight < inner_i").select("scenario", F.col("i").alias("first"), F.col("j").alias("hub"), "weight")
    stars = stars.unionByName(pairs.where("several_j AND weight <= inner_j").select("scenario", F.col("j").alias("first"), F.col("i").alias("hub"), "weight"))
    stars = stars.unionByName(of.where("several").select("scenario", F.col("mac").alias("first"), F.col("mac").alias("hub"), F.col("inner").alias("weight")))
    ends = stars.join(members.where("mac <> first"), ["scenario", "first"])
    ends = ends.select("scenario", F.least("hub", "mac").alias("i"), F.greatest("hub", "mac").alias("j"), "weight")
    return pairs.select("scenario", "i", "j", "weight").unionByName(ends)


def _block_distances(one: pa.Table, other: pa.Table, specs: Mapping, places: int | None) -> np.ndarray:
    """Distances of all pairs of two blocks, from the side of the lesser address."""
    a, b = (x.column("texts").to_pylist() for x in (one, other))
    there, back, _ = matrix_.whole_distances(a, b, specs, [matrix_.own_weights(specs)], places)
    if there is back:
        return there[0]
    i, j = (x.column("key").to_numpy() for x in (one, other))
    return np.where(i[:, None] <= j[None, :], there[0], back[0])


def _blocks(groups: DataFrame, blocks: int | None) -> int:
    n, chars = groups.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json("texts"))), F.lit(0))).first()
    return blocks or max(1, min(n, max(matrix_.SPREAD, -(-max(n, chars // matrix_.CHARS) // BLOCK))))


def profile_core_distances(groups: DataFrame, specs: Mapping, min_samples: int = 2, places: int | None = None, blocks: int | None = None) -> DataFrame:
    """``key, core`` as ``grouped_core_distances``, without a matrix: blocks of profiles pass on the least few distances of each.

    ``groups``: ``key, texts, times``: the least of the addresses of a profile, its values as ``matrix.whole_profiles`` has
    them, and how many addresses it has. Distances are rounded to ``places``, if given.
    """
    count, kind = _blocks(groups, blocks), dict(groups.dtypes)["key"]

    def nearest(d: np.ndarray, times: np.ndarray) -> np.ndarray:
        at = np.argpartition(d, min(min_samples, d.shape[1]) - 1, axis=1)[:, :min_samples]
        again = np.arange(min_samples)[None, None, :] < times[at][:, :, None]
        found = np.where(again, np.take_along_axis(d, at, 1)[:, :, None], np.inf).reshape(len(d), -1)
        return np.sort(found, axis=1)[:, :min_samples]

    def work(keys, one, other):
        d = _block_distances(one, other, specs, places)
        for side, m, against in ((one, d, other), (other, d.T, one))[: 1 if one is other else 2]:
            yield {"key": side.column("key").combine_chunks(), "least": pa.array(list(nearest(m, against.column("times").to_numpy())))}

    found = matrix_.in_blocks(groups.select("key", "texts", "times"), [], count, f"key {kind}, least array<double>", work)
    least = found.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, min_samples).alias("least"))
    core = F.get("least", F.lit(min_samples - 1))
    return least.select("key", F.when(core < float("inf"), core).alias("core"))


def _block_tree(d: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """The least spanning tree, by (weight, lesser, greater), of the edges between two blocks or within one, as pairs of places in them.

    ``i`` and ``j`` tell the order of the addresses of both sides.
    """
    n = len(i)
    rank = i if same else np.r_[i, j]
    rows = d if same else [*d, *np.ascontiguousarray(d.T)]
    span = int(rank.max()) + 1
    weight, edge, above = np.full(len(rank), np.inf), np.full(len(rank), np.iinfo(np.int64).max), np.zeros(len(rank), dtype=np.int64)
    out = np.ones(len(rank), dtype=bool)
    found, at = [], 0
    out[0] = False
    for _ in range(len(rank) - 1):
        sides = slice(None) if same else slice(n, None) if at < n else slice(0, n)
        w, r = rows[at], rank[sides]
        e = np.minimum(r, rank[at]) * span + np.maximum(r, rank[at])
        nearer = out[sides] & ((w < weight[sides]) | (w == weight[sides]) & (e < edge[sides]))
        weight[sides][nearer], edge[sides][nearer], above[sides][nearer] = w[nearer], e[nearer], at
        live = np.where(out, weight, np.inf)
        ties = np.flatnonzero(out & (live == live.min()))
        at = int(ties[np.argmin(edge[ties])])
        out[at] = False
        found.append((int(above[at]), at) if same or above[at] < at else (at, int(above[at])))
    return found


def profile_edges(groups: DataFrame, members: DataFrame, specs: Mapping, places: int | None = None, blocks: int | None = None) -> DataFrame:
    """``i, j, weight``: edges among which are those of the spanning tree of all addresses, without a matrix.

    ``groups`` has ``key, texts, times, core``, ``members`` ``mac, first``. An edge of the whole tree is in the tree of any
    part of the edges that has it, so two blocks pass on only the tree of the edges between them, and a block that of its own.

    Of a profile's addresses only the least one has other edges than one: all lie as far from the least address h of any
    profile, their own too, and h is linked to their own least address by a lesser edge; so of two such edges of an
    address the greater one closes a circle in which it is the last. The least one leads to the least (weight, h).
    """
    count, kind = _blocks(groups, blocks), dict(groups.dtypes)["key"]

    def work(keys, one, other):
        i, j = (x.column("key").combine_chunks() for x in (one, other))
        core = [x.column("core").to_numpy() for x in (one, other)]
        w = np.fmax(_block_distances(one, other, specs, places), np.fmax(core[0][:, None], core[1][None, :]))
        order = pa.compute.rank(pa.concat_arrays([i] if one is other else [i, j]), tiebreaker="dense").to_numpy().astype(np.int64)
        same = one is other
        tree = np.array(_block_tree(w, order[: len(i)], order if same else order[len(i) :], same), dtype=np.int64).reshape(-1, 2)
        if not same:
            tree[:, 1] -= len(i)
        a, b = tree[:, 0], tree[:, 1]
        yield {"i": i.take(pa.array(a)), "j": j.take(pa.array(b)), "weight": w[a, b], "star": np.zeros(len(a), bool)}
        for side, hubs, m in ((other, i, w), (one, j, w.T))[: 1 if same else 2]:
            several = np.flatnonzero(side.column("times").to_numpy() > 1)
            at = np.argmin(m, axis=0)[several]  # rows are in the order of their addresses: the least of equal ones
            yield {"i": side.column("key").combine_chunks().take(pa.array(several)), "j": hubs.take(pa.array(at)), "weight": m[at, several], "star": np.ones(len(several), bool)}

    found = matrix_.in_blocks(groups.select("key", "texts", "times", "core"), [], count, f"i {kind}, j {kind}, weight double, star boolean", work)
    found = stash(found, "block-edges")
    edge = lambda a, b: (F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), "weight")
    stars = found.where("star").groupBy(F.col("i").alias("first")).agg(F.min(F.struct("weight", F.col("j").alias("hub"))).alias("x"))
    ends = members.where("mac <> first").join(stars.select("first", "x.hub", "x.weight"), "first")
    return found.where("NOT star").select(*edge("i", "j")).unionByName(ends.select(*edge("hub", "mac")))


def _roots(parents: DataFrame) -> DataFrame:
    """``scenario, node, root`` by pointer jumping: as many rounds as the logarithm of the longest way to a root."""
    now = stash(parents.select("scenario", "node", F.col("up").alias("root"), F.lit(True).alias("moved")), "jump")
    while True:
        above = now.select("scenario", F.col("node").alias("root"), F.col("root").alias("next"))
        after = now.join(above, ["scenario", "root"]).select("scenario", "node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        now = stash(after, "jump")
        if not now.where("moved").take(1):
            return now.select("scenario", "node", "root")


def spanning_tree(edges: DataFrame) -> DataFrame:
    """``scenario, i, j, weight``: the least spanning tree, ties by (weight, i, j), of ``edges`` with ``i < j``; a forest if they do not connect.

    In each round every part takes its least edge to another, and the parts that these connect become one; of the
    edges between two parts only the least is carried on, so a round has at most a quarter of the edges of a full matrix.
    """
    live = stash(edges.select("scenario", F.col("i").alias("a"), F.col("j").alias("b"), F.struct("weight", "i", "j").alias("e")), "edges")
    found = []
    while True:
        ends = live.select("scenario", F.col("a").alias("node"), F.col("b").alias("up"), "e").unionByName(live.select("scenario", F.col("b").alias("node"), F.col("a").alias("up"), "e"))
        least = ends.groupBy("scenario", "node").agg(F.min(F.struct("e", "up")).alias("x"))
        picked = stash(least.select("scenario", "node", "x.up", "x.e"), "picked")
        if not picked.take(1):
            break
        found.append(picked.select("scenario", "e.i", "e.j", "e.weight").distinct())
        other = picked.select("scenario", F.col("node").alias("up"), F.col("e").alias("back"))
        both = picked.join(other, ["scenario", "up"])  # two parts that take the same edge: the lesser one is the root
        up = F.when((F.col("e") == F.col("back")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up")
        roots = _roots(both.select("scenario", "node", up))
        name = lambda c: roots.select("scenario", F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        moved = live.join(name("a"), ["scenario", "a"]).join(name("b"), ["scenario", "b"]).where("root_a <> root_b")
        between = moved.groupBy("scenario", F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        live = stash(between.agg(F.min("e").alias("e")), "edges")
    if not found:
        return edges.limit(0)
    return reduce(DataFrame.unionByName, found)


class _Merges:
    """The tree of merges of a slice: leaves are parts, each edge by rank joins two of them."""

    def __init__(self, edges: pd.DataFrame):
        edges = edges.sort_values("rank")
        self.i, self.j, self.weight = edges["i"].tolist(), edges["j"].tolist(), edges["weight"].tolist()
        self.at: dict = {}
        self.sizes: list[int] = []
        pairs = []
        for a, b, x, y in zip(edges["part_i"].tolist(), edges["part_j"].tolist(), edges["size_i"].tolist(), edges["size_j"].tolist()):
            for part, size in ((a, x), (b, y)):
                if part not in self.at:
                    self.at[part] = len(self.sizes)
                    self.sizes.append(size)
            pairs.append((self.at[a], self.at[b]))
        self.leaves = len(self.sizes)
        self.kids: list[tuple[int, int]] = []
        self.pairs, above = pairs, list(range(self.leaves + len(pairs)))

        def top(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for a, b in pairs:
            left, right = top(a), top(b)
            above[left] = above[right] = self.leaves + len(self.kids)
            self.kids.append((left, right))
            self.sizes.append(self.sizes[left] + self.sizes[right])
        self.top = [top(x) for x in range(self.leaves)]

    def merged(self) -> tuple[list, list, list]:
        """Each part, the least part of what it is in now, and the size of that."""
        parts, least = list(self.at), {}
        for part, t in zip(parts, self.top):
            least[t] = min(least.get(t, part), part)
        return parts, [least[t] for t in self.top], [self.sizes[t] for t in self.top]

    def placed(self, start, entry, offset: int, reach, before) -> list[tuple]:
        """For each part of a single tree: its entry, the number of addresses visited before, the edge that enters and where from."""
        n = len(self.sizes)
        low, count = [0] * n, [1] * self.leaves
        for left, right in self.kids:
            count.append(count[left] + count[right])
        for k in range(n - 1, self.leaves - 1, -1):
            left, right = self.kids[k - self.leaves]
            low[left], low[right] = low[k], low[k] + count[left]
        state: list = [None] * n
        state[n - 1] = low[self.at[start]], entry, offset, reach, before
        for k in range(n - 1, self.leaves - 1, -1):
            e = k - self.leaves
            (left, right), (a, b) = self.kids[e], self.pairs[e]
            inside = low[left] <= state[k][0] < low[left] + count[left]
            old, new = (left, right) if inside else (right, left)
            into, origin, leaf = (self.j[e], self.i[e], b) if inside else (self.i[e], self.j[e], a)
            state[old] = state[k]
            state[new] = low[leaf], into, state[k][2] + self.sizes[old], self.weight[e], origin
        return [(part, *state[x][1:]) for part, x in self.at.items()]


def visiting_order(tree: DataFrame, macs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``scenario, pos, mac, reachability, predecessor`` of a walk over the spanning ``tree`` that begins at the least address.

    ``macs`` has ``scenario, mac``. The first address has no reachability and no predecessor; where the tree is a
    forest, the part of the least address comes first, and each part begins so. A scenario of one address has one row.
    """
    kind = dict(macs.dtypes)["mac"]
    ranked = numbered(tree, ["scenario", "weight", "i", "j"], "number")
    first = ranked.groupBy("scenario").agg(F.min("number").alias("first"))
    ranked = stash(ranked.join(first, "scenario").withColumn("rank", F.col("number") - F.col("first")).drop("number", "first"), "ranked")
    slices = -(-((ranked.agg(F.max("rank")).first()[0] or 0) + 1) // chunk)
    parts = stash(macs.select("scenario", "mac", F.col("mac").alias("part"), F.lit(1).cast("long").alias("size")), "parts")
    scenario_kind, passed = dict(macs.dtypes)["scenario"], []

    def merge(edges: pd.DataFrame) -> pd.DataFrame:
        names, after, size = _Merges(edges).merged()
        return pd.DataFrame({"scenario": edges["scenario"].iloc[0], "part": names, "after": after, "all": size})

    for k in range(slices):
        side = lambda c: parts.select("scenario", F.col("mac").alias(c), F.col("part").alias(f"part_{c}"), F.col("size").alias(f"size_{c}"))  # noqa: B023, E731
        own = ranked.where((F.col("rank") >= k * chunk) & (F.col("rank") < (k + 1) * chunk))
        own = stash(own.join(side("i"), ["scenario", "i"]).join(side("j"), ["scenario", "j"]), "slice")
        merged = stash(own.groupBy("scenario").applyInPandas(merge, f"scenario {scenario_kind}, part {kind}, after {kind}, all bigint"), "merged")
        passed.append((own, parts, merged))
        new = parts.join(merged, ["scenario", "part"], "left")
        parts = stash(new.select("scenario", "mac", F.coalesce("after", "part").alias("part"), F.coalesce("all", "size").alias("size")), "parts")

    whole = parts.groupBy("scenario", "part").agg(F.min("mac").alias("entry"), F.first("size").alias("size"))
    before = Window.partitionBy("scenario").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None)
    now = whole.select(
        "scenario", "part", "entry", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("pos"), none.cast("double").alias("reach"), none.cast(kind).alias("origin")
    )
    schema = f"scenario {scenario_kind}, part {kind}, entry {kind}, pos bigint, reach double, origin {kind}"

    def split(edges: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        (row,) = of.itertuples(index=False)
        if not len(edges):
            return of[["scenario", "part", "entry", "pos", "reach", "origin"]]
        reach, origin = (None if pd.isna(x) else x for x in (row.reach, row.origin))
        found = _Merges(edges).placed(row.start, row.entry, int(row.pos), reach, origin)
        return pd.DataFrame([(row.scenario, *f) for f in found], columns=["scenario", "part", "entry", "pos", "reach", "origin"], dtype=object)

    for own, inside, merged in reversed(passed):
        start = inside.select("scenario", F.col("mac").alias("entry"), F.col("part").alias("start"))
        of = now.join(start, ["scenario", "entry"])
        edges = own.join(merged.select("scenario", F.col("part").alias("part_i"), F.col("after").alias("part")), ["scenario", "part_i"])
        now = stash(edges.groupBy("scenario", "part").cogroup(of.groupBy("scenario", "part")).applyInPandas(split, schema), "placed")
    return now.select("scenario", "pos", F.col("part").alias("mac"), F.col("reach").alias("reachability"), F.col("origin").alias("predecessor"))
