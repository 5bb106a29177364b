"""SimHash near-duplicates by BK-trees over shards of the fingerprints.

Two fingerprints within ``radius`` bits agree in at least two of ``radius + 2`` bit blocks, so each distinct
fingerprint goes to one shard for each pair of blocks. A shard's BK-tree keys children by their integer Hamming
distance to the parent; a query follows only edges within the radius of its own distance. A shard's tree and
queries travel together: fingerprints of a whole corpus are neither collected on the driver nor sent to every
task, which a driver-side broadcast would do. A shard above ``SHARD`` fingerprints is cut into pieces, and the
tree of each piece is sent to the queries of every piece of the same shard.

Trees of all the shards in a slice are built and searched together with NumPy. A shard reports a spanning forest
of its links, not its pairs.

``near_duplicate_components`` is the form for texts of a similarity of 0.8 or more: such pairs differ in 3 to 15 of
64 bits, which blocks of bits cannot shard. It takes 256 bits and shards by least shingle hashes, which similar texts
share. The trees only propose there, with a wide radius: what they hold together is searched again with the shingle
sets at hand, and a pair is linked if the sets say so. A pair that fails links nothing, and the search goes on.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spread_join, stash, stash_by, text_hash
from .components import components

SHARD = 20_000  #: fingerprints in a tree at most
SLICE = 200_000  #: rows of whole shards that a task holds at once
FRONT = 250_000  #: (query, node) pairs in work at once
COMPARED = 500_000  #: shingles compared at once
MAPPED = 1_000_000  #: words of bit maps compared at once
STEP = 1_000  #: rows taken from a batch at once, which bounds what is held beyond SETS
SETS = 2_000_000  #: shingles of a shard's piece at most, and of the whole shards that a task holds at once


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; fewer words: the whole sequence; none: zero."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and white space is ASCII's
    if not words:
        return 0
    size = min(shingle, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*[words[i:] for i in range(size)])
    h = np.array([digest(join(r), seed) for r in runs], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, each one word or a row of words."""
    d = np.bitwise_count(a ^ b).astype(np.int64)
    return d.sum(axis=1) if d.ndim == 2 else d


class Forest:
    """One BK-tree for each group; ``group`` is sorted and ``prints`` (words or rows of words) are distinct within a group."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        self.prints, self.bits = prints, 64 * (prints.shape[1] if prints.ndim == 2 else 1)
        span, self.levels = self.bits + 1, []
        new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.empty(0, bool)
        self.groups, self.roots = group[new], np.flatnonzero(new)
        waiting = np.flatnonzero(~new)
        at = self.roots[np.cumsum(new) - 1][waiting]
        keys, children = [], []
        while len(waiting):
            edge = at * span + bits_apart(prints[waiting], prints[at])
            key, first, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            children.append(waiting[first])
            self.levels.append((waiting[first], key // span))
            stays = np.ones(len(waiting), bool)
            stays[first] = False
            at, waiting = waiting[first][back][stays], waiting[stays]
        keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.children = (np.concatenate(children) if children else np.empty(0, np.int64))[order]

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """The label that a node's whole subtree has, or -1."""
        low, high = label.copy(), label.copy()
        for child, parent in reversed(self.levels):
            np.minimum.at(low, parent, low[child])
            np.maximum.at(high, parent, high[child])
        return np.where(low == high, low, -1)

    def within(self, group: np.ndarray, prints: np.ndarray, radius: int, useful=None):
        """Yield arrays (query, node) of those within the radius; a query's group must have a tree.

        ``useful(query, node)`` may mask those whose subtree has nothing new for the query.
        """
        span = self.bits + 1
        root = self.roots[np.searchsorted(self.groups, group)]
        work = [(np.arange(len(prints)), root)]
        while work:
            q, node = work.pop()
            if len(q) > FRONT:
                work += [(q[FRONT:], node[FRONT:]), (q[:FRONT], node[:FRONT])]
                continue
            if useful is not None and 4 * len(q) > len(self.prints):
                still = useful(q, node)
                q, node = q[still], node[still]
            d = bits_apart(prints[q], self.prints[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.keys, node * span + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.keys, node * span + np.minimum(d + radius, self.bits), "right") - low
            if n.sum():
                ends = np.cumsum(n)
                inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
                work.append((np.repeat(q, n), self.children[np.repeat(low, n) + inside]))


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each pair the same label, the least index of their set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


class Sets:
    """The shingle sets of the rows, one after the other: which pairs have at least a Jaccard similarity, a fraction."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray, least: tuple[int, int] | None = None):
        self.sizes, self.values, self.starts = sizes, values, np.cumsum(sizes) - sizes
        self.least, self.maps = least or SIMILAR, None
        self.all = np.sort(values ^ self._salt(np.repeat(np.arange(len(sizes)), sizes)))

    @staticmethod
    def _salt(row: np.ndarray) -> np.ndarray:
        return row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        few, many = np.where(self.sizes[a] <= self.sizes[b], (a, b), (b, a))
        n = self.sizes[few]
        ends = np.cumsum(n)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        wanted = self.values[np.repeat(self.starts[few], n) + inside] ^ self._salt(np.repeat(many, n))
        at = np.minimum(np.searchsorted(self.all, wanted), max(len(self.all) - 1, 0))
        hits = np.r_[0, np.cumsum(self.all[at] == wanted)]
        common = hits[ends] - hits[ends - n]
        up, down = self.least
        return common * (up + down) >= up * (n + self.sizes[many])

    def _mapped(self) -> np.ndarray:
        """A row of bits for each set, one of them set by each shingle: about four times as many as the mean set has shingles."""
        words = 1 << max(0, int(self.sizes.sum() // max(1, len(self.sizes)) * 4 - 1).bit_length() - 6)
        maps = np.zeros((len(self.sizes), words), dtype=np.uint64)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = ((self.values >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
        np.bitwise_or.at(maps, (row, at), np.uint64(1) << (self.values & np.uint64(63)))
        return maps

    def able(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and bits leave room for enough common shingles: a bit of one side only stands for a shingle of that side only."""
        up, down = self.least
        x, y = self.sizes[a], self.sizes[b]
        found = down * np.minimum(x, y) >= up * np.maximum(x, y)
        if not found.any():
            return found
        if self.maps is None:
            self.maps = self._mapped()
        left, step = np.flatnonzero(found), max(1, MAPPED // self.maps.shape[1])
        for k in range(0, len(left), step):
            at = left[k : k + step]
            p, q = self.maps[a[at]], self.maps[b[at]]
            only = [np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64) for u, v in ((p, q), (q, p))]
            most = np.minimum(x[at] - only[0], y[at] - only[1])
            found[at] = most * (up + down) >= up * (x[at] + y[at])
        return found

    def link(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """``union`` of the similar pairs; those that others link meanwhile are not compared."""
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        able = self.able(a, b)
        a, b = a[able], b[able]
        while len(a):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            n = max(1, int(np.searchsorted(np.cumsum(np.minimum(self.sizes[a], self.sizes[b])), COMPARED)))
            good = self.similar(a[:n], b[:n])
            union(label, a[:n][good], b[:n][good])
            a, b = a[n:], b[n:]


def shard_links(
    group: np.ndarray, prints: np.ndarray, role: np.ndarray, radius: int, sizes=None, values=None
) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose links hold together what is linked in each group. role: bit 0 a tree's fingerprint, bit 1 a query.

    A subtree that is already in the query's component is not searched: its links would add nothing. With the ``sizes``
    and ``values`` of the rows' shingle sets, a pair within the radius is linked only if its sets are similar.
    """
    alone = np.bincount(group)[group] < 2
    at = np.flatnonzero(~alone)
    sets = None if sizes is None else Sets(sizes[at], values[np.repeat(~alone, sizes)])
    group, prints, role = group[at], prints[at], role[at]
    tree, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if not len(tree):
        return at[:0], at[:0]
    query = query[np.isin(group[query], group[tree])]
    forest, label = Forest(group[tree], prints[tree]), np.arange(len(prints))
    useful = lambda q, node: forest.uniform(label[tree])[node] != label[query[q]]
    for q, node in forest.within(group[query], prints[query], radius, useful):
        a, b = query[q], tree[node]
        if sets is None:
            union(label, a, b)
        else:
            once = (a > b) | (role[a] != 3)  # where all are both tree and query, a pair comes twice
            sets.link(label, a[once], b[once])
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return at[linked], at[label[linked]]


def _blocks(radius: int) -> list[int]:
    """Masks (signed) of the pairs of radius + 2 blocks of bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    masks = [a | b for a, b in combinations(block, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges ``a, b`` that connect all distinct ``fp`` (bigint) within ``radius`` bits of one another."""
    bands = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in _blocks(radius)])
    return tree_links(prints.select("fp", F.posexplode(bands).alias("band", "bits")), "fp", ["fp"], radius)


def tree_links(rows: DataFrame, node: str, words: list[str], radius: int, large: DataFrame | None = None) -> DataFrame:
    """Edges ``a, b`` (of ``node``, bigint) within ``radius`` bits of ``words`` and in one shard ``band, bits``.

    Rows with ``shingles`` (array<bigint>) are linked only where these are similar; ``large`` then has ``band, bits, n`` of
    the shards to be cut into n / SHARD pieces.
    """
    verified = ["shingles"] if "shingles" in rows.columns else []
    if large is None:
        large = rows.groupBy("band", "bits").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    rows = rows.join(large, ["band", "bits"], "left")
    pieces = F.coalesce(F.ceil(F.col("n") / SHARD), F.lit(1)).cast("int")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64(node), pieces).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    tree, query = F.col("piece") <= F.col("other"), F.col("piece") >= F.col("other")
    carried = list(dict.fromkeys([node, *words, *verified]))
    rows = rows.select(
        "band", "bits", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), *carried,
        (tree.cast("int") + 2 * query.cast("int")).alias("role"),
    )
    shard = ["band", "bits", "i", "j"]
    dealt = rows.repartition(*shard).sortWithinPartitions(*shard, node)

    def make():
        held: list = []

        def links(key, name, fp, role, *sets):
            group = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)]) if len(name) else np.empty(0, np.int64)
            a, b = shard_links(group, fp[:, 0] if len(words) == 1 else fp, role, radius, *sets)
            return {"a": name[a], "b": name[b]}

        def work(batch, last=False):
            if not last:
                for at in range(0, batch.num_rows, STEP):
                    yield from part(batch.slice(at, STEP), False)
            else:
                yield from part(None, True)

        def part(batch, last):
            if batch is not None:
                key = np.stack([batch[c].to_numpy().astype(np.int64) for c in shard], 1)
                fp = np.stack([batch[c].to_numpy().view(np.uint64) for c in words], 1)
                sets = [batch[c] for c in verified]
                sets = [x for s in sets for x in (s.value_lengths().to_numpy().astype(np.int64), s.flatten().to_numpy().view(np.uint64))]
                held.append((key, batch[node].to_numpy(), fp, batch["role"].to_numpy(), *sets))
            if not held or not last and sum(len(x[1]) for x in held) < SLICE and sum(len(x[-1]) for x in held) < SETS:
                return
            key, name, fp, role, *sets = (np.concatenate(x) for x in zip(*held))
            held.clear()
            end = len(name)
            if not last:  # the last shard may go on in the next batch
                other = np.flatnonzero((key != key[-1]).any(axis=1))
                end = other[-1] + 1 if len(other) else 0
                cut = [end, int(sets[0][:end].sum())] if sets else []
                held.append((key[end:], name[end:], fp[end:], role[end:], *[s[c:] for s, c in zip(sets, cut)]))
                sets = [s[:c] for s, c in zip(sets, cut)]
            if end:
                yield links(key[:end], name[:end], fp[:end], role[:end], *sets)

        return work

    return map_rows(dealt, "a bigint, b bigint", make, last=True)


def simhash_components(
    docs: DataFrame, shingle: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, fingerprint, component_id`` of each input row; the component's id is the least key that it reaches.

    Fingerprints within ``radius`` bits are linked, equal ones too; texts without words have fingerprint zero and
    are linked like any other. A null text has no words. Repeated rows are rows of one component. A component
    whose keys are all null has a null id.
    """
    kind = dict(docs.dtypes)[key]

    def make():
        def work(batch):
            found = np.array([fingerprint(t, shingle) for t in batch[text].to_pylist()], dtype=np.uint64)
            yield {key: batch[key], "fp": found.view(np.int64)}

        return work

    # short rows before anything is shuffled
    digest = stash(map_rows(docs.select(key, text), f"`{key}` {kind}, fp bigint", make), "simhash")
    prints = stash(digest.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("rows")), "simhash-prints")
    roots = components(fingerprint_links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    owner = stash(spread_join(named.select("fp", "rows", "root"), ids, "root", "prints").select("fp", "component_id", "rows"), "simhash-owners")
    found = spread_join(digest, owner, "fp", "rows")
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WORDS = 4  #: 64-bit words of the wide fingerprint
NEAR = 72  #: of its 256 bits, to propose a pair: one of similarity 0.8 is expected at 39, or 48 for 4 of 5 shingles, with a standard deviation of 6
SIMILAR = 4, 5  #: least Jaccard similarity, as a fraction
BANDS, ROWS = 8, 2  #: shards of a text, least hashes in each: 0.9997 of the pairs of similarity 0.8 share one


def _mixed(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A new 64-bit hash of each ``h`` for each seed (the finaliser of splitmix64): one row a seed."""
    z = h[None, :] + seeds[:, None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


SEEDS = np.arange(1, WORDS + BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the word shingles; fewer words: the whole sequence; none: empty."""
    words = (text or "").encode().lower().split()
    size = max(1, min(shingle, len(words)))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(r), seed) for r in zip(*[words[i:] for i in range(size)])], dtype=np.uint64))


def wide_fingerprint(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of ``WORDS`` words and the keys of ``BANDS`` shards of a shingle set. Without shingles both are zero.

    Repeats of a shingle count once, or one line repeated often would link texts of a low Jaccard similarity.
    """
    if not len(h):
        return np.zeros(WORDS, np.uint64), np.zeros(BANDS, np.uint64)
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1 << 14):
        part = _mixed(h[at : at + (1 << 14)], SEEDS)
        bits = np.unpackbits(np.ascontiguousarray(part[:WORDS].T).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        np.minimum(least, part[WORDS:].min(axis=1), out=least)
    prints = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)
    first, *others = least.reshape(BANDS, ROWS).T
    for o in others:
        first = first * np.uint64(0x9E3779B97F4A7C15) + o
    return prints, first


def near_duplicate_components(
    docs: DataFrame, shingle: int = 5, radius: int = NEAR, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, component_id`` of each input row: texts of a similarity of SIMILAR or more that share a shard are linked.

    Texts without words are linked to one another; a null text has no words. A component whose keys are all null has
    a null id. Equal texts are one node before anything is sharded. Trees of ``radius`` bits propose groups; the texts
    of a group are compared by their shingle sets, in one task, or in the shards again where a group is large.
    """
    named = docs.select(F.col(key).alias(key), F.col(text).alias("body"), text_hash(text).alias("node"))
    texts = stash_by(named.groupBy("node").agg(F.first("body").alias("body")), "node", "near")
    least = named.groupBy("node").agg(F.min(key).alias("least"), F.count("*").alias("rows"))
    least = least.join(_linked(texts, shingle, radius), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    owner = stash(spread_join(least.select("node", "rows", "root"), ids, "root", "nodes").select("node", "component_id", "rows"), "near-owners")
    return spread_join(named.select(key, "node"), owner, "node", "rows").select(key, "component_id")


def _linked(texts: DataFrame, shingle: int, radius: int) -> DataFrame:
    """``node, root`` of the nodes that are similar to others, from ``node, body``, a table bucketed by node with a row each."""
    words = [f"w{k}" for k in range(WORDS)]

    def make():
        def work(batch):
            sets = [shingle_set(t, shingle) for t in batch["body"].to_pylist()]
            found = [wide_fingerprint(h) for h in sets]
            prints = np.array([f[0] for f in found], dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            yield {
                "node": batch["node"], **{w: prints[:, k].copy() for k, w in enumerate(words)},
                "shards": [f[1].view(np.int64) for f in found], "size": [len(h) for h in sets],
            }

        return work

    schema = f"node bigint, {', '.join(w + ' bigint' for w in words)}, shards array<bigint>, size bigint"
    nodes = stash(map_rows(texts, schema, make), "near-nodes")
    proposed = tree_links(nodes.select("node", *words, F.posexplode("shards").alias("band", "bits")), "node", words, radius)
    return _members(_verified(texts, nodes, _members(proposed), words, shingle, radius))


def _members(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes that have an edge, the least ones too."""
    found = components(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _verified(texts: DataFrame, nodes: DataFrame, proposed: DataFrame, words: list[str], shingle: int, radius: int) -> DataFrame:
    """Edges of similar nodes of each proposed group (``node, root``); their texts are read again, from where they are."""
    grouped = nodes.join(proposed, "node")
    groups = grouped.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    # a small group is one shard, so that its sets travel once; a large one keeps its shards
    keys = F.when((F.col("m") <= SETS) & (F.col("n") <= SHARD), F.array("root")).otherwise(F.col("shards"))
    joined = spread_join(grouped, groups.withColumn("rows", F.col("n")), "root", "rows")
    members = stash(joined.select("node", *words, "size", keys.alias("keys")), "near-members")
    band = F.when(F.size("keys") == 1, -1).otherwise(F.col("band")).alias("band")
    placed = members.select("size", "keys", F.posexplode("keys").alias("band", "bits")).select("size", band, "bits")
    pieces = F.greatest(F.count("*"), F.ceil(F.sum("size") * SHARD / SETS))
    large = placed.where("band >= 0").groupBy("band", "bits").agg(pieces.alias("n")).where(F.col("n") > SHARD)
    kept = ["node", *words, "keys"]

    def make():
        def work(batch):
            yield {
                **{c: batch[c].to_pylist() for c in kept},
                "shingles": [shingle_set(t, shingle).view(np.int64) for t in batch["body"].to_pylist()],
            }

        return work

    schema = f"node bigint, {', '.join(w + ' bigint' for w in words)}, keys array<bigint>, shingles array<bigint>"
    full = map_rows(texts.join(members, "node").select(*kept, "body"), schema, make)
    rows = full.select("node", *words, "shingles", "keys", F.posexplode("keys").alias("band", "bits"))
    return tree_links(rows.select("node", *words, "shingles", band, "bits"), "node", words, radius, large)


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 5, radius: int = NEAR, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each near-duplicate component stays. Columns as given.

    It is the row of the least (key, hash of the text, hash of all columns), a null key after all others: rows are told
    apart by these, not by the key, so null and repeated keys lose no component, and the order of tasks has no say.

    The rows are grouped by text once, copies within a task before they move, and written bucketed by it. What follows
    (shingle sets of the texts to compare, rows that go) is joined to that table where it lies, whatever its size.
    """
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns])
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), text_hash(text).alias("node"), row.alias("row"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), first.alias("first"))
    once = named.groupBy(F.col("first.node").alias("node")).agg(F.min_by("kept", "first").alias("kept"), F.min("first").alias("first"))
    table = stash_by(once, "node", "near")
    linked = stash(_linked(table.select("node", F.col("kept")[text].alias("body")), shingle, radius), "near-linked")
    named = table.select("node", "first").join(linked, "node")
    stay = named.groupBy("root").agg(F.min("first").alias("stays"), F.count("*").alias("n"))
    gone = spread_join(named, stay, "root", "n").where(F.col("node") != F.col("stays.node")).select("node")
    return table.join(stash(gone, "near-gone"), "node", "left_anti").select("kept.*")
