"""MinHash near-duplicates by one-permutation hashing, banded buckets and stars of candidate edges.

One hash of each shingle fills all the bins of a signature: its bin and its rank there. An empty bin takes the value of
the first filled one on a random walk of its own (optimal densification), so a bin of two sets agrees with the
probability of their Jaccard similarity, whatever their size. Bands of bins are bucket keys.

A bucket is a star: its centre, the member that meets most others over all its buckets, is the only one that is compared
with every member, so candidate edges are at most the bucket's rows. Stars are dealt out by centre, a large one in
pieces, with whole shingle sets, and an edge stays if these are similar. Where a bucket still holds two texts that no
link connects, and neither is its centre, the same is done inside it until each member has been a centre or all that are
left are connected: that is exact for every pair that shares a bucket.

Texts move once, into a table of distinct texts bucketed by their identity; everything later is joined to it there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spread_join, stash, stash_by, text_hash
from .components import components
from .simhash import Sets, shingle_set

BANDS, ROWS = 20, 4  #: of two sets of similarity 0.85 all bands differ with a probability of 4e-7
STARS = 20_000  #: members of a star's or bucket's piece at most
SETS = 1_000_000  #: their shingles at most, and of the whole pieces that a task holds at once
BITS = 1024  #: of the map that rules pairs out before their sets are compared
PIECE = 1_000  #: rows taken from a batch at once
_BINS = BANDS * ROWS


def _mixed(h: np.ndarray) -> np.ndarray:
    z = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: the walk of each bin, the same for every set: which bin to look at next
WALKS = (_mixed(np.arange(1, _BINS * 1024 + 1, dtype=np.uint64)) % np.uint64(_BINS)).astype(np.int64).reshape(_BINS, 1024)


def signature(h: np.ndarray) -> np.ndarray:
    """Value of each bin of a set of shingle hashes, which must not be empty."""
    none = np.iinfo(np.uint64).max
    value = _mixed(h)
    out = np.full(_BINS, none, dtype=np.uint64)
    np.minimum.at(out, (h % np.uint64(_BINS)).astype(np.int64), np.minimum(value, none - np.uint64(1)))
    filled = out != none
    empty = np.flatnonzero(~filled)
    found = out.copy()
    for low, high in ((0, 16), (16, 128), (128, 1024)):
        if not len(empty):
            break
        hits = filled[WALKS[empty, low:high]]
        first = hits.argmax(axis=1)
        done = hits[np.arange(len(empty)), first]
        found[empty[done]] = out[WALKS[empty[done], low + first[done]]]
        empty = empty[~done]
    found[empty] = out[filled].min()  # by chance below 1e-5 for a single shingle
    return found


def bucket_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band of the signature; a set without shingles has none."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    rows = signature(h).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


class Mapped(Sets):
    """Shingle sets with a map of bits each: a bit that one set has and the other lacks is a shingle that they do not share."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray, similar: tuple[int, int]):
        super().__init__(sizes, values, similar)
        self.bits = np.zeros((len(sizes), BITS // 64), dtype=np.uint64)
        at = (values % np.uint64(BITS)).astype(np.int64)
        np.bitwise_or.at(self.bits, (np.repeat(np.arange(len(sizes)), sizes), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

    def link(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        up, down = self.least
        able = np.empty(len(a), dtype=bool)
        for k in range(0, len(a), 1 << 16):
            p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            x, y = self.bits[p], self.bits[q]
            shared = np.minimum(
                self.sizes[p] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), self.sizes[q] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            )
            able[k : k + (1 << 16)] = shared * (up + down) >= up * (self.sizes[p] + self.sizes[q])
        super().link(label, a[able], b[able])


def star_links(group: np.ndarray, known: np.ndarray, sets: Sets, once: bool) -> np.ndarray:
    """A label for each row: rows of equal label are linked, or were ``known`` by an equal name before.

    ``group`` is sorted. The first row of each is compared with all its others that it is not linked with; unless
    ``once``, the next row follows, until all that are left in the group are linked.
    """
    _, first, back = np.unique(known, return_index=True, return_inverse=True)
    label = first[back]
    left = np.arange(len(group))
    while len(left):
        g = group[left]
        head = np.r_[True, g[1:] != g[:-1]]
        centre = left[head][np.cumsum(head) - 1]
        sets.link(label, centre[~head], left[~head])
        if once:
            break
        left, g = left[~head], g[~head]
        if len(left):
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            apart = np.minimum.reduceat(label[left], starts) != np.maximum.reduceat(label[left], starts)
            left = left[np.repeat(apart, np.diff(np.r_[starts, len(g)]))]
    return label


def _compared(rows: DataFrame, once: bool, similar: tuple[int, int]) -> DataFrame:
    """Links ``a, b`` within each ``shard, piece, other`` of ``rows``, which have ``node, root, place, shingles``; the least place is the first centre."""
    keys = ["shard", "piece", "other"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "place", "node")

    def make():
        held: list = []

        def work(batch, last=False):
            for at in range(0, batch.num_rows, PIECE) if not last else [0]:
                part = None if last else batch.slice(at, PIECE)
                if part is not None:
                    key = np.stack([part[c].to_numpy().astype(np.int64) for c in keys], 1)
                    s = part["shingles"]
                    held.append((key, part["node"].to_numpy(), part["root"].to_numpy(), s.value_lengths().to_numpy().astype(np.int64), s.flatten().to_numpy().view(np.uint64)))
                if not held or not last and sum(len(x[-1]) for x in held) < SETS and sum(len(x[0]) for x in held) < STARS:
                    continue
                key, node, root, sizes, values = (np.concatenate(x) for x in zip(*held))
                held.clear()
                end = len(node)
                if not last:  # the last shard may go on
                    other = np.flatnonzero((key != key[-1]).any(axis=1))
                    end = other[-1] + 1 if len(other) else 0
                    cut = int(sizes[:end].sum())
                    held.append((key[end:], node[end:], root[end:], sizes[end:], values[cut:]))
                    key, node, root, sizes, values = key[:end], node[:end], root[:end], sizes[:end], values[:cut]
                if end:
                    group = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)])
                    label = star_links(group, root, Mapped(sizes, values, similar), once)
                    new = root != root[label]  # what has a name already is linked to it
                    yield {"a": root[new], "b": root[label[new]]}

        return work

    return map_rows(dealt, "a bigint, b bigint", make, last=True)


def _with_sets(texts: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """``members``' columns (``node`` and ``places``, an array) with ``shingles``: the table of texts stays where it is."""
    kept = members.columns
    kinds = dict(members.dtypes)

    def make():
        def work(batch):
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield {c: part[c] for c in kept} | {"shingles": [shingle_set(t, shingle).view(np.int64) for t in part["body"].to_pylist()]}

        return work

    schema = ", ".join([f"{c} {kinds[c]}" for c in kept] + ["shingles array<bigint>"])
    return map_rows(texts.join(members, "node").select(*kept, "body"), schema, make)


def _pieces(size: str, rows: str):
    """Into how many pieces what has so many shingles and rows is cut."""
    return F.greatest(F.ceil(F.col(size) / SETS), F.ceil(F.col(rows) / STARS), F.lit(1)).cast("int")


def similar_links(texts: DataFrame, nodes: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """Links ``a, b`` that connect all similar nodes which share a bucket, from ``texts(node, body)`` and ``nodes(node, size, keys)``."""
    up, down = similar
    placed = stash(nodes.select("node", "size", F.explode("keys").alias("bucket")), "minhash-placed")
    counts = stash(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "minhash-buckets")
    total = counts.agg(F.sum("n")).first()[0] or 0
    shared = spread_join(placed, counts.withColumn("m", F.col("n")), "bucket", "n", total)
    shared = stash(shared, "minhash-shared")
    met = shared.groupBy("node").agg(F.sum("m").alias("met"))
    shared = stash(shared.join(met, "node"), "minhash-met")
    centres = shared.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("met"), "node", "size")).alias("c"), F.count("*").alias("n"))
    centred = spread_join(shared.select("bucket", "node", "size"), centres.select("bucket", F.col("c.node").alias("centre"), F.col("c.size").alias("most"), "n"), "bucket", "n", total)
    centred = stash(centred, "minhash-centred")
    fits = down * F.least("size", "most") >= up * F.greatest("size", "most")
    edges = centred.where((F.col("node") != F.col("centre")) & fits).select("node", "size", "centre", "most").distinct()
    edges = stash(edges, "minhash-edges")
    stars = edges.groupBy("centre").agg(F.sum("size").alias("sum"), F.count("*").alias("n")).withColumn("pieces", _pieces("sum", "n"))
    stars = stash(stars.select("centre", "pieces", "n"), "minhash-stars")
    place = lambda shard, piece, other, root, first: F.struct(
        F.col(shard).alias("shard"), piece.alias("piece"), other.alias("other"), F.col(root).alias("root"), F.lit(first).alias("place")
    )
    dealt = spread_join(edges.select("node", "centre"), stars, "centre", "n")
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    members = dealt.select("node", place("centre", own, F.lit(0), "node", 1).alias("p"))
    every = stars.select(F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    every = every.select("node", place("node", F.col("piece"), F.lit(0), "node", 0).alias("p"))
    by_node = lambda rows: rows.groupBy("node").agg(F.collect_list("p").alias("places"))  # noqa: E731  # a few for each bucket of a node
    spread = lambda rows: _with_sets(texts, by_node(rows), shingle).select("node", "shingles", F.inline("places"))
    first = stash(_compared(spread(members.unionByName(every)), True, similar), "minhash-links")

    # what is left: buckets with two texts that are not connected and not the centre
    named = components(first)
    left = centred.where("node <> centre").join(named, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    left = stash(left, "minhash-left")
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "node"), 24)).alias("s"))
    open_ = left.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("apart"), mark.alias("mark"), F.sum("size").alias("sum")).where("apart")
    once = open_.groupBy("mark").agg(F.min("bucket").alias("bucket"), F.first("sum").alias("sum"))  # bands often hold the same texts
    once = stash(once.select("bucket", F.col("mark.n").alias("n"), _pieces("sum", "mark.n").alias("pieces")), "minhash-open")
    dealt = spread_join(left.select("bucket", "node", "root"), once, "bucket", "n", left.count())
    dealt = dealt.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rest = dealt.select("node", place("bucket", F.least("own", "with"), F.greatest("own", "with"), "root", 1).alias("p"))
    return first.unionByName(_compared(spread(rest), False, similar))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similar: tuple[int, int] = (85, 100), text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of each input row.

    Texts are linked whose sets of word shingles (A-Z in lower case; fewer words: the whole sequence) have a Jaccard
    similarity of ``similar`` (a fraction) or more; ``component_id`` is the least key that a row reaches over links. A
    row without words, or without a text, is linked with nothing: its component is its own key. Equal texts are linked,
    repeated rows too. A component whose keys are all null has a null id. ``kept``: the key is the component's, null
    equal to null; rows that repeat that key are all kept.
    """
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("body"), text_hash(text).alias("node"))
    texts = stash_by(named.groupBy("node").agg(F.first("body").alias("body")), "node", "minhash-texts")

    def make():
        def work(batch):
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                sets = [shingle_set(t, shingle) for t in part["body"].to_pylist()]
                yield {"node": part["node"], "size": [len(h) for h in sets], "keys": [bucket_keys(h) for h in sets]}

        return work

    nodes = stash(map_rows(texts, "node bigint, size bigint, keys array<bigint>", make), "minhash-nodes")
    linked = components(similar_links(texts, nodes.where("size > 0"), shingle, similar))
    digest = docs.select(F.col(key).alias("id"), text_hash(text).alias("node"))
    least = digest.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    least = least.join(nodes.select("node", F.col("size").alias("n_shingles")), "node").join(linked, "node", "left")
    least = stash(least.withColumn("root", F.coalesce("root", "node")), "minhash-least")
    ids = least.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("nodes"))
    owner = spread_join(least, ids, "root", "nodes").select("node", "n_shingles", "component", "rows")
    found = spread_join(digest, stash(owner, "minhash-owners"), "node", "rows")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component"))
    return found.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
