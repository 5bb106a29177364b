"""Benchmark decontamination by spaced seeds.

A fixed mask picks some positions of a run of tokens and ignores the others, so a hit survives substitutions at
the ignored ones. Test and training hashes of every mask are joined; the overlap around each hit is then verified
token by token on its diagonal, substitutions allowed.

A phrase that many items share, such as the frame of a question, is no overlap by itself if it is short. So a seed of
more than FEW items is not joined as it is, but with the tokens at both ends of each span of LEAST and up to REACH more
tokens around it: items and documents that share nothing but the phrase never meet, whatever their numbers.

Training positions pass a Bloom filter of the test hashes first, so only documents that may overlap go on, with their
text, to the join and the verification. The filter grows with the benchmark, up to MOST_BITS; a benchmark beyond that
makes it let more documents through, and the result is the same.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, WordKeys, fresh, map_rows, null_safe, spread_join, stash, text_hash

MASKS = ("110110011", "1010110101", "1110010011", "1001101011")  #: fixed masks; 1 counts, 0 is ignored
LEAST = 13  #: tokens of an overlap, or the whole item if it is shorter
MISMATCH = 3  #: matches that pay for one substitution: at least 3 in 4 tokens of an overlap agree
FILTER = 64  #: bits of the filter for each seed of the benchmark: one position in 2 million passes by chance
MOST_BITS = 30  #: its size at most, as a power of two: 128 MB, for 16 million seeds (4 million tokens of benchmark)
WORDS = 1 << 17  #: token hashes that a task remembers
FEW = 8  #: items that a seed is joined with as it is
REACH = 3  #: an overlap contains one of LEAST to LEAST + REACH tokens from a match to a match around a seed, or others of its seeds do
SIDE = 7  #: tokens kept on each side of a seed
ITEMS = 64  #: items whose texts a row holds
TOGETHER = 1 << 16  #: tokens looked up at once, or one document
_TOKENS = re.compile(r"\w+").findall
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def tokens(text: str | None) -> list[str]:
    return _TOKENS((text or "").lower())


def spaced(keys: np.ndarray, mask: str) -> np.ndarray:
    """Hash at each position of the tokens that the mask picks."""
    n = len(keys) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, len(mask) ^ int(mask, 2) << 8, dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(BASE)
            out += keys[i : i + n]
    return out ^ out >> np.uint64(29)


def masks_for(lengths: list[int]) -> tuple[str, ...]:
    """MASKS, and for each length of an item too short for them, whole-item masks that ignore any fourth of it."""
    short = sorted({n for n in lengths if 0 < n < min(map(len, MASKS))})
    own = ["".join("0" if i in gone else "1" for i in range(n)) for n in short for gone in combinations(range(n), n // 4)]
    return MASKS + tuple(own)


def _short_lengths(items: DataFrame) -> list[int]:
    """Token numbers of the items that are shorter than every mask: a few small numbers."""
    least = min(map(len, MASKS))

    def make():
        def work(batch):
            yield {"n": sorted({n for t in batch["text"].to_pylist() if 0 < (n := len(tokens(t))) < least})}

        return work

    return [r["n"] for r in map_rows(items.select("text"), "n int", make).distinct().collect()]


def filter_bits(seeds: int) -> int:
    """Size of the filter as a power of two."""
    return min(MOST_BITS, max(16, (FILTER * seeds - 1).bit_length()))


def _slot(seeds: np.ndarray, k: int, bits: int) -> np.ndarray:
    return seeds * np.uint64(_MIX[k]) >> np.uint64(64 - bits)


def _around(keys: np.ndarray, at: np.ndarray, size: int, low, high) -> np.ndarray:
    """Of each position: 32 bits of the SIDE tokens before it and of those behind its ``size`` tokens; 0 beyond low or high."""
    out = np.zeros((len(at), 2 * SIDE), dtype=np.int32)
    if len(keys):
        for k in range(1, SIDE + 1):
            for column, place in ((k - 1, at - k), (SIDE + k - 1, at + size - 1 + k)):
                inside = (place >= low) & (place < high)
                token = (keys[np.clip(place, 0, len(keys) - 1)] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                out[:, column] = np.where(inside, np.where(token == 0, 1, token), 0)
    return out


def seed_table(texts: DataFrame, key: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """``key, seed, pos, size, short, around``: every position of every mask; a mask of a short length only of items of that length.

    ``size`` is the mask's length, ``short`` says that the item has fewer than LEAST tokens.
    """
    kind = dict(texts.dtypes)[key]

    def make():
        hashes = WordKeys(limit=WORDS)

        def work(batch):
            for k, t in zip(batch[key].to_pylist(), batch["text"].to_pylist(), strict=True):
                a = hashes.array(tokens(t))
                for mask in masks:
                    if mask not in MASKS and len(mask) != len(a):
                        continue
                    s = spaced(a, mask)
                    at = np.arange(len(s))
                    yield {
                        key: [k] * len(s), "seed": s.view(np.int64), "pos": at.astype(np.int32), "size": np.full(len(s), len(mask), np.int32),
                        "short": np.full(len(s), len(a) < LEAST), "around": list(_around(a, at, len(mask), 0, len(a))),
                    }

        return work

    return map_rows(texts.select(key, "text"), f"`{key}` {kind}, seed bigint, pos int, size int, short boolean, around array<int>", make)


def _bloom(seeds: DataFrame) -> np.ndarray:
    """The filter, made in Spark: at most 2**(MOST_BITS - 6) longs come to the driver, for any benchmark."""
    bits = filter_bits(seeds.count())

    def make():
        def work(batch):
            s = batch["seed"].to_numpy().view(np.uint64)
            yield {"slot": np.unique(np.concatenate([_slot(s, k, bits).astype(np.int64) for k in range(len(_MIX))]))}

        return work

    slots = map_rows(seeds.select("seed"), "slot bigint", make)
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")
    )
    found = words.toArrow()
    table = np.zeros(1 << bits - 6, dtype=np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def candidates(docs: DataFrame, bloom: np.ndarray, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """``doc, doc_id, text, seeds, places, sizes, around`` of the documents (``doc, doc_id, text``) of which some position passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)  # 2**MOST_BITS bits at most
    bits = 5 + len(bloom).bit_length()

    def make():
        hashes, table = WordKeys(limit=WORDS), shared.value

        def passed(seeds):
            at = np.arange(len(seeds))
            for k in range(len(_MIX)):
                slot = _slot(seeds[at], k, bits)
                at = at[table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0]
            return at

        def work(batch):
            ids, texts = list(zip(batch["doc"].to_pylist(), batch["doc_id"].to_pylist())), batch["text"].to_pylist()
            held: list[np.ndarray] = []  # token hashes of consecutive documents, looked up together
            first = 0
            for k, t in enumerate(texts):
                held.append(hashes.array(tokens(t)))
                if k + 1 == len(texts) or sum(map(len, held[-64:])) >= TOGETHER or len(held) == 64:
                    yield looked_up(ids[first : k + 1], texts[first : k + 1], held)
                    first, held = k + 1, []

        def looked_up(ids, texts, held):
            ends = np.cumsum([len(a) for a in held])
            every = np.concatenate(held)
            found: dict[int, tuple[list, list, list, list]] = {}
            for mask in masks:
                s = spaced(every, mask)
                at = passed(s)
                doc = np.searchsorted(ends, at, "right")
                inside = at + len(mask) <= ends[doc] if len(at) else doc > 0  # not across the end of a document
                at, doc = at[inside], doc[inside]
                starts = ends[doc] - [len(held[d]) for d in doc.tolist()] if len(doc) else doc
                sides = _around(every, at, len(mask), starts, ends[doc] if len(doc) else doc)
                for d, seed, place, side in zip(doc.tolist(), s[at].view(np.int64).tolist(), (at - starts).tolist(), sides.tolist()):
                    seeds, places, sizes, around = found.setdefault(d, ([], [], [], []))
                    seeds.append(seed)
                    places.append(place)
                    sizes.append(len(mask))
                    around.extend(side)
            own = sorted(found)
            lists = {n: [found[d][k] for d in own] for k, n in enumerate(("seeds", "places", "sizes", "around"))}
            return {"doc": [ids[d][0] for d in own], "doc_id": [ids[d][1] for d in own], "text": [texts[d] for d in own], **lists}

        return work

    schema = "doc bigint, doc_id bigint, text string, seeds array<bigint>, places array<int>, sizes array<int>, around array<int>"
    return map_rows(docs.select("doc", "doc_id", "text"), schema, make)


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matches, first, last + 1 in the item) of the best run on the diagonal: +1 a match, -MISMATCH a substitution.

    If that is no overlap, the whole item if 3 in 4 agree, or else the longest run from a match to a match of which they do.
    """
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = doc[low + diagonal : high + diagonal] == item[low:high]
    total = np.r_[0, np.cumsum(np.where(same, 1, -MISMATCH))]
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    begin = int(np.flatnonzero(total[: end + 1] == total[: end + 1].min())[-1])
    if end - begin < min(LEAST, len(item)):
        if len(same) == len(item) and total[-1] >= 0:
            begin, end = 0, len(item)
        elif len(same) >= LEAST and same.any():
            starts, ends = np.flatnonzero(same), np.flatnonzero(same) + 1
            most = np.maximum.accumulate(total[ends][::-1])  # from each end on, the last one first
            last = len(ends) - 1 - np.searchsorted(most, total[starts], "left")  # a single match always does
            k = int((ends[last] - starts).argmax())
            begin, end = int(starts[k]), int(ends[last[k]])
    return int(same[begin:end].sum()), low + begin, low + end


def _counted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``, where many documents may have a passage or an item."""
    n = stash(left.groupBy(key).agg(F.count("*").alias("n")), "counts")
    return spread_join(left, null_safe(right, n, key, how="inner"), key, "n", n.agg(F.sum("n")).first()[0] or 0)


def _spans(rows: DataFrame) -> DataFrame:
    """``rows`` once for each span of LEAST to LEAST + REACH tokens around the seed, with the hash of seed, span and its end tokens as ``key``."""

    def keys(size: int):
        found = []
        for left in range(LEAST + REACH - size + 1):
            for right in range(max(0, LEAST - size - left), LEAST + REACH - size - left + 1):
                a, b = F.col("around")[left - 1] if left else F.lit(1), F.col("around")[SIDE + right - 1] if right else F.lit(1)
                found.append(F.when((a != 0) & (b != 0), F.xxhash64("seed", F.lit(left), a, F.lit(right), b)))
        return F.array(*found)

    every = F.lit(None).cast("array<bigint>")
    for size in sorted({len(m) for m in MASKS}):
        every = F.when(F.col("size") == size, keys(size)).otherwise(every)
    return rows.withColumn("key", F.explode(F.array_compact(every))).drop("seed", "size", "around")


def candidate_pairs(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """``doc, item, diagonals``: where a document may overlap an item, from ``candidates`` and the items' ``seed_table``."""
    each = found.select("doc", F.posexplode(F.arrays_zip("seeds", "places", "sizes")).alias("k", "x"), "around")
    around = F.slice("around", F.col("k") * (2 * SIDE) + 1, 2 * SIDE).alias("around")
    each = stash(each.select("doc", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"), F.col("x.sizes").alias("size"), around), "places")
    long = seeds.where("NOT short")
    many = stash(long.groupBy("seed").agg(F.count("*").alias("items")).where(F.col("items") > FEW).select("seed"), "many")
    few = long.join(many, "seed", "left_anti").unionByName(seeds.where("short"))
    there = each.groupBy("seed").agg(F.count("*").alias("n")).join(many, "seed")
    hot = _spans(spread_join(each, there, "seed", "n"))
    spans = _spans(long.join(many, "seed")).select("key", "item", "pos")
    met = [_counted(each.select("doc", "seed", "place"), few.select("seed", "item", "pos"), "seed"), _counted(hot.select("doc", "key", "place"), spans, "key")]
    rows = [x.select("doc", "item", (F.col("place") - F.col("pos")).alias("diagonal")) for x in met]
    pairs = rows[0].unionByName(rows[1]).distinct().groupBy("doc", "item")
    return pairs.agg(F.collect_list("diagonal").alias("diagonals"))  # as many as the two are long at most


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps, the best of each pair: ``doc_id, item_id, n_matched, n_overlap, n_item, doc_start, item_start``.

    Tokens are runs of word characters in lower case. An overlap has LEAST tokens and at least 3 in 4 agree, from a match
    to a match or over the whole item, which may be shorter. Items of fewer tokens than the shortest mask have masks of their own, which miss none;
    null and empty texts give none. Rows that repeat an id count as one id with the texts of all of them; a null id is an id.
    """
    name = F.xxhash64("item_id", "text").alias("item")  # ids may be null or repeat
    items = benchmark.where(F.col("text").isNotNull()).select(name, "item_id", "text").dropDuplicates(["item"])
    masks = masks_for(_short_lengths(items))
    seeds = stash(seed_table(items, "item", masks), "seeds")
    named = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stash(candidates(named, _bloom(seeds), masks), "candidates")
    texts = found.select("doc", "doc_id", "text").dropDuplicates(["doc"])
    pairs = stash(candidate_pairs(found, seeds), "pairs")
    # the texts of at most about ITEMS items go together to a document that they may be in
    rows = F.pmod(F.xxhash64("item"), F.ceil(F.col("items") / ITEMS)).alias("row")
    of_doc = pairs.groupBy("doc").agg(F.count("*").alias("items"))
    wanted = _counted(pairs.join(of_doc, "doc").select("doc", "item", "diagonals", rows), items, "item")
    wanted = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("item_id", "diagonals", "text")).alias("hits"))

    def make():
        hashes = WordKeys(limit=WORDS)

        def work(batch):
            names = ("doc_id", "item_id", "n_matched", "n_overlap", "n_item", "doc_start", "item_start")
            out: dict[str, list] = {n: [] for n in names}
            for d, t, hits in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "hits")), strict=True):
                a, best = hashes.array(tokens(t)), {}
                for h in hits:
                    b = hashes.array(tokens(h["text"]))
                    for diagonal in h["diagonals"]:
                        n, i, j = best_overlap(a, b, diagonal)
                        if j - i >= min(LEAST, len(b)):
                            row = (n, j - i, len(b), i + diagonal, i)
                            best[h["item_id"]] = max(best.get(h["item_id"], row), row)
                for item, row in best.items():
                    for c, x in zip(names, (d, item, *row), strict=True):
                        out[c].append(x)
            yield out

        return work

    schema = "doc_id bigint, item_id bigint, n_matched bigint, n_overlap bigint, n_item bigint, doc_start bigint, item_start bigint"
    verified = map_rows(texts.join(wanted, "doc").select("doc_id", "text", "hits"), schema, make)
    columns = F.struct("n_matched", "n_overlap", "n_item", "doc_start", "item_start")
    return verified.groupBy("doc_id", "item_id").agg(F.max(columns).alias("x")).select("doc_id", "item_id", "x.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents whose text overlaps a benchmark item; columns as given.

    Texts are judged by their hash, so a document stays whatever others that share its id, or have none, contain; null
    and empty texts stay, and repeated rows stay or go together.
    """
    texts = docs.select(text_hash("text").alias("doc_id"), "text")
    name = fresh("__bad", docs)
    bad = stash(contaminated(texts, benchmark).select(F.col("doc_id").alias(name)).distinct(), "contaminated")  # its size is known to the join
    return docs.join(bad, text_hash("text") == F.col(name), "left_anti")
