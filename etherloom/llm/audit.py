"""Source divergence audit: how far the sources of a language differ in the terms that they use.

Sort-based streaming in two scans, each a repartition with a secondary sort. The first is sorted by (lang, term,
source, block of documents): its run lengths are document frequencies and counts, and a run of a term that is in too
few documents leaves nothing. The second is sorted by (lang, part, term, source) behind the totals of the language's
sources: each run of a term adds its share to the divergence of every pair of sources and emits the terms that a
source has above its language. A task holds one run and a bounded matrix of partial pairs, never a language.

Terms of the documents that a task reads are counted there first, so a frequent term is a row for each block and
source, not for each document; a language is dealt over ``ways`` parts by term, so a hot one is many tasks' work.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stash

ENTRIES = 500_000  #: (source, term) counts that a task holds before it emits them
CELLS = 4_000_000  #: partial pairs that a task holds before it emits them
SCALE = 1_000_000_000  #: of a probability
PRIOR = 5  #: added to each count
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of letters A-Z in lower case, a-z and characters beyond ASCII, in UTF-8."""
    return text.encode().translate(_LETTERS).split()


def probability(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) of longs, count <= total, exact: a long division by thousands stays within 64 bits."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """From ``lang, source, text``: ``lang, term, source, block, docs, n``, summed over the documents of a block."""

    def make():
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        part, blocks = TaskContext.get().partitionId(), 0

        def emitted():
            nonlocal blocks
            block, blocks = part << 32 | blocks, blocks + 1
            for (lang, source), (n, within) in held.items():
                m = len(n)
                yield {
                    "lang": pa.repeat(lang, m), "term": list(n), "source": pa.repeat(source, m), "block": np.full(m, block),
                    "docs": [within[t] for t in n], "n": list(n.values()),
                }
            held.clear()

        def work(batch, last=False):
            if last:
                yield from emitted()
                return
            size = sum(len(n) for n, _ in held.values())
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                n, within = held[lang, source]
                before, words = len(n), terms(text)
                n.update(words)
                within.update(set(words))
                size += len(n) - before
                if size >= ENTRIES:
                    yield from emitted()
                    size = 0

        return work

    return map_rows(docs, "lang string, term string, source string, block bigint, docs bigint, n bigint", make, last=True)


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a run of rows that are equal in all the columns begins."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _joined(*batches: pa.RecordBatch | None) -> pa.RecordBatch | None:
    held = [b for b in batches if b is not None and b.num_rows]
    if len(held) < 2:
        return held[0] if held else None
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """``lang, term, source, n, new`` of the terms in at least ``least`` documents of their language; ``new`` is 1 once a term."""
    dealt = counts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")

    def make():
        held = None

        def work(batch, last=False):
            nonlocal held
            rows = _joined(held, batch)
            held = None
            if rows is None:
                return
            runs = _starts(rows["lang"], rows["term"], rows["source"])
            docs, n = (np.add.reduceat(rows[c].to_numpy(), runs) for c in ("docs", "n"))
            first = rows.take(pa.array(runs))
            rows = pa.RecordBatch.from_pydict(
                {c: first[c] for c in ("lang", "term", "source", "block")} | {"docs": docs, "n": n}, schema=rows.schema
            )
            words = _starts(rows["lang"], rows["term"])
            if not last:  # the last term may go on in the next batch; it is carried as one row a source
                held = rows.slice(int(words[-1]))
                rows, words, docs = rows.slice(0, int(words[-1])), words[:-1], docs[: words[-1]]
                if not len(words):
                    return
            stays = np.add.reduceat(docs, words) >= least
            lengths = np.diff(np.r_[words, rows.num_rows])
            new = np.zeros(rows.num_rows, dtype=np.int64)
            new[words] = 1
            mask = np.repeat(stays, lengths)
            found = rows.filter(pa.array(mask))
            yield {"lang": found["lang"], "term": found["term"], "source": found["source"], "n": found["n"], "new": new[mask]}

        return work

    return map_rows(dealt, "lang string, term string, source string, n bigint, new bigint", make, last=True)


class Sources:
    """The sources of a language in UTF-8 order, and the partial pairs of the terms seen: twice what each pair gains
    over a term that neither has, written half to both of its rows where both have the term."""

    def __init__(self, lang: str, names: list[str], totals: list[int], size: int):
        self.lang, self.names, self.size = lang, pa.array(names, pa.string()), size
        self.at = {x: i for i, x in enumerate(names)}
        self.totals = np.array(totals, dtype=np.int64) + PRIOR * size
        self.all = sum(totals) + PRIOR * size
        self.none = probability(np.full(len(names), PRIOR), self.totals) if size else None
        self.room = max(1, CELLS // max(1, len(names)))
        self.slot, self.owner = np.full(len(names), -1), []
        self.cells = np.zeros((min(self.room, len(names)), len(names)), dtype=np.int64)

    def add(self, own: np.ndarray, p: np.ndarray):
        """A term's sources and their probabilities; yields what has to make room."""
        full = self.none.copy()
        full[own] = p
        weight = np.full(len(full), 2)
        weight[own] = 1
        for k in range(0, len(own), self.room):
            part = own[k : k + self.room]
            fresh = part[self.slot[part] < 0]
            if len(self.owner) + len(fresh) > len(self.cells):
                yield from self.pairs()
                fresh = part
            self.slot[fresh] = np.arange(len(self.owner), len(self.owner) + len(fresh))
            self.owner += fresh.tolist()
            gain = np.abs(full[part, None] - full) - np.abs(self.none[part, None] - self.none)
            self.cells[self.slot[part]] += gain * weight

    def pairs(self):
        """The partial pairs held, which are then forgotten."""
        cells = self.cells[: len(self.owner)]
        row, column = np.nonzero(cells)
        if len(row):
            yield {
                "lang": pa.repeat(self.lang, len(row)), "source": self.names.take(pa.array(np.array(self.owner)[row])),
                "part": pa.repeat("pair", len(row)), "item": self.names.take(pa.array(column)), "value": cells[row, column],
            }
        cells[:] = 0
        self.slot[self.owner] = -1
        self.owner = []


def partials(kept: DataFrame, totals: DataFrame, ways: int) -> DataFrame:
    """``lang, source, part, item, value``: partial pairs (in doubles, see ``Sources``) and the terms of a source above its language.

    ``totals``: ``lang, source, total, size``, the occurrences of kept terms in each source and their number in its language.
    """
    part = F.pmod(F.xxhash64("term"), F.lit(ways)).cast("int").alias("way")
    every = F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("way")
    rows = totals.select("lang", every, F.lit(0).alias("kind"), F.lit("").alias("term"), "source", F.col("total").alias("n"), "size").unionByName(
        kept.select("lang", part, F.lit(1).alias("kind"), "term", "source", "n", F.lit(0).cast("long").alias("size"))
    )
    dealt = rows.repartition("lang", "way").sortWithinPartitions("lang", "way", "kind", "term", "source")

    def make():
        held, now, heads, key = None, None, [], None

        def ended():
            nonlocal now
            if now is not None:
                yield from now.pairs()
            now = None

        def work(batch, last=False):
            nonlocal held, now, heads, key
            rows = _joined(held, batch)
            held = None
            bounds = np.r_[_starts(rows["lang"], rows["way"]), rows.num_rows].tolist() if rows is not None else [0]
            for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
                segment = rows.slice(low, high - low)
                name = segment["lang"][0].as_py(), segment["way"][0].as_py()
                if name != key:
                    yield from ended()
                    key, heads = name, []
                m = int(np.searchsorted(segment["kind"].to_numpy(), 1))
                if m:
                    heads += zip(*(segment[c][:m].to_pylist() for c in ("source", "n", "size")))
                words = segment.slice(m)
                if not words.num_rows:
                    continue
                if now is None:
                    now = Sources(name[0], [h[0] for h in heads], [h[1] for h in heads], heads[0][2])
                runs = _starts(words["term"])
                if k == len(bounds) - 2 and not last:  # this term may go on in the next batch
                    held = words.slice(int(runs[-1]))
                    words, runs = words.slice(0, int(runs[-1])), runs[:-1]
                if len(runs):
                    yield from scanned(words, runs)
            if last:
                yield from ended()

        def scanned(words, runs):
            n = words["n"].to_numpy()
            own = np.array([now.at[s] for s in words["source"].to_pylist()])
            p = probability(n + PRIOR, now.totals[own])
            ends = np.r_[runs[1:], len(n)]
            q = np.repeat(probability(np.add.reduceat(n, runs) + PRIOR, now.all), ends - runs)
            for low, high in zip(runs.tolist(), ends.tolist()):
                yield from now.add(own[low:high], p[low:high])
            over = np.flatnonzero(p > q)
            m, at = len(over), pa.array(over)
            if m:
                yield {
                    "lang": pa.repeat(now.lang, m), "source": words["source"].take(at), "part": pa.repeat("term", m),
                    "item": words["term"].take(at), "value": (p - q)[over],
                }

        return work

    return map_rows(dealt, "lang string, source string, part string, item string, value bigint", make, last=True)


def source_divergence(
    docs: DataFrame, least: int = 30, top: int = 50, ways: int = 64, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each (language, source) of ``docs``.

    Part ``pair``: every other source of the language by the sum of |p - q| over the language's terms that are in at
    least ``least`` of its documents. Part ``term``: the ``top`` terms by p - q above the whole language. p is
    1 + floor(SCALE * (count + 5) / (N + 5 V)), all in integers. Ranks go by falling value, then by item in UTF-8.

    A row is a document, so repeated rows count again. Null text, language and source are ''. A source without terms has
    its pairs; a language without kept terms has pairs of value 0, one with a single source has none; no rows give none.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    groups = read.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    kept = stash(kept_terms(term_counts(read), least), "audit-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("new").alias("new"))
    sums = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("new", F.lit(0)).alias("new"))
    size = F.sum("new").over(Window.partitionBy("lang")).alias("size")
    totals = stash(sums.select("lang", "source", "total", size), "audit-totals")
    found = stash(partials(kept, totals, ways), "audit-partials")

    halves = found.where("part = 'pair'")
    halves = halves.select("lang", "source", "item", "value").unionByName(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    gains = halves.groupBy("lang", "source", "item").agg(F.sum("value").alias("twice"))
    none = F.when(F.col("size") == 0, 0).otherwise(F.expr(f"1 + ({SCALE}L * {PRIOR} div (total + {PRIOR} * greatest(size, 1)))"))
    one = totals.select("lang", "source", "size", none.alias("p"))
    pairs = one.join(one.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), "lang").where("source <> item")
    value = (F.col("size") * F.abs(F.col("p") - F.col("q")) + F.expr("coalesce(twice, 0) div 2")).cast("long").alias("value")
    pairs = pairs.join(gains, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    above = found.where("part = 'term'").select("*", ranked).where(F.col("rank") <= top)
    return pairs.select("*", ranked).unionByName(above)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
size AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT x.lang, x.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source
), l AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p
  FROM g JOIN size USING (lang) JOIN kept USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v))::HUGEINT AS q
  FROM c JOIN l USING (lang) JOIN size USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), above AS (
  SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM above
  ) WHERE rank <= 50
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""
