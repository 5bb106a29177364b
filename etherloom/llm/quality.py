"""Quality rules: measures of each text, and lines that too many documents of a host share.

One pass over the texts leaves a small digest of each document (its counts, the hashes of its normalised lines
and the words in each). Distinct documents are counted for each line and host; the words in lines above the
limits are taken off, and a document that is depleted by that is rejected. Lines above the limits, of which a large
host may have any number, meet the documents in a join by host and line, spread where a line is hot.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import xxhash

from .common import covered, map_rows, rolling, spread_join, stash, WordKeys
from .lines import line_counts

WINDOW = 8  #: words of the windows that show repetition inside a text
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(rb"[0-9]+")


def measures(text: str, keys: WordKeys) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line keys, words of those lines."""
    raw = text.encode()
    words = raw.split()  # bytes.split() cuts at space and U+0009 to U+000D, nothing else
    joined = b"".join(words)
    tails = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0))))  # bytes that only continue a code point
    lines = [x for x in raw.split(b"\n") if x.strip()] if words else []
    windows = rolling(keys.array(words), WINDOW)
    _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[back] > 1)
    normal = [_DIGITS.sub(b"0", b" ".join(x.split()).lower()) for x in lines]
    return (
        len(words),
        len(joined) - tails,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        int(covered(again, WINDOW, len(words)).sum()) if len(again) else 0,
        [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in normal],
        [x.count(b" ") + 1 for x in normal],
    )


DIGEST = (
    "doc_id bigint, host string, page bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, lines array<bigint>, line_words array<int>"
)


def line_rules(
    docs: DataFrame, host: str = "source", share: float = 0.05, least: int = 20, most: int = 10_000, depleted: float = 0.5
) -> DataFrame:
    """One row a document: ``doc_id, n_words``, the four base measures, ``base_failed, kept, n_line_words_removed``.

    A line (case, runs of white space and digits levelled) goes if ``most`` distinct documents of the host have it, or
    ``least`` and more than ``share`` of them; exact copies are one document. A document is depleted if less than
    ``1 - depleted`` of its words remain; ``kept`` is false for it and where ``base_failed``. A null or empty text
    has no words and fails; a null host is a host of its own; each repeated row gives its own row.
    """

    def make():
        keys = WordKeys()

        def work(batch):
            found = [measures(t or "", keys) for t in batch["text"].to_pylist()]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words")
            columns = dict(zip(names, zip(*found), strict=True)) if found else {n: [] for n in names}
            yield columns | {c: batch[c] for c in ("doc_id", "host", "page")}

        return work

    source = docs.select("doc_id", F.col(host).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("page"), "text")
    digest = stash(map_rows(source, DIGEST, make), "quality")
    hashed = F.xxhash64("host", "page").alias("copy")  # a host and a page as one key, the null host too
    pages = digest.groupBy("host", "page").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"), F.count("*").alias("rows"))
    pages = stash(pages.withColumn("copy", hashed), "quality-pages")
    counts = line_counts(pages.select("host", "page", F.array_distinct("lines").alias("keys")))
    limit = (F.col("n") >= most) | (F.col("n") >= least) & (F.col("n") > share * F.col("pages"))
    place = F.xxhash64("host", "line").alias("place")
    each = pages.select("copy", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("y"))
    each = each.select("copy", "host", F.col("y.lines").alias("line"), F.col("y.line_words").alias("words")).select("copy", place, "words")
    gone = spread_join(each, counts.where(limit).select(place, "n"), "place", "n").groupBy("copy").agg(F.sum("words").alias("gone"))
    removed = pages.select("copy", "rows").join(gone, "copy", "left").withColumn("gone", F.coalesce("gone", F.lit(0).cast("long")))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return spread_join(digest.select(*names, hashed), removed, "copy", "rows").select(
        *names,
        failed.alias("base_failed"),
        (~failed & (F.col("gone") <= depleted * F.col("n_words"))).alias("kept"),
        F.col("gone").alias("n_line_words_removed"),
    )
