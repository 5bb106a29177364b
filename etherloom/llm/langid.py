"""Language ID: scripts narrow the candidates, then Viterbi over word scores with a penalty for each switch.

A word's score for a language is the sum of the log probabilities of its letter n-grams, less the best language's,
and not under -CAP. Viterbi labels every word; a run of one label is a span of the text. Most texts are of one
language: where no stretch gains half a penalty by any other language, the constant path is optimal and the
recursion is skipped.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

CAP = 5.0  #: most that one word says against a language
SWITCH = 20.0  #: penalty of a switch: a span needs about five clear words
GRAMS = 20_000  #: n-grams of each language in the model, the most frequent
SAMPLE = 2_000  #: labelled documents of each language to fit on, expected number; all of a rarer one
SMOOTH = 0.01  #: share of the pooled n-grams in each language's
CACHE = 400_000  #: words a worker keeps scores of
_LETTERS = re.compile(r"[^\W\d_]+").findall  # and some numbers that are no digits
UNKNOWN = "und"

# First and last code point of the scripts told apart.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3134F)],
}


def script(word: str) -> str:
    """Script of the first letter; 'Other' if it is in none of the ranges."""
    c = ord(word[0])
    return next((s for s, ranges in SCRIPTS.items() for a, b in ranges if a <= c <= b), "Other")


def letters(text: str | None) -> list[str]:
    found = _LETTERS((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str) -> list[str]:
    """Runs of one to three characters of the word between two marks."""
    w = f"<{word}>"
    n = len(w)
    return [w[i : i + 3] for i in range(n - 2)] + [w[i : i + 2] for i in range(n - 1)] + list(word)


def fit(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> dict:
    """Model from rows with a non-null ``lang``: n-gram counts of about ``sample`` documents of each, taken by a hash of the text.

    Counting is distributed: each task sums what it has read, then the sums meet by n-gram. A language keeps its own
    GRAMS n-grams, however rare it is beside others; scripts are counted apart. No row: a model without languages.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = rows.groupBy("lang").count().collect()  # reads no text; a row a language, as many as the model has
    limit = [F.lit(x) for r in n for x in (r["lang"], int(min(1, sample / r["count"]) * (1 << 30)))]
    limit = F.try_element_at(F.create_map(*limit), F.col("lang")) if n else F.lit(0)
    rows = rows.where(F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 30)) < limit)
    rows = rows.where(F.col("text").isNotNull()).select("lang", "text")

    def make():
        def work(batch):
            words: dict[str, Counter] = {}
            for g, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words.setdefault(g, Counter()).update(letters(t))
            count = {g: Counter() for g in words}
            for g, distinct in words.items():
                c = count[g]
                for w, k in distinct.items():
                    for x in grams(w):
                        c[x] += k
                    c["\x00" + script(w)] += k
            flat = [(g, x, k) for g, c in count.items() for x, k in c.items()]
            yield {"lang": [x[0] for x in flat], "gram": [x[1] for x in flat], "n": [x[2] for x in flat]}

        return work

    counts = map_rows(rows, "lang string, gram string, n bigint", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    marks = F.col("gram").startswith("\x00")
    best = F.row_number().over(Window.partitionBy("lang", marks).orderBy(F.desc("n"), "gram"))
    table, scripts, total = {}, {}, Counter()
    for row in counts.withColumn("at", best).where(F.col("at") <= GRAMS).collect():  # GRAMS and the scripts of each language
        (scripts if row["gram"][0] == "\x00" else table).setdefault(row["gram"], {})[row["lang"]] = row["n"]
        total[row["lang"]] += row["n"] * (row["gram"][0] == "\x00")
    names = sorted(total)
    of = lambda d: np.array([d[x].get(g, 0) for x in sorted(d) for g in names], dtype=float).reshape(len(d), len(names))
    share = of(table) / np.maximum(of(table).sum(axis=0), 1)
    share = (1 - SMOOTH) * share + SMOOTH * share.mean(axis=1, keepdims=True) if names else share
    used = {mark[1:]: np.array([d.get(g, 0) > 0.01 * total[g] for g in names]) for mark, d in scripts.items()}
    return {"langs": names, "grams": {g: i for i, g in enumerate(sorted(table))}, "logs": np.log(share), "scripts": used}


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each row of ``scores``; ties go to the first label, and to staying."""
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    if k == 1:
        return np.zeros(n, dtype=int)
    gains = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gains[1:])
    if (gains - np.minimum.accumulate(gains, axis=0)).max() <= switch / 2:
        return np.full(n, best)
    # Blocks of equal length run side by side: first from every label a block may be entered with, then, once the
    # values at the block borders are known, with back pointers. Rows of zeros fill the last block and change nothing.
    length = max(16, int(n**0.5))
    blocks = -(-n // length)
    steps = np.zeros((length, blocks, k))
    padded = np.zeros((blocks * length, k))
    padded[:n] = scores
    steps[:] = padded.reshape(blocks, length, k).swapaxes(0, 1)
    through = np.tile(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (blocks, 1, 1))
    for row in steps:
        through = np.maximum(through, through.max(axis=2, keepdims=True) - switch) + row[:, None, :]
    value = np.zeros((blocks, k))
    for b in range(1, blocks):
        value[b] = (value[b - 1][:, None] + through[b - 1]).max(axis=0)
    labels = np.arange(k)
    come = np.empty((length, blocks, k), dtype=np.int64)
    for t, row in enumerate(steps):
        floor = value.max(axis=1, keepdims=True) - switch
        come[t] = np.where(value >= floor, labels, value.argmax(axis=1)[:, None])
        value = np.maximum(value, floor) + row
    ends = np.empty((length, blocks, k), dtype=np.int64)  # label of each word, for each label that its block may end with
    at = np.tile(labels, (blocks, 1))
    for t in range(length - 1, -1, -1):
        ends[t] = at
        at = np.take_along_axis(come[t], at, axis=1)
    path = np.empty((blocks, length), dtype=np.int64)
    last = int(value[-1].argmax())
    for b in range(blocks - 1, -1, -1):
        path[b] = ends[:, b, last]
        last = int(at[b, last])
    return path.reshape(-1)[:n]


class Scorer:
    """Word scores of a model, kept for the words seen, in a table that is emptied at CACHE words."""

    SLICE = 4096  #: new words scored at once, which bounds the n-grams held

    def __init__(self, model: dict):
        self.langs, self.grams, self.scripts = model["langs"], model["grams"], model["scripts"]
        self.logs = np.vstack([model["logs"], np.zeros((1, len(self.langs)))])  # last: no n-gram
        self.seen: dict[str, int] = {}
        self.table = np.empty((1 << 14, len(self.langs)))

    def _learn(self, words: list[str]) -> None:
        """Score new words together: their n-grams lie in one array, a word's share of it is summed."""
        n, get, none = len(self.seen), self.grams.get, len(self.logs) - 1
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        flat, starts = [], []
        for w in words:
            starts.append(len(flat))
            flat.append(none)
            flat += [i for g in grams(w) if (i := get(g)) is not None]
        score = np.add.reduceat(self.logs[flat], starts)
        by_script: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            by_script.setdefault(script(w), []).append(i)
        for name, rows in by_script.items():
            use = self.scripts.get(name)
            if use is not None and use.any():
                score[np.ix_(rows, ~use)] = -np.inf
        self.table[n : n + len(words)] = np.maximum(score - score.max(axis=1, keepdims=True), -CAP)
        self.seen.update(zip(words, range(n, n + len(words))))

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen.clear()
        at = list(map(self.seen.get, words))
        if None in at:
            new = [w for w in dict.fromkeys(words) if w not in self.seen]
            for i in range(0, len(new), self.SLICE):
                self._learn(new[i : i + self.SLICE])
            at = list(map(self.seen.get, words))
        return self.table[at]

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """(language of most letters, their share, spans as (first word, words, language)); no letter: und, 0, none."""
        words = letters(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0, []
        path = viterbi(self.scores(words))
        size = np.bincount(path, weights=np.fromiter(map(len, words), float, len(words)), minlength=len(self.langs))
        best = int(size.argmax())
        cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        spans = [(int(a), int(b - a), self.langs[path[a]]) for a, b in zip(cut, [*cut[1:], len(path)])]
        return self.langs[best], float(size[best] / size.sum()), spans


def identify(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score, spans`` of each input row; spans are (first_word, n_words, lang) over runs of letters.

    A null text and one without a letter are ``und`` with score 0 and no spans; so is everything if the model has no
    language. Repeated rows each give a row. Whole texts are labelled, whatever their length.
    """
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS rows a language at most

    def make():
        scorer = Scorer(shared.value)

        def work(batch):
            found = [scorer.label(t) for t in batch[text].to_pylist()]
            spans = [[{"first_word": a, "n_words": n, "lang": g} for a, n, g in x[2]] for x in found]
            yield {key: batch[key], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "spans": spans}

        return work

    schema = f"`{key}` {kind}, lang_pred string, score double, spans array<struct<first_word:int,n_words:int,lang:string>>"
    return map_rows(docs.select(key, text), schema, make)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def fit_documents(docs: DataFrame) -> dict:
    """The model of ``documents``: rows whose crc32(doc_id) modulo 4 is 2 are never learnt from."""
    return fit(docs.where(~held_out()).select("text", "lang"))


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that are ``und`` or of which less than ``least`` is in one language; columns as given.

    A null text and one without a letter go, and so does every row if the model has no language; repeated rows stay or
    go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make_rows(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.label(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(_mask([x[0] != UNKNOWN and x[1] >= least for x in found]))

    return docs.mapInArrow(make_rows, docs.schema)


def _mask(values: list[bool]):
    import pyarrow as pa

    return pa.array(values, type=pa.bool_())
