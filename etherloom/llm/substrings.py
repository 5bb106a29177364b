"""Exact substring dedup behind a count-min prefilter.

Documents are dealt by hash into chunks of a few megabytes, once; every pass works on a chunk.

A window of WINDOW words is counted by its minimizer, the run of ANCHOR words inside it with the least hash (the first
of equals). Equal windows have it at the same place in them, so a minimizer is never counted less often than a window
that it stands for, and a sixth of the numbers is enough. First pass: each chunk counts the minimizers of its windows
in a count-min sketch and emits it as the cells it touched. The sketch is cut into slices by the minimizer's hash, of a
fixed load each however large the corpus; a slice merges the chunks' sketches and answers each chunk with one bit for
each of its cells: repeated or not. Counts never fall short, so no repeated window is lost. Neither the sketch nor the
answers pass through the driver or through all tasks, and nothing changes with the size of the corpus but the number and
the size of slices and chunks (``loads``).

Second pass: windows estimated repeated, and only they, are grouped exactly, by 128 bits of hash (of the minimizer and
of the window), to find where each begins first. Windows of one minimizer travel as one row, and of equal windows in a
chunk only the first, so a passage in a third of all documents is one row a chunk. What a document loses is then: its
windows estimated repeated, less those that are the first of their words.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, powers

WINDOW = 20
ANCHOR = 12  #: words of a minimizer
CHUNK = 4 << 20  #: bytes of text in a chunk, on average, up to GROWS bytes of text; both grow with the square root beyond
SLICE = 1 << 19  #: minimizers in a slice, on average
GROWS = 64 << 30
MOST = 32  #: times CHUNK and SLICE at most: 128 MB, and 128 MB of cells; reached at 64 TB
DEPTH, CELLS = 2, 8  #: rows of the sketch, cells of a row for each minimizer: one in 70 single ones is taken for repeated
BLOCK = 1 << 20  #: bytes hashed at once
SEGMENT = 1 << 17  #: windows hashed at once
NULL = -(1 << 63)  #: stands for a null key
PIECES = "slice int, chunk int, n0 int, cells0 binary, n1 int, cells1 binary"
ANSWERS = "chunk int, slice int, bits0 binary, bits1 binary"
FOUND = "anchor bigint, doc bigint, place bigint, pos int, whole array<bigint>"
KEPT = "doc bigint, n_words bigint, n_removed bigint, kept string"
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_ROWS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Hashes:
    """64-bit hashes of runs of words, from prefix sums over the bytes; two kinds that are independent of one another."""

    def __init__(self):
        self.letter = [np.array([xxhash.xxh64_intdigest(bytes([b]), k) for b in range(256)], dtype=np.uint64) for k in (1, 2)]
        self.up = [powers(b, BLOCK) for b in _BASES]
        self.down = [powers(pow(b, -1, 1 << 64), BLOCK) for b in _BASES]

    def prefixes(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int):
        """Of each word: the sum of the bytes before its start and before its end, and what shifts a run from its start to 0."""
        first, size = int(starts[0]), int(ends[-1] - starts[0])
        s, e = starts - first, ends - first
        at_start, at_end, shift = (np.empty(len(s), dtype=np.uint64) for _ in range(3))
        so_far = np.uint64(0)
        for low in range(0, size, BLOCK):
            part = self.letter[kind][text[first + low : first + min(low + BLOCK, size)]]
            part *= self.up[kind][: len(part)]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part, out=sums[1:])
            sums *= np.uint64(pow(_BASES[kind], low, 1 << 64))
            sums += so_far
            i, j = np.searchsorted(s, (low, low + BLOCK))
            at_start[i:j] = sums[s[i:j] - low]
            shift[i:j] = self.down[kind][s[i:j] - low] * np.uint64(pow(_BASES[kind], -low, 1 << 64))
            i, j = np.searchsorted(e, (low, low + BLOCK), "right")
            at_end[i:j] = sums[e[i:j] - low]
            so_far = sums[-1]
        return at_start, at_end, shift

    @staticmethod
    def runs(prefixes, size: int) -> np.ndarray:
        at_start, at_end, shift = prefixes
        n = len(at_start) - size + 1
        h = (at_end[size - 1 :] - at_start[:n]) * shift[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_ROWS[0])
        return h ^ h >> np.uint64(29)


_HASHES: list[Hashes] = []


def hashes() -> Hashes:
    """One a worker process, however many tasks it runs."""
    if not _HASHES:
        _HASHES.append(Hashes())
    return _HASHES[0]


def least(g: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` neighbours, the first of equals."""
    value, at, have = g, np.zeros(len(g), dtype=np.int8), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:] + np.int8(step), at[:-step])
        value, have = np.where(right, value[step:], value[:-step]), have + step
    return np.arange(len(value)) + at


class Words:
    """The words of some texts, one after the other: ``text`` has a space after each, text k has words upto[k] to upto[k + 1] - 1."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        space = raw == 32
        space |= (raw - np.uint8(9)) < 5
        keep = ~space
        keep[1:] |= keep[:-1]  # and the first space after each word
        self.text = raw[keep]
        ends = space[keep]
        self.text[ends] = 32
        self.ends = np.flatnonzero(ends)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        borders = np.cumsum([len(t) + 1 for t in texts])
        self.upto = np.r_[0, np.searchsorted(np.flatnonzero(space & keep), borders)]

    def windows(self, full: bool):
        """start, minimizer's word, its hash, and if ``full`` the window's hash, of each window; starts ascend, and so do minimizers."""
        h, n = hashes(), len(self.ends)
        last = np.repeat(self.upto[1:], np.diff(self.upto)) - WINDOW  # last start of a window in the word's text
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))]
        for low in range(0, n - WINDOW + 1, SEGMENT):
            to = min(n, low + SEGMENT + WINDOW - 1)
            starts, ends = self.starts[low:to], self.ends[low:to]
            anchors = h.runs(h.prefixes(self.text, starts, ends, 0), ANCHOR)
            at = least(anchors, WINDOW - ANCHOR + 1)
            own = np.flatnonzero(np.arange(low, low + len(at)) <= last[low : low + len(at)])
            at = at[own]
            whole = h.runs(h.prefixes(self.text, starts, ends, 1), WINDOW)[own] if full else at[:0].astype(np.uint64)
            found.append((own + low, at + low, anchors[at], whole))
        return tuple(np.concatenate(x) for x in zip(*found))

    def without(self, removed: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Of each text: the number of words removed, and the others joined by one space."""
        stay = ~removed
        text = self.text[np.repeat(stay, self.ends - self.starts + 1)] if removed.any() else self.text
        size = np.r_[0, np.cumsum((self.ends - self.starts + 1) * stay)][self.upto]
        gone = np.diff(np.r_[0, np.cumsum(removed)][self.upto])
        raw = text.tobytes()
        return gone.tolist(), [raw[a : b - 1] if b > a else b"" for a, b in zip(size[:-1].tolist(), size[1:].tolist())]


class Chunk:
    """The rows of a chunk in the order of (key, hash of the text); equal rows are one text of ``words``."""

    def __init__(self, rows: pa.Table):
        doc, tag = (rows[c].to_numpy() for c in ("doc", "tag"))
        order = np.lexsort((tag, doc))
        new = np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(tag[order]) != 0)] if len(order) else np.empty(0, bool)
        self.of_row = np.empty(len(order), dtype=np.int64)
        self.of_row[order] = np.cumsum(new) - 1
        self.rows, once = doc, order[new]
        self.doc = doc[once]
        texts = rows["text"].combine_chunks().cast(pa.binary()).take(pa.array(once)).to_pylist()
        self.words = Words([t or b"" for t in texts])


def loads(size: int) -> tuple[int, int, int, int]:
    """Bytes of a chunk, minimizers of a slice, and the numbers of both, for so many bytes of text.

    Chunks and slices exchange a row each. Both sizes grow with the square root of the text, so the rows grow with the
    text and not with its square, until a chunk or a slice is what a task can hold.
    """
    times = min(MOST, max(1, size / GROWS) ** 0.5)
    chunk, load = int(CHUNK * times), int(SLICE * times)
    return chunk, load, 1 + size // chunk, 1 + size // (30 * load)  # a minimizer for five words of six bytes


def _cells(anchors: np.ndarray, row: int, slices: int, load: int) -> np.ndarray:
    """slice * (cells of a slice) + cell, of a row of the sketch."""
    part = (anchors >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    cell = ((anchors * np.uint64(_ROWS[row])) >> np.uint64(32)) * np.uint64(load * CELLS) >> np.uint64(32)
    return part * np.uint64(load * CELLS) + cell


def _packed(cell: np.ndarray, again: np.ndarray) -> bytes:
    """Sorted cells as differences, byte by byte of the number, and a bit for those counted twice or more."""
    gaps = np.diff(cell.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(again).tobytes(), 1)


def _unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
    gaps = np.ascontiguousarray(data[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(gaps, dtype=np.uint32), np.unpackbits(data[4 * n :], count=n) > 0


def chunk_sketch(chunk: int, anchors: np.ndarray, slices: int, load: int | None = None) -> dict[str, list]:
    """The chunk's sketch: a row for each slice that it touches, with n0, n1 cells."""
    size, out = np.uint64((load or SLICE) * CELLS), {}
    for row in range(DEPTH):
        key, times = np.unique(_cells(anchors, row, slices, load or SLICE), return_counts=True)
        used, begins = np.unique(key // size, return_index=True)  # the same slices in each row
        edges = list(zip(begins, [*begins[1:], len(key)]))
        out |= {f"n{row}": [b - a for a, b in edges], f"cells{row}": [_packed(key[a:b] % size, times[a:b] > 1) for a, b in edges]}
    return {"slice": used.astype(np.int32), "chunk": [chunk] * len(used), **out}


def merged_slice(pieces: pa.Table, load: int | None = None) -> dict[str, list]:
    """The chunks' sketches of a slice added up; each chunk's answer is a bit for each of its cells."""
    out: dict[str, list] = {c: pieces[c].to_pylist() for c in ("chunk", "slice")}
    for row in range(DEPTH):
        count = np.zeros((load or SLICE) * CELLS, dtype=np.uint8)
        sizes, packed = pieces[f"n{row}"].to_pylist(), pieces[f"cells{row}"]
        for n, raw in zip(sizes, packed):
            cell, again = _unpacked(raw.as_py(), n)
            count[cell] = np.minimum(count[cell] + 1 + again, 2)
        out[f"bits{row}"] = [np.packbits(count[_unpacked(raw.as_py(), n)[0]] > 1).tobytes() for n, raw in zip(sizes, packed)]
    return out


def repeated(anchors: np.ndarray, answers: pa.Table, slices: int, load: int | None = None) -> np.ndarray:
    """Which of the chunk's minimizers are estimated to occur twice or more: every row of the sketch must say so."""
    answers = answers.sort_by("slice")
    yes = np.ones(len(anchors), dtype=bool)
    for row in range(DEPTH):
        key, back = np.unique(_cells(anchors, row, slices, load or SLICE), return_inverse=True)
        sizes = np.unique(key // np.uint64((load or SLICE) * CELLS), return_counts=True)[1]
        bits = [np.unpackbits(np.frombuffer(raw.as_py(), dtype=np.uint8), count=n) for raw, n in zip(answers[f"bits{row}"], sizes)]
        if bits:
            yes &= np.concatenate(bits)[back] > 0
    return yes


def _estimated(chunk: Chunk, answers: pa.Table, slices: int, load: int, full: bool):
    """start, minimizer's word, hashes of the windows estimated repeated."""
    start, at, anchor, whole = chunk.words.windows(full)
    if not len(start):
        return start, at, anchor, whole
    new = np.r_[True, at[1:] != at[:-1]]
    yes = repeated(anchor[new], answers, slices, load)[np.cumsum(new) - 1]
    return start[yes], at[yes], anchor[yes], whole[yes] if full else whole


def candidates(k: int, rows: pa.Table, answers: pa.Table, slices: int, load: int) -> dict[str, list]:
    """Windows estimated repeated, of equal ones in the chunk the first; neighbours with one minimizer are one row."""
    chunk = Chunk(rows)
    start, at, anchor, whole = _estimated(chunk, answers, slices, load, True)
    order = np.argsort(whole, kind="stable")
    same = (np.diff(whole[order].view(np.int64)) == 0) & (np.diff(anchor[order].view(np.int64)) == 0)
    first = np.sort(order[np.r_[True, ~same]]) if len(order) else order
    start, at, anchor, whole = start[first], at[first], anchor[first], whole[first]
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(start) != 1)]) if len(start) else first
    text = np.searchsorted(chunk.words.upto, start[new], "right") - 1
    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(start)].astype(np.int32)), pa.array(whole.view(np.int64))) if len(new) else []
    return {
        "anchor": anchor[new].view(np.int64), "doc": chunk.doc[text], "place": (k << 32) + text,
        "pos": (start[new] - chunk.words.upto[text]).astype(np.int32), "whole": lists,
    }


def _first_of(anchor, whole, doc, place, pos):
    """Of each window the least (doc, place, pos)."""
    order = np.lexsort((pos, place, doc, whole, anchor))
    a, w = anchor[order], whole[order]
    order = order[np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]]
    return anchor[order], whole[order], doc[order], place[order], pos[order]


def first_windows(found: DataFrame) -> DataFrame:
    """``chunk, firsts``: where windows begin first, as triples of 32-bit numbers (text, first window, windows)."""
    dealt = found.repartition("anchor").sortWithinPartitions("anchor")

    def make():
        held: list = []  # the windows of the last minimizer, which may go on: the first of each only

        def runs(place, pos):
            order = np.lexsort((pos, place))
            place, pos = place[order], pos[order]
            new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(pos) != 1)])
            n = np.diff(np.r_[new, len(pos)])
            chunk, triples = place[new] >> 32, np.stack([place[new] & 0xFFFFFFFF, pos[new], n], 1).astype(np.int32)
            cut = np.r_[np.flatnonzero(np.r_[True, np.diff(chunk) != 0]), len(chunk)]
            return {"chunk": chunk[cut[:-1]], "firsts": [triples[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]}

        def work(batch, last=False):
            if not last:
                size = batch["whole"].value_lengths().to_numpy().astype(np.int64)
                anchor, doc, place, pos = (np.repeat(batch[c].to_numpy(), size) for c in ("anchor", "doc", "place", "pos"))
                inside = np.arange(len(pos)) - np.repeat(np.cumsum(size) - size, size)
                new = (anchor, batch["whole"].flatten().to_numpy(), doc, place, pos + inside)
                new = tuple(map(np.concatenate, zip(*held, new))) if held else new
                held.clear()
                if not len(new[0]):
                    return
                new = _first_of(*new)
                going = new[0] == new[0][-1]  # sorted by minimizer: these may go on
                held.append(tuple(x[going] for x in new))
                done = [x[~going] for x in new[3:]]
            else:
                done = held.pop()[3:] if held else ()
            if done and len(done[0]):
                yield runs(*done)

        return work

    return map_rows(dealt, "chunk int, firsts binary", make, last=True)


def kept_rows(rows: pa.Table, told: pa.Table, slices: int, load: int, digest: bool) -> dict[str, list]:
    """The chunk's rows with what they keep; ``told`` has its answers and where windows begin first."""
    chunk = Chunk(rows)
    words = chunk.words
    start = _estimated(chunk, told.filter(told["slice"].is_valid()), slices, load, False)[0]
    edge = np.zeros(len(words.ends) + 1, dtype=np.int64)
    lost = np.zeros(len(words.ends), dtype=bool)
    lost[start] = True
    for raw in told["firsts"]:
        if raw.is_valid:
            text, pos, n = np.frombuffer(raw.as_py(), dtype=np.int32).reshape(-1, 3).T.astype(np.int64)
            at = np.repeat(words.upto[text] + pos - np.cumsum(n) + n, n) + np.arange(n.sum())
            lost[at] = False
    at = np.flatnonzero(lost)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    gone, kept = words.without(np.cumsum(edge[:-1]) > 0)
    kept = [sha256(x).hexdigest() if digest else x.decode() for x in kept]
    total = np.diff(words.upto)
    return {
        "doc": chunk.rows, "n_words": total[chunk.of_row], "n_removed": np.array(gone, dtype=np.int64)[chunk.of_row],
        "kept": [kept[k] for k in chunk.of_row.tolist()],
    }


def _table(columns: dict, form: pa.Schema) -> pa.Table:
    made = [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in form]
    return pa.Table.from_arrays(made, schema=form)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """Take off every word of a window of WINDOW words that also begins earlier.

    Earlier is in a smaller ``key``, or in the same document at an earlier word; windows are those of the input.
    Returns ``key, n_words, n_removed, kept`` with the words that stay joined by one space, or ``kept_sha256`` of
    them with ``digest``, for each input row. Null and empty texts have no words; texts below WINDOW words lose none.
    Identical rows are one place: none of them is earlier than the other, and each keeps its words. Rows that share a
    key but not the text are ordered by hash. A null key is earlier than any other.
    """
    place = F.coalesce(F.col(key).cast("long"), F.lit(NULL))
    rows = docs.select(place.alias("doc"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    _, load, chunks, slices = loads(size)
    tag = F.xxhash64("text")
    dealt = rows.select("doc", tag.alias("tag"), "text", F.pmod(F.xxhash64("doc", "text"), F.lit(chunks)).cast("int").alias("chunk"))

    of_pieces, of_answers, of_found, of_kept = map(arrow_schema, (PIECES, ANSWERS, FOUND, KEPT))

    def sketch(key, rows):
        _, at, anchor, _ = Chunk(rows).words.windows(False)
        anchor = anchor[np.r_[True, at[1:] != at[:-1]]] if len(at) else anchor
        return _table(chunk_sketch(key[0].as_py(), anchor, slices, load), of_pieces)

    def merge(pieces):
        return _table(merged_slice(pieces, load), of_answers)

    def second(key, rows, answers):
        return _table(candidates(key[0].as_py(), rows, answers, slices, load), of_found)

    def last(rows, told):
        return _table(kept_rows(rows, told, slices, load, digest), of_kept)

    pieces = dealt.groupBy("chunk").applyInArrow(sketch, PIECES)
    answers = pieces.groupBy("slice").applyInArrow(merge, ANSWERS)
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(second, FOUND)
    told = answers.unionByName(first_windows(found), allowMissingColumns=True)
    # all three passes read the same shuffle of the texts, which Spark keeps
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(last, KEPT)
    return out.select(F.nullif("doc", F.lit(NULL)).alias(key), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digest else "kept"))
