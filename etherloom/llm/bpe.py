"""BPE encoding and decoding with a published vocabulary.

A word's symbols form a doubly linked list; a priority queue holds (merge rank, position) of the
pairs seen so far. The lowest rank is taken first; an entry whose pair has changed since it was
queued is stale and skipped. Decoding concatenates the vocabulary strings of the ids.

White space separates words for good in this vocabulary's pre-tokenizer, so a worker keeps the
result of each distinct space-free chunk in a bounded cache.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame

from .common import map_rows

CHUNKS, PIECES = 500_000, 200_000  #: results of chunks and of word pieces a worker remembers before it starts anew (about 250 MB)
_LOW = (1 << 32) - 1
#: White space as Unicode has it; str.split() would also cut at U+001C to U+001F.
_SPACE = re.compile("[\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (``tokenizers`` JSON of a BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        self.rank, self.merged = {}, []
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 20 | vocab[right]] = r
            self.merged.append(vocab[left + right])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.mark_start = tuple({s[:2] for s in self.special})
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.most = CHUNKS

    def merge(self, s: list[int]) -> list[int]:
        n, rank, merged = len(s), self.rank.get, self.merged
        if n < 2:
            return s
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(s[i] << 20 | s[i + 1])) is not None]
        if not queue:
            return s
        heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            i, r = entry & _LOW, entry >> 32
            j = after[i]
            if j < 0 or s[i] < 0 or rank(s[i] << 20 | s[j]) != r:
                continue  # stale
            s[i], s[j] = new, gone = merged[r], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (q := rank(new << 20 | s[k])) is not None:
                    heappush(queue, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := rank(s[h] << 20 | new)) is not None:
                heappush(queue, q << 32 | h)
        return [x for x in s if x >= 0]

    def word(self, piece: str) -> list[int]:
        if (found := self.words.get(piece)) is None:
            if len(self.words) >= PIECES:
                self.words.clear()
            raw = piece.encode()
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            self.words[piece] = found = self.merge(symbols)
        return found

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for part in self.marks.split(chunk) if any(m in chunk for m in self.mark_start) else (chunk,):
            if (mark := self.special.get(part)) is not None:
                ids.append(mark)
            elif part:
                # lower-casing is by character: no final sigma
                text = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for piece in self.pieces(text):
                    ids += self.word(piece)
        return ids

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the decoded strings of a chunk, each joined by a space."""
        if (found := self.chunks.get(chunk)) is None:
            if len(self.chunks) >= self.most:
                self.chunks.clear()
            ids = self.chunk_ids(chunk)
            found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            if len(chunk) < 100:
                self.chunks[chunk] = found
        return found

    def split(self, text: str) -> list[str]:
        return text.split() if not _SEPARATORS.search(text) else [x for x in _SPACE.split(text) if x]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.split(text) for i in self.chunk_ids(c)]

    def decode(self, ids) -> str:
        """The file names no decoder: vocabulary strings, one space between them."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by a space, decoded text) of a whole text, from the chunk cache."""
        found = [x for x in map(self.chunk, self.split(text)) if x[0]]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


_OPEN: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a worker process, however many tasks it runs."""
    if path not in _OPEN:
        _OPEN[path] = Codec(path)
    return _OPEN[path]


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids array<int>`` of every whole text, a row for each row, repeated ones too; null counts as empty, an empty text has no ids."""
    kind = dict(df.dtypes)[key]

    def make():
        c = codec(vocabulary)

        def work(batch):
            yield {key: batch[key], "ids": [c.encode(t or "") for t in batch[text].to_pylist()]}

        return work

    return map_rows(df.select(key, text), f"`{key}` {kind}, ids array<int>", make)


def decode_documents(df: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key, decoded string``, a row for each row, repeated ones too; null ids count as none."""
    kind = dict(df.dtypes)[key]

    def make():
        c = codec(vocabulary)

        def work(batch):
            yield {key: batch[key], "decoded": [c.decode(x or ()) for x in batch[ids].to_pylist()]}

        return work

    return map_rows(df.select(key, ids), f"`{key}` {kind}, decoded string", make)


def digest_documents(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", chunks: int = CHUNKS) -> DataFrame:
    """Encode, decode and digest each whole text in one pass: ``key, n_tokens, ids_sha256, decoded_sha256``.

    One row for each input row, repeated ids included. A null text counts as empty: no tokens, digests of the
    empty string. Texts of any length are handled whole; a chunk of 100 characters or more is not cached, and a worker
    remembers at most ``chunks`` others.
    """
    from hashlib import sha256

    kind = dict(df.dtypes)[key]

    def make():
        c = codec(vocabulary)
        c.most = chunks

        def work(batch):
            n, ids, dec = [], [], []
            for t in batch[text].to_pylist():
                count, i, d = c.digest(t or "")
                n.append(count)
                ids.append(sha256(i.encode()).hexdigest())
                dec.append(sha256(d.encode()).hexdigest())
            yield {key: batch[key], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": dec}

        return work

    return map_rows(df.select(key, text), f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
