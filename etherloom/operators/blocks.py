"""Unit distances of two blocks of profiles at once, as arrays: what a task does with the blocks that meet in it.

A profile is the JSON text of its values, taken apart by ``matrix.taken_apart``. Texts that repeat are compared once; the
values of the others go in slices, so that what is held is bounded however many values a profile has. The distances are
those of ``matrix.unit_distance``, null as NaN.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute

CELLS = 2000  #: values of a side compared at once
LISTED = 250_000  #: pairs of lists put in order at once


def _apart(a: list, b: list) -> np.ndarray:
    """Differing bits of rows of numbers below 2^32; a shorter row goes on with zeros."""
    words = max((len(x) for x in (*a, *b)), default=0)
    x, y = (np.array([[*r, *[0] * (words - len(r))] for r in rows], dtype=np.uint32).reshape(len(rows), words) for rows in (a, b))
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(words):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _known(rows: list) -> np.ndarray:
    return np.flatnonzero([x is not None for x in rows])


def _shares(a: list, b: list) -> np.ndarray:
    """``distance.pieces_share`` of all pairs: differing bits over those of the first side, 1 if either is no number."""
    out, x, y = np.ones((len(a), len(b))), _known(a), _known(b)
    if len(x) and len(y):
        n = np.array([a[i][0] for i in x], dtype=float)
        out[np.ix_(x, y)] = _apart([a[i][1:] for i in x], [b[i][1:] for i in y]) / (4 * n[:, None])
    return out


def _places(rows: Sequence) -> dict:
    """Where each key stands: key -> rows of it, and what these have for it."""
    at: dict = defaultdict(lambda: ([], []))
    for i, row in enumerate(rows):
        for k, v in row.items():
            at[k][0].append(i)
            at[k][1].append(v)
    return at


def _met(a: Sequence, b: Sequence, of: Callable) -> np.ndarray:
    """Sum over the keys that both sides of a pair have of ``of(values there, values here)``."""
    out, here, there = np.zeros((len(a), len(b))), _places(a), _places(b)
    for k in here.keys() & there.keys():
        (i, v), (j, w) = here[k], there[k]
        out[np.ix_(i, j)] += of(v, w)
    return out


def _one(v: list, w: list) -> float:
    return 1.0


def _bits(a: list, b: list, spec) -> np.ndarray:
    out, x, y = np.full((len(a), len(b)), float(spec.penalty)), _known(a), _known(b)
    if len(x) and len(y):
        n, m = (np.array([r[i][0] for i in k]) for r, k in ((a, x), (b, y)))
        share = _apart([a[i][1:] for i in x], [b[i][1:] for i in y]) / (4 * n[:, None])
        out[np.ix_(x, y)] = np.where(n[:, None] == m[None, :], share, float(spec.penalty))
    return out


def _lost(out: np.ndarray, a: list, b: list) -> np.ndarray:
    """Null where either side is."""
    out[[x is None for x in a], :] = np.nan
    out[:, [x is None for x in b]] = np.nan
    return out


def _sizes(rows: Sequence) -> np.ndarray:
    return np.array([len(x) for x in rows], dtype=float)


def _tags(a: list, b: list, spec) -> np.ndarray:
    w1, w2, w3 = spec.weights
    x, y = [r or {} for r in a], [r or {} for r in b]
    shared = _met(x, y, _one)
    other = _sizes(x)[:, None] + _sizes(y)[None, :] - 2 * shared
    return _lost(_met(x, y, _shares) * w2 + other * w1 - shared * w3, a, b)


def _vendors(a: list, b: list, spec) -> np.ndarray:
    w1, w2, w3 = spec.weights
    x, y = [r or {} for r in a], [r or {} for r in b]
    flat = lambda rows: [{(u, k): p for u, types in r.items() for k, p in (types or {}).items()} for r in rows]
    shared, types = _met(x, y, _one), _met(flat(x), flat(y), lambda v, w: _shares(v, w) * w2 + w3)
    out = types + (_sizes(x)[:, None] + _sizes(y)[None, :] - 3 * shared) * w1
    void = _met(x, y, lambda v, w: np.array([t is None for t in v])[:, None] | np.array([t is None for t in w])[None, :])
    return _lost(np.where(void > 0, np.nan, out), a, b)


def _frames(a: list, b: list, spec) -> np.ndarray:
    w1, w2, w3, w4 = spec.weights
    (r, t), (s, u) = (tuple(np.array([np.nan if (f or {}).get(c) is None else float(f[c]) for f in rows]) for c in "rt") for rows in (a, b))
    return np.power(w1, np.abs(r[:, None] - s[None, :])) + np.where(np.abs(t[:, None] - u[None, :]) > w4, w2, -w2) + w3


#: kind -> what an entry is compared by, the distances of all pairs of entries, and how those of two profiles become one
ENTRIES = {
    "hex_bit": ("bits", _bits, np.add), "ext_tag": ("tags", _tags, np.add), "vendor_spec": ("vendors", _vendors, np.add), "rssi_time": ("frame", _frames, np.fmin),
}


def _by_entries(a: list, b: list, spec) -> np.ndarray:
    """Of profiles that have values: the mean over all pairs of these, or the least."""
    name, cells, fold = ENTRIES[spec.kind]
    mean = fold is np.add
    out = np.zeros((len(a), len(b))) if mean else np.full((len(a), len(b)), np.nan)
    (of_a, xs), (of_b, ys) = ((np.repeat(np.arange(len(side)), [len(x) for x in side]), [e for x in side for e in x]) for side in (a, b))
    for i in range(0, len(xs), CELLS):
        for j in range(0, len(ys), CELLS):
            x, y, p, q = xs[i : i + CELLS], ys[j : j + CELLS], of_a[i : i + CELLS], of_b[j : j + CELLS]
            part = cells([e.get(name) for e in x], [e.get(name) for e in y], spec)
            if mean:
                part = part * np.array([e["n"] for e in x], dtype=float)[:, None] * np.array([e["n"] for e in y], dtype=float)[None, :]
            rows, columns = (np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) for k in (p, q))
            at = np.ix_(p[rows], q[columns])
            out[at] = fold(out[at], fold.reduceat(fold.reduceat(part, rows, axis=0), columns, axis=1))
    times = [np.array([sum(e["n"] for e in x) for x in side], dtype=float) for side in (a, b)]
    return out / (times[0][:, None] * times[1][None, :]) if mean else out


def _counts(rows: list) -> list[dict]:
    found = []
    for r in rows:
        found.append({})
        for e in r:
            found[-1][e["v"]] = found[-1].get(e["v"], 0) + 1
    return found


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of all pairs of rows of codes, -1 and -2 behind their ends."""
    above = np.zeros((b.shape[1] + 1, len(a), len(b)), dtype=np.int32)
    for i in range(a.shape[1]):
        left = np.zeros((len(a), len(b)), dtype=np.int32)
        corner = above[0]
        for j in range(b.shape[1]):
            left = np.maximum(left, np.where(a[:, i, None] == b[None, :, j], corner + 1, above[j + 1]))
            corner = above[j + 1].copy()
            above[j + 1] = left
    return above[-1]


def _lists(a: list, b: list, spec) -> np.ndarray:
    x, y = _counts(a), _counts(b)
    both = _met(x, y, lambda v, w: np.minimum(np.array(v)[:, None], np.array(w)[None, :]))
    n, m = _sizes(a), _sizes(b)
    names: dict = {}
    codes = lambda rows, end, size: np.array([[*[names.setdefault(e["v"], len(names)) for e in r], *[end] * (size - len(r))] for r in rows]).reshape(len(rows), size)
    p, q = codes(a, -1, int(n.max(initial=0))), codes(b, -2, int(m.max(initial=0)))
    step = max(1, LISTED // max(1, len(b)))
    order = [_in_order(p[k : k + step], q) for k in range(0, len(p), step)]
    return n[:, None] + m[None, :] - 2 * both + np.maximum(n[:, None], m[None, :]) - np.concatenate(order)


def _rates(a: list, b: list, spec) -> np.ndarray:
    x, y = _counts(a), _counts(b)
    return _sizes(x)[:, None] + _sizes(y)[None, :] - 2 * _met(x, y, _one)


def _unit(a: list, b: list, spec, missing: float) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    x, y = (np.array([len(r) > 0 for r in side], dtype=bool) for side in (a, b))
    out[x[:, None] != y[None, :]] = missing
    i, j = np.flatnonzero(x), np.flatnonzero(y)
    if len(i) and len(j):
        of = {"ie_list": _lists, "data_rates": _rates}.get(spec.kind, _by_entries)
        out[np.ix_(i, j)] = of([a[k] for k in i], [b[k] for k in j], spec)
    return out


def unit(a: Sequence[str | None], b: Sequence[str | None], spec, missing: float) -> np.ndarray:
    """``matrix.unit_distance`` of all pairs of texts of a field, from the side of ``a``; NaN where either has no row for it."""
    sides = []
    for texts in (a, b):
        at: dict = {}
        where = np.array([at.setdefault(t, len(at)) for t in texts], dtype=np.int64)
        sides.append((where, [[] if t is None else json.loads(t) for t in at], [t is None for t in at]))
    (i, x, none), (j, y, other) = sides
    found = _unit(x, y, spec, missing)
    found[none, :] = np.nan
    found[:, other] = np.nan
    return found if len(x) == len(a) and len(y) == len(b) else found[i][:, j]


def rounded(x: np.ndarray, places: int | None) -> np.ndarray:
    """As Spark rounds: halves go away from zero."""
    if places is None:
        return x
    return np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places, x) + 0.0


def in_pairs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table, pa.Table]]:
    """Of rows sorted by ``keys``, which end in the blocks ``p`` and ``q``: the keys, the rows of the one block and those of the other.

    ``second`` tells those of the other block; a block that meets itself is there once.
    """

    def made(held: list) -> tuple:
        table = pa.Table.from_batches(held)
        key = tuple(table.column(k)[0].as_py() for k in keys)
        if key[-1] == key[-2]:
            return key, table, table
        second = table.column("second")
        return key, table.filter(pa.compute.invert(second)), table.filter(second)

    held: list = []
    last = None
    for batch in batches:
        rows = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]))
        cuts = [0, *[k for k in range(1, len(rows)) if rows[k] != rows[k - 1]], len(rows)]
        for at, end in zip(cuts, cuts[1:]):
            if at == end:
                continue
            if held and rows[at] != last:
                yield made(held)
                held = []
            last = rows[at]
            held.append(batch.slice(at, end - at))
    if held:
        yield made(held)
