"""Distances between two field values as column expressions; all but ``lcs`` run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_HEX = "^(0x)?[0-9A-Fa-f]+$"
_DIGITS = 8  #: hexadecimal digits compared at once, so that a piece fits a signed long


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "^0x", "")


def _piece(value: Column, at: Column) -> Column:
    return F.conv(F.substr(value, at, F.lit(_DIGITS)), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two strings of hexadecimal digits; the shorter is padded with zeros on the left."""
    size = F.greatest(F.length(a), F.length(b), F.lit(1))
    left, right = F.lpad(a, size, "0"), F.lpad(b, size, "0")
    pieces = F.sequence(F.lit(1), size, F.lit(_DIGITS))
    return F.aggregate(pieces, F.lit(0), lambda sum_, i: sum_ + F.bit_count(_piece(left, i).bitwiseXOR(_piece(right, i))))


def bit_share(a: Column, b: Column) -> Column:
    """Differing bits over the bits of ``a``; 1 if either is not a number of hexadecimal digits."""
    valid = a.rlike(_HEX) & b.rlike(_HEX)
    return F.when(valid, hamming(_digits(a), _digits(b)) / (4 * F.length(_digits(a)))).otherwise(1.0)


def hex_bit(a: Column, b: Column, penalty: float = 1.0) -> Column:
    """``bit_share`` of two ``0x`` strings of one length, else the penalty; so too without digits or with others."""
    alike = a.startswith("0x") & b.startswith("0x") & (F.length(a) == F.length(b)) & a.rlike(_HEX) & b.rlike(_HEX)
    return F.when(alike, bit_share(a, b)).otherwise(F.lit(float(penalty)))


def hex_pieces(value: Column) -> Column:
    """The digits of a ``0x`` string, 8 to a number, behind their number; null without digits or with others."""
    digits, n = _digits(value), F.length(value) - 2
    pieces = F.transform(F.sequence(F.lit(1), n, F.lit(_DIGITS)), lambda i: _piece(digits, i))
    return F.when(value.startswith("0x") & value.rlike(_HEX), F.concat(F.array(n.cast("long")), pieces))


def bits_apart(a: Column, b: Column, penalty: float = 1.0) -> Column:
    """``hex_bit`` of two strings by their ``hex_pieces``."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), bits / (4 * F.get(a, F.lit(0)))).otherwise(F.lit(float(penalty)))


def payload_pieces(value: Column) -> Column:
    """The digits of a payload, 8 to a number from the right, behind their number; null if there are none or others."""
    digits = _digits(value)
    n = F.length(digits)
    piece = lambda end: F.conv(F.substr(digits, F.greatest(end - (_DIGITS - 1), F.lit(1)), F.least(end, F.lit(_DIGITS))), 16, 10).cast("long")
    return F.when(value.rlike(_HEX), F.concat(F.array(n.cast("long")), F.transform(F.sequence(n, F.lit(1), F.lit(-_DIGITS)), piece)))


def pieces_share(a: Column, b: Column) -> Column:
    """``bit_share`` of two payloads by their ``payload_pieces``."""
    zero, n = F.lit(0).cast("long"), F.get(a, F.lit(0))
    apart = F.zip_with(a, b, lambda x, y: F.bit_count(F.coalesce(x, zero).bitwiseXOR(F.coalesce(y, zero))))
    bits = F.aggregate(apart, F.lit(0), lambda s, x: s + x) - F.bit_count(n.bitwiseXOR(F.get(b, F.lit(0))))
    return F.coalesce(bits / (4 * n), F.lit(1.0))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _different(a: Column, b: Column) -> Column:
    return F.size(F.array_union(a, b)) - _shared(a, b)


def data_rates(a: Column, b: Column, weight: float = 1.0) -> Column:
    """Values that only one of the two sets has."""
    return _different(a, b) * F.lit(float(weight))


def multiset_difference(a: Column, b: Column) -> Column:
    """Sum over the values of how much their counts in the two lists differ."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_union(a, b), F.lit(0), lambda sum_, v: sum_ + F.abs(times(a, v) - times(b, v)))


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two lists; null where one is null.

    A cell of the usual table is the greatest so far of its row among: one more than above left where the two agree,
    else what is above. So a row is one running maximum, and a pair takes len(a) steps of length len(b).
    """

    def length(x, y) -> int | None:
        if x is None or y is None:
            return None
        names: dict = {}  # a null equals nulls only
        code = np.array([names.setdefault(v, len(names)) for v in (*x, *y)], dtype=np.int64)
        first, second = code[: len(x)], code[len(x) :]
        above = np.zeros(len(second) + 1, dtype=np.int64)
        for c in first:
            above[1:] = np.maximum.accumulate(np.where(second == c, above[:-1] + 1, above[1:]))
        return int(above[-1])

    seen: dict = {}  # lists repeat within a batch

    def once(x, y) -> int | None:
        key = None if x is None or y is None else (tuple(x), tuple(y))
        if key not in seen:
            seen[key] = length(x, y)
        return seen[key]

    return pd.Series([once(x, y) for x, y in zip(a, b)], dtype="Int32")


def ie_list(a: Column, b: Column, weight: float = 1.0) -> Column:
    """Differences in content plus the part of the longer list that is out of order."""
    return (multiset_difference(a, b) + F.greatest(F.size(a), F.size(b)) - lcs(a, b)) * F.lit(float(weight))


def _bits_of_shared(a: Column, b: Column, share: Callable[[Column, Column], Column]) -> Column:
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(keys, F.lit(0.0), lambda sum_, k: sum_ + share(F.element_at(a, k), F.element_at(b, k)))


def ext_tag(a: Column, b: Column, w1: float = 1.0, w2: float = 1.0, w3: float = 1.0, share: Callable[[Column, Column], Column] = bit_share) -> Column:
    """Maps tag -> payload: bits of shared tags, plus other tags, less shared tags; it may be negative. ``share`` compares payloads."""
    ka, kb = F.map_keys(a), F.map_keys(b)
    return _bits_of_shared(a, b, share) * F.lit(float(w2)) + _different(ka, kb) * F.lit(float(w1)) - _shared(ka, kb) * F.lit(float(w3))


def vendor_spec(a: Column, b: Column, w1: float = 1.0, w2: float = 1.0, w3: float = 1.0, share: Callable[[Column, Column], Column] = bit_share) -> Column:
    """Maps vendor -> type -> payload: bits and number of shared types, plus other vendors less shared ones. ``share`` compares payloads."""
    ka, kb = F.map_keys(a), F.map_keys(b)

    def vendor(sum_, k):
        x, y = F.element_at(a, k), F.element_at(b, k)
        return sum_ + _bits_of_shared(x, y, share) * F.lit(float(w2)) + _shared(F.map_keys(x), F.map_keys(y)) * F.lit(float(w3))

    types = F.aggregate(F.array_intersect(ka, kb), F.lit(0.0), vendor)
    return types + (_different(ka, kb) - _shared(ka, kb)) * F.lit(float(w1))


def rssi_time(r1: Column, t1: Column, r2: Column, t2: Column, w1: float, w2: float, w3: float, w4: float) -> Column:
    """Least over all pairs of frames of ``w1^|level| + w3``, plus ``w2`` if they lie more than ``w4`` apart, else less it."""
    frames = lambda r, t: F.zip_with(r, t, lambda x, y: F.struct(x.alias("r"), y.alias("t")))
    return frames_apart(frames(r1, t1), frames(r2, t2), w1, w2, w3, w4)


def frames_apart(own: Column, other: Column, w1: float, w2: float, w3: float, w4: float) -> Column:
    """``rssi_time`` of two lists of frames with ``r`` and ``t``."""

    def pair(x, y):
        apart = F.when(F.abs(x["t"] - y["t"]) > F.lit(float(w4)), F.lit(float(w2))).otherwise(F.lit(-float(w2)))
        return F.pow(F.lit(float(w1)), F.abs(x["r"] - y["r"])) + apart + F.lit(float(w3))

    return F.array_min(F.transform(own, lambda x: F.array_min(F.transform(other, lambda y: pair(x, y)))))
