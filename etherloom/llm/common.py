"""What the operators of this subpackage share: reading, lineage cuts, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etherloom.sources.storage import scratch, shared_dir, stash, stash_by

__all__ = ["scratch", "shared_dir", "stash", "stash_by"]

WORD = 1_048_576  #: entries a worker's word cache may hold before it is emptied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOT, WAYS = 1000, 64


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """Inner join on ``key``; ``right`` has the number of ``left``'s rows with its key in ``count``, which is dropped, and, if
    no ``total`` is given, one row a key.

    A key with more than one in HOT of ``left``'s rows, ``total`` in all, is hot. There are fewer than HOT of them, so their names may be
    sent to all tasks; a hot key's rows are then spread over WAYS keys, and its row of ``right`` is repeated for each.
    """
    if total is None:
        right = stash(right, "spread")
        total = right.agg(F.sum(count)).first()[0] or 0
    name, at = fresh("__hot", left, right), fresh("__way", left, right)
    hot = right.where(F.col(count) * HOT > total).select(F.col(key).alias(name)).distinct()
    marked = left.join(F.broadcast(hot), F.col(key) == F.col(name), "left")
    hashed = [F.col(f"`{c}`") for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]  # maps have no hash
    way = F.when(F.col(name).isNotNull(), F.pmod(F.xxhash64(*hashed), F.lit(WAYS)).cast("int")).otherwise(0)
    marked = marked.withColumn(at, way).drop(name)
    ways = F.when(F.col(count) * HOT > total, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(right.withColumn(at, F.explode(ways)).drop(count), [key, at]).drop(at)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name


def null_safe(left: DataFrame, right: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null; the right side's keys are dropped."""
    names = {k: fresh(f"__{k}", left, right) for k in keys}
    renamed = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[n]) for k, n in names.items()]
    joined = left.join(renamed, on, how)
    return joined.drop(*names.values())


def text_hash(text: str) -> Column:
    """Identity of a text where keys may be null or repeat; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class WordKeys(dict):
    """word -> 64-bit hash, filled as words come and emptied at ``limit`` entries, so a worker's memory is bounded."""

    def __init__(self, seed: int = 0, limit: int = WORD):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        self[word] = key = xxhash.xxh3_64_intdigest(word, self.seed)
        return key

    def array(self, words: list) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15  #: odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def rolling(keys: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` consecutive word keys, by prefix sums: the cost does not depend on ``size``."""
    n = len(keys)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(keys * powers(BASE, n), out=sums[1:])
    return (sums[size:] - sums[:-size]) * powers(INVERSE, n - size + 1)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``size`` words that begins at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[dict]]], last: bool = False
) -> DataFrame:
    """``mapInArrow`` where ``make()`` runs once in each task and gives the function from a batch to dicts of columns.

    With ``last``, the function is called once more after a task's batches, as ``work(None, last=True)``.
    """
    arrow = arrow_schema(schema)

    def run(batches):
        work = make()

        def made():
            for batch in batches:
                yield from work(batch)
            if last:
                yield from work(None, last=True)

        for columns in made():
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
