"""Embedding whitening: principal components of all vectors by MLlib's computeSVD, and each vector in their units.

The rows of the decomposition are the distinct vectors, centred by their exact mean; a singular value s of n such rows
is an eigenvalue s * s / n of the covariance. The share of a component is taken of the total variance, which comes from
the exact squared deviations of the rows and not from the decomposition. Only numbers of the vectors' own dimension
reach the driver: sums, the d x d matrix inside computeSVD, and the components.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stash

GRID = 256  #: whole steps of a vector's entry
ZERO = 1e-12  #: of the largest eigenvalue: a component below has no variance but rounding
_SAFE = 1 << 61


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sum of each dimension."""

    def make():
        def work(batch):
            x = _matrix(batch["x"], d)
            exact = x if np.abs(x.astype(np.float64)).max(initial=0) * len(x) < _SAFE else x.astype(object)
            yield {"pos": np.arange(d), "total": [Decimal(int(t)) for t in exact.sum(axis=0)]}

        return work

    rows = map_rows(fit, "pos int, total decimal(38,0)", make).groupBy("pos").agg(F.sum("total").alias("total")).collect()
    found = {r["pos"]: int(r["total"]) for r in rows}
    return [found[k] for k in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    most = max(np.abs(x.astype(np.float64)).max(initial=0) * n, max(map(abs, sums), default=0))
    if most < _SAFE:
        return (n * x - np.array(sums, dtype=np.int64)) / n
    return (n * x.astype(object) - np.array(sums, dtype=object)).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n x - S)^2 in whole numbers of any size: n n x.x - 2 n x.S + S.S."""
    most, d = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, x.shape[1]
    exact = x if most * most * d < _SAFE and most * sum(map(abs, sums)) < _SAFE else x.astype(object)
    own, cross = (exact * exact).sum(axis=1), (exact * np.array(sums, dtype=exact.dtype)).sum(axis=1)
    every = sum(s * s for s in sums)
    return [n * n * int(a) - 2 * n * int(b) + every for a, b in zip(own, cross)]


def _principal(fit: DataFrame, n: int, sums: list[int], components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and components (d x k) of the rows' covariance, those without variance left out."""
    d = len(sums)

    def make():
        def work(batch):
            v = centred(_matrix(batch["x"], d), n, sums)
            yield {"v": pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * d, v.ravel())}

        return work

    rows = map_rows(fit, "v array<double>", make).select(array_to_vector("v").alias("v"))
    # all of the d components: the Gramian is then made in one pass and decomposed to double precision
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v")).computeSVD(d, computeU=False)
    e = svd.s.toArray() ** 2 / n
    k = min(components, int((e > ZERO * e[0]).sum()))
    return e[:k], svd.V.toArray()[:, :k]


def whiten(embeddings: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error, deviation_exact`` of each row and component.

    An entry c is taken as floor(256 c). Rows whose vector is null or has null or non-finite entries go, and so do those
    of another length than most vectors have (of equally frequent lengths the greatest stays). Copies of a vector count
    once in the fit, but each row has its results; a null key is kept. ``deviation`` is null where it exceeds a long
    (``deviation_exact`` has it, up to 38 digits). A component without variance has no rows, so fewer than ``components``
    come of vectors that span less; equal vectors, or no rows, give none.
    """
    spark, kind = embeddings.sparkSession, dict(embeddings.dtypes)[key]
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    steps = F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long")).alias("x")
    read = stash(embeddings.where(F.col(vector).isNotNull() & finite).select(F.col(key).alias("id"), steps), "vectors")
    lengths = read.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    d = lengths["d"] if lengths else 0
    read = read.where(F.size("x") == d)
    fit = stash(read.select("x").distinct(), "vectors-once")
    n = fit.count()
    if not n or not d:
        return spark.createDataFrame([], schema)
    sums = _sums(fit, d)

    def projected(axes: np.ndarray):
        def make():
            def work(batch):
                x = _matrix(batch["x"], d)
                w = centred(x, n, sums) @ axes
                exact = [Decimal(v) for v in deviations(x, n, sums)]
                ids = {"id": batch["id"]} if "id" in batch.schema.names else {}
                ends = np.arange(len(w) + 1, dtype=np.int32) * axes.shape[1]
                yield ids | {"exact": exact, "w": pa.ListArray.from_arrays(ends, w.ravel())}

            return work

        return make

    total = map_rows(fit, "exact decimal(38,0), w array<double>", projected(np.empty((d, 0)))).agg(F.sum("exact")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    e, v = _principal(fit, n, sums, components)
    k, trace = len(e), Fraction(int(total), n**3)
    explained = [float(Fraction(float(x)) / trace) for x in e]
    axes = v / np.sqrt(e)
    white = map_rows(fit, "exact decimal(38,0), w array<double>", projected(axes))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))

    out = map_rows(read, f"id {kind}, exact decimal(38,0), w array<double>", projected(axes))
    out = out.select("id", "exact", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("exact").try_cast("bigint").alias("deviation"),
        "whitened", F.array(*map(F.lit, explained))[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
        F.col("exact").alias("deviation_exact"),
    )
