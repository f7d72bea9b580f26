"""Whitening of embeddings by exact scatter sums on bit slices.

Components become integers. In a block of rows they are lessened by the block's
least and split to bit planes: a dimension's plane packs one bit of 64 rows a word.
The cross product of two dimensions is the sum, over pairs of their planes, of the
ones that both have, times the planes' weights; the lessening is put back exactly.
Sums over the blocks of all tasks are exact too, and so is the centring, in integers:
n times the cross products less the products of sums. Only then come doubles and the
eigenvectors of the dims times dims matrix, which is all that the driver gets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.exact_sums import LONG_MAX, TERMS, collected, matrix, sound, terms
from verdigris.llm.shared import mapped, named, written

#: Factor and offset that make components integers, and components of the result.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Rows of a block.
BLOCK = 8192
#: Integers end here; larger components count as this.
LARGEST = float(1 << 52)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c), without the offset: it moves neither covariances nor deviations."""
    return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


class BitPlanes:
    """A block of integer rows as bit planes, lessened by the least of each dimension."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n, self.dims = rows.shape
        self.low = rows.min(axis=0)
        raised = (rows - self.low).T
        self.bits = max(1, int(raised.max()).bit_length())
        padded = np.zeros((self.dims, -(-self.n // 64) * 64), np.int64)
        padded[:, : self.n] = raised
        planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(self.bits)]
        #: [dimension, bit, word]
        self.planes = np.ascontiguousarray(np.stack(planes, axis=1))
        self.weights = np.array([1 << b for b in range(self.bits)], object)

    def sums(self) -> np.ndarray:
        """Sums of the raised components."""
        return np.bitwise_count(self.planes).sum(axis=2, dtype=np.int64).astype(object) @ self.weights

    def products(self) -> np.ndarray:
        """[i, j] for i <= j: the sum of the products of the raised components; ones of both planes, weighed."""
        out = np.zeros((self.dims, self.dims), object)
        for i in range(self.dims):
            for a in range(self.bits):
                ones = np.bitwise_count(self.planes[i, a] & self.planes[i:]).sum(axis=2, dtype=np.int64)
                out[i, i:] += (ones.astype(object) @ self.weights) * (1 << a)
        return out

    def scatter(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums, and sums of products (i <= j), of the components as they came."""
        low, raised = self.low.astype(object), self.sums()
        return raised + self.n * low, self.products() + np.outer(low, raised) + np.outer(raised, low) + self.n * np.outer(low, low)


def _scatter(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """TERMS: by (-1, -1) the rows, by (i, -1) the sums, by (i, j) for i <= j the sums of products."""
    n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = BitPlanes(integers(matrix(batch.column(0).slice(at, BLOCK), dims), scale))
            s, p = block.scatter()
            n, sums, products = n + block.n, sums + s, products + p
    if n:
        out = {(-1, -1): n} | {(i, -1): int(sums[i]) for i in range(dims)} | {(i, j): int(products[i, j]) for i in range(dims) for j in range(i, dims)}
        yield from terms(out)


@dataclass
class Whitening:
    """What the scatter of n rows gives: integer sums, and unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float]

    @classmethod
    def of(cls, sums: dict[tuple[int, int], int], dims: int, components: int) -> Whitening:
        n, s = sums[-1, -1], [sums[i, -1] for i in range(dims)]
        covariance = np.zeros((dims, dims))
        for i in range(dims):
            for j in range(i, dims):  # integers are centred first, then divided with one rounding
                covariance[i, j] = covariance[j, i] = (n * sums[i, j] - s[i] * s[j]) / (n * n)
        trace = sum(n * sums[i, i] - s[i] ** 2 for i in range(dims)) / (n * n)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = values[order], vectors[:, order]
        values = np.where(values > dims * np.finfo(float).eps * max(values.max(initial=0), 0), values, 0.0)
        return cls(n, s, values, vectors, [float(v) / trace if trace else 0.0 for v in values])

    def apply(self, rows: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Deviations and whitened components of integer rows; a component without variance is 0."""
        largest = max(int(np.abs(rows).max(initial=0)), 1) * self.n * 2
        if rows.shape[1] * largest**2 < LONG_MAX:
            centred = self.n * rows - np.array(self.sums, np.int64)
            deviations, z = (centred**2).sum(axis=1).tolist(), centred / self.n
        else:
            exact = self.n * rows.astype(object) - np.array(self.sums, object)
            deviations, z = [min(int(d), LONG_MAX) for d in (exact**2).sum(axis=1)], (exact / self.n).astype(np.float64)
        scale = np.divide(1, np.sqrt(self.values), out=np.zeros(len(self.values)), where=self.values > 0)
        return deviations, (z @ self.vectors) * scale


def _whitened(batches: Iterator[pa.RecordBatch], fit: Whitening, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            deviations, w = fit.apply(integers(matrix(part.column(1), dims), scale))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]))[: len(w) + 1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations, pa.int64()), lists], names=["vec_id", "deviation", "w"])


def _identity_error(rows: DataFrame, w: Column, fit: Whitening) -> float | None:
    """The largest absolute entry of the covariance of whitened rows less the identity, over components with variance."""
    some = [c for c, v in enumerate(fit.values) if v > 0]
    if not some:
        return None
    means = rows.agg(*(F.avg(w[c]).alias(f"m{c}") for c in some)).first()
    pairs = [(a, b) for a in some for b in some if a <= b]
    found = rows.agg(*(F.avg((w[a] - means[f"m{a}"]) * (w[b] - means[f"m{b}"])).alias(f"v{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[f"v{a}_{b}"] - (a == b)) for a, b in pairs)


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null or hold a null, NaN or infinite component take no part. A
    component c becomes the integer floor(scale * c), at most 2**52 in size; an offset
    common to all changes nothing. Shorter vectors count as padded with zeros up to
    the longest. Eigenvectors are those of the covariance of all n vectors, numbered
    from 1 by falling eigenvalue, up to the number of dimensions. deviation is the sum
    of (n * x - S)**2, exact; beyond a long it shows as the largest long. A component
    without variance (one vector, equal vectors) is 0 in whitened and explained, and
    identity_error is null if no component has any. Rows that repeat an id or a vector
    count each; a null id is kept. Without vectors there are no rows. Other columns
    aren't read.

    Two scans of the vectors; the driver gets about dims * dims / 2 sums.
    """
    kept = vectors.where(sound(named(vector_col))).select(named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<double>").alias("x"))
    dims = kept.agg(F.max(F.size("x"))).first()[0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return kept.sparkSession.createDataFrame([], schema)
    kept = kept.select("vec_id", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x"))).alias("x"))
    fit = Whitening.of(collected(mapped(kept.select("x"), lambda it: _scatter(it, dims, scale), TERMS)), dims, components)
    rows = written(mapped(kept, lambda it: _whitened(it, fit, dims, scale), "vec_id long, deviation long, w array<double>"), "whitened")
    error = _identity_error(rows, F.col("w"), fit)
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.array(*map(F.lit, fit.explained))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of all embeddings."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
