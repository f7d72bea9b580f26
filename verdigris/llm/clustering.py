"""Centroid clustering in exact integers; the nearest centroid is found by the threshold algorithm.

Each dimension has the centroids sorted by their value there. A vector walks all
these lists outward from its own values, a centroid a step and dimension; each one
met first is compared exactly. An unmet centroid is in every dimension at least as
far as that list's frontier, so the walk stops when the squares of the frontiers add
up to more than the best distance: strictly, since an equal one may have a smaller
number. All vectors of a slice take a step at once; those that have stopped leave it.

Centroids and their sums are k times dims numbers, so tasks get them as part of their
function and send sums that Spark adds up; no vector is shuffled or collected.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.exact_sums import LONG_MAX, TERMS, collected, matrix, sound, terms
from verdigris.llm.shared import mapped, named, written

#: Clusters, rounds, components of a vector, and the factor that makes them integers.
CLUSTERS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Vectors that walk together.
SLICE = 1024
#: Components end here (a float's do before), so sums of them fit what exact_sums holds.
LARGEST = 2.0**130


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): longs whose squared distances fit a long, or else Python's integers."""
    values = np.clip(values, -LARGEST, LARGEST)
    if not values.size or np.abs(values).max() * scale < 2.0**29 / values.shape[1] ** 0.5:
        return np.floor(values * scale).astype(np.int64)
    return np.array([int(x * scale // 1) for x in values.ravel().tolist()], object).reshape(values.shape)


class SortedLists:
    """Centroids (a matrix of integers) by dimension, in the order of their values."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order = np.argsort(centroids.T, axis=1, kind="stable")
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the nearest centroid (ties: the smaller number) and its squared distance."""
        n, k = len(x), len(self.centroids)
        wide = object if object in (x.dtype, self.centroids.dtype) else np.int64
        who, best = np.full(n, k), np.zeros(n, wide)
        met = np.zeros((n, k), bool)
        rows, dims = np.arange(n), np.arange(x.shape[1])
        right = np.stack([np.searchsorted(self.values[j], x[:, j]) for j in dims], axis=1) if len(dims) else np.zeros((n, 0), int)
        left = right - 1
        for step in range(k):
            mine = x[rows]
            to_left, to_right = np.abs(mine - self.values[dims, np.maximum(left, 0)]), np.abs(self.values[dims, np.minimum(right, k - 1)] - mine)
            lefts = (left >= 0) & ((right == k) | (to_left <= to_right))
            frontier = np.where(lefts, to_left, to_right)
            new = np.zeros((len(rows), k), bool)
            new[np.arange(len(rows))[:, None], self.order[dims, np.where(lefts, left, right)]] = True
            if not len(dims):
                new[:] = True
            new &= ~met[rows]
            met[rows] |= new
            at, c = np.nonzero(new)  # by row, then by number
            far = ((mine[at] - self.centroids[c]) ** 2).sum(axis=1).astype(wide)
            order = np.lexsort((c, far, at)) if wide is np.int64 else np.array(sorted(range(len(at)), key=lambda i: (at[i], far[i], c[i])), int)
            first = order[np.unique(at[order], return_index=True)[1]]
            found, distance, number = rows[at[first]], far[first], c[first]
            better = (who[found] == k) | (distance < best[found]) | ((distance == best[found]) & (number < who[found]))
            who[found[better]], best[found[better]] = number[better], distance[better]
            going = ~((frontier**2).sum(axis=1) > best[rows])
            if not going.any() or step == k - 1:
                break
            left, right = (left - lefts)[going], (right + ~lefts)[going]
            rows = rows[going]
        return who, best


def _assigned(batches: Iterator[pa.RecordBatch], lists: SortedLists, dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches with (their vectors, the centroid of each, the squared distances)."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x = integers(matrix(part.column(part.num_columns - 1), dims), scale)
            yield part, x, *lists.nearest(x)


def _sums(batches: Iterator[pa.RecordBatch], lists: SortedLists, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """TERMS of the sum of each cluster's vectors by (cluster, dimension), and by (cluster, -1) their number."""
    sums: dict[tuple[int, int], int] = defaultdict(int)
    for _, x, who, _ in _assigned(batches, lists, dims, scale):
        for c in np.unique(who).tolist():
            mine = x[who == c]
            sums[c, -1] += len(mine)
            for j, total in enumerate(mine.sum(axis=0).tolist()):
                sums[c, j] += total
    yield from terms(sums)


def _distances(batches: Iterator[pa.RecordBatch], lists: SortedLists, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    for part, _, who, best in _assigned(batches, lists, dims, scale):
        shown = pa.array([min(d, LONG_MAX) for d in best.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who, pa.int32()), shown], names=["vec_id", "cluster", "distance"])


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Vectors are floor(scale * x) by component. Those take part that have exactly dims
    components, none of them null, NaN or infinite. Centroids start as the k vectors
    whose SHA-256 of seed, a colon and the id is least (in hexadecimal, null ids last,
    then by components); with fewer vectors there are fewer clusters, without any no
    rows. A round assigns every vector to the nearest centroid (squared distance, ties
    to the smaller number) and replaces each centroid by the floor of its vectors'
    mean; one without vectors stays. At last all are assigned once more.

    Rows that repeat an id or a vector count each. Components of any size up to 2**130
    are exact, larger ones count as that; a distance or sum that a long can't hold shows as the largest long. Other
    columns aren't read. A round is a scan and an aggregate that sends k times dims
    sums to the driver.
    """
    kept = vectors.where(sound(named(vector_col)) & (F.size(named(vector_col)) == dims)).select(named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<double>").alias("x"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(drawn.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = [integers(np.array([r.x]).reshape(1, dims), scale)[0].tolist() for r in first]

    def lists() -> SortedLists:
        wide = max((abs(v) for c in centroids for v in c), default=0) >= 1 << 24
        return SortedLists(np.array(centroids, object if wide else np.int64).reshape(len(centroids), dims))

    for _ in range(rounds if centroids else 0):
        now = lists()
        sums = collected(mapped(kept.select("x"), lambda it, now=now: _sums(it, now, dims, scale), TERMS))
        centroids = [[sums[c, j] // sums[c, -1] for j in range(dims)] if (c, -1) in sums else old for c, old in enumerate(centroids)]
    now = lists()
    found = mapped(kept, lambda it: _distances(it, now, dims, scale), "vec_id long, cluster int, distance long")
    if centroids:
        found = written(found, "assigned")
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()} if centroids else {}
    total = min(sum(inertia.values()), LONG_MAX)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = [(c, min(inertia.get(c, 0), LONG_MAX), total, digest) for c, digest in enumerate(digests)]
    of_cluster = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 16 clusters, after 3 rounds."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM kept QUALIFY c < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT no, arg_min(struct_pack(c := c, d := d), struct_pack(d := d, c := c)) AS best FROM (
    SELECT kept.no, c.c, CAST(list_sum(list_transform(list_zip(kept.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept, c{r} c) GROUP BY no)""")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (
      SELECT a.best.c AS c, i, sum(kept.q[i]) AS s, count(*) AS n FROM kept JOIN a{r} a USING (no), range(1, {DIMS + 1}) AS t(i) GROUP BY a.best.c, i) GROUP BY c) m ON m.c = c.c)""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(c.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY c.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} a USING (no) JOIN c{ROUNDS} c ON c.c = a.best.c
"""


OP11_SQL = _sql()
