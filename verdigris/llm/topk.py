"""Exact top-k inner products by bit-sliced indexes.

A block of vectors becomes bitmaps: slice b of dimension d holds bit b of that
component for every row of the block. A query's weights pick slices by their own
bits; carry-save additions on whole bitmaps turn them into the slices of the score
of all rows at once. From the most significant slice down, rows that must be among
the best are taken and rows that can't be are left; rows that tie at the boundary
are resolved by their ids. Scores have as many slices as they need, so components
of any size are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.shared import mapped, written

#: Rows of a block and queries of a group: the memory of one task, whatever the table's size.
BLOCK, GROUP = 8192, 512
#: Pairs of a block and a group that a task takes.
PAIRS = 8
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole-valued doubles as int64, or as Python's integers where sums could leave 62 bits."""
    if not values.size or np.abs(values).max() < 1 << 24:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


class BitSlices:
    """The index of one block: components less their least as bitmaps, rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray) -> None:
        self.ids, self.low = ids, low
        self.bits, self.dims, self.words = slices.shape
        #: [sign][bit, dimension, word]; the second holds the complements, for negative weights.
        self.slices = (slices, ~slices)
        self.rows = np.packbits(np.arange(64 * self.words) < len(ids), bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> BitSlices:
        """The index of rows; values is a matrix of integers or of whole-valued doubles."""
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], _whole(values[order]) if values.dtype == np.float64 else values[order]
        n, dims = values.shape
        low = values.min(axis=0) if n else np.zeros(dims, np.int64)
        raised = values - low
        bits = max(1, int(raised.max(initial=0)).bit_length())
        words = -(-n // 64)
        padded = np.zeros((64 * words, dims), raised.dtype)
        padded[:n] = raised
        slices = np.stack([np.ascontiguousarray(np.packbits((padded.T >> b & 1).astype(np.uint8), axis=1, bitorder="little")).view(np.uint64) for b in range(bits)])
        return cls(ids, low, slices.reshape(bits, dims, words))

    def score_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of every row's score less a constant, least significant first."""
        size, levels = np.abs(weights), {}
        for sign, mine in ((0, weights > 0), (1, weights < 0)):
            for j in range(int(size[mine].max(initial=0)).bit_length()):
                if len(dims := np.flatnonzero(mine & ((size >> j & 1) == 1))):
                    for b in range(self.bits):
                        levels.setdefault(j + b, []).append(self.slices[sign][b, dims])
        out, carries, level, top = [], [], 0, max(levels, default=-1)
        while level <= top or carries:
            parts = levels.get(level, []) + carries
            carries, level = [], level + 1
            if not parts:
                out.append(np.zeros(self.words, np.uint64))
                continue
            stack = np.concatenate(parts)
            while len(stack) > 1:
                if third := len(stack) // 3:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    stack = np.concatenate((half ^ c, stack[3 * third :])) if len(stack) % 3 else half ^ c
                else:
                    carries.append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
            out.append(stack[0])
        return out

    def constant(self, weights: np.ndarray) -> int:
        """What the slices of a score leave out: the least components, and the complements that stand for negative weights."""
        pairs = list(zip(map(int, weights), map(int, self.low), strict=True))
        return sum(w * x for w, x in pairs) + sum(w for w, _ in pairs if w < 0) * ((1 << self.bits) - 1)

    def best(self, weights: np.ndarray, k: int, own: int) -> tuple[np.ndarray, list[int]]:
        """Ids and exact scores of the k best rows but those with the id own."""
        weights = np.concatenate([weights[: self.dims], np.zeros(max(0, self.dims - len(weights)), weights.dtype)])
        open_rows = self.rows.copy()
        for i in range(*np.searchsorted(self.ids, [own, own + 1]).tolist()):
            open_rows[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        taken, n = np.zeros(self.words, np.uint64), 0
        score = self.score_slices(weights)
        for bitmap in reversed(score):
            hit = open_rows & bitmap
            m = int(np.bitwise_count(hit).sum())
            if n + m > k:
                open_rows = hit
            else:
                taken |= hit
                n += m
                open_rows &= ~bitmap
                if n == k:
                    break
        where = np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little"))
        if n < k:  # those that are left tie; rows are in the order of ids, so the first have the smallest
            words = np.flatnonzero(open_rows)[: k - n]
            ties = [(int(w) << 6) + np.flatnonzero(np.unpackbits(open_rows[w : w + 1].view(np.uint8), bitorder="little")) for w in words]
            where = np.concatenate([where, *ties])[:k] if ties else where
        word, bit = where >> 6, (where & 63).astype(np.uint64)
        wide = np.int64 if len(score) < 62 else object
        raised = np.zeros(len(where), wide)
        for level, bitmap in enumerate(score):
            raised += (bitmap[word] >> bit & np.uint64(1)).astype(np.int64).astype(wide) << level
        fixed = self.constant(weights)
        return self.ids[where], [int(x) + fixed for x in raised]


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: a block's slices, its ids and its least components as decimal text."""
    dims = max(1, rows["q"].map(len).max())
    found = BitSlices.of(rows["vec_id"].to_numpy(np.int64), _matrix(rows["q"], dims))
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "ids": [found.ids.tobytes()], "low": [[str(x) for x in found.low]], "bits": [found.bits], "slices": [found.slices[0].tobytes()]})


def _group(queries: pd.DataFrame) -> pd.DataFrame:
    dims = max(1, queries["q"].map(len).max())
    return pd.DataFrame({"grp": [int(queries["grp"].iloc[0])], "query_ids": [queries["vec_id"].to_numpy(np.int64).tobytes()], "dims": [dims], "weights": [_matrix(queries["q"], dims).tobytes()]})


def _over(score: int) -> bytes | None:
    """A key that orders scores which a long can't hold, and its two ends."""
    return None if _LOW < score < _HIGH else (score + (1 << 4999)).to_bytes(625)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids, low, bits, slices, query_ids, dims, weights): the best of a block for each query of a group."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("over", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):
            ids, low, bits, slices, query_ids, dims, weights = (batch.column(c)[i].as_py() for c in range(7))
            least = np.array([int(x) for x in low], object)
            index = BitSlices(np.frombuffer(ids, np.int64), least, np.frombuffer(slices, np.uint64).reshape(bits, len(low), -1))
            out: list[list] = [[], [], [], []]
            for own, vector in zip(np.frombuffer(query_ids, np.int64).tolist(), np.frombuffer(weights).reshape(-1, dims), strict=True):
                found, scores = index.best(_whole(vector), k, own)
                out[0] += [own] * len(found)
                out[1] += found.tolist()
                out[2] += [min(max(s, _LOW), _HIGH) for s in scores]
                out[3] += map(_over, scores)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, q): floor(scale * x) of every component, x as double; q holds the whole numbers as doubles, which is exact.

    Rows without an id, null vectors, and vectors with a component that is null or
    isn't finite (before or after scaling) take no part.
    """
    by = lambda x: x.cast("double") * scale
    sound = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(by(x)) < float("inf")))
    # Doubles from 2**52 on are whole already, and a long doesn't hold all of them.
    parts = F.transform(vector_col, lambda x: F.when(F.abs(by(x)) < float(1 << 52), F.floor(by(x)).cast("double")).otherwise(by(x)))
    return vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), parts.alias("q"))


def top_inner_products(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    rows and queries have (vec_id, q) as quantised() gives them; a row is no
    candidate of the query of its own id. Ties go to the smaller vec_id. Shorter
    vectors count as padded with zeros, so empty ones score 0. Rows that repeat an
    id are candidates each; repeated queries answer once, and different vectors
    under one query id are merged into one ranking. Without rows or queries there
    are no results. Scores rank exactly whatever their size; one that a long can't
    hold is shown as the end of the longs that it lies beyond. Other columns are
    not read.

    Rows are dealt to blocks and queries to groups. The slices of a block are
    built once and written; each pair of a block and a group is a row of the join
    of the two, and a block sends on its k best a query.
    """
    rows, queries = rows.select("vec_id", "q"), queries.select("vec_id", "q").distinct()
    blocks = max(1, math.ceil(rows.count() / block))
    groups = max(1, math.ceil(queries.count() / group))
    # Rows are dealt by lot and not by hash, so repeats of one row don't fill one block.
    index = written(rows.withColumn("block", F.floor(F.rand(11) * blocks).cast("int")).groupBy("block").applyInPandas(_index, "block int, ids binary, low array<string>, bits int, slices binary"), "slices")
    asked = written(queries.withColumn("grp", F.pmod(F.xxhash64("vec_id", "q"), F.lit(groups)).cast("int")).groupBy("grp").applyInPandas(_group, "grp int, query_ids binary, dims int, weights binary"), "asked")
    pairs = index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(asked, "grp")
    dealt = pairs.repartition(max(1, blocks * groups // PAIRS), "block", "grp").select("ids", "low", "bits", "slices", "query_ids", "dims", "weights")
    best = mapped(dealt, lambda it: _search(it, k), "query_id long, vec_id long, score long, over binary")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every 20th.

    Vectors that are null, or hold a null or a component that isn't finite, take
    no part.
    """
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_inner_products(rows, rows.where("vec_id % 20 = 0"), 20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
