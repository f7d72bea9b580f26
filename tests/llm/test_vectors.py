"""Clustering, whitening and shards against brute force, and their odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import NAMES
from verdigris.llm import clustering, sharding, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, dims=64, seed=3, spread=0.2):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, spread), 3) for _ in range(dims)], 0) for i in range(n)]


def odd_vectors():
    """Sound vectors among nulls, holes, NaN, infinities, other lengths, repeats and a null id."""
    rows = vectors(60)
    bad = [(100, None, 1), (101, [], 1), (102, [None, *rows[0][1][1:]], 1), (103, [float("nan"), *rows[0][1][1:]], 1), (104, [float("inf"), *rows[0][1][1:]], 1), (105, [0.5] * 63, 1), (106, [0.5] * 65, 1)]
    more = [rows[3], (3, rows[5][1], 0), (None, rows[7][1], 0), *[(200 + i, rows[9][1], 0) for i in range(30)]]
    return rows + bad + more


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [int(Fraction(float(np.float32(x))) * scale // 1) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and abs(x) < float("inf") for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])) + [r for r in kept if r[0] is None]
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if mine := [v for (_, v), c in zip(kept, of, strict=True) if c == j]:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    top = (1 << 63) - 1
    inertia = {j: min(top, sum(min(d, top) for _, d, c in out if c == j)) for j in range(len(centroids))}
    return sorted(((i, j, min(d, top), inertia[j], min(top, sum(inertia.values())), digest[j]) for i, d, j in out), key=str)


@pytest.mark.parametrize("k", [1, 5, 16, 200])
def test_clusters_against_brute_force(spark, k):
    rows = odd_vectors()
    got = clustering.clustered(spark.createDataFrame(rows, VECTORS).repartition(3), k=k).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, k, 3, 64, 64)


def test_clusters_of_huge_components_and_few_dimensions(spark):
    rows = [(i, [x, -x, 0.25], 0) for i, x in enumerate([3e38, -3e38, 1e20, 1.0, 0.5, 2.0, 1e9, -1e9, 1e9])]
    got = clustering.clustered(spark.createDataFrame(rows, VECTORS), k=4, dims=3).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, 4, 3, 3, 64)


def test_clusters_of_nothing_and_with_clashing_columns(spark):
    assert clustering.clustered(spark.createDataFrame([], VECTORS)).collect() == []
    assert clustering.clustered(spark.createDataFrame([(1, None, 0)], VECTORS)).collect() == []
    rows = spark.createDataFrame(vectors(20), VECTORS)
    crowded = rows.select("*", *(F.lit("x").alias(n) for n in [*NAMES, "x", "cluster", "distance"]))
    assert sorted(map(tuple, clustering.clustered(crowded).collect())) == sorted(map(tuple, clustering.clustered(rows).collect()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=9), st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=20))
def test_walks_find_the_nearest_with_ties(centroids, rows):
    for kind in (np.int64, object):
        who, best = clustering.SortedLists(np.array(centroids, kind)).nearest(np.array(rows, np.int64))
        for v, c, d in zip(rows, who, best, strict=True):
            assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(centroids))


def test_walks_stop_before_all_are_met():
    """Far centroids aren't compared: with one dimension the frontier tells at once."""

    class Counting(np.ndarray):
        compared = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype.kind == "i":
                Counting.compared += len(at)
            return super().__getitem__(at)

    lists = clustering.SortedLists(np.arange(1000)[:, None] * 10)
    lists.centroids = lists.centroids.view(Counting)
    who, _ = lists.nearest(np.array([[5001], [12], [9999]]))
    assert who.tolist() == [500, 1, 999] and Counting.compared < 20


def plain_whitening(rows, dims):
    x = np.array([[int(Fraction(float(np.float32(c))) * 1024 // 1) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    centred = n * x - s
    z = (centred / n).astype(float)
    e, v = np.linalg.eigh(z.T @ z / n)
    return (centred**2).sum(axis=1).tolist(), e[::-1], z @ v[:, ::-1]


def check_whitening(found, kept, dims, parts):
    deviations, e, z = plain_whitening([v for _, v in kept], dims)
    assert len(found) == len(kept) * parts
    want = {(i, d): k for k, ((i, _), d) in enumerate(zip(kept, deviations, strict=True))}
    signs = np.zeros(parts)
    for r in found:
        k, c = want[r.vec_id, r.deviation], r.component - 1
        ref = z[k, c] / e[c] ** 0.5
        if abs(ref) > 0.01:
            signs[c] = signs[c] or np.sign(ref * r.whitened)
            assert abs(r.whitened * signs[c] - ref) < 1e-7
        assert r.n == len(kept) and abs(r.explained * e.sum() / e[c] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_against_brute_force(spark):
    rows = [r for r in odd_vectors() if r[1] is None or len(r[1]) in (63, 64)]
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    check_whitening(whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(3)).collect(), kept, 64, 8)


def test_whitening_of_few_dimensions_and_wide_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1e3), rng.gauss(5, 1)], 0) for i in range(300)]
    check_whitening(whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect(), [(i, v) for i, v, _ in rows], 2, 2)


def test_whitening_without_variance_of_nothing_and_clashing_columns(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 0), (2, [None], 0)], VECTORS)).collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25], 0)] * 3, VECTORS)).collect()
    assert {tuple(r) for r in one} == {(1, c, 3, 0, 0.0, 0.0, None) for c in (1, 2)} and len(one) == 6
    huge = whitening.whitened(spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0)], VECTORS)).collect()
    assert all(r.deviation == (1 << 63) - 1 and abs(abs(r.whitened) - 1) < 1e-9 for r in huge if r.component == 1)
    rows = spark.createDataFrame(vectors(20, 4), VECTORS)
    crowded = rows.select("*", *(F.lit("x").alias(n) for n in [*NAMES, "x", "w", "deviation", "at"]))
    assert sorted(map(tuple, whitening.whitened(crowded).collect())) == sorted(map(tuple, whitening.whitened(rows).collect()))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(1, 4), st.integers(0, 2**40), st.integers(0, 99))
def test_scatter_of_bit_planes_is_exact(n, dims, spread, seed):
    rng = random.Random(seed)
    x = [[rng.randint(-spread, spread) for _ in range(dims)] for _ in range(n)]
    sums, products = whitening.BitPlanes(np.array(x, np.int64)).scatter()
    assert list(sums) == [sum(c) for c in zip(*x, strict=True)]
    assert all(products[i, j] == sum(r[i] * r[j] for r in x) for i in range(dims) for j in range(i, dims))


def jump(key, shards):
    """The published loop."""
    key, last, to = key % 2**64, -1, 0
    while to < shards:
        last, key = to, (key * 2862933555777941757 + 1) % 2**64
        to = int((last + 1) * (2.0**31 / ((key >> 33) + 1)))
    return last


def test_jumps_are_those_of_the_published_loop(spark):
    rng = random.Random(1)
    keys = [*range(500), *(rng.randrange(-(2**63), 2**63) for _ in range(500)), -(2**63), 2**63 - 1, -1]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k long")
    for n in (1, 2, 24, 25, 48, 49, 3000):
        got = rows.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()
        assert all(r.s == (None if r.k is None else jump(r.k, n)) for r in got)


def plain_shards(rows, shards):
    crc = lambda t: zlib.crc32((t or "").encode())
    size = lambda t: len((t or "").encode()) + 8
    out, used = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, crc(r[1]), size(r[1]))):
        s = jump(i or 0, shards)
        used[s] = used.get(s, -1) + 1
        out.append((i, size(t), crc(t), "key", s, used[s], jump(i or 0, shards + 1)))
    return sorted(out, key=str)


def test_shards_of_odd_rows(spark, odd, clashing, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    many = spark.createDataFrame([(i % 7, "same") for i in range(2000)] + [(9, "same")] * 3000, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, sharding.sharded(odd, 3).collect()), key=str) == plain_shards(rows, 3)
    assert sorted(map(tuple, sharding.sharded(clashing, 3).collect()), key=str) == plain_shards(rows, 3)
    assert sorted(map(tuple, sharding.sharded(many).collect()), key=str) == plain_shards([tuple(r) for r in many.collect()], 24)
    assert sharding.sharded(none).collect() == []


def test_more_shards_take_rows_only_into_themselves(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("k"), "id").alias("name"))
    for column in ("doc_id", "name"):
        moved = sharding.with_shards(sharding.with_shards(ids, 24, column, "a"), 30, column, "b").groupBy("a", "b").count().collect()
        assert all(r.a == r.b or r.b >= 24 for r in moved)
        share = sum(r["count"] for r in moved if r.a != r.b) / 20_000
        assert 0.17 < share < 0.23
        sizes = {}
        for r in moved:
            sizes[r.b] = sizes.get(r.b, 0) + r["count"]
        assert len(sizes) == 30 and min(sizes.values()) > 550 and max(sizes.values()) < 790


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(5, "hot")] * 200, "doc_id long, text string")
    sharding.write_shards(docs, 4, f"{tmp_path}/out", files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert all(r.shard == jump(r.doc_id, 4) for r in back.collect())
