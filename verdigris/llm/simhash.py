"""SimHash near-duplicates, linked by BK-trees.

Each distinct fingerprint is dealt to shards by the pairs of its four 16-bit words:
two fingerprints that differ in at most two bits have at least two words in common,
so they meet in a shard. A shard's fingerprints form a BK-tree, where a child's key
is its Hamming distance to the parent; a search follows only the edges within the
radius. A shard tells which fingerprints it joins by links to one of them, so a
dense group gives a link for each member and not one for each pair.

The trees are built where the shard's rows are. They are not broadcast: all
fingerprints of a corpus have no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.shared import components, mapped, sliced, written

#: Words in a shingle; links at this many differing bits or fewer.
WORDS, RADIUS = 3, 2
#: A larger shard is parted by the words of what its members don't share.
SHARD = 2048
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Set bits of each byte, least first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits: each is set if it is in the XXH64 (seed 42) of over half the shingles."""
    tokens = text.encode().translate(LOWER).split()  # bytes split at \x20 and \x09-\x0D
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), (ends[words - 1 :] - 1 if len(tokens) >= words else ends[-1:] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)], np.uint64)
        spread = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
        seen = np.bincount(spread.ravel(), minlength=2048).reshape(8, 256)
        counts += (seen @ BITS).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        marks = np.array([fingerprint(text or "", words) for text in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "mark"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, mark): a row for each row of docs; mark holds the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, lambda it: _fingerprints(it, words), "doc_id long, mark long")


class BKTree:
    """Children by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Positions of values within radius of value, as they are found."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            edges = self.children[at]
            for d in range(max(0, distance - radius), distance + radius + 1):
                if (child := edges.get(d)) is not None:
                    todo.append(child)

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while self.values:
            edges = self.children[at]
            distance = (self.values[at] ^ value).bit_count()
            if distance not in edges:
                edges[distance] = new
                break
            at = edges[distance]
        self.values.append(value)
        self.children.append({})


def _parts(marks: list[int], rest: list[int], radius: int) -> Iterator[list[int]]:
    """Parts of a large shard in which every pair within radius of each other meets.

    rest are the bit positions that aren't shared by all yet. They are cut into
    radius + 2 runs; marks within radius agree on at least two of them.
    """
    if len(marks) <= SHARD or len(rest) < 2 * (radius + 2):
        yield marks
        return
    runs = [rest[i :: radius + 2] for i in range(radius + 2)]
    for one, two in combinations(range(len(runs)), 2):
        fixed = sum(1 << b for b in runs[one] + runs[two])
        left = [b for i, run in enumerate(runs) if i not in (one, two) for b in run]
        by: dict[int, list[int]] = {}
        for mark in marks:
            by.setdefault(mark & fixed, []).append(mark)
        for some in by.values():
            if len(some) > 1:
                yield from _parts(some, left, radius)


def shard_links(marks: list[int], rest: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the marks of a shard as their pairs within radius do: (member, least of its class)."""
    root = {mark: mark for mark in marks}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for part in _parts(marks, rest, radius):
        tree = BKTree()
        for mark in part:
            for at in tree.near(mark, radius):
                a, b = find(mark), find(tree.values[at])
                if a != b:
                    root[max(a, b)] = min(a, b)
            tree.add(mark)
    return [(mark, top) for mark in marks if (top := find(mark)) != mark]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard. Shards of one member have no link and are passed over."""
    held_key, held = None, []
    out: list[tuple[int, int]] = []

    def close() -> None:
        if len(held) > 1:
            one, two = held_key[0]
            rest = [b for w in range(4) if w not in (one, two) for b in range(16 * w, 16 * w + 16)]
            out.extend(shard_links(held, rest, radius))

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = np.array(links, np.uint64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], ["a", "b"])

    pairs = list(combinations(range(4), 2))
    for batch in batches:
        which, key, mark = (batch.column(i).to_numpy() for i in range(3))
        edges = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (key[1:] != key[:-1]))))
        ends = np.append(edges[1:], len(key))
        for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
            if (now := (pairs[which[a]], key[a])) != held_key:
                close()
                held_key, held = now, []
            elif a:
                pass
            held.extend(mark[a:b].view(np.uint64).tolist())
        if len(out) > 50_000:
            yield batch_of(out)
            out.clear()
    close()
    yield batch_of(out)


def mark_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct values of marks.mark that join the same classes as all pairs within radius."""
    if radius > 2:
        raise ValueError("four words have two in common for a radius of 2 at most")
    word = [F.shiftrightunsigned("mark", 16 * w).bitwiseAND(F.lit(0xFFFF)) for w in range(4)]
    shards = [F.struct(F.lit(i).cast("byte").alias("which"), F.shiftleft(word[a], 16).bitwiseOR(word[b]).alias("key")) for i, (a, b) in enumerate(combinations(range(4), 2))]
    dealt = marks.select(F.inline(F.array(*shards)), "mark").select("which", "key", "mark")
    dealt = dealt.repartition("which", "key").sortWithinPartitions("which", "key", "mark")
    return mapped(dealt, lambda it: _links(it, radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, mark, component_id): the smallest id that links of at most radius bits reach.

    Null texts count as empty; texts without a word have the fingerprint zero,
    which links as any other. Repeated rows and ids each get their row. Null ids
    are passed over when the smallest is sought (a group of null ids only has a
    null component_id). An empty table gives no rows.
    """
    marks = written(fingerprints(docs, id_col, text_col, words), "marks")
    least = marks.groupBy("mark").agg(F.min("doc_id").alias("least"))
    roots = components(mark_links(least.select("mark"), radius))
    members = least.join(roots, least["mark"] == roots["node"], "left").select("mark", F.coalesce("root", "mark").alias("root"), "least")
    of_root = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_mark = members.join(of_root, "root").select("mark", "component_id")
    return marks.join(of_mark, "mark").select("doc_id", "mark", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
