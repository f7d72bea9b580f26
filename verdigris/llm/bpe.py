"""Byte-level BPE on padded numpy matrices.

Texts are cut by the tokenizer's pattern; each distinct piece of a slice of rows is
encoded once. Pieces of like length make the rows of a matrix. In a round every
row merges its leftmost pair of minimum rank: ranks come from an open-addressing
table of id pairs, the merged place is closed up, and rows without a mergeable
pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.shared import mapped, sliced

NONE = np.int32(2**31 - 1)
#: Bounds of piece lengths in bytes for the matrices; longer pieces take the heap.
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Cells of one matrix.
CELLS = 1 << 18
#: Bytes of distinct pieces that a worker remembers before it starts afresh; what one takes beside its text and ids; the longest that is remembered past its slice.
MEMORY, PIECE, LONG_PIECE = 24 << 20, 200, 64
#: Characters beyond which a text is cut to pieces a list at a time.
LONG_TEXT = 1 << 18
#: Ids of a text that are Python objects at once when it is decoded or digested.
IDS = 1 << 14


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """Ranks from the lines of a .tiktoken file: base64 of the token, a space, its rank."""
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class PairTable:
    """(left id, right id) -> id of both together, with linear probing in arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            self.keys[at[free]] = key[free]  # of several that meet in a slot the last one stays
            put = self.keys[at] == key
            self.values[at[put]] = value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is none. Ids below 0 have no pair."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        key[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        at, out = self._slot(key), np.full(key.shape, NONE, np.int32)
        left_over = np.flatnonzero(key >= 0)
        while len(left_over):
            there = self.keys[at[left_over]]
            hit = there == key[left_over]
            out[left_over[hit]] = self.values[at[left_over[hit]]]
            left_over = left_over[~hit & (there != -1)]
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Codec:
    """Encodes texts as the tiktoken library would without special tokens, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: b"%d," % rank for rank in ranks.values()}
        self.known: dict[str, bytes] = {}  # ids as the bytes of an int32 array: one object a piece
        self.held = 0  # bytes of known, about

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        out = [b""] * len(pieces)
        rows = np.full((len(pieces), width), -1, np.int32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        which = np.arange(len(pieces))
        ranks = self.pairs.get(rows[:, :-1], rows[:, 1:])
        while len(which):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(which), np.int64)
            least = ranks[np.arange(len(which)), best] if ranks.shape[1] else np.full(len(which), NONE)
            done = least == NONE
            if done.any():
                held = rows[done] >= 0
                ids, ends = rows[done][held].tobytes(), np.cumsum(4 * held.sum(axis=1)).tolist()
                for i, a, b in zip(which[done].tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[i] = ids[a:b]
                rows, ranks, which, best, least = rows[~done], ranks[~done], which[~done], best[~done], least[~done]
                if not len(which):
                    break
            n, cols = np.arange(len(which)), np.arange(rows.shape[1] - 1)
            rows[n, best] = least
            rows = np.take_along_axis(rows, cols + (cols > best[:, None]), axis=1)
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols > best[:, None]), axis=1)
            if ranks.shape[1]:
                before, at = np.maximum(best - 1, 0), np.minimum(best, ranks.shape[1] - 1)
                for place in (before, at):
                    ranks[n, place] = self.pairs.get(rows[n, place], rows[n, place + 1])
        return out

    def _long(self, piece: bytes) -> bytes:
        """The same merges for a piece beyond the matrices, by a heap of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        found = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(rank, i) for i, rank in enumerate(found) if rank != NONE]
        heapq.heapify(heap)
        now = dict(enumerate(found))

        def look(i: int) -> None:
            j = after[i]
            pair = self.tokens[ids[i]] + self.tokens[ids[j]] if j >= 0 else b""
            now[i] = rank = self.ranks.get(pair, int(NONE)) if pair else int(NONE)
            if rank != NONE:
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if now.get(i) != rank:
                continue
            j = after[i]
            ids[i], after[i] = rank, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            now.pop(j, None)
            look(i)
            if before[i] >= 0:
                look(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int32).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that aren't known yet, by length."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, sys.byteorder)
                continue
            width = next((b for b in BUCKETS if len(raw) <= b), 0)
            by.setdefault(width, []).append((piece, raw))
        for width, some in by.items():
            step = max(1, CELLS // width) if width else 1
            for at in range(0, len(some), step):
                part = some[at : at + step]
                raws = [raw for _, raw in part]
                coded = self._matrix(raws, width) if width else [self._long(raws[0])]
                self.known.update(zip((piece for piece, _ in part), coded, strict=True))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches in a long text, in lists that stay small."""
        matches = self.pattern.finditer(text)
        while some := [m.group() for m in islice(matches, 1 << 16)]:
            yield some

    def forget(self) -> None:
        """Drop the pieces remembered so far."""
        self.known.clear()
        self.held = 0

    def _ids(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Ids of each list of pieces; what isn't known yet is learnt for all lists at once, and long pieces are forgotten after."""
        if self.held > MEMORY:
            self.forget()
        missing = set().union(*lists).difference(self.known)
        if missing:
            self.learn(missing)
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, some)), np.int32) for some in lists]
        for piece in missing:
            if len(piece) > LONG_PIECE:
                del self.known[piece]
            else:
                self.held += PIECE + 2 * len(piece)
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        short = [i for i, text in enumerate(texts) if len(text) <= LONG_TEXT]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for i, ids in zip(short, self._ids([self.pattern.findall(texts[i]) for i in short]), strict=True):
            out[i] = ids
        for i in set(range(len(texts))).difference(short):
            out[i] = np.concatenate([ids for some in self.pieces(texts[i]) for ids in self._ids([some])])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(b"".join(map(self.tokens.__getitem__, ids[at : at + IDS].tolist())) for at in range(0, len(ids), IDS))

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas, in lowercase hex."""
        told = hashlib.sha256()
        for at in range(0, len(ids), IDS):
            listed = b"".join(map(self.digits.__getitem__, ids[at : at + IDS].tolist()))
            told.update(listed if at + IDS < len(ids) else listed[:-1])
        return told.hexdigest()


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    """One for each worker process, read from the tokenizer files that every machine has installed."""
    with open(path) as lines:
        return Codec(read_ranks(lines.readlines()), pattern)


def encode_batches(batches: Iterator[pa.RecordBatch], text_col: str, path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Adds token_ids, slice by slice."""
    codec = _codec(path, pattern)
    try:
        for batch in sliced(batches, text_col, 1 << 20):
            ids = codec.encode_all([text or "" for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            coded = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), coded], [*(n for n, _ in kept), "token_ids"])
    finally:
        codec.forget()  # the worker outlives its task, and stages after this one need its memory


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Adds decoded, the bytes that token_ids stand for."""
    codec = _codec(path, pattern)
    for batch in batches:
        coded = batch.column(batch.schema.get_field_index("token_ids"))
        texts = [codec.decode(ids.values.to_numpy()) for ids in coded]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids array<int>. Null and empty texts have no ids; texts of any length are read whole.

    Columns of docs keep their names; one that is called token_ids already is
    replaced. Rows are told apart by nothing, so repeated rows and ids are
    harmless, and an empty table gives no rows.
    """
    docs = docs.drop("token_ids")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, lambda it: encode_batches(it, text_col, path, pattern), f"{fields}, token_ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """coded with decoded, the bytes of its token_ids."""
    coded = coded.drop("decoded")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in coded.schema)
    return mapped(coded, lambda it: decode_batches(it, path, pattern), f"{fields}, decoded binary")


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        ids = [c.values.to_numpy() for c in batch.column("token_ids")]
        decoded = [hashlib.sha256(c.as_buffer()).hexdigest() for c in batch.column("decoded")]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(i) for i in ids], pa.int64()), "ids_sha256": list(map(codec.digest, ids)), "decoded_sha256": decoded})


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode and digest in one pass over the batches."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    through = lambda it: _digests(decode_batches(encode_batches(it, "text", path, pattern), path, pattern), path, pattern)
    return mapped(rows, through, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
