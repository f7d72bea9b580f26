"""Repeated passages, exactly, by enhanced suffix arrays over the places that may repeat.

A repeat of LENGTH bytes has in all its places the same anchor: the k-gram of least
hash inside it. So every LENGTH-byte window of a text belongs to one record (anchor,
run of window starts), and equal windows meet under their anchor. Counts by anchor,
combined before their shuffle, leave out what can't repeat. Runs of the same bytes,
told by 128-bit digests beside their anchor's 64 bits, repeat as they are. What
remains are the edges of repeats: their bytes, one example for each digest, go to a
suffix array by ranks of doubled prefixes, with the common prefixes of neighbours. A
stack scan of its common-prefix intervals gives the maximal repeats, those whose
occurrences differ in what stands to their left, with all their occurrences.

An anchor with very many different surroundings (a short line that half the corpus
has) parts them by longer anchors, in the same way, up to whole windows. Anchors and
runs that very many records share are dealt to salts in the joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.shared import mapped, named, sliced, spread_join, written

#: Bytes of a repeat, and of an anchor in it.
LENGTH, GRAM = 200, 64
#: Different surroundings of an anchor beyond which they are parted by longer anchors.
HOT = 1500
#: Bytes that are scanned at once.
PIECE = 1 << 20
_PLACE = 24  # bits of a position in a piece
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 4096, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width keys, by running minima of blocks from both sides."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def scan(data: bytes, bounds: list[tuple[int, int]], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, anchor place) of each record; windows stay inside a bound."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[:n], dtype=np.uint64)))
    h = (sums[gram:] - sums[:-gram]) * _INVERSE[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    mask = np.uint64((1 << _PLACE) - 1)
    least = _sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in bounds if b - a >= length] or [np.zeros(0, np.int64)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    of = least[starts]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    place = (of[first] & mask).astype(np.int64)
    return h[place].view(np.int64), starts[first], starts[last], place


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[tuple], bytes, list[tuple[int, int]]]]:
    """Texts joined up to PIECE bytes: (keys and offsets, bytes, bounds). A longer text is cut with an overlap."""
    keys, parts, bounds, size = [], [], [], 0
    for batch in sliced(batches, "text", PIECE):
        for doc_id, h, offset, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            content = text or b""
            for at in range(0, max(1, len(content) - length + 1), PIECE // 2):
                part = content[at : at + PIECE // 2 + length - 1]
                if len(part) < length:
                    continue
                if size + len(part) > PIECE:
                    yield keys, b"".join(parts), bounds
                    keys, parts, bounds, size = [], [], [], 0
                keys.append((doc_id, h, offset + at - size))
                bounds.append((size, size + len(part)))
                parts.append(part)
                size += len(part)
    if parts:
        yield keys, b"".join(parts), bounds


#: What equal runs have in common: the anchor's hash and both halves of the run's digest.
KIND = ["ah", "ch", "cl"]
RECORD = "ah long, ch long, cl long, doc_id long, h long, a long, run int"
_RECORD = [("ah", pa.int64()), ("ch", pa.int64()), ("cl", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("a", pa.int64()), ("run", pa.int32())]


def _records(batches: Iterator[pa.RecordBatch], length: int, gram: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    """Each run of windows: its anchor, the digest of its bytes, where it starts, how many windows follow the first, and maybe the bytes."""
    schema = pa.schema([*_RECORD, *[("bytes", pa.binary())] * with_bytes])
    for keys, data, bounds in _pieces(batches, length):
        ah, first, last, place = scan(data, bounds, length, gram)
        if not len(ah):
            continue
        view, digest = memoryview(data), xxhash.xxh3_128_digest
        # The digest also holds where in the run the anchor is, so equal digests have their windows at equal distances.
        joined = b"".join(digest(view[a : b + length], p) for a, b, p in zip(first.tolist(), last.tolist(), (place - first).tolist(), strict=True))
        ch, cl = np.frombuffer(joined, np.int64).reshape(-1, 2).T
        of = np.searchsorted(np.array([b for b, _ in bounds]), first, side="right") - 1
        ids = pa.array([k[0] for k in keys], pa.int64()).take(pa.array(of))
        hs, shift = np.array([k[1] for k in keys], np.int64)[of], np.array([k[2] for k in keys], np.int64)[of]
        for at in range(0, len(ah), 20_000):
            cut = slice(at, at + 20_000)
            columns = [pa.array(ah[cut]), pa.array(ch[cut]), pa.array(cl[cut]), ids.slice(at, 20_000), pa.array(hs[cut]), pa.array((first + shift)[cut]), pa.array((last - first)[cut].astype(np.int32))]
            if with_bytes:
                columns.append(pa.array([data[a : b + length] for a, b in zip(first[cut].tolist(), last[cut].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _ranks(data: np.ndarray, ends: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank of each position by its first h bytes) for h = 4, 8, 16 ... from most on; a text's end goes before any byte."""
    at = np.arange(len(data))
    key = np.zeros(len(data), np.int64)
    for j in range(4):
        key = key << 9 | np.where(at + j < ends, data[np.minimum(at + j, len(data) - 1)].astype(np.int64) + 1, 0)
    rank, levels, h = np.unique(key, return_inverse=True)[1] + 1, [], 4
    while True:
        levels.append((h, rank))
        if h >= most:
            return levels
        after = np.where(at + h < ends, rank[np.minimum(at + h, len(data) - 1)], 0)
        rank = np.unique(rank * (len(data) + 1) + after, return_inverse=True)[1] + 1
        h *= 2


def suffix_array(texts: list[bytes], starts: list[int], groups: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, common prefix with the next) of suffixes in order, those of a group of texts together.

    starts tells how many positions of each text, from its first, begin a suffix.
    Suffixes of different groups have no common prefix.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data, firsts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    ends = np.repeat(firsts + sizes, sizes)
    levels = _ranks(data, ends, int(sizes.max()))
    count = np.minimum(np.array(starts, np.int64), sizes)
    text = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + firsts[text]
    group = np.array(groups, np.int64)[text]
    order = np.lexsort((levels[-1][1][at], group))
    text, at, group = text[order], at[order], group[order]
    a, b, shared = at[:-1], at[1:], np.zeros(max(0, len(at) - 1), np.int64)
    last = len(data) - 1
    for h, rank in reversed(levels):
        whole = (a + shared + h <= ends[a]) & (b + shared + h <= ends[b])
        shared += h * (whole & (rank[np.minimum(a + shared, last)] == rank[np.minimum(b + shared, last)]))
    for _ in range(3):
        whole = (a + shared < ends[a]) & (b + shared < ends[b])
        shared += whole & (data[np.minimum(a + shared, last)] == data[np.minimum(b + shared, last)])
    shared[group[:-1] != group[1:]] = 0
    return text, at - firsts[text], np.append(shared, 0)


def maximal_repeats(texts: list[bytes], starts: list[int], least: int, groups: list[int] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The suffix array [(text, position)], and its maximal repeats [(length, begin, end)] of at least so many bytes.

    All occurrences of a repeat are the suffixes from begin to end. starts tells
    how many positions of each text, from its first, begin a suffix; the first of
    them has nothing to its left that it could share. Intervals come before those
    that hold them, which have shorter repeats and more occurrences. Texts of
    different groups share nothing.
    """
    text, at, common = suffix_array(texts, starts, groups or [0] * len(texts))
    places = list(zip(text.tolist(), at.tolist(), strict=True))
    common = np.where(common >= least, common, 0)
    found: list[tuple[int, int, int]] = []
    # Only runs of suffixes with long enough prefixes in common have intervals.
    inside = np.concatenate(([False], common > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        # Open intervals: common prefix, first suffix, what stands to the left (a byte, or None once it differs).
        stack: list[tuple[int, int, int | None]] = []
        shares = common[first : end + 1].tolist()
        for i, shared in enumerate(shares, first):
            t, s = places[i]
            begin, byte = i, texts[t][s - 1] if s else -1 - t
            while stack and stack[-1][0] > shared:
                size, begin, held = stack.pop()
                byte = byte if byte == held else None
                if byte is None:
                    found.append((size, begin, i + 1))
            if shared:
                if stack and stack[-1][0] == shared:
                    size, begin, held = stack.pop()
                    byte = byte if byte == held else None
                stack.append((shared, begin, byte))
    return places, found


SPAN = "doc_id long, h long, start long, end long"
_SPAN = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: Bytes of surroundings that one suffix array takes, but for the last anchor's.
ARRAY = 1 << 19
GROUP = "repeat string, length int, ah long, ch long, cl long, place int"
_GROUP = pa.schema([("repeat", pa.string()), ("length", pa.int32()), ("ah", pa.int64()), ("ch", pa.int64()), ("cl", pa.int64()), ("place", pa.int32())])


def _spans(rows: list[tuple], places: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """What the repeats cover, of each example; a suffix's first repeat is its longest."""
    spans: dict[int, list[tuple[int, int]]] = {}
    free = list(range(len(places) + 1))  # the next suffix that no repeat has yet
    for size, begin, end in found:
        at = begin
        while at < end:
            if free[at] == at:
                t, s = places[at]
                spans.setdefault(t, []).append((s, s + size))
                free[at] = at + 1
            at = free[at]
        free[begin] = end
    for t, some in spans.items():
        doc_id, h, a = rows[t][3:6]
        yield from ((doc_id, h, a + x, a + y) for x, y in _merged(some))


def _members(rows: list[tuple], places: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """Each repeat with all its occurrences, as places in kinds of runs; its name is that of its least occurrence."""
    for size, begin, end in found:
        held = sorted((*rows[t][:3], s) for t, s in places[begin:end])
        name = ":".join(map(str, (*held[0], size)))
        yield from ((name, size, *x) for x in held)


def _edges(batches: Iterator[pa.RecordBatch], length: int, take, schema: pa.Schema) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Rows (ah, ch, cl, doc_id, h, a, run, bytes) come sorted by anchor; take makes rows of the maximal repeats of some anchors' surroundings."""
    rows: list[tuple] = []
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        if len(rows) > 1:
            places, found = maximal_repeats([r[7] for r in rows], [r[6] + 1 for r in rows], length, [r[0] for r in rows])
            out = list(take(rows, places, found))
        for at in range(0, max(1, len(out)), 20_000):
            some = out[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > ARRAY and row[0] != rows[-1][0]:
                yield from close()
                rows, size = [], 0
            rows.append(row)
            size += len(row[7])
    yield from close()


def _level(records: DataFrame, texts: DataFrame | None, length: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What one length of anchors tells: records that share an anchor, those of them whose whole run repeats, examples
    of the different surroundings of anchors, and the surroundings (doc_id, h, a, bytes) of anchors that have too many.

    texts gives the bytes of examples where records don't carry them.
    """
    ends = [f(c).alias(f"{name}_{c}") for c in ("ch", "cl") for name, f in (("lo", F.min), ("hi", F.max))]
    anchors = records.groupBy("ah").agg(F.count("*").alias("n"), *ends).where("n > 1")
    anchors = written(anchors.select("ah", "n", F.expr("lo_ch <> hi_ch OR lo_cl <> hi_cl").alias("mixed")), "anchors")
    total = anchors.agg(F.sum("n")).first()[0] or 1
    again = written(spread_join(records, anchors, ["ah"], total).drop("n"), "records")
    mixed = again.where("mixed")
    carried = ["doc_id", "h", "a", "run", *["bytes"] * (texts is None)]
    kinds = written(mixed.groupBy(*KIND).agg(F.count("*").alias("n"), F.min(F.struct(*carried)).alias("example")), "kinds")
    alike = spread_join(mixed, kinds.where("n > 1").select(*KIND, "n"), KIND, total).drop("n")
    whole = again.where("NOT mixed").unionByName(alike)
    examples = kinds.select(*KIND, *(F.col(f"example.{c}").alias(c) for c in carried))
    if texts is not None:
        wanted = examples.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
        found = wanted.join(texts, wanted["_id"].eqNullSafe(texts["doc_id"]) & (wanted["_h"] == texts["h"]))
        found = found.select(*KIND, "doc_id", "h", "a", "run", F.substring(F.col("text"), F.col("a").cast("int") + 1, F.col("run") + length).alias("bytes"))
        examples = written(found.dropDuplicates([*KIND, "doc_id", "h", "a"]), "edges")  # rows that repeat id and text give the same bytes
    many = kinds.groupBy("ah").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("ah")
    few = examples.join(many, "ah", "left_anti").repartition("ah").sortWithinPartitions("ah").select(*KIND, "doc_id", "h", "a", "run", "bytes")
    return again, whole, few, examples.join(many, "ah", "left_semi").select("doc_id", "h", "a", "bytes")


def _levels(texts: DataFrame, length: int, gram: int, hot: int) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """(records, whole, few) of anchors of gram bytes, and of longer ones while some anchor has more than hot surroundings.

    texts has (doc_id, h, text binary), where equal (doc_id, h) have equal texts.
    Anchors of half the remaining length more part hot surroundings, and at last
    whole windows, of which equal ones have none left to differ in.
    """
    if not 0 < gram < length:
        raise ValueError("an anchor is shorter than a repeat")
    source, first = texts.select("doc_id", "h", F.lit(0).cast("long").alias("offset"), "text"), True
    while True:
        size, with_bytes = gram, not first
        records = mapped(source, lambda it, size=size, with_bytes=with_bytes: _records(it, length, size, with_bytes), RECORD + ", bytes binary" * with_bytes)
        again, whole, few, rest = _level(records, texts if first else None, length, hot)
        yield again, whole, few
        if gram == length:
            return
        source = written(rest.select("doc_id", "h", F.col("a").alias("offset"), F.col("bytes").alias("text")), "hot")
        if source.isEmpty():
            return
        gram = length if length - gram < 32 else (gram + length + 1) // 2
        first = False


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, h, start, end): byte spans whose every window of length bytes also starts elsewhere; they may overlap.

    texts has (doc_id, h, text binary), where equal (doc_id, h) have equal texts.
    """
    parts = []
    for _, whole, few in _levels(texts, length, gram, hot):
        parts.append(whole.select("doc_id", "h", F.col("a").alias("start"), (F.col("a") + F.col("run") + length).alias("end")))
        parts.append(mapped(few, lambda it: _edges(it, length, _spans, _SPAN), SPAN))
    return _union(parts)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = named(text_col).cast("string")
    return docs.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("text"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(repeat, length, doc_id, h, start): maximal repeats of at least length bytes with all their occurrences, a row each.

    repeat names a group; h is a hash of the text, which tells rows of one id apart.
    A repeat is maximal within the surroundings of its anchor, which reach up to
    length - gram bytes past the anchor to either side: a longer repeat comes as
    the overlapping groups of the anchors in it, each with all its places. Null
    texts count as empty; an empty table gives no rows; other columns are not read.
    """
    parts = []
    for again, whole, few in _levels(_rows(docs, id_col, text_col), length, gram, hot):
        size = F.col("run") + length
        parts.append(whole.select(F.concat_ws(":", *KIND, F.lit(0), size).alias("repeat"), size.alias("length"), "doc_id", "h", F.col("a").alias("start")))
        groups = mapped(few, lambda it: _edges(it, length, _members, _GROUP), GROUP)
        met = groups.join(again.select(*KIND, "doc_id", "h", "a"), KIND)
        parts.append(met.select("repeat", "length", "doc_id", "h", (F.col("a") + F.col("place")).alias("start")))
    return _union(parts).groupBy("repeat", "length", "doc_id", "h", "start").agg(F.count("*").alias("n")).drop("n")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds removed (merged spans) and kept (the bytes that are left)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in sliced(batches, "text"):
        removed, kept = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs = _merged([(s["start"], s["end"]) for s in spans or ()])
            ends = [0, *(b for _, b in runs)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(text)], strict=True)))
            removed.append([{"start": a, "end": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "text", "removed", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, text binary, removed array<struct<start, end>>, kept binary): a row for each row of docs.

    Every byte is removed that a string of length bytes covers which starts at
    another place too, in any text or the same. Null texts count as empty; texts
    under length bytes have nothing removed. A row that repeats another's id and
    text is another place. Null ids are ids. An empty table gives no rows; other
    columns are not read.
    """
    texts = _rows(docs, id_col, text_col)
    spans = repeated_spans(texts, length, gram, hot)
    by_doc = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans")
    rows = texts.join(by_doc, texts["doc_id"].eqNullSafe(by_doc["_id"]) & (texts["h"] == by_doc["_h"]), "left").select("doc_id", "text", "spans")
    return mapped(rows, _cut, "doc_id long, text binary, removed array<struct<start: long, end: long>>, kept binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed = batch.column("removed").to_pylist()
        texts, kept = batch.column("text").to_pylist(), batch.column("kept").to_pylist()
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()), "n_spans": pa.array(map(len, removed), pa.int64()), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated passages from all documents."""
    cut = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mapped(cut, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
