from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from verdigris.llm import exact_dedup, near_copies, simhash
from verdigris.llm.shared import components

from .conftest import ROWS


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_groups_of_odd_rows(odd):
    by = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        by[text or ""].append(doc_id)
    want = []
    for text, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            want.append((i, top, len(ids), i == top and first, sha(text)))
            first = first and i != top
    rows = [tuple(r) for r in exact_dedup.exact_groups(odd).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


@pytest.mark.parametrize(("budget", "bits"), [(20_000, 0), (400, 9), (1 << 20, None)])
def test_grace_partitions_again_until_buckets_fit(spark, budget, bits):
    """900 texts, many of them equal, and two of different hash that share a bucket to the last bit."""
    r = random.Random(budget)
    texts = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 1, 3, 40]))) for _ in range(900)]
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    rows = [(i, bytearray(t), xxhash.xxh3_64_intdigest(t) - (1 << 63), len(t) + exact_dedup.ENTRY_BYTES) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, "local_id long, text binary, h long, takes long")
    got = {r.local_id: r.class_id for r in exact_dedup.grace(held, budget, bits).collect()}
    assert got == {i: min(ids) for ids in want.values() for i in ids}


def test_table_compares_contents_when_hashes_are_equal():
    table = exact_dedup.Table()
    assert [table.find(b"a", 7), table.find(b"b", 7), table.find(b"a", 7)] == [0, 1, 0]


def test_small_tables_give_the_same_groups(spark, odd):
    whole = sorted(map(str, exact_dedup.exact_groups(odd).collect()))
    assert sorted(map(str, exact_dedup.exact_groups(odd, table_bytes=10).collect())) == whole


def test_exact_dedup_keeps_columns_and_one_of_each(spark, odd, clashing, none):
    for docs in (odd, clashing):
        kept = exact_dedup.exact_dedup(docs)
        assert kept.columns == docs.columns
        assert len({r.text or "" for r in kept.collect()}) == kept.count() == len({t or "" for _, t, *_ in ROWS})
    assert kept.where("_sha <> '10 _sha'").count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    repeats = spark.createDataFrame([(7, "x")] * 3 + [(6, "x"), (7, "y"), (None, "z"), (None, "z")], "doc_id long, text string")
    assert sorted(map(str, exact_dedup.exact_dedup(repeats).collect())) == sorted(map(str, [repeats.first(), *repeats.where("text = 'y'").collect(), repeats.where("text = 'z'").first()]))


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().translate(simhash.LOWER).split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, near):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(values)
    for k, a in enumerate(values):
        for b in values[:k]:
            if near(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("shard", [8, 2048])
def test_shard_links_join_what_all_pairs_join(shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)
    r = random.Random(shard)
    marks = sorted({r.getrandbits(5) | r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64) for _ in range(700)})
    want = classes(marks, lambda a, b: (a ^ b).bit_count() <= 2)
    assert dict(simhash.shard_links(marks, list(range(64)))) == {m: t for m, t in want.items() if m != t}


def test_op4_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = classes(texts, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, sf).collect()}
    assert got == {i: (f"{marks[i]:016x}", want[i]) for i in texts}


def test_op4_on_odd_rows(spark, odd, none):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.mark & (1 << 64) - 1): r.component_id for r in rows}
    assert by[3, 0] == by[4, 0] == by[None, 0] == 3
    assert by[2, plain_fingerprint(ROWS[0][1])] == 1
    assert simhash.near_groups(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 400))}


def test_near_copies_are_found_and_others_left(spark, odd, clashing, none):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, groups = [], {}
    for g in range(12):
        base = [word() for _ in range(300)]
        for k in range(6):
            copy = list(base)
            for _ in range(k):
                copy[r.randrange(300)] = word()
            rows.append((100 * g + k, " ".join(copy)))
            groups[100 * g + k] = 100 * g
    rows += [(5000 + i, " ".join(word() for _ in range(200))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups
    for docs in (odd, clashing):
        kept = near_copies.near_copy_dedup(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {1, 3, 4, None, 5, 6, 7}
    assert near_copies.near_copy_dedup(none).count() == 0


def test_near_copies_tell_rows_of_one_id_apart(spark):
    """A row that only shares its id with one that goes stays; repeats of a row that stays stay."""
    a, b, c = ("some words that are long enough for shingles", "other words that nobody has seen before now", "a third text which has words of its own too")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, c + " "), (None, a), (None, None)]
    kept = near_copies.near_copy_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, a), (2, b), (3, c), (3, c), (None, a), (None, None)]))


def test_near_copies_of_sf_equal_all_pairs(spark, sf):
    """Recall and wrong removals against all pairs: none is missed, and none goes that has no neighbour at 0.8."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: set(near_copies.shingles(r.text).tolist()) for r in docs.collect()}
    sets = {i: x for i, x in sets.items() if x}
    want = classes(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    members = {t for i, t in want.items() if i != t}
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: t for i, t in want.items() if t in members}


def test_signatures_tell_similarity():
    words = [f"w{i}" for i in range(400)]
    changed = words[:300] + [f"v{i}" for i in range(100)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    a, b = shingles(words), shingles(changed)
    (_, x), (_, y) = (near_copies.sketch(near_copies.shingles(" ".join(w))) for w in (words, changed))
    assert abs(sum(x == y) / len(x) - len(a & b) / len(a | b)) < 0.08


def test_near_copies_are_decided_by_exact_similarity(spark):
    """Of 396 shingles, 44 others give a similarity of 0.80, and 45 one of 0.796; a repeated passage changes no set."""
    rows, want = [], {}
    for k in range(40):
        for at, changed in ((0, 44), (1000, 45)):
            base = [f"{at}x{k}w{i}" for i in range(400)]
            rows += [(at + 2 * k, " ".join(base)), (at + 2 * k + 1, " ".join(base[: 400 - changed] + [f"{at}y{k}w{i}" for i in range(changed)]))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    passage = [f"p{i}" for i in range(20)]
    rest = [f"r{i}" for i in range(300)]
    rows += [(5000, " ".join(rest + passage)), (5001, " ".join(rest + passage * 200))]
    want |= {5000: 5000, 5001: 5000}
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_block_links_join_what_all_pairs_join():
    r = random.Random(7)
    sets = []
    for _ in range(12):
        base = [r.getrandbits(64) for _ in range(r.choice([4, 5, 30, 100]))]
        for _ in range(r.choice([1, 6, 12])):
            base = [r.getrandbits(64) if r.random() < 0.06 else x for x in base][r.choice([0, 0, 1]) if len(base) > 3 else 0 :]
            sets.append(set(base))
    want = classes(range(len(sets)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert 20 < len(set(want.values())) < len(sets) - 10
    got = dict(near_copies.block_links(list(range(len(sets))), [np.array(sorted(s), np.uint64) for s in sets]))
    assert got == {i: t for i, t in want.items() if i != t}


@pytest.mark.parametrize("pivots", [1, 3])
def test_large_groups_are_parted_with_the_same_result(spark, pivots):
    """A third of all texts come from one page, some only by a chain of copies; limits part bands and blocks alike."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    page, texts = [word() for _ in range(150)], []
    for k in range(60):
        texts.append([word() if r.random() < k / 1500 else w for w in page])
    link = page
    for _ in range(25):  # each is near the one before, the last far from the first
        link = [word() if i in r.sample(range(150), 2) else w for i, w in enumerate(link)]
        texts.append(link)
    for _ in range(12):
        base = [word() for _ in range(80)]
        texts += [base, [word() if i == 40 else w for i, w in enumerate(base)], [word() for _ in range(40)]]
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in rows}
    want = classes(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    want = {i: t for i, t in want.items() if list(want.values()).count(t) > 1}
    assert max(list(want.values()).count(t) for t in want.values()) > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.keep_id for x in near_copies.near_groups(docs, limit=8192, pivots=pivots).collect()}
    assert got == want


def test_near_copies_are_searched_by_simhash(spark):
    """At 0.8 fingerprints differ in the share of bits that the radius and the tables go by; with shards of a few texts the groups are the same."""
    rng = np.random.default_rng(5)
    pairs = []
    for size in (4, 9, 40, 300):
        for _ in range(60):
            shared, own = rng.integers(0, 1 << 64, (2, size + size // 4), np.uint64)
            n, extra = (size, 0) if size == 4 else (8 * size // 9, size // 9)
            a, b = np.sort(np.append(shared[:n], own[:extra])), np.sort(np.append(shared[:n], own[extra : 2 * extra] if extra else own[:1]))
            pairs.append(np.mean(near_copies.simhash_bits(a, 8) != near_copies.simhash_bits(b, 8)))
    share = near_copies.flip_share(0.8)
    assert abs(np.mean(pairs) - share) < 0.03
    assert max(pairs) * 192 < near_copies.radius(192, 0.8)
    assert all((1 - (1 - share) ** bits) ** times <= near_copies.MISS for n in (1, 5000, 10**6, 10**9) for times, bits in [near_copies.tables(n)])
    r = random.Random(3)
    texts = []
    for k in range(150):
        base = [f"{k}w{r.random()}" for _ in range(90)]
        texts += [base, [w if i != k % 90 else "x" for i, w in enumerate(base)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert near_copies.tables(300, shard=8)[1] == 6
    got = {x.doc_id: x.keep_id for x in near_copies.near_groups(docs, shard=8).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_only_texts_that_can_have_near_copies_are_dealt(spark, monkeypatch):
    """Others share a line at most; what is dealt follows the near copies and not all texts, and the groups are those of all pairs."""
    r = random.Random(17)
    line = [f"line{i}" for i in range(8)]
    dealt = []

    def grouped(placed, *more):
        dealt.append(placed.count())
        return group_links(placed, *more)

    group_links = near_copies.group_links
    monkeypatch.setattr(near_copies, "group_links", grouped)
    for others in (100, 500):
        texts = [[f"o{k}w{i}" for i in range(r.choice([60, 120, 300]))] + line for k in range(others)]
        for k in range(20):
            base = [f"n{k}w{i}" for i in range(r.choice([6, 20, 60, 300]))]
            texts += [base, [w if i != k % len(base) else "x" for i, w in enumerate(base)]]
        r.shuffle(texts)
        rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
        sets = {i: set(near_copies.shingles(t).tolist()) for i, t in rows}
        want = classes(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))  # noqa: B023
        want = {i: t for i, t in want.items() if list(want.values()).count(t) > 1}
        assert len(want) > 15
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {x.doc_id: x.keep_id for x in near_copies.near_groups(docs, shard=16).collect()} == want
    # two calls a run: shards, then blocks
    assert dealt[2] < 2 * dealt[0]


def test_near_copies_share_least_shingles():
    """Sets of 0.8 have more than the stated number of their least elements in common; chances are below MISS."""
    for similarity in (0.3, 0.5, 0.8, 0.95, 1):
        k, t = near_copies.least_needed(similarity)
        assert 1 <= t <= k and sum(math.comb(k, i) * similarity**i * (1 - similarity) ** (k - i) for i in range(t)) <= near_copies.MISS
    k, t = near_copies.least_needed(0.8)
    assert (k, t) == (16, 4)
    rng = np.random.default_rng(9)
    for both in (4, 8, 12, 16, 20, 40, 400):
        for _ in range(300):
            whole = rng.permutation(rng.integers(0, 1 << 64, 5 * both // 4, np.uint64))
            cut = int(rng.integers(both, len(whole) + 1))
            a, b = np.sort(whole[:cut]), np.sort(np.append(whole[:both], whole[cut:]))
            shared = len(np.intersect1d(a[:k], b[:k]))
            assert shared * k >= t * min(k, len(a)) and shared * k >= t * min(k, len(b))


@pytest.mark.parametrize("few", [64, 2])
def test_near_copies_that_simhash_misses_are_found(spark, monkeypatch, few):
    """Pairs whose fingerprints are too far apart; and all groups where no shard has a candidate, with the texts of a shingle joined or parted."""
    words = [[f"v{k}x{i}" for i in range(9)] for k in (30214, 41369)]
    docs = spark.createDataFrame([(10 * k + n, " ".join(w[:n])) for k, w in enumerate(words) for n in (8, 9)], "doc_id long, text string")
    if few == 64:
        assert {x.doc_id: x.keep_id for x in near_copies.near_groups(docs).collect()} == {8: 8, 9: 8, 18: 18, 19: 18}
    r = random.Random(23)
    line = [f"line{i}" for i in range(12)]
    texts = [[f"o{k}w{i}" for i in range(r.choice([3, 6, 40]))] + line for k in range(30)]
    for k in range(12):
        base = [f"n{k}w{i}" for i in range(r.choice([8, 20, 60, 900]))]
        texts += [base, base[: len(base) - len(base) // 12], [w if i != len(base) // 2 else "x" for i, w in enumerate(base)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in rows}
    want = classes(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    want = {i: t for i, t in want.items() if list(want.values()).count(t) > 1}
    assert len(want) > 20
    for name, value in (("FEW", few), ("TILE", 4), ("shard_links", lambda members, similarity: [])):
        monkeypatch.setattr(near_copies, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.keep_id for x in near_copies.near_groups(docs).collect()} == want
