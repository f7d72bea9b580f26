from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from verdigris.llm import bpe, mixing, quality, topk, urls
from verdigris.llm.shared import written
from verdigris.llm.simhash import LOWER

from .conftest import ROWS


def test_bit_slices_equal_sorting():
    r = np.random.default_rng(3)
    for n, span in ((1, 3), (70, 2), (500, 90), (200, 1), (60, 10**30)):
        values, ids = r.integers(-min(span, 10**9), min(span, 10**9) + 1, (n, 12)), r.permutation(n) * 3
        if span > 10**9:
            values = values.astype(object) * 10**21 + 7
        index = topk.BitSlices.of(ids, values)
        for q in range(0, n, 37):
            scores = values @ values[q]
            order = sorted((i for i in range(n) if ids[i] != ids[q]), key=lambda i: (-scores[i], ids[i]))[:20]
            found, told = index.best(values[q], 20, ids[q])
            assert sorted(found) == sorted(ids[order])
            assert sorted(told) == sorted(scores[order])


def test_topk_of_odd_vectors(spark):
    nan, inf = float("nan"), math.inf
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [9.0, 9.0])]
    # The extra columns clash with names that the operator uses.
    vectors = topk.quantised(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, block int, q int"))
    for block in (8192, 2):
        got = [tuple(r) for r in topk.top_inner_products(vectors, vectors.where("vec_id % 20 = 0"), 20, block=block, group=1).collect()]
        best = [(r[2], r[3]) for r in sorted(got) if r[0] == 0]
        assert best == [(7, 64 * 64 * 5), (7, 64 * 64 * 5), (6, 4096), (5, 0), (20, 32 * 64 - 64 * 128)]
    assert topk.top_inner_products(vectors.limit(0), vectors, 20).count() == 0


@pytest.mark.parametrize("block", [8192, 2])
def test_topk_keeps_finite_vectors_of_any_size(spark, block):
    """Scores within a long are exact; those beyond it rank exactly and show the end of the longs."""
    rows = [(0, [1e8, 1.0]), (1, [1e8, 0.0]), (2, [3e38, 0.0]), (3, [2.5e38, 9.0]), (4, [-3e38, 0.0]), (5, [1.5, 0.25]), (6, [0.0] * 40 + [1e9])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    floors = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows}
    score = {i: sum(a * b for a, b in zip(floors[0], floors[i])) for i in floors if i}
    want = sorted(score, key=lambda i: (-score[i], i))
    got = topk.top_inner_products(vectors, vectors.where("vec_id = 0"), 20, block=block).orderBy("rank").collect()
    assert [r.vec_id for r in got] == want
    assert [r.score for r in got] == [min(max(score[i], -(2**63)), 2**63 - 1) for i in want]


def test_topk_of_very_long_vectors(spark):
    vectors = topk.quantised(spark.createDataFrame([(0, [0.5] * 30_000), (1, [0.25] * 20_000), (2, [1.0])], "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.top_inner_products(vectors, vectors.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 20_000 * 32 * 16), (0, 2, 2, 32 * 64)]


def test_urls_of_odd_pages(spark):
    rows = [
        (1, None), (2, "no host"), (3, "http://EXAMPLE.net/en/x"), (4, "http://a.net"), (5, "http://a.net/"), (6, "x://www.spam-farm.example.com/en/1"),
        (7, "http://notspam-farm.example.com/"), (8, "http://www.Cheap-Pills.example.org/fr/9"), (9, "http://ok.example.com/de/1?x=http://y.net/"), (9, "http://ok.example.com/de/1?x=http://y.net/"), (10, "http://h?q=/wp-login.php#"), (None, "http://é.org/fr"),
    ]
    pages = spark.createDataFrame([(a, b, "", "") for a, b in rows], "page_id long, url string, html string, token string")
    got = sorted((tuple(r) for r in urls.judged(pages).collect()), key=str)
    want = [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.net", "/en/x", "example.net/en/", "allow"), (4, "a.net", "", None, "allow"), (5, "a.net", "/", "net/", "block"), (6, "www.spam-farm.example.com", "/en/1", None, "block"),
        (7, "notspam-farm.example.com", "/", None, "allow"), (8, "www.cheap-pills.example.org", "/fr/9", "org/fr/", "allow"), *[(9, "ok.example.com", "/de/1", "example.com/de/", "block")] * 2, (10, "h", "", None, "block"), (None, "é.org", "/fr", None, "allow"),
    ]
    assert got == sorted(want, key=str)
    assert urls.judged(pages.limit(0)).count() == 0


def test_urls_of_many_rules_and_long_urls(spark):
    """3000 listed rules, of equal lengths too, and rules without a token; against trying each."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    listed = tuple({f"{word(2)}.{word(2)}/{word(r.choice([0, 1, 2]))}": r.choice(["block", "allow"]) for _ in range(3000)}.items()) + (("é/", "allow"), ("aa.bb/Cc", "block"))
    found = [f"http://{r.choice(['', 'x.'])}{word(2)}.{word(2)}/{word(3)}" for _ in range(300)] + ["http://é/x", "http://AA.bb/Cc", "http://aa.bb/cc", "http://a.b/" + "long/" * 40_000 + "wp-login.php"] * 2
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in urls.judged(pages, listed=listed).collect()}
    for i, url in enumerate(found):
        host, _, path = url[7:].partition("/")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(rule), rule, verdict) for rule, verdict in listed if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0])) and ("/" + path).startswith("/" + rule.partition("/")[2])]
        want = max(fits)[1:] if fits else (None, "block" if "wp-login" in url else "allow")
        assert got[i] == want, url


def test_patterns_of_hosts_and_exceptions(spark):
    found = {
        "http://casino.example/": "block", "http://www.casino-x.example/": "block", "http://best-casino.example/": "block", "http://a-casino-b.example/": "block", "http://mycasino.example/": "allow", "http://news.example/casino.html": "allow",
        "http://news.example/a-casino.html": "allow", "http://casino.state.gov/": "allow", "http://casino.gov.example/": "block", "http://spam-filter.example/": "allow", "http://x.example/wp-login.php": "block", "http://spam-filter.example/wp-login.php": "allow",
        "http://x.example/download/a.exe": "block", "http://x.example/download/a.exe?b": "allow", "x://[casino]/": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    own = spark.createDataFrame([(p,) for p in (*urls.PATTERNS, None)], "pattern string")
    for patterns in (urls.PATTERNS, own):
        got = {r.page_id: r.verdict for r in urls.judged(pages, patterns, listed=()).collect()}
        assert [got[i] for i in range(len(found))] == list(found.values())
    assert len(urls.PATTERNS) > 150


def test_thousands_of_patterns_against_trying_each(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    forms = ["||{}.$host", "||{}-$host", "-{}.$host", "|{}.{}^$host", "||*.{}^$host", "/{}/*.{}|", "^{}={}^", "@@||{}.", "@@-{}-$host", "{}", "*{}*"]
    patterns = tuple({form.format(word(2), word(2)) for form in forms for _ in range(300)})
    assert len(patterns) > 180
    some = [f"http://{r.choice(['', 'x.', word(2) + '-'])}{word(2)}{r.choice(['.', '-'])}{word(2)}.{word(2)}/{word(3)}/{word(2)}.{word(2)}{r.choice(['', '?' + word(2) + '=' + word(2)])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    got = {x.page_id: x.verdict for x in urls.judged(pages, patterns, listed=()).collect()}
    for i, url in enumerate(some):
        host = url[7:].split("/")[0]
        hits = {urls.pattern_parts(p)[0] for p in patterns if re.search(urls.pattern_regex(p), f"|{host}|" if urls.pattern_parts(p)[2] else url)}
        assert got[i] == ("block" if hits == {"block"} else "allow"), url


def test_pattern_tokens_are_delimited():
    assert urls.pattern_tokens("||spam-farm.") == ["spam", "farm"]
    assert urls.pattern_tokens("/affiliate/*/click^") == ["affiliate", "click"]
    assert urls.pattern_tokens("ad*banner") == []


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id: r.kept for r in quality.resampled(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "kept").collect()}
    seen = Counter((r.quality, kept[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect())
    assert seen[1, True] >= 0.98 * (seen[1, True] + seen[1, False])
    assert seen[0, False] >= 0.85 * (seen[0, True] + seen[0, False])


def plain_buckets(text):
    """Buckets of words, word pairs, and their shapes, one at a time."""
    def bucket(h):
        return (h * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> (64 - 14)

    out = []
    shape = lambda w: bytes(97 if 97 <= c < 123 or c >= 128 else 65 if 65 <= c < 91 else 57 if 48 <= c < 58 else c for c in w)
    for seed, words in enumerate((text.encode().split(), [shape(w) for w in text.encode().split()])):
        hashed = [crc32(w) + (seed << 32) for w in words]
        out += map(bucket, hashed)
        out += [bucket((a * 0x9E3779B97F4A7C15 + b & (1 << 64) - 1) ^ 1 << 40) for a, b in zip(hashed, hashed[1:])]
    return out


def plain_draw(spark, sf):
    """Scores by plain counting, and the draw by sorting log weights with their noise."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(F.col("doc_id"), F.col("text")).alias("g")).collect()}
    label = {}
    for r in labels.collect():
        label[r.doc_id] = min(r.quality, label.get(r.doc_id, 1))
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(plain_buckets(t))
        if label.get(i) == 1:
            target.update(plain_buckets(t))
    size = 1 << 14
    ratio = lambda b: math.log((target[b] + 0.5) / (sum(target.values()) + 0.5 * size)) - math.log((raw[b] + 0.5) / (sum(raw.values()) + 0.5 * size))
    ratios = {b: ratio(b) for b in raw}
    score = {i: sum(ratios[b] for b in plain_buckets(t)) for i, t in texts.items() if t.split()}
    k = round(len(score) * sum(label.values()) / len(label))
    return score, sorted(sorted(score, key=lambda i: score[i] + noise[i], reverse=True)[:k])


def test_quality_equals_brute_force(spark, sf):
    score, drawn = plain_draw(spark, sf)
    texts = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in quality.op2_quality(spark, sf).collect()}
    assert set(got) == texts
    assert sorted(i for i, r in got.items() if r.kept) == drawn
    for i, r in got.items():
        assert r.quality_score == pytest.approx(score[i], abs=1e-5) if i in score else r.quality_score is None


def test_noise_is_gumbel_and_decides_among_equal_weights(spark):
    """Equal texts but for an id: the draw is by noise alone, whose mean and variance are those of the distribution."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    values = [r.g for r in docs.select(quality.gumbel(F.col("doc_id"), F.col("text")).alias("g")).collect()]
    assert abs(np.mean(values) - 0.5772) < 0.04
    assert abs(np.var(values) - math.pi**2 / 6) < 0.08
    rows = quality.resampled(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), k=5000).collect()
    assert sum(r.kept for r in rows) == 5000
    order = sorted(range(20_000), key=values.__getitem__, reverse=True)
    assert {r.doc_id for r in rows if r.kept} == set(order[:5000])


def test_quality_of_odd_rows(spark, odd, clashing, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 0), (7, None, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd, clashing):
        rows = quality.resampled(docs, labels)
        assert rows.columns == [*docs.columns, "quality_score", "kept"]
        assert all(not r.kept and r.quality_score is None for r in rows.collect() if not (r.text or "").split())
        assert rows.count() == len(ROWS)
    assert quality.resampled(odd, labels.limit(0)).where("kept").count() == 7
    assert quality.resampled(none, labels).count() == 0


def test_kth_largest(spark):
    r = random.Random(4)
    keys = [r.randrange(-(2**63), 2**63) for _ in range(500)] + [5] * 20
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 3, 250, 520):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def plain_exponent(shares, entropy, passes, budget=None):
    """By plain bisection, each condition on its own."""
    n = len(shares)

    def measures(alpha):
        z = sum(s**alpha for s in shares)
        w = [s**alpha / z for s in shares]
        f = [x / s * (budget or 1) for x, s in zip(w, shares)]
        return -sum(x * math.log(x) for x in w), max(f) if budget else max(f) / min(f)

    def cross(low, high, holds):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(*measures(mid)) else (low, mid)
        return low

    target = cross(0.0, 16.0, lambda h, _: h >= entropy * math.log(n))
    if target < 1:
        return max(target, cross(0.0, 1.0, lambda _, p: p > passes))
    return min(target, cross(1.0, 16.0, lambda _, p: p <= passes))


def skewed(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), s) for i, s in enumerate(["hot"] * 3000 + ["mid"] * 900 + ["low"] * 300 + [None] * 100)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def lifted(shares, lift):
    """The target that a lift stands for, as a share of the largest entropy."""
    own, most = -sum(s * math.log(s) for s in shares), math.log(len(shares))
    return (own + lift * (most - own)) / most


def plain_mixture(spark, docs, entropy, passes, budget, block_size=512, seed=7):
    """How often each row is taken, by sorting; only the hashes and the last digits of the exponent come from Spark."""
    place = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = [(r.doc_id, r.source, len((r.text or "").split()), r.place) for r in docs.select("*", place.alias("place")).collect()]
    tokens, count = Counter(), Counter()
    for _, s, n, _ in rows:
        tokens[s] += n
        count[s] += 1
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}
    totals = mixing.source_totals(docs.select("source", mixing.n_words(F.col("text")).alias("n_tokens")))
    alpha = mixing.exponent(totals, entropy, passes, budget and budget * total)
    target = lifted(shares.values(), mixing.LIFT) if entropy is None else entropy
    assert alpha == pytest.approx(plain_exponent(list(shares.values()), target, passes, budget), abs=1e-6)
    z = sum(p**alpha for p in shares.values())
    size = total * budget if budget else total * z / min(p ** (alpha - 1) for p in shares.values())
    made = spark.createDataFrame([(p, s, max(1, math.ceil(count[s] / block_size))) for _, s, _, p in rows], "place long, source string, blocks int")
    made = made.withColumn("block_no", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("blocks")).cast("int")).withColumn("turn", F.xxhash64(F.lit(seed + 2), "source", "block_no"))
    where = {(r.source, r.place): (r.turn % math.ceil(math.sqrt(r.blocks)), r.turn, r.block_no) for r in made.collect()}
    times = Counter()
    for s, share in shares.items():
        goal = round(share**alpha / z * size / tokens[s], 9)
        whole, rest = int(goal), int((goal - int(goal)) * tokens[s])
        mine = sorted((where[s, p], p, n, i) for i, src, n, p in rows if src == s)
        blocks = sorted({m[0] for m in mine})
        for b in blocks:
            of = [m for m in mine if m[0] == b]
            held = sum(m[2] for m in of)
            run, ended = 0, held > rest
            for _, _, n, i in of:
                run += n
                times[i] += whole + (rest > 0 and run <= rest if ended else True)
            rest = max(0, rest - held) if not ended else 0
            if ended:
                rest = -1
    return +times, alpha, size


@pytest.mark.parametrize(("entropy", "passes", "budget", "block"), [(0.95, 4.0, 1.0, 512), (0.95, 2.0, None, 32), (0.3, 50.0, 1.0, 32), (0.4, 1.5, 1.2, 512), (None, 4.0, None, 512)])
def test_mixture_equals_brute_force(spark, monkeypatch, entropy, passes, budget, block):
    """Exponents under and over 1, bound by entropy and by passes; every row that is taken, and how often."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows, docs = skewed(spark)
    want, alpha, size = plain_mixture(spark, docs, entropy, passes, budget, block)
    assert abs(alpha - 1) > 0.01
    got, taken = Counter(), 0
    for r in mixing.mixed(docs, entropy, passes, budget).collect():
        got[r.doc_id] += 1
        taken += r.n_tokens
    assert got == want
    assert abs(taken - size) <= 4 * 40
    assert max(got.values()) <= math.ceil(passes + 1e-6)
    if budget is None:
        assert len(got) == len(rows)


def entropy_of(shares, alpha):
    powers = [(s / max(shares)) ** alpha for s in shares]
    return -sum(x * math.log(x) for x in (p / sum(powers) for p in powers) if x)


@pytest.mark.parametrize("spread", [0.5, 0.02, 0.001])
def test_exponents_have_no_upper_end(spark, spread):
    """Sources that are nearly equal: the target is met whatever exponent it takes."""
    r = random.Random(4)
    sizes = [10_000_000 + round(10_000_000 * spread * r.random()) for _ in range(20)]
    shares = [n / sum(sizes) for n in sizes]
    totals = spark.createDataFrame([(f"s{i}", n, 1, x) for i, (n, x) in enumerate(zip(sizes, shares))], "source string, tokens long, docs long, share double")
    alpha = mixing.exponent(totals, 0.95, 1e9, float(sum(sizes)))
    assert entropy_of(shares, alpha) == pytest.approx(0.95 * math.log(20), abs=1e-4)
    assert spread > 0.1 or alpha > 50
    low = mixing.exponent(totals, lift=0.5)
    assert entropy_of(shares, low) == pytest.approx(lifted(shares, 0.5) * math.log(20), abs=1e-9) and 0 < low < 1
    weights = [r.weight for r in mixing.plan(totals, alpha, float(sum(sizes))).collect()]
    assert sum(weights) == pytest.approx(1) and max(weights) > 0.05


def test_targets_that_none_can_meet(spark):
    of = lambda sizes: spark.createDataFrame([(f"s{i}", n, 1, n / sum(sizes)) for i, n in enumerate(sizes)], "source string, tokens long, docs long, share double")
    assert mixing.exponent(of([5, 5, 5, 5]), 0.9) == mixing.exponent(of([5, 5, 5, 5])) == 1.0
    assert mixing.exponent(of([9, 9, 9, 1]), 0.5) == 1.0  # three tie, so entropy stays over log 3
    assert mixing.exponent(of([7]), 0.5) == mixing.exponent(of([]), 0.5) == 1.0
    assert mixing.exponent(of([10, 1]), 1.0, 3.0) == pytest.approx(1 - math.log(3) / math.log(10), abs=1e-6)


def test_op7_target_binds(spark, sf):
    """The registered mixture isn't the corpus once over: its exponent is not 1."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, alpha, _ = plain_mixture(spark, docs, None, mixing.MOST_PASSES, 1.0)
    assert 0 < alpha < 0.9
    assert Counter(r.doc_id for r in mixing.op7_mixing(spark, sf).collect()) == want


def test_mixture_of_odd_rows(spark, odd, clashing, none):
    for docs in (odd, clashing):
        rows = mixing.mixed(docs)
        assert rows.columns == [*docs.columns, "n_tokens", "pass_no", "block_no"]
        assert {r[0] for r in rows.collect()} == {r[0] for r in ROWS}
    assert rows.where("_order <> '7 _order'").count() == 0
    assert mixing.mixed(none).count() == 0


def shingles(text):
    tokens = text.encode().translate(LOWER).split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def test_pipeline_equals_plain_stages(spark, sf):
    """Each stage against a plain version on the same input, and run() against the stages one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    quality_stage, exact_stage, near_stage, mixing_stage, encoding_stage = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = written(quality_stage(spark, docs, sf), "good")
    assert good.columns == docs.columns
    kept = ids(good)
    assert kept == plain_draw(spark, sf)[1]

    exact = written(exact_stage(spark, good, sf), "exact")
    largest = {}
    for i in kept:
        largest[texts[i]] = max(i, largest.get(texts[i], -1))
    assert (exact.columns, ids(exact)) == (docs.columns, sorted(largest.values()))

    near = written(near_stage(spark, exact, sf), "near")
    before, after = ids(exact), set(ids(near))
    sets = {i: shingles(texts[i]) for i in before}
    for i in before:
        alike = [len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in before if j < i]
        if max(alike, default=0) >= 0.8:
            assert i not in after
        elif all(len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) < 0.8 for j in before if j > i):
            assert i in after
    assert near.columns == docs.columns

    mixture = written(mixing_stage(spark, near, sf), "mixture")
    times = Counter(ids(mixture))
    assert mixture.columns == docs.columns
    assert set(times) == after
    assert max(times.values()) <= 2

    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks, special_tokens={})
    plain = {i: ",".join(map(str, tik.encode_ordinary(texts[i]))) for i in after}
    want = sorted((i, hashlib.sha256(plain[i].encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i in times.elements())
    row = lambda r: (r.doc_id, r.ids_sha256, r.decoded_sha256)
    assert sorted(map(row, encoding_stage(spark, mixture, sf).collect())) == want
    assert sorted(map(row, corpus_pipeline.run(spark, sf).collect())) == want


def test_pipeline_of_odd_clashing_and_empty_tables(spark, clashing, none, folder):
    """Columns of every inner name come through, and null ids, sources and texts; an empty table gives nothing."""
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    more = clashing.withColumns({"kept": F.lit("k"), "pass_no": F.lit("p"), "quality_score": F.lit("q"), "row": F.lit("r")})
    at = folder(documents=more, labels=labels)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = written(stage(spark, docs, at), f"odd_{k}")
        assert docs.columns == more.columns, name
    rows = docs.collect()
    assert {r[0] for r in rows} == {2, None, 5, 6, 7}
    assert {(r["kept"], r["pass_no"], r["quality_score"], r["row"], r["_sha"]) for r in rows} == {("k", "p", "q", "r", "10 _sha")}
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).collect()} == {2, None, 5, 6, 7}
    empty = folder(documents=none, labels=labels.limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0
