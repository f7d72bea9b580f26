"""Verbatim runs against every diagonal, and the clean-room gate's codes."""

from __future__ import annotations

import hashlib
import random

import pytest

from verdigris.operators import leaks


def plain_runs(a, b, span):
    out = []
    for diagonal in range(-len(b), len(a) + 1):
        run = 0
        for i in range(max(0, diagonal), min(len(a), len(b) + diagonal) + 1):
            if i < len(a) and i - diagonal < len(b) and a[i] == b[i - diagonal]:
                run += 1
            else:
                if run >= span:
                    out.append((i - run, i - run - diagonal, run))
                run = 0
    return out


@pytest.mark.parametrize("span", [40, 12, 7, 2])
def test_runs_against_every_diagonal(spark, span):
    rng = random.Random(span)
    source = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    items = [source(rng.randint(0, 160), "ab\n"), source(90, "abcdefgh é🙂"), "x" * 55, "ab" * 40, source(span, "pqr")]
    docs = ["", "x" * 100, "ab" * 35 + "b" + "ab" * 30, *items]
    for _ in range(12):
        item = rng.choice(items)
        at = rng.randint(0, max(0, len(item) - 1))
        docs.append(source(rng.randint(0, 50), "ab\n") + item[at : at + rng.randint(0, 90)] + source(rng.randint(0, 50), "abé") + item[:45])
    left = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(0, docs[0]), (99, None), (None, items[1])], "doc_id long, text string")
    right = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (None, docs[3])], "item_id long, text string")
    got = sorted(map(tuple, leaks.verbatim_spans(left, right, span).collect()))
    assert got == sorted((d, i, *run) for d, a in enumerate(docs) for i, b in enumerate(items) for run in plain_runs(a, b, span))
    assert {tuple(r) for r in leaks.verbatim_span_guard(left, right, span).collect()} == {r[:2] for r in got}


def test_codes_of_the_clean_room(spark):
    line = "const fee = amount * 0.03; // upstream wrote this line"
    sha = hashlib.sha256(line.encode()).hexdigest()
    ref = "o/r@" + "a" * 40 + ":x.ts"
    good = {"rec_no": 1, "origin": "wild", "red": True, "green": True, "source_ref": ref, "evidence_sha256": sha, "fetched": line, "evidence": None, "vulnerable": "own()", "fixed": "own2()", "payload": '{"a":1}'}
    rows = [
        (good, []), (good | {"rec_no": 2, "payload": '{"p":{"evidence":""}}', "green": False}, ["evidence-leak", "not-proven"]), (good | {"rec_no": 3, "source_ref": "o/r@main:x", "evidence_sha256": None}, ["bad-sourceref", "no-hash"]),
        (good | {"rec_no": 4, "fetched": "moved"}, ["dead-pointer"]), (good | {"rec_no": 5, "fixed": f"a\n{line}\nb"}, ["verbatim-span"]), (good | {"rec_no": 6, "fetched": None, "evidence": f"  {line}\t", "vulnerable": line}, ["verbatim-span"]),
        (good | {"rec_no": 7, "origin": "owned", "source_ref": None, "evidence_sha256": None, "red": None}, ["not-proven"]), (good | {"rec_no": 8, "fetched": "short", "evidence_sha256": hashlib.sha256(b"short").hexdigest(), "vulnerable": "short"}, []),
    ]
    schema = "rec_no long, origin string, red boolean, green boolean, source_ref string, evidence_sha256 string, fetched string, evidence string, vulnerable string, fixed string, payload string"
    table = spark.createDataFrame([tuple(r.values()) for r, _ in rows], schema)
    assert {r.rec_no: r.issues for r in leaks.cleanroom_issues(table).collect()} == {r["rec_no"]: codes for r, codes in rows}
    sources = spark.createDataFrame([(1, f"before {line} after")], "item_id long, text string")
    met = {r.rec_no for r in leaks.cleanroom_issues(table, sources).collect() if "verbatim-span" in r.issues}
    assert met == {5, 6}
    assert {r.rec_no for r in leaks.cleanroom_issues(table, sources.limit(0)).collect()} == set(range(1, 9))
