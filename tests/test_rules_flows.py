"""Rule tables against plain expressions, and taint against a walk over every path."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from verdigris.operators import flows, rules


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("License", {"license"}),
        ("Apache|MIT", {"apache", "mit"}),
        ("[A-Z]{4,}", None),
        ("(foo|ba[rz])+qux?", {"qu"}),
        ("a(bc)?longer", {"longer"}),
        ("(?i)Straße", {"stra"}),
        ("x*", None),
        ("(?=peek)wide", {"wide"}),
        (r"\bword\b", {"word"}),
        (r"\Q(\E", None),
    ],
)
def test_literals_of_expressions(pattern, literals):
    assert rules.required_literals(pattern) == literals


def test_literals_are_in_every_match():
    rng = random.Random(4)
    atoms = ["ab", "c", "[a-c]", "(a|bc)", "(b|)", "a?", "(ca)+", "(?:bb|cc){1,2}", "b*", "(?i:aC)", ".", "(a(b|cb)c)?"]
    for _ in range(400):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 4)))
        literals = rules.required_literals(pattern)
        for _ in range(40):
            text = "".join(rng.choice("abcABC") for _ in range(rng.randint(0, 7)))
            if literals is not None and re.search(pattern, text):
                assert any(x in text.lower() for x in literals), (pattern, text)


def test_spelled_literals_are_in_every_match():
    assert rules.spelled_literals('(["|]|[A-Z]{2})the(s|ed)?[ .,]') == {f"{c}the" for c in '"|ABCDEFGHIJKLMNOPQRSTUVWXYZ'}
    assert rules.spelled_literals("(foo|ba[rz])!") == {"foo!", "bar!", "baz!"}
    assert [rules.spelled_literals(p) for p in ("(?i)abc", "[^a]", "x*", "", r"\Q(\E", "[a-c&&[b]]x", "(a|)")] == [None] * 7
    rng = random.Random(6)
    atoms = ["ab", "c", "[a-c]", "(a|bc)", "(b|)", "a?", "(ca)+", "(?:bb|cc){1,2}", "b*", "[A-C]{2}", ".", "(a(b|cb)c)?", "$", "(?=b)", "[^b]", "[a-zA-C]{4}"]
    for _ in range(600):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 4)))
        literals = rules.spelled_literals(pattern)
        for _ in range(40):
            text = "".join(rng.choice("abcABC") for _ in range(rng.randint(0, 8)))
            if literals is not None and (m := re.search(pattern, text)):
                assert any(x in m.group() for x in literals), (pattern, text)


def test_few_pairs_are_fetched_in_vain(spark):
    """A common word is no literal where the expression asks for a quote or capitals before it."""
    texts = ["all of the words and the rest " * 50, 'say "the" word', "by THthe .", "no such word", "of them in an end"]
    table = [{"rule_id": "t", "name": '(["|]|[A-Z]{2})the(s|ed)?[" .,]', "trigger": "them in", "kind": "forbidden", "pattern": "the"}]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in rules.fetched(docs, table).collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in rules.rule_scan(docs, table).collect()) == [1, 2, 4]


def test_thousands_of_rules_in_one_pass(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    table = [
        {"rule_id": f"r{i}", "name": rng.choice([f"{word(3)}X", f"[0-9]{{2}}{word(2)}", f"({word(3)}|{word(4)})!", "[x-z]{3}"]), "trigger": word(4), "module": rng.choice([None, "mod"]), "kind": rng.choice(["forbidden", "followup", "constant", "other"]), "pattern": f"{word(2)}[0-9]", "expected": word(4)}
        for i in range(5000)
    ]
    texts = [" ".join(rng.choice([word(4), word(3) + "X", "12" + word(2), word(3) + "!", "zzz", "mod", word(2) + "7\n"]) for _ in range(12)) for _ in range(40)] + ["", None, "Z" * 50_000 + "aaaa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def judged(rule, text):
        has = lambda p: re.search(p, text) is not None
        result = {"forbidden": "fail" if has(rule["pattern"]) else "pass", "followup": "cant_tell" if rule["trigger"] not in text else "pass" if has(rule["pattern"]) else "fail", "constant": "pass" if has(rule["expected"]) else "fail" if has(rule["pattern"]) else "cant_tell"}.get(rule["kind"], "cant_tell")
        at = re.search(rule["pattern"], text)
        return result, text[: at.start()].count("\n") + 1 if result == "fail" and at else None

    want = sorted(((r["rule_id"], i, *judged(r, t)) for i, t in enumerate(texts) if t is not None for r in table if (r["trigger"] in t or re.search(r["name"], t)) and (not r["module"] or r["module"] in t)), key=str)
    assert sorted(map(tuple, rules.rule_scan(docs, table).collect()), key=str) == want
    monkeypatch.setattr(rules, "AUTOMATON_RULES", 2000)
    assert sorted(map(tuple, rules.rule_scan(docs, spark.createDataFrame([tuple(r[f] for f in rules.FIELDS) for r in table], rules.RULE)).collect()), key=str) == want


def test_no_rules_and_registered_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    assert rules.rule_scan(docs, []).collect() == []
    rules.register_check("long", lambda rule, text: F.when(F.length(text) > 2, "fail").otherwise("pass"))
    rule = {"rule_id": "x", "name": "b", "trigger": "q", "kind": "long", "pattern": "b"}
    assert sorted(map(tuple, rules.rule_scan(docs, [rule]).collect())) == [("x", 1, "fail", 1), ("x", 2, "pass", None)]


def plain_flows(calls, sources, sinks, forward, backward):
    """Every walk from a source to a sink, the best for each function."""
    nothing = lambda row: any(x is None for x in row)
    calls = {c for c in calls if not nothing(c) and c[0] != c[2]}
    sources, sinks = {s for s in sources if not nothing(s)}, {s for s in sinks if not nothing(s)}
    name = lambda p: f"{p[0]}.{p[1]}"
    best = {}

    def tell(fn, rank, hops, path):
        best[fn] = min(best.get(fn, (9, 0, [])), (rank, hops, path))

    def walk(place, path, most, ends):
        if place in ends:
            yield path
        if len(path) <= most:
            for c, a, d, p in calls:
                if (c, a) == place:
                    yield from walk((d, p), [*path, name((d, p))], most, ends)

    for s in sources:
        for path in walk(s, [name(s)], forward, sinks):
            tell(s[0], 0 if len(path) == 1 else 1, len(path) - 1, path)
        for path in walk(s, [name(s)], backward, sinks):
            if len(path) > 1:
                tell(path[-1].split(".")[0], 2, len(path) - 1, path)
    kind = {0: "direct", 1: "forward", 2: "backward"}
    fns = {c[0] for c in calls} | {c[2] for c in calls} | {s[0] for s in sources | sinks}
    return sorted(((f, "fail", kind[best[f][0]], *best[f][1:]) if f in best else (f, "pass", None, None, None) for f in fns), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_flows_against_every_walk(spark, seed):
    rng = random.Random(seed)
    fns, values = [f"f{i}" for i in range(12)], ["x", "y"]
    calls = [(rng.choice(fns), rng.choice(values), rng.choice(fns), rng.choice(values)) for _ in range(30)]
    calls += [("f0", "x", "f1", "x"), ("f1", "x", "f0", "x"), ("f2", "x", "f2", "y"), ("f3", None, "f4", "x"), calls[0]]
    sources = [(rng.choice(fns), rng.choice(values)) for _ in range(4)] + [("f0", None)]
    sinks = [(rng.choice(fns), rng.choice(values)) for _ in range(3)]
    tables = spark.createDataFrame(calls, "caller string, arg string, callee string, param string"), spark.createDataFrame(sources, "fn string, value string"), spark.createDataFrame(sinks, "fn string, value string")
    for forward, backward in ((2, 1), (5, 3), (0, 0)):
        got = flows.taint_flows(*tables, forward, backward).collect()
        assert sorted(map(tuple, got), key=str) == plain_flows(calls, sources, sinks, forward, backward)


def test_flows_of_nothing(spark):
    none = spark.createDataFrame([], "caller string, arg string, callee string, param string")
    places = spark.createDataFrame([], "fn string, value string")
    assert flows.taint_flows(none, places, places).collect() == []


def test_documents_of_one_split_are_scanned_by_all_cores(spark):
    """Expressions run where the documents are, so those of one partition are dealt to more tasks than there are cores."""
    docs = spark.range(200).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("call("), F.col("id").cast("string"), F.lit(")\nend")).alias("text"))
    rule = {"rule_id": "r", "name": "call", "trigger": "call(", "kind": "forbidden", "pattern": "end"}
    tasks = rules.rule_scan(docs, [rule]).select("doc_id", "line", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.doc_id, r.line) for r in tasks) == [(i, 2) for i in range(200)]
    assert len({r.task for r in tasks}) >= spark.sparkContext.defaultParallelism
