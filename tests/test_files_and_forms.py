"""Lock and env files, base58, one form of JSON, lots with faults."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from verdigris.functions import scalars as S
from verdigris.sources import files, lockfiles

V1 = {"name": "app", "lockfileVersion": 1, "dependencies": {"a": {"version": "1.0"}, "@s/b": {"version": "2.0", "dependencies": {"deep": {"version": "3"}}}, "none": {}}}
V2 = {"packages": {"": {"version": "0"}, "packages/own": {"version": "9"}, "node_modules/own": {"resolved": "packages/own", "link": True}, "node_modules/@s/b": {"version": "2.0"}, "node_modules/a/node_modules/c": {"version": "4"}, "node_modules/empty": {"version": ""}, "node_modules/odd": 7}}


def entries(name, text):
    return sorted(x[:2] for x in lockfiles.LockEntries.func().eval(name, text))


def test_npm_locks_of_both_versions():
    assert entries("package-lock.json", json.dumps(V1)) == [("@s/b", "2.0"), ("a", "1.0")]
    assert entries("x/package-lock.json", json.dumps(V2)) == [("@s/b", "2.0"), ("c", "4")]
    for broken in ("", "{", "[1]", '{"packages": 3, "dependencies": null}', None):
        assert entries("package-lock.json", broken) == []
    assert entries("node_modules/q/package-lock.json", json.dumps(V1)) == entries(".hidden/package-lock.json", json.dumps(V1)) == []


def test_locks_by_lines():
    assert entries("Cargo.lock", '[[package]]\nname = "a"\nversion = "1"\n[package.x]\nversion = "2"\n[[package]]\nversion = "3"\nname = "b"\n[[package]]\nname = "c"\n[metadata]\nname = "m"\nversion = "4"\n') == [("a", "1"), ("b", "3")]
    assert entries("yarn.lock", '# x@y\na@^1, a@^2:\n  version "1.5"\n  dependencies:\n    version "9"\n"@s/p@npm:^3":\n  version: 3.1\n__metadata:\n  version: 6\n') == [("@s/p", "3.1"), ("a", "1.5")]
    assert entries("pnpm-lock.yaml", "packages:\n\n  /a@1.0(peer@2):\n    engines: {x: y}\n  '@s/b@2.0':\n    dev: true\nsnapshots:\n  c@3:\n    x: y\n") == [("@s/b", "2.0"), ("a", "1.0")]
    assert entries("Gemfile.lock", "GEM\n  specs:\n    a (1.0)\n      b (>= 1)\n\nDEPENDENCIES\n    c (2)\n") == [("a", "1.0")]
    assert entries("go.mod", "require a.b/c v1.0.0\nrequire (\n\ta.b/d v2.0.0 // indirect\n\ta.b/e master\n)\nexclude (\n a.b/f v3.0.0\n)\nreplace a.b/c => a.b/g v9.0.0\n") == [("a.b/c", "v1.0.0"), ("a.b/d", "v2.0.0")]
    assert entries("requirements.txt", "a == 1.0 # x\n b==2\nc>=3\n-r d\n") == [("a", "1.0"), ("b", "2")]
    assert entries("composer.lock", '{"packages": [{"version": "v1", "name": "a/b"}, {"name": "x/y"}, 4], "packages-dev": [{"name": "c/d", "version": "2"}]}') == [("a/b", "1"), ("c/d", "2")]


def test_one_entry_of_a_package_in_a_repository(spark):
    rows = [("r", "poetry.lock", '[[package]]\nname = "a"\nversion = "1"\n'), ("r", "requirements.txt", "a==1\na==2\n"), ("q", "requirements.txt", "a==1"), ("q", "other.txt", "b==1"), ("q", None, None)]
    got = sorted(map(tuple, files.lockfile_inventory(spark.createDataFrame(rows, "repo string, file string, text string")).collect()))
    assert got == [("q", "a", "1", "pypi", "requirements.txt"), ("r", "a", "1", "pypi", "poetry.lock"), ("r", "a", "2", "pypi", "requirements.txt")]


def test_env_files(spark):
    text = "A=1\r\n# B=2\n  export C = 'x y' \nD=\n3E=4\nF=\"open\n_g=a=b # c\nH='"
    rows = spark.createDataFrame([("r", ".env", text), ("r", ".env2", None)], "repo string, file string, text string")
    assert sorted((r.line_no, r.name, r.value) for r in lockfiles.env_entries(rows).collect()) == [(1, "A", "1"), (3, "C", "x y"), (6, "F", '"open'), (7, "_g", "a=b # c"), (8, "H", "'")]


def decoded_length(text):
    n = 0
    for c in text:
        n = n * 58 + S.BASE58.index(c)
    return len(text) - len(text.lstrip("1")) + (n.bit_length() + 7) // 8


def test_base58_lengths_without_numbers(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(S.BASE58) for _ in range(n)) for n in range(80, 91) for _ in range(12)] + ["1" * z + rng.choice(S.BASE58[1:]) + "".join(rng.choice(S.BASE58) for _ in range(n)) for z in (1, 3, 20, 40, 62, 63, 64) for n in (0, 1, 27, 59, 60, 80, 83)]
    for k in (62, 63, 64):
        texts += S.base58_thresholds(64)[k:] + ["1" + x for x in S.base58_thresholds(64)[k:]] + ["z" * 86, "z" * 87, "1" * 64, "1" * 65]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", S.base58_decodes_to(F.col("x"), 64).alias("ok")).collect()
    assert all(r.ok == (decoded_length(r.x) == 64) for r in rows) and {r.ok for r in rows} == {True, False}
    odd = spark.createDataFrame([("",), (None,), ("0" * 88,), ("é" * 88,)], "x string").select(S.base58_decodes_to(F.col("x"), 64).alias("ok")).collect()
    assert not any(r.ok for r in odd)


def test_one_form_of_json(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {rng.choice("abcxyz") + rng.choice(["", "é", '"', "\n"]): value(depth - 1) for _ in range(rng.randrange(5))}
        return [rng.randint(-(10**12), 10**12), rng.choice(["", "a\\b", "tab\t", "\u0001", "漢字 🙂", "/"]), None, rng.random() < 0.5][kind]

    def shuffled(v):
        if isinstance(v, dict):
            items = [(k, shuffled(x)) for k, x in v.items()]
            rng.shuffle(items)
            return dict(items)
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    values = [value(4) for _ in range(200)]
    rows = [(i, json.dumps(shuffled(v), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for i, v in enumerate(values) for _ in range(2)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", S.canonical_json(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.c == json.dumps(values[r.i], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    odd = spark.createDataFrame([("{",), (None,), ("1.50",), ('{"a":1,"a":2}',)], "t string").select(S.canonical_json(F.col("t")).alias("c")).collect()
    assert [r.c for r in odd] == [None, None, "1.5", None]


def test_lots_tell_their_faults(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"rec_no": 1, "trap_id": "x"}\n\n  \n{"rec_no": 2\nnothing\n{"rec_no": "text"}\n{}\n')
    rows, faults = files.lots_with_faults(spark, {"a": f"{tmp_path}/a.jsonl", "b": f"{tmp_path}/b.jsonl", "c": f"{tmp_path}/none/*.jsonl"})
    assert sorted((r.lot, r.rec_no) for r in rows.collect() if r.rec_no) == [("a", 1)] and rows.count() == 2
    assert sorted(map(tuple, faults.collect()), key=str) == [("a", "malformed", "nothing"), ("a", "malformed", '{"rec_no": "text"}'), ("a", "malformed", '{"rec_no": 2'), ("b", "missing", None), ("c", "missing", None)]
    rows, faults = files.lots_with_faults(spark, {"b": f"{tmp_path}/b.jsonl"})
    assert rows.count() == 0 and faults.count() == 1


def test_documents_are_written_by_all_tasks(spark, sf):
    """A file for each document, and not all of them by the task that reads a small table."""
    from verdigris.plans import registry

    names = [f.rsplit("/", 1)[-1] for f in registry.queries()["document_scan"](spark, sf).inputFiles()]
    assert len(names) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len({n.split("-")[1] for n in names}) > 1
