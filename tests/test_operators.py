"""Cases that the tables don't hold: nulls, ties, tampering, batches that come again."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris.functions import scalars as S
from verdigris.operators import access, corpus, hive, ledgers, merges, money, reports, texts
from verdigris.sources import files
from verdigris.streaming import streams

RECORD = "rec_no long, trap_id string, sdk_name string, sdk_version string, class string, severity string, corroboration long, red boolean, green boolean, captured_at long, license string, lot string, snippet string"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "t1", "a", "1", "auth-bypass", "critical", 5, True, True, 100, "MIT", "seed", "x  y"),
        (2, "t1", "a", "1", "auth-bypass", "critical", 2, True, True, 200, "MIT", "seed", " x y "),
        (3, "t2", "b", None, "other", "odd", -1, True, None, None, None, "seed", None),
        (4, "t3", "b", "2", "novel", "low", None, True, True, 300, "GPL-3.0", "contrib", ""),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_scores_and_keys(records):
    rows = {r.rec_no: r for r in corpus.scored(records).collect()}
    assert [rows[i].score for i in (1, 2, 3, 4)] == [100, 76, 0, 18]
    assert rows[1].content_key == rows[2].content_key != rows[3].content_key
    assert {r.rec_no: r.duplicate_of for r in corpus.first_seen_dedup(corpus.scored(records)).collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_feed_holds_back_and_resumes(records):
    assert [r.rec_no for r in access.feed_select(records, limit=2).collect()] == [1, 2]
    assert [r.rec_no for r in access.feed_select(records, since=100).collect()] == [2, 4]
    counts = access.feed_counts(records, 1, None, 1, 3600 + 250).first()
    assert (counts.matched, counts.held_back, counts.emitted, counts.capped, counts.cursor) == (3, 1, 1, 1, 100)
    none = access.feed_counts(records.limit(0), 1, 7, 0, 0).first()
    assert (none.matched, none.emitted, none.cursor) == (0, 0, 7)


def test_lots_and_tiers(spark):
    assert access.expand_lots(["crypto"], ["WEB3", "web3"]) == ["crypto", "solana", "evm"]
    with pytest.raises(ValueError, match="unknown bundle"):
        access.expand_lots([], ["nothing"])
    rows = spark.createDataFrame([(float("nan"),), (-5.0,), (99_999.0,), (1e6,), (float("inf"),)], "b double")
    assert [r.tier for r in rows.select(access.tier_of(F.col("b")).alias("tier")).collect()] == ["sample", "sample", "sample", "firehose", "sample"]


def test_budget_needs_really_lift(spark):
    rows = spark.createDataFrame([(c,) for c in ["auth-bypass"] * 80 + ["other"] * 19 + ["wrong-constant"]], "class string")
    for r in corpus.class_budget(rows).collect():
        assert (r.n + r.need) * 20 >= r.total + r.need
        if r.room:
            assert (r.n + r.room) * 4 <= r.total + r.room
    assert {r.status for r in corpus.class_budget(rows.limit(0)).collect()} == {"ok"}


def test_richest_copy_and_merge_twice(records):
    rich = merges.richest_copy(records)
    assert sorted(r.rec_no for r in rich.collect()) == [1, 3, 4]
    again = merges.upsert_merge(rich, rich)
    assert {r.outcome for r in again.collect()} == {"unchanged"}


def test_chain_breaks_are_found(spark):
    entries = spark.createDataFrame([(g, i, i, "sample", 3) for g in (1, 2, 3, 4) for i in range(5)], "ledger long, seq long, buyer long, tier string, records_served long")
    chain = ledgers.usage_chain_build(entries).toPandas()
    chain.loc[(chain.ledger == 2) & (chain.seq == 2), "hash"] = "0"
    chain.loc[(chain.ledger == 3) & (chain.seq == 4), "buyer"] = 9
    chain = chain[~((chain.ledger == 4) & (chain.seq == 1))]
    got = {r.ledger: (r.broken_at, r.reason) for r in ledgers.usage_chain_verify(spark.createDataFrame(chain)).collect()}
    assert got == {1: (None, None), 2: (2, "bad-hash"), 3: (4, "bad-hash"), 4: (2, "bad-sequence")}


def test_overlaps_equal_pairs(spark):
    sites = [(f, a, a + w) for f in range(3) for a in range(0, 60, 7) for w in (0, 3, 20)]
    ranges = [(0, 5, 6), (0, 0, 40), (1, 33, 33), (2, 100, 200)]
    got = reports.diff_scope_join(spark.createDataFrame(sites, "file_no int, start int, end int"), spark.createDataFrame(ranges, "file_no int, start int, end int")).collect()
    want = [s for s in sites if any(r[0] == s[0] and s[1] <= r[2] and s[2] >= r[1] for r in ranges)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_spans_and_evidence(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i % 10) for i in range(60))
    docs = spark.createDataFrame([(1, "zz" + text[10:50] + "zz"), (2, "zz" + text[10:49] + "!!"), (3, text[:40]), (4, None), (5, "one  two\nthree four five"), (6, "bone two three four five")], "doc_id long, text string")
    assert sorted(r.doc_id for r in texts.verbatim_span_guard(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()) == [1, 3]
    assert [tuple(r) for r in texts.evidence_match(docs, spark.createDataFrame([(7, "one two three four")], "item_id long, text string")).orderBy("doc_id").collect()] == [(5, 7), (6, 7)]


def test_evidence_of_any_length_is_plain_containment(spark):
    import random

    r = random.Random(4)
    bodies = {i: "".join(r.choice("ab ") for _ in range(r.choice([0, 1, 5, 40, 90]))) for i in range(60)} | {60: None, 61: "a  b\n c"}
    flat = lambda s: " ".join((s or "").split())
    needles = {i: "".join(r.choice("ab ") for _ in range(n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 14, 15, 16, 30, 31, 32] * 2)} | {40: bodies[next(i for i in bodies if len(bodies[i]) > 80)][7:60], 41: " ", 42: None}
    got = texts.evidence_match(spark.createDataFrame(list(bodies.items()), "doc_id long, text string"), spark.createDataFrame(list(needles.items()), "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, n) for d, b in bodies.items() for n, x in needles.items() if flat(x) and flat(x) in flat(b))
    assert texts.evidence_match(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_examples_are_never_the_item_itself(spark):
    pool = spark.createDataFrame([(i,) for i in range(300)], "item_id long")
    rows = texts.brief_sample(pool, 5).collect()
    assert all(r.item_id != r.example_id for r in rows)
    assert len({(r.item_id, r.example_id) for r in rows}) == len(rows) == 1500
    assert texts.brief_sample(pool.limit(1), 5).count() == texts.brief_sample(pool.limit(0), 5).count() == 0


def test_secrets(spark):
    lines = ['api_key = "' + "a1" * 20 + '"', "password: changeme", "token=<your token>", "secret = abcdefghijklmnop", "key [" + ", ".join(["12"] * 64) + "]", "[" + ",".join(["300"] * 64) + "]", "5" * 88, ""]
    words = " ".join(["abandon"] * 11 + ["about"])
    lines += [f'MNEMONIC="{words}"', "a = 1; api_key = " + "b2" * 20, "ANCHOR_WALLET=/keys/id.json", "private_key = short", "[" + ",\n".join(["7"] * 32) + "]", "x='y' token: '" + "z" * 16 + "'"]
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, f"  {words}\n"), (3, None), (4, words + " again")], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.kind, r.name) for r in texts.secret_scan(rows).collect())
    assert got == [(1, 1, "hex", "api_key"), (1, 4, "named", "secret"), (1, 5, "bytes", ""), (1, 7, "base58", ""), (1, 9, "phrase", "mnemonic"), (1, 10, "hex", "api_key"), (1, 11, "path", "anchor_wallet"), (1, 12, "named", "private_key"), (1, 13, "bytes", ""), (1, 45, "named", "token"), (2, 1, "phrase", "")]


def test_secrets_of_a_very_long_line(spark):
    """A megabyte of word characters on one line, and one of brackets and blanks, in a few seconds at most."""
    import time

    rows = spark.createDataFrame([(1, "a" * 1_000_000), (2, "[ 1, " * 200_000), (3, "a = " * 250_000), (4, "word " * 200_000)], "doc_id long, text string").cache()
    rows.count()
    began = time.perf_counter()
    texts.secret_scan(rows).collect()
    assert time.perf_counter() - began < 20


def test_rules_are_validated(spark):
    good = {"rule_id": "r", "name": "x", "trigger": "x", "kind": "forbidden", "pattern": "x"}
    assert texts.validated([good]) == [good]
    for bad in ([good, good], [good | {"pattern": "("}], [good | {"kind": "constant"}], [{"rule_id": "r"}]):
        with pytest.raises(ValueError, match="r: "):
            texts.rule_candidates(spark.createDataFrame([], "doc_id long, text string"), bad)
    texts.register_check("shout", lambda rule, text: F.when(text == F.upper(text), "fail").otherwise("pass"))
    docs = spark.createDataFrame([(1, "X"), (2, "xX")], "doc_id long, text string")
    assert {(r.doc_id, r.result) for r in texts.rule_scan(docs, [good | {"kind": "shout", "name": "X"}]).collect()} == {(1, "fail"), (2, "pass")}


def test_references_and_advisories(spark):
    sha = "a" * 40
    refs = [f"o/r@{sha}:p/x.py#L7", f"https://raw.githubusercontent.com/o/r/{sha}/x", "o/r@main:x", "o/r", None]
    rows = spark.createDataFrame([(r,) for r in refs], "ref string").select(texts.source_ref_parse(F.col("ref")).alias("p")).collect()
    assert [(r.p.owner, r.p.path, r.p.line, r.p.error) for r in rows] == [("o", "p/x.py", 7, None), ("o", "x", None, None), (None, None, None, "mutable"), (None, None, None, "form"), (None, None, None, "empty")]
    values = spark.createDataFrame([(v,) for v in ["9.8", "7", "4.1 (x)", "0", "MODERATE", "low", "CVSS:3.1", None]], "v string")
    assert [r.s for r in values.select(S.severity_from_score(F.col("v")).alias("s")).collect()] == ["critical", "high", "medium", "low", "medium", "low", "high", "high"]


def test_precedent_is_never_its_own_file(spark):
    new = spark.createDataFrame([(1, 1, "fail"), (1, 2, "fail"), (2, 1, "fail")], "rule_id int, file_no int, result string")
    fixes = spark.createDataFrame([(1, 1, 9), (1, 3, 5), (2, 1, 1)], "rule_id int, file_no int, at int")
    assert sorted(map(tuple, reports.same_rule_precedent(new, fixes).collect())) == [(1, 1, 3), (1, 2, 1)]


def test_replay_counts_what_was_accepted(spark):
    rows = spark.createDataFrame([(1, i, i, a, True) for i, a in enumerate([60.0, 50.0, 40.0, 1.0])], "session long, at long, id long, amount double, recipient_ok boolean")
    assert [r.accepted for r in money.spend_replay(rows, 100.0, 100.0).orderBy("id").collect()] == [True, False, True, False]


def test_folds_go_on_over_batches():
    state, one = streams.limit_rows(None, [0.0, 1.0, 2.0], 2, 10.0)
    _, two = streams.limit_rows(state, [9.0, 10.0], 2, 10.0)
    assert one + two == [(True, 0.0), (True, 0.0), (False, 8.0), (False, 1.0), (True, 0.0)]
    state, first = streams.change_rows(None, pd.DataFrame({"event_id": [1, 2], "value": ["a", "a"]}))
    _, second = streams.change_rows(state, pd.DataFrame({"event_id": [3, 4], "value": ["b", "a"]}))
    assert (first, second) == ([], [(3, "a", "b", 1), (4, "b", "a", 2)])


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, float(i * i % 17)) for i in range(40)], "user_id long, event_id long, seconds double").withColumn("seconds", F.col("event_id") * 5.0)
    rows.repartition(4, "event_id").write.parquet(f"{tmp_path}/hits.parquet")
    stream = streams.table_stream(spark, str(tmp_path), "hits")
    streams.run_once(streams.rate_limit(stream, "user_id", 2, 60.0), f"{tmp_path}/out")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/data").collect()))
    assert got == sorted(map(tuple, streams.rate_limit_batch(rows, "user_id", 2, 60.0).collect()))


def test_files(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "node_modules").mkdir(parents=True)
    (tree / "a.txt").write_text("text")
    (tree / "b.bin").write_bytes(b"x\0y")
    (tree / "big.txt").write_text("x" * 70_000)
    (tree / "node_modules" / "c.txt").write_text("c")
    assert [r.text for r in files.file_tree_scan(spark, str(tree)).collect()] == ["text"]
    lots = tmp_path / "lots"
    lots.mkdir()
    (lots / "one.jsonl").write_text('{"trap_id": "t", "rec_no": 1}\n{"trap_id": \n')
    good, bad = files.good_and_bad(files.lot_scan(spark, [str(lots)]).cache())
    assert [(r.trap_id, r.lot) for r in good.collect()] == [("t", "one")]
    assert bad.count() == 1
    with pytest.raises(ValueError, match="completion mark"):
        files.feed_source(spark, str(tmp_path / "nothing"))
    sums = files.checksums(spark, str(tree))
    assert {r.name: r.status for r in files.checksum_verify(sums, sums.where("name <> 'a.txt'")).collect()} == {"a.txt": "extra", "b.bin": "ok", "big.txt": "ok"}


def test_manifests(spark):
    texts_ = [
        ("r", "package.json", '{"dependencies": {"left": "1.0", "both": "2.0"}, "devDependencies": {"dev": "3"}}'),
        ("r", "requirements.txt", "both==9.9\nflask==2.0.1 # x\n-e .\n"),
        ("r", "Cargo.toml", '[package]\nname = "me"\nversion = "1"\n[dependencies]\nserde = { version = "1.0" }\n'),
        ("r", "go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
        ("s", "Cargo.lock", '[[package]]\nname = "syn"\nversion = "2.0.1"\n'),
        ("s", "yarn.lock", '"@a/b@^1.0":\n  version "1.2.0"\nlodash@^4:\n  version "4.1.0"\n'),
        ("s", "package-lock.json", '{"packages": {"": {"version": "0"}, "node_modules/x/node_modules/y": {"version": "7"}}}'),
        ("s", "Gemfile.lock", "GEM\n  specs:\n    rails (7.0.1)\n"),
        ("s", "composer.lock", '{"packages": [{"name": "a/b", "version": "v3"}]}'),
        ("s", "pnpm-lock.yaml", "packages:\n  /foo@1.2.3:\n    x: y\n"),
        ("s", "poetry.lock", '[[package]]\nname = "toml"\nversion = "0.1"\n'),
    ]
    files_ = spark.createDataFrame(texts_, "repo string, file string, text string")
    got = {(r.name, r.version, r.ecosystem) for r in files.dependency_extract(files_.where("repo = 'r'")).collect()}
    assert got == {("left", "1.0", "npm"), ("both", "2.0", "npm"), ("dev", "3", "npm"), ("flask", "2.0.1", "pypi"), ("serde", "1.0", "cargo"), ("github.com/a/b", "v1.2.3", "go")}
    locks = {(r.name, r.version, r.source) for r in files.lockfile_inventory(files_.where("repo = 's'")).collect()}
    assert locks == {("syn", "2.0.1", "Cargo.lock"), ("@a/b", "1.2.0", "yarn.lock"), ("lodash", "4.1.0", "yarn.lock"), ("y", "7", "package-lock.json"), ("rails", "7.0.1", "Gemfile.lock"), ("a/b", "3", "composer.lock"), ("foo", "1.2.3", "pnpm-lock.yaml"), ("toml", "0.1", "poetry.lock")}


def test_policy_stream_equals_its_batch_twin_and_a_fold(spark, sf):
    from verdigris.plans import registry

    queries = registry.queries()
    stream, batch = ({(r.space, r.id): r.accepted for r in queries[name](spark, sf).collect()} for name in ("stream_policy_versions", "policy_versions_batch"))
    want, held = {}, {}
    for e in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect():
        version, k = int(e.value // 1), e.event_id
        now = held.get(e.user_id)
        ok = now is None or (version > now[0] and k % 7 in now[1])
        if ok:
            held[e.user_id] = (version, {(k + 1) % 7, (k + 2) % 7, (k + 4) % 7})
        want[e.user_id, k] = ok
    assert stream == batch == want
    assert 0 < sum(v for (s, i), v in want.items()) < len(want)


def test_scalars_of_odd_values(spark):
    row = spark.range(1).select(
        S.snake_case(F.lit("myHTTPServer two-Parts")).alias("a"), S.usd_text(F.lit(None).cast("double")).alias("b"), S.usd_text(F.lit(1.5e9)).alias("c"), S.age_text(F.lit(None).cast("long"), 0).alias("d"),
        S.age_text(F.lit(10), 0).alias("e"), S.invoked_programs(F.array(F.lit("Program A invoke [1]"), F.lit("Program log: x"), F.lit("Program B invoke [2]"), F.lit("Program A invoke [3]"))).alias("f"), S.rule_pattern(F.lit("x-Algorithm-None")).alias("g"),
    ).first()
    assert tuple(row) == ("my_httpserver_two_parts", "—", "$1.50B", "never", None, ["A", "B"], "algorithm-none")


def test_outbreaks_gather_repositories_once_a_name(spark):
    """Records of one SDK share the list of its repositories; rows of one record with two names have both."""
    rows = [(i, "t", "high" if i % 2 else "low", "Sdk-A" if i % 3 else "sdk-b", True, True) for i in range(40)] + [(1, "t", "high", "SDK-B", True, True), (50, "t", "critical", "none", True, True), (51, "t", "high", None, True, True)]
    records = spark.createDataFrame(rows, "rec_no long, trap_id string, severity string, sdk_name string, red boolean, green boolean")
    pairs = [(r, "sdk-a") for r in range(5)] + [(r, "SDK-A") for r in range(3)] + [(r, "sdk-B") for r in range(4, 7)] + [(9, None), (None, "sdk-a")]
    out = hive.outbreak_match(records, spark.createDataFrame(pairs, "repo_id long, dep string"))
    want = {}
    for no, _, severity, name, _, _ in rows:
        if severity != "low" and name:
            want.setdefault(no, set()).update(r for r, d in pairs if d and r is not None and d.lower() == name.lower())
    got = {r.rec_no: (r.breadth, r.repos) for r in out.collect()}
    assert got == {no: (len(r), sorted(r)) for no, r in want.items() if r}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join" in line]
    assert len(joins) == 2 and "collect_set(repo_id" not in plan.splitlines()[0]
    first = plan.splitlines()[joins[0]]
    assert "_names" in first  # records meet lists of repositories, not repositories
'''


def test_a_brief_gathers_records_before_dependencies(spark):
    """A name that a repository has in two spellings counts twice; records are grouped under the join."""
    rows = [(i, f"trap-{i % 5}", "Sdk" if i % 2 else "other", "c0" if i % 3 else "c1", "high", i % 8, True, True, 1000 + i) for i in range(30)]
    records = spark.createDataFrame(rows, "rec_no long, trap_id string, sdk_name string, class string, severity string, corroboration long, red boolean, green boolean, captured_at long")
    deps = spark.createDataFrame([(1, "SDK"), (1, "sdk"), (2, "sdk"), (2, "OTHER"), (3, "none")], "repo_id long, dep string")
    out = hive.brief_rank(deps, records, spark.createDataFrame([("trap-3",)], "trap_id string"))
    got = {(r.repo_id, r.sdk_name, r["class"]): (r.instances, r.corroboration, r.personal) for r in out.collect()}
    want = {}
    for repo, dep in [tuple(r) for r in deps.collect()]:
        for _, trap, sdk, cls, _, c, *_ in rows:
            if sdk.lower() == dep.lower():
                n, most, own = want.get((repo, sdk.lower(), cls), (0, 0, False))
                want[repo, sdk.lower(), cls] = (n + 1, max(most, c), own or trap == "trap-3")
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("max_by")
'''


def test_chains_of_many_ledgers_cost_no_call_each(spark):
    """3000 ledgers in four partitions, one of them over several batches: each chain is whole and verifies, and there is no group for Python."""
    rows = [(n % 3000, n, n % 7, "a\"b" if n % 5 else None, n % 50) for n in range(9000)] + [(7, 10_000 + n, 1, "x", n) for n in range(25_000)]
    entries = spark.createDataFrame(rows, "ledger long, seq long, buyer long, tier string, records_served long")
    chain = ledgers.usage_chain_build(entries)
    assert "FlatMapGroupsInPandas" not in chain._jdf.queryExecution().optimizedPlan().toString()
    got = {r.ledger: (r.rows, r.broken_at) for r in ledgers.usage_chain_verify(chain).collect()}
    assert got == {k: (25_003 if k == 7 else 3, None) for k in range(3000)}


def test_a_blank_needle_is_in_every_text_if_asked(spark):
    """As SQL has it that trims a needle after asking whether it is empty."""
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, text string")
    needles = spark.createDataFrame([(1, " "), (2, ""), (3, "b"), (4, None)], "item_id long, text string")
    assert sorted(map(tuple, texts.evidence_match(docs, needles, blank=True).collect())) == [(1, 1), (1, 3), (2, 1)]
    assert sorted(map(tuple, texts.evidence_match(docs, needles).collect())) == [(1, 3)]
