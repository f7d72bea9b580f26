"""Views that bind the driver's tables to the library's schemas; the same SQL text for Spark and for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations", "embeddings")

#: name -> (tables and views it reads, text). <S> is the engine's string type, <x> a table or view.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "records": (
        ("documents", "labels"),
        """SELECT d.doc_id AS rec_no, concat('trap-', CAST(d.n_chars % 60 AS <S>)) AS trap_id,
 concat('sdk-', CAST(d.n_chars % 37 AS <S>)) AS sdk_name, d.lang AS sdk_version, d.source AS source_repo,
 CASE WHEN d.n_chars % 100 < 39 THEN 'auth-bypass' WHEN d.n_chars % 100 < 69 THEN 'missing-verification'
  WHEN d.n_chars % 100 < 80 THEN 'unconfirmed-state' WHEN d.n_chars % 100 < 88 THEN 'other'
  WHEN d.n_chars % 100 < 92 THEN 'silent-zero-revenue' WHEN d.n_chars % 100 < 96 THEN 'missing-slippage-guard'
  WHEN d.n_chars % 100 < 98 THEN 'wrong-constant' ELSE 'unchecked-staleness' END AS class,
 CASE d.doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
 d.n_chars % 8 AS corroboration, coalesce(l.quality = 1, false) AS red, coalesce(l.toxic = 0, false) AS green,
 1704067200 + 60 * d.doc_id AS captured_at,
 CASE WHEN d.text LIKE '%MIT License%' THEN 'MIT' WHEN d.text LIKE '%Apache License%' THEN 'APACHE-2.0'
  WHEN d.doc_id % 17 = 0 THEN 'GPL-3.0' ELSE 'NOASSERTION' END AS license,
 CASE WHEN d.doc_id % 5 = 0 THEN 'contrib' ELSE 'seed' END AS lot, d.text AS snippet
FROM <documents> d LEFT JOIN <labels> l ON l.doc_id = d.doc_id""",
    ),
    "xp": (
        ("events",),
        """SELECT event_id, event_type AS rule_id, user_id % 25 AS repo_id, user_id AS author,
 event_id % 40 AS file_no, ts AS fixed_at, value, props AS detail FROM <events>""",
    ),
    "ledger": (
        ("orders",),
        """SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_custkey AS buyer, o_orderdate AS ts,
 CASE o_orderstatus WHEN 'P' THEN 'sample' WHEN 'O' THEN 'standard' ELSE 'firehose' END AS tier,
 o_orderkey % 50 AS records_served FROM <orders>""",
    ),
    "deps": (
        ("lineitem",),
        "SELECT DISTINCT l_suppkey AS repo_id, concat('SDK-', CAST((l_suppkey * 7 + l_linenumber * 11) % 60 AS <S>)) AS dep FROM <lineitem>",
    ),
    "findings": (
        ("lineitem",),
        """SELECT l_orderkey AS run_id, l_partkey % 16 AS rule_id, l_suppkey AS file_no, l_linenumber AS line,
 CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'pass' ELSE 'cant_tell' END AS result,
 CASE l_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
 l_shipdate AS run_ts FROM <lineitem>""",
    ),
    "snap_old": (
        ("findings",),
        """SELECT rule_id, file_no, CASE (count(*) + rule_id) % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'cant_tell' END AS result
FROM <findings> WHERE run_id % 2 = 0 GROUP BY rule_id, file_no""",
    ),
    "snap_new": (
        ("findings",),
        """SELECT rule_id, file_no, CASE (count(*) + rule_id) % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'cant_tell' END AS result
FROM <findings> WHERE run_id % 2 = 1 GROUP BY rule_id, file_no""",
    ),
    "adv_old": (("lineitem",), "SELECT DISTINCT l_partkey AS pkg, l_suppkey AS advisory, l_partkey % 4 AS sev FROM <lineitem> WHERE l_orderkey % 2 = 0"),
    "adv_new": (("lineitem",), "SELECT DISTINCT l_partkey AS pkg, l_suppkey AS advisory, l_partkey % 4 AS sev FROM <lineitem> WHERE l_orderkey % 2 = 1"),
    "edges": (
        ("orders",),
        """SELECT o_orderkey AS src, o_custkey * 10 + o_orderkey % 10 AS dst FROM <orders>
UNION SELECT o_orderkey, o_custkey * 10 + o_orderkey % 7 FROM <orders>""",
    ),
    "evals": (
        ("events",),
        """SELECT event_id AS task_id, CASE WHEN user_id % 2 = 0 THEN 'bare' ELSE 'recall' END AS condition,
 CASE event_type WHEN 'error' THEN 'RED' WHEN 'view' THEN 'UNKNOWN' ELSE 'GREEN' END AS color, user_id % 9 AS class_no FROM <events>""",
    ),
}


class Tables:
    """The driver's tables and the views, each as an attribute, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._view(name) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def _view(self, name: str) -> DataFrame:
        reads, text = VIEWS[name]
        for table in reads:
            text = text.replace(f"<{table}>", f"{{{table}}}")
        return self.spark.sql(text.replace("<S>", "STRING"), **{t: getattr(self, t) for t in reads})

    @cached_property
    def documents_lines(self) -> DataFrame:
        """(doc_id, line_no, line): lines of documents, from 1."""
        from pyspark.sql import functions as F

        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names in front of it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if f"<{name}>" in text and name not in need:
                add(VIEWS[name][1])
                need.append(name)

    add(sql)
    plain = lambda text: _names(text.replace("<S>", "VARCHAR"))
    head = ", ".join(f"{name} AS ({plain(VIEWS[name][1])})" for name in need)
    body = plain(sql).strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def _names(text: str) -> str:
    for name in (*VIEWS, *TABLES):
        text = text.replace(f"<{name}>", name)
    return text
