"""Verbatim runs between documents and sources, with their places, and the clean-room gate.

Seeds: a document gives a block of characters at each multiple of a step, a source
one at each place, both with the characters around them; so what is joined are
windows of some sixty characters and never texts. Blocks that are equal are widened
to both sides inside their windows, and what lies on one diagonal (the same distance
between the two places) is put together: those are the maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.scalars import proven

SPAN = 40


def _shared_head(a: Column, b: Column) -> Column:
    """How many characters two short texts share at their beginning."""
    n = F.least(F.length(a), F.length(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), False)
    return F.when(n == 0, 0).otherwise(F.when(differs == 0, n).otherwise(differs - 1)).cast("int")


def verbatim_spans(docs: DataFrame, sources: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, doc_at, item_at, length): maximal runs of at least span characters that a document shares with a source (item_id, text).

    Places count characters from 0. Maximal: the characters before and after differ
    or aren't there. A passage that a source has twice gives a run for each place.
    Of every run the blocks at multiples of the step lie so close that their windows
    overlap, and one of them lies inside a run of span characters. Null texts and
    ids give nothing; repeated rows are harmless.
    """
    half = span // 2
    step = span - half + 1
    # Chunks of a step: a block is the beginning of one, what surrounds it its neighbours. All in one pass over the text.
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    around = lambda c, i: F.struct((i * step).alias("at"), F.substring(c, 1, half).alias("block"), F.coalesce(F.get("chunks", i - 1), F.lit("")).alias("left"), F.concat(F.substring(c, half + 1, step), F.coalesce(F.get("chunks", i + 1), F.lit(""))).alias("right"))
    a = docs.where((F.length("text") >= span) & F.col("doc_id").isNotNull()).select("doc_id", chunks.alias("chunks")).select("doc_id", F.inline(F.transform("chunks", around)))
    piece = lambda first, n: F.array_join(F.slice("chars", first, n), "")
    every = F.transform(F.sequence(F.lit(0), F.size("chars") - half), lambda i: F.struct(i.alias("of"), piece(i + 1, F.lit(half)).alias("block"), piece(F.greatest(i - step + 1, F.lit(1)), F.least(i, F.lit(step))).alias("l"), piece(i + half + 1, F.lit(step + 1)).alias("r")))
    b = sources.where((F.length("text") >= span) & F.col("item_id").isNotNull()).select("item_id", F.split("text", "").alias("chars")).select("item_id", F.inline(every))
    met = a.where(F.length("block") == half).join(b, "block")
    back, ahead = _shared_head(F.reverse("left"), F.reverse("l")), _shared_head(F.col("right"), F.col("r"))
    runs = met.select("doc_id", "item_id", (F.col("at") - F.col("of")).alias("diagonal"), (F.col("at") - back).alias("start"), (F.col("at") + half + ahead).alias("end"))
    line = W.partitionBy("doc_id", "item_id", "diagonal").orderBy("start", "end")
    seen = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(F.col("start") <= seen, 0).otherwise(1))
    placed = marked.withColumn("island", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    whole = placed.groupBy("doc_id", "item_id", "diagonal", "island").agg(F.min("start").alias("doc_at"), F.max("end").alias("end"))
    length = F.col("end") - F.col("doc_at")
    return whole.where(length >= span).select("doc_id", "item_id", "doc_at", (F.col("doc_at") - F.col("diagonal")).alias("item_at"), length.alias("length"))


def verbatim_span_guard(docs: DataFrame, sources: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id) where a document has a run of span characters of a source (item_id, text)."""
    return verbatim_spans(docs, sources, span).select("doc_id", "item_id").distinct()


def holdout_disjoint(train: DataFrame, held: DataFrame) -> DataFrame:
    """Training documents without a verbatim span of a held-out item."""
    return train.join(verbatim_span_guard(train, held).select("doc_id").distinct(), "doc_id", "left_anti")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def cleanroom_issues(records: DataFrame, sources: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """(rec_no, issues): what keeps each record from being sold, in this order; an empty array if nothing does.

    * evidence-leak: what is sold (payload, JSON) still has a field of evidence;
    * not-proven: the proof isn't red and then green;
    * bad-sourceref, no-hash: a wild record (origin) without a reference pinned to a
      commit, or without a digest of its evidence;
    * dead-pointer: the line that the reference leads to (fetched; null if it wasn't
      looked up) has another digest;
    * verbatim-span: the fetched line, else the evidence, has span characters or more
      without the blanks around it and is whole in vulnerable or fixed; or, with
      sources (item_id, text), one of these shares a run of span characters with them.

    rec_no tells the records. Other nulls count as empty.
    """
    from verdigris.operators.texts import source_ref_parse

    wild = F.coalesce(F.col("origin") == "wild", F.lit(False))
    sha = _text("evidence_sha256")
    needle = F.regexp_replace(F.coalesce("fetched", "evidence", F.lit("")), r"^\s+|\s+$", "")
    copied = (F.length(needle) >= span) & (F.contains(_text("vulnerable"), needle) | F.contains(_text("fixed"), needle))
    rows = records
    if sources is not None:
        codes = records.select(F.explode(F.array(F.struct("rec_no", F.lit("vulnerable").alias("side"), F.col("vulnerable").alias("text")), F.struct("rec_no", F.lit("fixed").alias("side"), F.col("fixed").alias("text")))).alias("c"))
        met = verbatim_span_guard(codes.select(F.struct("c.rec_no", "c.side").alias("doc_id"), "c.text"), sources, span)
        found = met.select("doc_id.rec_no", F.lit(True).alias("_met")).distinct()
        rows = records.join(found, "rec_no", "left")
        copied = copied | F.coalesce(F.col("_met"), F.lit(False))
    checks = (
        ("evidence-leak", F.contains(_text("payload"), F.lit('"evidence"'))),
        ("not-proven", ~F.coalesce(proven(F.col("red"), F.col("green")), F.lit(False))),
        ("bad-sourceref", wild & source_ref_parse(_text("source_ref"))["error"].isNotNull()),
        ("no-hash", wild & (sha == "")),
        ("dead-pointer", wild & F.col("fetched").isNotNull() & (sha != "") & (F.sha2("fetched", 256) != sha)),
        ("verbatim-span", copied),
    )
    return rows.select("rec_no", F.array_compact(F.array(*(F.when(held, code) for code, held in checks))).alias("issues"))
