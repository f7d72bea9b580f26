"""Temperature mixing of sources.

Source weights are token shares raised to an exponent and normalised. The exponent
is the one that gives the weights their target entropy: under 1 it lifts small
sources, over 1 large ones. The target is an entropy of its own, or lies so far on
the way from the entropy of the shares to the largest possible one, which always
lifts small sources. If some source would then be passed over more often than the
limit allows, the exponent is the nearest one that keeps to the limit. Each source
then gets its budget of tokens: whole passes over it, and for the rest whole blocks
of its documents in an order permuted by hash, up to a document of the block in
which the budget ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.shared import named, written

#: How far the entropy of the weights lies from that of the shares to the largest one, and how often a source may be passed over.
LIFT, MOST_PASSES = 0.5, 4.0
#: Documents of a block, about.
BLOCK = 512
#: Exponents that one step of the bisection tries at once, and steps after the first one, which goes up by powers of two.
SECTIONS, STEPS, DOUBLINGS = 64, 4, 60


def n_words(text: Column) -> Column:
    """Tokens are counted as runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) of the sources that have tokens; a null source is a source. A written table."""
    totals = written(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"), "mix_sources")
    return totals.withColumn("share", F.col("tokens") / F.lit(totals.agg(F.sum("tokens")).first()[0] or 1))


def exponent(totals: DataFrame, entropy: float | None = None, passes: float = MOST_PASSES, budget: float | None = None, lift: float = LIFT) -> float:
    """The exponent, 0 at least, by bisection with many sections a step; it has no upper end.

    entropy is the target as a share of the largest possible one; without it the
    target follows from lift. Entropy falls as the exponent rises, towards that of
    the sources that tie for the largest share: a target below that can't be met, as
    with equal shares, and the exponent is then 1. The passes over the source that is
    repeated most fall up to 1 and rise from there, so the limit leaves an interval
    around 1. Without a budget passes count relative to those over the source passed
    over least; with one that no exponent keeps to the limit it is 1.

    A step is one aggregation over the sources that sends SECTIONS rows to the driver.
    """
    n, least, most, tokens = totals.agg(F.count("*"), F.min("share"), F.max("share"), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0
    # Logs of shares relative to the largest one: their powers vanish in time, and never all of them.
    logs = totals.select(F.log(F.col("share") / F.lit(most)).alias("l"))

    def measures(at: list[float]) -> list[tuple[float, float]]:
        """Entropy of the weights, and passes over the source repeated most, for each exponent."""
        each = logs.select("l", F.posexplode(F.array(*map(F.lit, at))).alias("i", "a"))
        sums = each.groupBy("i").agg(F.sum(F.exp(F.col("a") * F.col("l"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("l")) * F.col("l")).alias("s")).collect()
        out: list = [None] * len(at)
        for r in sums:
            a, low = at[r.i], math.log(least / most)
            some = sorted((math.exp(min(700.0, (a - 1) * low)), 1.0))
            out[r.i] = (math.log(r.z) - a * r.s / r.z, budget / tokens / most * some[1] / r.z if budget else some[1] / some[0] if some[0] else math.inf)
        return out

    def bisect(holds: Callable[[float, float], bool], low: float, high: float | None) -> float:
        """The point up to which holds is true; without a high end one is sought."""
        if high is None:
            grid = [low + 2.0**k for k in range(-2, DOUBLINGS)]
            k = sum(holds(*m) for m in measures(grid))
            if k == len(grid):
                return math.inf
            low, high = grid[k - 1] if k else low, grid[k]
        for _ in range(STEPS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            k = sum(holds(*m) for m in measures(grid))  # monotonous: the first k are true
            if k == 0:
                return low
            if k == len(grid):
                return high
            low, high = grid[k - 1], grid[k]
        return low

    if entropy is None:
        own = measures([1.0])[0][0]
        wanted = own + lift * (math.log(n) - own)
        target = 1.0 if least == most else bisect(lambda h, _: h >= wanted, 0.0, 1.0)
    else:
        wanted = entropy * math.log(n)
        tied = totals.where(F.col("share") == most).count()
        target = 1.0 if math.log(tied) >= wanted else bisect(lambda h, _: h >= wanted, 0.0, None)
    if target == 1 or measures([target])[0][1] <= passes:
        return target
    return bisect(lambda _, p: p > passes, target, 1.0) if target < 1 else bisect(lambda _, p: p <= passes, 1.0, target)


def plan(totals: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """(source, weight, whole, rest_tokens, blocks): passes over each source, tokens beyond them, and its blocks.

    Without a budget the mixture is as large as it must be for one whole pass
    over every source, so no document is left out.
    """
    least, most, tokens = totals.agg(F.min("share"), F.max("share"), F.sum("tokens")).first()
    if most is None:
        return totals.select("source", F.lit(0.0).alias("weight"), F.lit(0).alias("whole"), F.lit(0).cast("long").alias("rest_tokens"), F.lit(1).alias("blocks"))
    power = F.pow(F.col("share") / F.lit(most), F.lit(alpha))  # relative to the largest share, so their sum is 1 at least
    z = totals.agg(F.sum(power)).first()[0]
    size = budget or tokens * most * z / min((least / most) ** (alpha - 1), 1.0)
    weight = power / z
    passes = F.round(weight * size / F.col("tokens"), 9)
    whole = F.floor(passes)
    return totals.select("source", weight.alias("weight"), whole.cast("int").alias("whole"), F.floor((passes - whole) * F.col("tokens")).alias("rest_tokens"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("int").alias("blocks"))


def mixed(docs: DataFrame, entropy: float | None = None, passes: float = MOST_PASSES, budget_share: float | None = None, seed: int = 7, columns: list[str] | None = None, lift: float = LIFT) -> DataFrame:
    """docs (or so many columns of it) with n_tokens, pass_no and block_no: a row for each time that a document is taken.

    budget_share is the size of the mixture as a share of all tokens; without it no
    document is left out. Null texts and texts without a word have no tokens: they
    come along once in every pass, and a source of such texts only once. Texts of
    any length are counted whole; one that is longer than what its source has left
    isn't taken. A null source is a source. Targets that can't be met: see exponent(). Equal rows share their fate, so the last of them may
    exceed a budget; ties of the hash order go together. An empty table gives no
    rows. Columns named n_tokens, pass_no or block_no are replaced; others may have
    any name.

    Texts are read and hashed once, into a written table. A hot source has many
    blocks, so no task gets all of it. Prefix sums of a source's blocks go in two
    levels, of which each has about the root of their number in a window.
    """
    docs = docs.drop("n_tokens", "pass_no", "block_no")
    row = F.struct(*map(named, docs.columns if columns is None else columns))
    table = written(docs.select(row.alias("row"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("string")).alias("place")), "mix_rows")
    light = table.select("source", "n_tokens", "place")
    totals = source_totals(light)
    budget = budget_share * (totals.agg(F.sum("tokens")).first()[0] or 0) if budget_share else None
    planned = written(plan(totals, exponent(totals, entropy, passes, budget, lift), budget), "mix_plan")
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("blocks")).cast("int")
    same = lambda a, b, *more: F.expr(" AND ".join([f"{a}.source <=> {b}.source", *(f"{a}.{c} = {b}.{c}" for c in more)]))
    placed = light.alias("l").join(planned.alias("p"), same("l", "p")).select("l.*", "p.whole", "p.rest_tokens", "p.blocks", block.alias("block_no"))
    turn = F.xxhash64(F.lit(seed + 2), "source", "block_no")
    shelf = F.pmod(turn, F.ceil(F.sqrt("blocks")).cast("int"))
    sizes = written(placed.groupBy("source", "block_no").agg(F.sum("n_tokens").alias("size"), *(F.first(c).alias(c) for c in ("whole", "rest_tokens", "blocks"))).withColumns({"turn": turn, "shelf": shelf}), "mix_sizes")
    # A source's blocks go by shelf and then by turn: first what the shelves before hold, then what the blocks before hold.
    ahead = W.partitionBy("source").orderBy("shelf").rowsBetween(W.unboundedPreceding, -1)
    shelves = sizes.groupBy("source", "shelf").agg(F.sum("size").alias("held")).select("source", "shelf", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"))
    inner = W.partitionBy("source", "shelf").orderBy("turn", "block_no").rowsBetween(W.unboundedPreceding, 0)
    summed = sizes.withColumn("within", F.sum("size").over(inner)).alias("s").join(shelves.alias("h"), same("s", "h", "shelf")).select("s.*", (F.col("before") + F.col("within")).alias("upto"))
    left = F.col("rest_tokens") - F.col("upto") + F.col("size")
    blocks = summed.select("source", "block_no", "whole", left.alias("left"), (F.col("upto") <= F.col("rest_tokens")).alias("inside"), ((left > 0) & (F.col("upto") > F.col("rest_tokens"))).alias("ends"))
    # In the block where the budget ends: the last place in the hash order that it still covers.
    of_end = placed.alias("p").join(blocks.where("ends").alias("e"), same("p", "e", "block_no")).select("p.source", "p.block_no", "p.place", "p.n_tokens", "e.left")
    of_end = of_end.groupBy("source", "block_no", "place").agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"))
    run = F.sum("n").over(W.partitionBy("source", "block_no").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    last = of_end.withColumn("run", run).where("run <= left").groupBy("source", "block_no").agg(F.max("place").alias("last"))
    cuts = written(blocks.alias("b").join(last.alias("l"), same("b", "l", "block_no"), "left").select("b.source", "b.block_no", "b.whole", "b.inside", "l.last"), "mix_blocks")
    rows = table.alias("r").join(planned.select("source", "blocks").alias("p"), same("r", "p"), "left").select("r.*", F.coalesce(block, F.lit(0)).alias("block_no"))
    met = rows.alias("r").join(cuts.alias("c"), same("r", "c", "block_no"), "left")
    once_more = F.coalesce(F.col("c.inside") | (F.col("r.place") <= F.col("c.last")), F.lit(False))
    times = F.coalesce(F.col("c.whole"), F.lit(1)) + F.when(once_more, 1).otherwise(0)
    taken = met.select("r.row", "r.n_tokens", "r.block_no", times.alias("times")).where("times > 0")
    taken = taken.withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return taken.select("row.*", "n_tokens", "pass_no", "block_no")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of all documents as large as the corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs, budget_share=1.0, columns=["doc_id", "source"])
