"""Taint through calls: which functions let a source's value reach a sink, and by which parameters.

The call table says which value of a caller becomes which parameter of a callee. A
place is a function and one of its values (a parameter or a local name). Two
summaries are enough for every function at once: how few calls a place is from a
sink, and how few from a source. Each is a frontier of places that grows by one
join a hop; places that are known already drop out, so cycles end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.sources.tables import kept

#: Calls that taint may pass on its way to a sink, and on its way into a function that sinks a parameter.
FORWARD_HOPS, BACKWARD_HOPS = 2, 1
_PLACE = ["fn", "value"]


def _place_text(fn: str, value: str):  # noqa: ANN202
    return F.concat_ws(".", F.col(fn).cast("string"), F.col(value).cast("string"))


def _spread(steps: DataFrame, start: DataFrame, hops: int, forward: bool) -> DataFrame:
    """(fn, value, hops, path): the places that start (fn, value) reaches over steps (fn, value, next_fn, next_value), with the fewest hops and of those the least path.

    forward says whether the path is told from start to the place or the other way.
    """
    seen = kept(start.select(*_PLACE).distinct().select(*_PLACE, F.lit(0).alias("hops"), F.array(_place_text(*_PLACE)).alias("path")), "places_0")
    front = seen
    for hop in range(1, hops + 1):
        here = F.array(_place_text("next_fn", "next_value"))
        path = F.concat("path", here) if forward else F.concat(here, "path")
        ahead = front.join(steps, _PLACE).groupBy(F.col("next_fn").alias("fn"), F.col("next_value").alias("value")).agg(F.min(path).alias("path"))
        front = kept(ahead.join(seen.select(*_PLACE), _PLACE, "left_anti").select(*_PLACE, F.lit(hop).alias("hops"), "path"), f"places_{hop}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def sink_summaries(calls: DataFrame, sinks: DataFrame, hops: int) -> DataFrame:
    """(fn, value, hops, path): places whose value gets into a sink (fn, value) after at most so many calls."""
    back = calls.select(F.col("callee").alias("fn"), F.col("param").alias("value"), F.col("caller").alias("next_fn"), F.col("arg").alias("next_value"))
    return _spread(back, sinks, hops, forward=False)


def source_summaries(calls: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(fn, value, hops, path): places that a source's value (fn, value) gets into after at most so many calls."""
    ahead = calls.select(F.col("caller").alias("fn"), F.col("arg").alias("value"), F.col("callee").alias("next_fn"), F.col("param").alias("next_value"))
    return _spread(ahead, sources, hops, forward=True)


def taint_flows(calls: DataFrame, sources: DataFrame, sinks: DataFrame, forward_hops: int = FORWARD_HOPS, backward_hops: int = BACKWARD_HOPS) -> DataFrame:
    """(fn, result, kind, hops, path) for each function of calls, sources or sinks.

    calls is (caller, arg, callee, param): caller hands its value arg to callee as
    param. sources and sinks are (fn, value): a value that comes straight from a
    source, and one that is handed straight to a sink. A function fails if

    * direct: one of its source values is handed to a sink in it;
    * forward: one of its source values gets to a sink after at most forward_hops calls;
    * backward: a parameter that it hands to a sink gets a source's value over at most
      backward_hops calls of other functions.

    The first of these that holds is told, with the fewest calls and, of those, the
    least path: "fn.value" from source to sink. Functions that call themselves or
    each other end like any other; a call with a null in it leads nowhere. Repeated
    rows are harmless. Other functions pass, with nulls in kind, hops and path.
    """
    calls = calls.select("caller", "arg", "callee", "param").dropna().where("caller <> callee").distinct()
    sources, sinks = sources.select(*_PLACE).dropna(), sinks.select(*_PLACE).dropna()
    to_sink = sink_summaries(calls, sinks, forward_hops)
    from_source = source_summaries(calls, sources, backward_hops)
    starts = to_sink.join(sources.distinct(), _PLACE).select("fn", F.when(F.col("hops") == 0, "direct").otherwise("forward").alias("kind"), "hops", "path")
    ends = from_source.where("hops > 0").join(sinks.distinct(), _PLACE).select("fn", F.lit("backward").alias("kind"), "hops", "path")
    rank = F.when(F.col("kind") == "direct", 0).when(F.col("kind") == "forward", 1).otherwise(2)
    best = starts.unionByName(ends).groupBy("fn").agg(F.min(F.struct(rank.alias("rank"), "hops", "path", "kind")).alias("b"))
    every = calls.select(F.col("caller").alias("fn")).unionByName(calls.select(F.col("callee").alias("fn"))).unionByName(sources.select("fn")).unionByName(sinks.select("fn")).distinct()
    return every.join(best, "fn", "left").select("fn", F.when(F.col("b").isNull(), "pass").otherwise("fail").alias("result"), "b.kind", "b.hops", "b.path")
