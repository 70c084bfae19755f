"""Greedy vertex cover in parallel rounds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loop import RoundLimitReached, checkpoint, checkpoint_counted, numbered


def vertex_cover(
    edges: DataFrame, key: Sequence[str] = (), limit: float | None = None, max_rounds: int = 1000
) -> DataFrame:
    """``(*key, id, pick_degree)``: a cover of each keyed graph, by largest residual degree.

    Each round takes every vertex that comes before all its neighbours by (residual degree
    descending, MD5 of the id, id) and drops its edges; the hash keeps chains of equal degrees from
    being picked one by one.  Such a vertex goes before its neighbours
    one at a time, too, so the cover and its pick degrees are those of the sequential greedy
    choice.  ``limit`` keeps that share of a group's vertices, those with the largest pick
    degrees, at least one; a group is finished as soon as so many have been picked by more than any degree that is left.
    """
    key = list(key)
    count = F.count(F.lit(1))
    left, seen = checkpoint_counted(edges.select(*key, "src", "dst").where("src != dst").distinct(), n=count)
    sizes = None
    if limit is not None:
        everybody = left.select(*key, "src").distinct()
        sizes = checkpoint(everybody.groupBy(*key).agg(F.greatest(F.lit(1), F.floor(count * F.lit(limit))).alias("most")))
    picks = []
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        degree = left.groupBy(*key, "src").agg(count.alias("degree"))
        other = degree.select(*key, F.col("src").alias("dst"), F.col("degree").alias("other"))
        order = lambda degree, end: F.struct(-F.col(degree), F.md5(F.col(end).cast("string").cast("binary")), F.col(end))
        first = order("degree", "src") < order("other", "dst")
        picked, _ = checkpoint_counted(
            left.join(degree, [*key, "src"])
            .join(other, [*key, "dst"])
            .groupBy(*key, F.col("src").alias("id"))
            .agg(F.bool_and(first).alias("first"), F.max("degree").alias("pick_degree"))
            .where("first")
            .select(*key, "id", "pick_degree"),
            n=count,
        )
        picks.append(picked)
        gone = lambda end, p=picked: p.select(*key, F.col("id").alias(end))
        rest = left.join(gone("src"), [*key, "src"], "left_anti").join(gone("dst"), [*key, "dst"], "left_anti")
        left, seen = checkpoint_counted(rest.select(*key, "src", "dst"), n=count)
        if limit is not None and seen["n"]:
            left, seen = checkpoint_counted(_unfinished(left, reduce(DataFrame.union, picks), sizes, key), n=count)
    else:
        raise RoundLimitReached(f"the cover was not complete after {max_rounds} rounds")
    if not picks:
        return left.select(*key, F.col("src").alias("id"), F.lit(0).cast("long").alias("pick_degree"))
    cover = reduce(DataFrame.union, picks)
    if limit is None:
        return cover
    ranked = numbered(cover, key, [F.desc("pick_degree"), F.asc("id")])
    ranked = ranked.join(sizes, key) if key else ranked.crossJoin(F.broadcast(sizes))  # one row
    return ranked.where("rank <= most").select(*key, "id", "pick_degree")


def _unfinished(left: DataFrame, picks: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """The edges of groups whose share may still change: a later pick has no larger degree than the largest one left."""
    one = F.lit(0).alias("__one")
    degree = left.groupBy(*key, "src").agg(F.count(F.lit(1)).alias("degree")).groupBy(*key, one).agg(F.max("degree").alias("top"))
    ahead = picks.withColumn("__one", F.lit(0)).join(degree, [*key, "__one"]).where("pick_degree > top").groupBy(*key, "__one").agg(F.count(F.lit(1)).alias("n"))
    done = ahead.join(sizes.withColumn("__one", F.lit(0)), [*key, "__one"]).where("n >= most").select(*key, "__one")
    return left.withColumn("__one", F.lit(0)).join(done, [*key, "__one"], "left_anti").select(*key, "src", "dst")
