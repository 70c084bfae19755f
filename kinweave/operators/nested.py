"""Largest components of graphs that contain one another (G3, G4 for all dates at once).

Vertices and edges have a weight; graph number ``n`` of a group consists of what weighs ``n`` or more, so each graph
contains those of larger numbers.  All graphs of a group are solved in one go, from its edges as they are, none copied for a number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import SMALL_EDGES, connected_components
from .loop import RoundLimitReached, checkpoint, checkpoint_counted


def nested_ranges(edges: DataFrame, vertices: DataFrame, key: Sequence[str], small: int = SMALL_EDGES) -> DataFrame:
    """``(*key, weight, range)``: size of the largest component of the graph of each number that some vertex weighs.

    ``edges`` is ``(*key, src, dst, weight)`` with whole numbers from 1 as weights, those of an edge no larger than those of its ends;
    ``vertices`` is ``(*key, id, weight)``.  Groups of up to ``small`` edges are solved inside tasks, by a maximum spanning forest
    that grows from the heaviest edge on.  Larger ones are halved: the graph of the middle number is solved for all groups at once,
    then its heavier part by itself and its lighter part with the components made one vertex each, so that an edge is part of
    one graph in each round and the rounds are as many as the numbers have binary digits.
    """
    key = list(key)
    edges = checkpoint(edges.select(*key, "src", "dst", F.col("weight").cast("long").alias("weight")).where("src < dst"))
    counted = checkpoint(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("top")))
    of = lambda some: edges.join(counted.where(some).select(*key), key, "left_semi")
    steps = [_grown(of(F.col("n") <= small), key)]
    top = counted.where(F.col("n") > small).agg(F.max("top")).first()[0]
    if top is not None:
        steps += _halved(checkpoint(of(F.col("n") > small)), key, top)
    # a graph is at least as large as those it contains, and somebody alone is one
    alone = vertices.select(*key, F.col("weight").cast("long").alias("weight")).distinct().withColumn("size", F.lit(1).cast("long")).withColumn("own", F.lit(True))
    every = alone.unionByName(reduce(DataFrame.union, steps).withColumn("own", F.lit(False)))
    merged = every.groupBy(*key, "weight").agg(F.max("size").alias("size"), F.max("own").alias("own"))
    heavier = W.partitionBy(*key).orderBy(F.desc("weight"))  # a row for each number
    return merged.withColumn("range", F.max("size").over(heavier)).where("own").select(*key, "weight", "range")


def _grown(edges: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, weight, size)`` for small groups: the sizes that the largest component passes through, heaviest edges first."""
    schema = StructType([*edges.select(*key).schema.fields, *StructType.fromDDL("weight long, size long").fields])

    def run(group: pa.Table) -> pa.Table:
        ends, at = np.unique(np.concatenate([group.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
        weight = group.column("weight").to_numpy()
        order = np.argsort(-weight, kind="stable")
        parent, size = list(range(len(ends))), [1] * len(ends)

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        found, most = {}, 1
        a, b = at[: len(weight)][order].tolist(), at[len(weight) :][order].tolist()
        for w, u, v in zip(weight[order].tolist(), a, b, strict=True):
            u, v = root(u), root(v)
            if u != v:
                u, v = (u, v) if size[u] >= size[v] else (v, u)
                parent[v] = u
                size[u] += size[v]
                if size[u] > most:
                    found[w] = most = size[u]
        picked = group.select(key).take(pa.array(np.zeros(len(found), np.int64)))
        columns = [*picked.columns, pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())]
        return pa.table(columns, names=[*key, "weight", "size"])

    return edges.groupBy(*key).applyInArrow(run, schema)


def _halved(edges: DataFrame, key: list[str], top: int) -> list[DataFrame]:
    """The same for groups of any size, a step for each round."""
    part = [*key, "lo", "hi"]
    left = edges.select(*key, F.lit(1).cast("long").alias("lo"), F.lit(top).cast("long").alias("hi"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    sizes = left.select(*part, F.col("a").alias("v"), F.lit(1).cast("long").alias("size")).where("false")  # of vertices that stand for many
    middle, steps = F.expr("(lo + hi + 1) DIV 2"), []
    for _ in range(top.bit_length() + 1):
        left, seen = checkpoint_counted(left, n=F.count(F.lit(1)))
        if not seen["n"]:
            return steps
        sizes = checkpoint(sizes)
        heavy = left.where(F.col("weight") >= middle)
        ends = heavy.select(*part, F.col("a").alias("id")).union(heavy.select(*part, F.col("b").alias("id")))
        comp = checkpoint(connected_components(heavy, ends, part, "a", "b"))
        one = F.coalesce("size", F.lit(1).cast("long"))
        grown = checkpoint(comp.withColumnRenamed("id", "v").join(sizes, [*part, "v"], "left").groupBy(*part, "comp").agg(F.sum(one).alias("size")))
        steps.append(grown.groupBy(*part).agg(F.max("size").alias("size")).select(*key, middle.alias("weight"), "size"))
        # above the middle vertices stay as they are; below it each component is one vertex, named by its smallest
        above = lambda df: df.withColumn("lo", middle + 1)
        below = lambda df: df.withColumn("hi", middle - 1)
        names = lambda end: comp.select(*part, F.col("id").alias(end), F.col("comp").alias(f"comp_{end}"))
        light = left.where(F.col("weight") < middle).join(names("a"), [*part, "a"], "left").join(names("b"), [*part, "b"], "left")
        light = light.select(*part, F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"), "weight").where("a != b")
        outside = sizes.join(comp.select(*part, F.col("id").alias("v")), [*part, "v"], "left_anti")
        merged = outside.union(grown.select(*part, F.col("comp").alias("v"), "size"))
        inner = sizes.join(heavy.select(*part).distinct(), part, "left_semi")
        left = above(left.where(F.col("weight") > middle)).union(below(light)).where("lo <= hi")
        sizes = above(inner).union(below(merged)).where("lo <= hi")
        used = left.select(*part, F.col("a").alias("v")).union(left.select(*part, F.col("b").alias("v"))).distinct()
        sizes = sizes.join(used, [*part, "v"], "left_semi")
    raise RoundLimitReached("halving the numbers did not end")
