"""Approximate neighbourhood sizes by mergeable distinct-count sketches.

A sketch has ``2^lg_k`` registers.  The MD5 of an id picks one and gives a rank, the place of the first set bit of
its next 64; a register holds the largest rank of the ids that picked it.  Sketches lie in rows of eight registers,
and rows without a filled register do not exist, so a small neighbourhood takes few of them.

What a register holds depends on the set of ids alone.  So it is known exactly which rows grew in a hop, and only
these travel in the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .loop import RoundLimitReached, checkpoint, checkpoint_counted, small

#: Registers in a row.
WIDTH = 8

_REGISTERS = [f"r{i}" for i in range(WIDTH)]


def _rank(digest: Column) -> Column:
    """Place, from 1, of the first set bit in hexadecimal digits 5 to 20."""
    digits = F.ltrim(F.substring(digest, 5, 16), F.lit("0"))
    first = F.substring(digits, 1, 1)
    inside = F.when(first >= "8", 0).when(first >= "4", 1).when(first >= "2", 2).otherwise(3)
    return (4 * (16 - F.length(digits)) + inside + 1).cast("byte")


def _own_sketches(edges: DataFrame, lg_k: int) -> DataFrame:
    """``(id, block, r0, ..., r7)`` of the sketches that hold their own vertex alone."""
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    register = F.shiftright(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), 16 - lg_k)
    placed = edges.select(F.col("src").alias("id")).distinct().select("id", register.alias("at"), _rank(digest).alias("rank"))
    filled = [F.when(F.col("at") % WIDTH == i, F.col("rank")).otherwise(F.lit(0).cast("byte")).alias(r) for i, r in enumerate(_REGISTERS)]
    return placed.select("id", F.floor(F.col("at") / WIDTH).cast("int").alias("block"), *filled)


def approx_neighbourhood(edges: DataFrame, h: int | None, lg_k: int = 12, max_rounds: int = 1000) -> DataFrame:
    """``(id, estimate)``: about how many people are within ``h`` hops, the start included.

    Without ``h`` sketches travel until none grows, which counts everybody within reach.  A vertex costs ``2^lg_k``
    registers at most, however large its neighbourhood is, and a hop costs the rows that grew in the last one, for each
    edge that leaves them.  The relative error is about ``1.04 / sqrt(2^lg_k)``; ``lg_k`` is 7 to 16.
    """
    if not 7 <= lg_k <= 16:
        raise ValueError("lg_k must be 7 to 16")
    into = checkpoint(edges.select("src", F.col("dst").alias("id")).distinct().repartition("id"))
    sketches = checkpoint(_own_sketches(into, lg_k))
    grown = sketches
    for _ in range(max_rounds if h is None else h):
        sent = into.join(grown, "id").select(F.col("src").alias("id"), "block", *_REGISTERS, F.lit(False).alias("held"))
        both = sketches.select("id", "block", *_REGISTERS, F.lit(True).alias("held")).union(sent)
        merged = both.groupBy("id", "block").agg(
            *[F.max(r).alias(r) for r in _REGISTERS],
            *[F.max(F.when(F.col("held"), F.col(r))).alias(f"old_{r}") for r in _REGISTERS],
        )
        grew = F.array_max(F.array(*[F.col(r) - F.coalesce(f"old_{r}", F.lit(0).cast("byte")) for r in _REGISTERS])) > 0
        known, seen = checkpoint_counted(merged.select("id", "block", *_REGISTERS, grew.alias("grew")), n=F.count_if("grew"))
        sketches, grown = known.drop("grew"), known.where("grew").drop("grew")
        if not seen["n"]:
            break
    else:
        if h is None:
            raise RoundLimitReached(f"sketches still grow after {max_rounds} hops")
    return _estimates(sketches, 1 << lg_k)


def approx_reach(edges: DataFrame, lg_k: int = 12) -> DataFrame:
    """``(id, estimate)``: about how many people are within reach of each, the start included; both directions of each edge are given.

    As :func:`approx_neighbourhood` without ``h``: whoever is within reach of one another has the same sketch, which is that of the
    component.  It is merged once for each component, from a row for each of its people, and no sketch travels along an edge.
    """
    if not 7 <= lg_k <= 16:
        raise ValueError("lg_k must be 7 to 16")
    both = checkpoint(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    comp = checkpoint(connected_components(both, both.select(F.col("src").alias("id"))))
    own = _own_sketches(both, lg_k).join(comp, "id")
    merged = own.groupBy("comp", "block").agg(*[F.max(r).alias(r) for r in _REGISTERS])
    found = checkpoint(_estimates(merged.withColumnRenamed("comp", "id"), 1 << lg_k).withColumnRenamed("id", "comp"))
    return comp.join(small(found, found.count()), "comp").select("id", "estimate")


def _estimates(sketches: DataFrame, registers: int) -> DataFrame:
    """The harmonic mean of the registers, or the share of empty ones where this is surer."""
    filled = sum((F.col(r) > 0).cast("int") for r in _REGISTERS)
    weight = sum(F.when(F.col(r) > 0, F.pow(F.lit(2.0), -F.col(r))).otherwise(0.0) for r in _REGISTERS)
    held = sketches.groupBy("id").agg(F.sum(filled).alias("filled"), F.sum(weight).alias("weight"))
    empty = F.lit(registers) - F.col("filled")
    mean = 0.7213 / (1 + 1.079 / registers) * registers**2 / (empty + F.col("weight"))
    few = registers * F.log(registers / F.nullif(empty, F.lit(0)))
    return held.select("id", F.round(F.when((mean <= 2.5 * registers) & (empty > 0), few).otherwise(mean)).cast("long").alias("estimate"))
