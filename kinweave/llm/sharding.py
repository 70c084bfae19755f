"""Uniform sharding by a hypergeometric communication matrix.

Rows are dealt into source partitions by a hash of their contents.  Given the
partitions' row counts and the shards' sizes (at most one row apart), the number of rows
that each partition sends to each shard is drawn exactly from the multivariate
hypergeometric law, which is what a uniform shuffle of all rows would give.  Each
partition permutes its rows locally (a seeded hash order) and cuts them by its row of
the matrix; after the exchange the rows of a shard are permuted again.  Shard sizes are
exact, and the result depends on the seed and the rows only, so a lost executor's work
can be repeated.

Both permutations rank inside buckets of bounded size and add the bucket's offset, so no
task sorts a whole shard.  Only the matrix of counts is on the driver.

Edge cases: nulls in any column and repeated ids are ordinary rows; very long texts are hashed
like others; rows that are equal in all columns are interchangeable, and if so many are that
their source partition would be overfull, each gets a number in a checkpoint first; an empty table
gives no rows; given columns named ``shard`` or ``slot`` come back as ``shard_given`` and
``slot_given``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.loop import checkpoint
from .text import BROADCAST_BYTES, set_aside

#: Rows that a bucket of a permutation holds on average.
BUCKET_ROWS = 1_000_000

#: Fixed value: numpy draws from urns with fewer balls than this.
NUMPY_URN = 1_000_000_000


def draw_good(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` balls, drawn without replacement, are good; for urns of any size.

    Beyond numpy's bound one uniform number is looked up in the cumulated probabilities around the
    mean; what lies further than 12 standard deviations off is below the number's resolution.
    """
    total = good + bad
    if total < NUMPY_URN:
        return int(draw.hypergeometric(good, bad, n))
    mean = n * (good / total)
    reach = 12 * math.sqrt(mean * (bad / total) * ((total - n) / (total - 1))) + 40
    low, high = max(0, n - bad, math.floor(mean - reach)), min(n, good, math.ceil(mean + reach))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    heights = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(heights, draw.random() * heights[-1], side="right")), len(k))


def draw_row(draw: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n`` from the counts ``left``."""
    if left.sum() < NUMPY_URN:
        return draw.multivariate_hypergeometric(left, n, method="marginals")
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, good in enumerate(left.tolist()):
        rest -= good
        out[s] = draw_good(draw, good, rest, n) if rest else n
        n -= int(out[s])
    return out


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard; all margins are exact.

    Partitions are taken in groups of fewer rows than ``NUMPY_URN``: what a group sends is drawn
    from all that is left, and what each of its partitions sends from the group's.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    matrix = np.zeros((len(counts), shards), np.int64)
    begin = 0
    while begin < len(counts):
        end, held = begin + 1, counts[begin]
        while end < len(counts) and held + counts[end] < NUMPY_URN // 2:
            held += counts[end]
            end += 1
        group = draw_row(draw, left, held)
        left -= group
        for p in range(begin, end):
            matrix[p] = draw_row(draw, group, counts[p])
            group -= matrix[p]
        begin = end
    return matrix


def assign(df: DataFrame, shards: int, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (the row's place in its shard, from 0)."""
    df = set_aside(df, ["shard", "slot"])
    spark, columns, own = df.sparkSession, df.columns, df.columns
    salted = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *own)
    total = df.count()
    partitions = max(shards, -(-total // bucket_rows))

    def deal(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        rows = rows.withColumn("__source", F.pmod(salted("source"), F.lit(partitions)).cast("int"))
        return rows, {r[0]: r[1] for r in rows.groupBy("__source").count().collect()}

    dealt, counted = deal(df)
    if max(counted.values(), default=0) > 2 * (total // partitions) + bucket_rows // 4:
        # Rows that are equal in every column crowd a partition: numbered, they part.
        own = [*own, "__copy"]
        dealt, counted = deal(checkpoint(df.withColumn("__copy", F.monotonically_increasing_id())))
    matrix = communication_matrix([counted.get(p, 0) for p in range(partitions)], shards, seed)
    ends = matrix.cumsum(axis=1)
    cuts = spark.createDataFrame(
        [(p, ends[p].tolist()) for p in range(partitions)], "__source int, __ends array<long>"
    )
    small = partitions * shards * 8 <= BROADCAST_BYTES
    cuts = F.broadcast(cuts) if small else cuts
    rank = F.row_number().over(W.partitionBy("__source").orderBy(salted("local"), *own))
    sent = (
        dealt.withColumn("__rank", rank)
        .join(cuts, "__source")
        .withColumn("shard", F.expr("size(filter(__ends, e -> e < __rank))"))
        .drop("__ends")
    )
    buckets = max(1, -(-total // (shards * bucket_rows)))
    order = salted("arrival")
    arrived = checkpoint(sent.withColumn("__order", order).withColumn("__bucket", F.pmod(F.shiftrightunsigned(order, 20), F.lit(buckets))))
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        arrived.groupBy("shard", "__bucket")
        .count()
        .select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    )
    offsets = F.broadcast(offsets) if buckets * shards * 24 <= BROADCAST_BYTES else offsets
    place = F.row_number().over(W.partitionBy("shard", "__bucket").orderBy("__order", "__source", "__rank"))
    return (
        arrived.withColumn("__place", place)
        .join(offsets, ["shard", "__bucket"])
        .select(*columns, F.col("shard").cast("int"), (F.col("__offset") + F.col("__place") - 1).cast("long").alias("slot"))
    )
