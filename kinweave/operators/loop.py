"""What every iterative operator shares: checkpoints, convergence, round caps.

Each round of a loop is cut with a reliable checkpoint in the folder named by
``spark.checkpoint.dir``, so that a lost executor costs a re-read and not the
whole lineage.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bytes up to which a table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


class RoundLimitReached(RuntimeError):
    """A loop hit its round cap before it converged; its answer would be wrong."""


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared checkpoint folder; make one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_counted(df: DataFrame, **aggregates) -> tuple[DataFrame, dict]:
    """Checkpoint ``df`` and return aggregates of it taken during the same job."""
    seen = Observation()
    out = checkpoint(df.observe(seen, *[a.alias(k) for k, a in aggregates.items()]))
    return out, seen.get


def fingerprint(*cols: str):
    """An order-independent aggregate: equal row sets give equal values."""
    return F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df``, which has been counted to have so many rows, marked for broadcast if these are few enough."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the number of each row in its group, from 1, by a total order.

    Rows are dealt into ranges of the order, so that a large group lies in many tasks; each range counts on from those before it.
    """
    key = list(key)
    ranged = checkpoint(df.repartitionByRange(*key, *order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy(*key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    offsets = counts.select(*key, "__range", F.coalesce(before, F.lit(0)).alias("__offset"))
    own = F.row_number().over(W.partitionBy(*key, "__range").orderBy(*order))
    placed = ranged.withColumn("__own", own).join(offsets, [*key, "__range"])
    return placed.select(*df.columns, (F.col("__own") + F.col("__offset")).cast("long").alias(name))
