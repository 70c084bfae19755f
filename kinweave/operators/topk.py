"""Ranked cuts with total orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: str | int, most: int | None = None) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``; ``k`` is a number or a column.

    With a number, Spark keeps only ``k`` rows of a key in each task before the shuffle; with a column
    it does so for ``most``, the largest value in it.
    """
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    if isinstance(k, int):
        kept = ranked.where(F.col("rank") <= k)
    else:
        kept = (ranked if most is None else ranked.where(F.col("rank") <= most)).where(F.col("rank") <= F.col(k))
    return kept.withColumn("rank", F.col("rank").cast("long"))


def largest(params: DataFrame, k: str = "k") -> int:
    """The largest ``k`` of a parameter table."""
    return params.agg(F.max(k)).first()[0] or 0


def top_k_by_part(
    df: DataFrame, key: Sequence[str], part: str, order: Sequence[Column], k: str | int, most: int | None = None
) -> DataFrame:
    """As :func:`top_k`, the best of each part of a key first, so that a large key is cut in many tasks."""
    best = top_k(df, [*key, part], order, k, most).drop("rank")
    return top_k(best, key, order, k, most)


def people_by_interests(tags: DataFrame, floor: int = 0) -> DataFrame:
    """``(person_id, n_tags)`` of people with ``floor`` interests or more, most first (T4)."""
    return tags.where(F.col("n_tags") >= floor).select("person_id", "n_tags").orderBy(F.desc("n_tags"), "person_id")


def pairs_worth_scoring(pairs: DataFrame, kth: str) -> DataFrame:
    """Pairs ``(n_tags_a, n_tags_b)`` that can still reach the ``kth`` common count (T4)."""
    return pairs.where(F.least("n_tags_a", "n_tags_b") >= F.col(kth))


def first_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of everything, without a full sort (T5)."""
    return df.orderBy(*order).limit(k)
