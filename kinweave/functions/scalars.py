"""Column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_key(day: str | Column) -> Column:
    """A date as the sortable number yyyymmdd (B1)."""
    return F.date_format(F.to_date(day), "yyyyMMdd").cast("int")


def born_since(person: DataFrame, day: date | str) -> DataFrame:
    """People born on or after ``day`` (B2)."""
    return person.where(F.col("birthday") >= F.lit(day).cast("date"))


def canonical_pair(a: str, b: str) -> tuple[Column, Column]:
    """The two ends of an unordered pair, the smaller first."""
    return F.least(a, b), F.greatest(a, b)


def by_name(df: DataFrame, name: str) -> DataFrame:
    """Rows with exactly this name, bytes and case alike."""
    return df.where(F.col("name") == F.lit(name))


def mutual(x: str | int) -> Column:
    """Both directions of an edge have more than ``x`` replies."""
    return F.least("in_cnt", "out_cnt") > (F.col(x) if isinstance(x, str) else F.lit(x))


def common_tags(a: str, b: str) -> Column:
    """Number of tags that two tag lists share (B6); a missing list is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0)).cast("long")


def born_since_in(audience: str, day: str | Column) -> Column:
    """The part of an audience list that was born on or after ``day``."""
    return F.filter(audience, lambda member: member["birthday"] >= day)
