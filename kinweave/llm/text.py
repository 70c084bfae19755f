"""Small helpers that the text operators share inside and outside of tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy or word-list step holds at a time.
PIECE_BYTES = 4 << 20

#: Bytes of record batches after which a task gives freed memory back.
GIVE_BACK_BYTES = 16 << 20

#: Bytes up to which a table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

#: A-Z to a-z, and every ASCII byte that is no digit or letter to a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory that Arrow's pool and glibc's malloc hold on to.

    Workers live on from stage to stage, and each would keep the most that any of its tasks took.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece has about ``PIECE_BYTES`` of text.

    A single text is never cut, so a piece is at most one text beyond that.  What earlier tasks and batches have
    freed is given back at the start, now and then, and at the end.
    """
    give_back()
    since = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > PIECE_BYTES:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)
        since += batch.nbytes
        if since >= GIVE_BACK_BYTES:
            del batch
            give_back()
            since = 0
    give_back()


def slices(text, size: int = PIECE_BYTES) -> Iterator:
    """``text`` (str or bytes) in parts of about ``size``, cut at blanks or line ends only."""
    blanks = (b" ", b"\n") if isinstance(text, bytes) else (" ", "\n")
    at = 0
    while len(text) - at > size:
        cuts = [c for b in blanks if (c := text.find(b, at + size)) >= 0]
        if not cuts:
            break
        yield text[at : min(cuts)]
        at = min(cuts)
    yield text[at:] if at else text


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df``, a checkpoint or table, marked for broadcast if so many rows of ``row_bytes`` fit; they are counted first."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def set_aside(df: DataFrame, taken: list[str]) -> DataFrame:
    """``df`` with the columns that an operator's results will be named like renamed, ``_given`` appended."""
    names = list(df.columns)
    for i, name in enumerate(names):
        while name in taken or name in names[:i] + names[i + 1 :]:
            name += "_given"
        names[i] = name
    return df.toDF(*names)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def plain_words(text: bytes) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def schema_of(df: DataFrame, columns: list[str], more: str) -> StructType:
    """The schema of some columns of ``df`` followed by the columns of a DDL string."""
    return StructType(df.select(*columns).schema.fields + StructType.fromDDL(more).fields)
