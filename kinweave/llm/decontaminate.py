"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``window`` consecutive words of a test item is a pattern; an item
with fewer words is one pattern.  Patterns of one length share a searcher.  It looks
at blocks of two words: the shift table says how far the search may jump when a block
ends no pattern, and a block that is no part of any pattern allows the longest jump.
Where the shift is zero, the hashes of the suffix block and of the prefix block select a bucket
of patterns, and comparing the words directly confirms or rejects each.

Shift tables are indexed by hashes and patterns are places in the items' words, so a task holds
some eight bytes for each byte of item text.  Items go out in sets of bounded size; if they exceed
one set, the texts are searched for one set after the other, the driver holds one at a time, and the
hits are combined.

Edge cases: null texts and items have no words; items without words have no
patterns; repeated items count once for each item id, items with a null id take part in
hits but have no id to report; repeated documents each get their row; very long texts are
searched whole; empty tables give no rows or no hits; columns other than id and text are ignored,
whatever they are called, and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.loop import checkpoint
from .text import BROADCAST_BYTES, as_bytes, pieces, plain_words, schema_of, small

#: Consecutive words that count as leaked.
WINDOW = 10

#: Bytes of item text whose patterns are sent to the tasks at a time.
SET_BYTES = BROADCAST_BYTES

#: Slots of a shift table at least, and for each word of the items.
SLOTS, SLOTS_A_WORD = 1 << 16, 4

_hash = xxhash.xxh3_64_intdigest


@dataclass(frozen=True)
class Patterns:
    """Patterns of one length: the shift table, and their places in the item words by bucket."""

    length: int
    shift: bytes
    buckets: np.ndarray
    places: np.ndarray
    owners: np.ndarray


@dataclass(frozen=True)
class Items:
    """Item ids, the words of all items, and their patterns."""

    ids: list
    words: bytes
    patterns: list[Patterns]


def item_set(items: list[tuple[int, str]], window: int = WINDOW) -> Items:
    """The tables of some items."""
    words: list[bytes] = []
    places: dict[int, list[int]] = defaultdict(list)
    owners: dict[int, list[int]] = defaultdict(list)
    for number, (_, text) in enumerate(items):
        own = plain_words((text or "").encode())
        if own:
            length = min(window, len(own))
            places[length] += range(len(words), len(words) + len(own) - length + 1)
            owners[length] += [number] * (len(own) - length + 1)
            words += own
    tables = [_patterns(length, words, np.array(places[length]), np.array(owners[length])) for length in sorted(places)]
    return Items([item for item, _ in items], b" ".join(words), tables)


def _patterns(length: int, words: list[bytes], places: np.ndarray, owners: np.ndarray) -> Patterns:
    block = min(2, length)
    hashes = np.fromiter((_hash(b" ".join(words[i : i + block])) for i in range(len(words) - block + 1)), np.uint64)
    slots = 1 << max(SLOTS, SLOTS_A_WORD * len(words)).bit_length()
    shift = np.full(slots, length - block + 1, np.uint8)
    for jump in range(length - block, -1, -1):  # shorter jumps overwrite longer ones
        shift[hashes[places + length - block - jump] & np.uint64(slots - 1)] = jump
    buckets = _bucket(hashes[places + length - block], hashes[places])
    order = np.argsort(buckets, kind="stable")
    return Patterns(length, shift.tobytes(), buckets[order], places[order], owners[order])


def _bucket(suffix, prefix):
    """One number for the hashes of a window's last and first block."""
    return suffix ^ (prefix >> np.uint64(1))


class WuManber:
    """Searches texts for the patterns of one length."""

    def __init__(self, patterns: Patterns, words: list[bytes]):
        self.patterns, self.words, self.block = patterns, words, min(2, patterns.length)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """Start of each occurrence and the number of an item that holds it there."""
        length, block, shift = self.patterns.length, self.block, self.patterns.shift
        last, n = len(shift) - 1, len(text)
        at = length  # the candidate's end
        while at <= n:
            suffix = _hash(b" ".join(text[at - block : at]))
            if jump := shift[suffix & last]:
                at += jump
                continue
            start = at - length
            for k in self.bucket(suffix, _hash(b" ".join(text[start : start + block]))):
                place = int(self.patterns.places[k])
                if self.words[place : place + length] == text[start:at]:
                    yield start, int(self.patterns.owners[k])
            at += 1

    def bucket(self, suffix: int, prefix: int) -> range:
        key, all_keys = _bucket(np.uint64(suffix), np.uint64(prefix)), self.patterns.buckets
        return range(int(np.searchsorted(all_keys, key)), int(np.searchsorted(all_keys, key, side="right")))


def searchers(items: Items) -> list[WuManber]:
    """One searcher for each length of pattern."""
    same: dict[bytes, bytes] = {}
    words = [same.setdefault(w, w) for w in items.words.split()]
    return [WuManber(p, words) for p in items.patterns]


def _item_sets(items: DataFrame, item_id: str, text: str, set_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in sets of about ``set_bytes``, one set on the driver at a time."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    sets = -(-max(1, total) // set_bytes)
    for k in range(sets):
        mine = items if sets == 1 else items.where(F.pmod(F.xxhash64(item_id, text), F.lit(sets)) == k)
        yield [tuple(row) for row in mine.select(item_id, text).toLocalIterator()]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _search(df: DataFrame, shared, id_col: str, text: str, all_rows: bool) -> DataFrame:
    """``(id, text_hash, n_words, hits, items)``; ``hits`` is a flat list of starts and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, tables = shared.value
        search = searchers(Items(ids, words, [Patterns(*t) for t in tables]))
        for piece in pieces(batches, text):
            rows, n_words, hits, items = [], [], [], []
            for row, content in enumerate(as_bytes(piece.column(text))):
                words = plain_words(content)
                spans, held = [], set()
                for s in search:
                    for at, item in s.find(words):
                        spans.append((at, at + s.patterns.length))
                        held.add(item)
                if all_rows or spans:
                    rows.append(row)
                    n_words.append(len(words))
                    hits.append([x for span in _merged(spans) for x in span])
                    items.append(sorted({str(ids[i]) for i in held if ids[i] is not None}))
            kept = piece.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column(id_col),
                    kept.column("__hash"),
                    pa.array(n_words, pa.int64()),
                    pa.array(hits, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[id_col, "text_hash", "n_words", "hits", "items"],
            )

    schema = schema_of(df, [id_col], "text_hash long, n_words long, hits array<int>, items array<string>")
    return df.select(id_col, text, F.xxhash64(text).alias("__hash")).mapInArrow(run, schema)


def find_items(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """``(id, text_hash, n_words, hits, items)`` for every row of ``df``.

    ``hits`` lists the word ranges that occurrences cover, merged and in order, as
    start, end, start, end, ...; ``items`` are the ids of the items with occurrences,
    sorted as strings.
    """
    parts = _item_sets(items, item_id, item_text, set_bytes)
    share = lambda part: df.sparkSession.sparkContext.broadcast(astuple(item_set(part, window)))
    found, more = _search(df, share(next(parts)), id_col, text, True), []
    for part in parts:
        shared = share(part)
        more.append(checkpoint(_search(df, shared, id_col, text, False)))
        shared.destroy()
    if not more:
        return found
    rest = checkpoint(
        reduce(DataFrame.unionByName, more)
        .groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.flatten(F.collect_set("hits")).alias("__hits"), F.flatten(F.collect_set("items")).alias("__items"))
    )
    both = found.join(rest, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    return both.select(
        id_col,
        "text_hash",
        "n_words",
        F.concat("hits", F.coalesce("__hits", F.array().cast("array<int>"))).alias("hits"),
        F.concat("items", F.coalesce("__items", F.array().cast("array<string>"))).alias("items"),
    ).mapInArrow(_merge_sets(id_col), found.schema)


def _merge_sets(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [
                [x for span in _merged(list(zip(h[::2], h[1::2], strict=True))) for x in span]
                for h in batch.column("hits").to_pylist()
            ]
            items = [sorted(set(i)) for i in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in (id_col, "text_hash", "n_words")),
                    pa.array(hits, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[id_col, "text_hash", "n_words", "hits", "items"],
            )

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Word counts, item counts and the SHA-256 of the sorted item ids."""
    lengths = F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.select(
        id_col,
        "n_words",
        lengths.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` in which no item occurs."""
    found = find_items(df, items, id_col, text, **options).where(F.size("hits") > 0)
    bad = checkpoint(found.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    matches = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    return df.join(small(bad), matches, "left_anti")
