"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, components.

A fingerprint has 64 bits; bit b is set if more than half of the text's 3-word
shingle hashes (XXH64, seed 42, repeats included) have it.  Two texts are linked if
their fingerprints differ in at most three bits.

Links are searched in BK-trees, whose children are keyed by their Hamming distance
to the parent; a search follows only edges within the radius.  One tree over all
fingerprints could be neither built nor broadcast, so fingerprints are dealt into
shards first: of four 16-bit blocks two fingerprints at distance three agree in at
least one, and of four 12-bit blocks of the other 48 bits again in at least one.
Each fingerprint therefore goes to 16 shards (block, sub-block, their 28 bits) and
every linked pair meets in one.  A shard of more than ``MAX_TREE`` fingerprints is dealt
again in the same way: of four blocks of the bits that are left, two close fingerprints agree in one.
Every level fixes more bits, so a shard that stays large after some levels would need more
different fingerprints than its free bits allow.  A shard's tree travels to its task
through the shuffle; no structure that grows with the data is broadcast.  Jobs report only links
that join two groups of theirs, never all pairs of a group.

Edge cases: a null text counts as empty and has fingerprint zero, which links like
any other; very long texts are read in parts; a null id belongs to its text's group but is never its
smallest id; repeated rows are returned as often as they come in; an empty table gives no rows; other
columns are ignored, whatever they are called, and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.loop import checkpoint, checkpoint_counted
from .text import as_bytes, pieces, schema_of, slices, small

#: Fingerprints in one BK-tree at most.
MAX_TREE = 4096

SEED = 42


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit SimHash of one text."""
    digest, ones, n, last = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for part in slices(text.lower()):
        words = last + part.split()
        hashes = np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:]))), "<u8")
        for at in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
        last = words[-2:]
    if not n:
        return digest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text_hash, fp)`` with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            fps = np.array([fingerprint(t) for t in as_bytes(piece.column(text))], np.uint64).view(np.int64)
            columns = [piece.column(id_col), piece.column("__hash"), pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "text_hash", "fp"])

    rows = df.select(id_col, text, F.xxhash64(text).alias("__hash"))
    return rows.mapInArrow(run, schema_of(df, [id_col], "text_hash long, fp long"))


class BKTree:
    """Fingerprints with children keyed by Hamming distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while node:
            d = (value ^ self.values[at]).bit_count()
            if (below := self.children[at].setdefault(d, node)) == node:
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes at distance ``radius`` or less."""
        todo = [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                yield at
            todo += [c for e, c in children[at].items() if -radius <= e - d <= radius]


def _joining_links(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join two groups; the groups that they leave are those that all links would."""
    group = list(range(len(prints)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    links, tree = [], BKTree()
    for i, value in enumerate(prints):
        for j in tree.within(value, radius):
            a, b = root(i), root(j)
            if a != b:
                group[a] = b
                links.append((value, prints[j]))
        tree.add(value)
    return links


def linked(fps: DataFrame, radius: int = 3, max_tree: int = MAX_TREE) -> DataFrame:
    """``(src, dst)`` links between distinct fingerprints ``fp``, enough to give all groups."""
    if not 0 <= radius <= 3:
        raise ValueError("the shards hold all links only up to a radius of 3")
    # what a shard has not fixed yet of its fingerprints' bits: ``rest``, ``free`` bits of it
    level = fps.select("fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"))
    free, found = 64, []
    for _ in range(2):
        level, free = _dealt(level, free)
    while True:
        sizes = level.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes, seen = checkpoint_counted(sizes, largest=F.coalesce(F.max("n"), F.lit(0)))
        last = seen["largest"] <= max_tree or free <= 8
        of = lambda some: level.join(some.select("shard"), "shard")  # noqa: B023,E731
        found.append(_tree_links(of(sizes if last else sizes.where(F.col("n") <= max_tree)), radius))
        if last:
            return reduce(DataFrame.union, found)
        level, free = _dealt(of(sizes.where(F.col("n") > max_tree)), free)
        level = checkpoint(level)


def _dealt(level: DataFrame, free: int) -> tuple[DataFrame, int]:
    """Each shard dealt into smaller ones by every fourth of its free bits; and how many stay free."""
    width = free // 4
    parts = []
    for block in range(4):
        fixed = F.shiftrightunsigned("rest", width * block).bitwiseAND(F.lit((1 << width) - 1))
        above = width * (block + 1)
        high = F.shiftleft(F.shiftrightunsigned("rest", above), width * block) if above < 64 else F.lit(0).cast("long")
        low = F.col("rest").bitwiseAND(F.lit((1 << width * block) - 1))
        parts.append(F.struct(F.lit(block).alias("block"), fixed.alias("fixed"), high.bitwiseOR(low).alias("rest")))
    spread = level.select("fp", "shard", F.explode(F.array(*parts)).alias("p"))
    shard = F.xxhash64("shard", "p.block", "p.fixed")  # two shards of one hash are one shard: its links are checked anyway
    return spread.select("fp", shard.alias("shard"), F.col("p.rest").alias("rest")), free - width


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links inside each shard by a BK-tree of its own.

    Rows are dealt and sorted by a number made from the shard's.  By the shard itself Spark would leave both out after a join by shards, and
    then, if it turns that join into a broadcast while it runs, shards reach their tasks in parts and out of order, and links are lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, prints, found = None, [], []

        def packed() -> pa.RecordBatch:
            columns = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], names=["src", "dst"])

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for key, value in zip(keys.tolist(), fps.view(np.uint64).tolist()):
                if key != shard:
                    found += _joining_links(prints, radius) if len(prints) > 1 else []
                    shard, prints = key, []
                prints.append(value)
            if found:
                yield packed()
                found = []
        found += _joining_links(prints, radius) if len(prints) > 1 else []
        yield packed()

    own = rows.select(F.xxhash64(F.lit("tree"), "shard").alias("shard"), "fp")  # two shards of one number are one shard
    return own.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "src long, dst long")


def components(fps: DataFrame, id_col: str = "doc_id", radius: int = 3) -> DataFrame:
    """The rows of :func:`fingerprints` with ``group``, the smallest fingerprint of their
    component, and ``component_id``, the smallest id in it.

    ``fps`` is read three times and should be a checkpoint or a table.
    """
    first = checkpoint(fps.groupBy("fp").agg(F.min(id_col).alias("first")))
    links = checkpoint(linked(first.select("fp"), radius))
    ends = links.select(F.col("src").alias("fp")).union(links.select("dst")).distinct()
    groups = connected_components(links, ends, vertex="fp")
    joined = checkpoint(first.join(groups, "fp"))
    smallest = joined.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_linked = joined.join(smallest, "comp").select("fp", "component_id", "comp")
    group = F.coalesce("comp", "fp").alias("group")
    own = F.when(F.col("comp").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")
    by_fp = checkpoint(first.join(of_linked, "fp", "left").select("fp", group, own))
    return fps.join(by_fp, "fp").select(*fps.columns, "group", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """``(id, text_hash, fp, group, component_id)`` of every row; texts are read once."""
    return components(checkpoint(fingerprints(df, id_col, text)), id_col, radius)


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One row of ``df`` for each group: one with the group's smallest id.

    If several rows of a group have that id, one text of theirs stays, once.
    """
    found = checkpoint(near_duplicates(df, id_col, text, radius))
    first = found.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    kept = checkpoint(first.groupBy("group").agg(F.min("text_hash").alias("__kept"), F.min("component_id").alias("__first"), F.count(F.lit(1)).alias("__n")))
    stays = F.col(id_col).eqNullSafe(F.col("__first")) & (F.col("text_hash") == F.col("__kept"))
    gone = found.join(kept, "group").where(~stays).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    matches = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    out = df.join(small(checkpoint(gone)), matches, "left_anti")
    return out if kept.where("__n > 1").isEmpty() else out.dropDuplicates([id_col, text])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fingerprints as 16 lower-case hex digits."""
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
