"""Closeness centrality inside keyed groups, with bounds that spare full searches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import connected_components
from .loop import RoundLimitReached, checkpoint, checkpoint_counted, small as broadcast_small
from .paths import h_hop, levels

#: People in a component that is searched inside one task, and about so many at a time.
SMALL = 2000

#: Members who search together: a row for each vertex and block of them holds a bit for each, in words of 64 bits.
BLOCK = 256
WORDS = [f"m{i}" for i in range(BLOCK // 64)]

#: A level sum goes into the running totals after so many levels, to keep the plan short.
_FOLD = 8


def geodesics(
    edges: DataFrame,
    members: DataFrame,
    key: Sequence[str],
    comp: DataFrame | None = None,
    small: int = SMALL,
    max_rounds: int = 1000,
) -> DataFrame:
    """``(*key, id, r, s)``: how many each member reaches in its group, and the sum of distances.

    Components of up to ``small`` people, of which a group usually has many, are searched whole
    inside tasks, several at a time.  Larger ones are searched level by level, many members at a time.
    Members who reach nobody have ``r = s = 0``.  ``comp`` spares finding the components.
    """
    key = list(key)
    comp = checkpoint(connected_components(edges, members, key)) if comp is None else comp
    sizes = comp.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("n"))
    placed = checkpoint(comp.join(sizes, [*key, "comp"]).select(*key, "id", "comp", "n"))
    none = F.lit(0).cast("long")
    alone = placed.where("n = 1").select(*key, "id", none.alias("r"), none.alias("s"))
    little = placed.where(F.col("n").between(2, small)).select(*key, F.col("id").alias("src"), "comp")
    found = alone.union(_whole_components(edges.join(little, [*key, "src"]), key, small))
    large = placed.where(F.col("n") > small)
    if not large.isEmpty():
        inside = edges.join(large.select(*key, F.col("id").alias("src")), [*key, "src"], "left_semi")
        found = found.union(bit_distance_sums(inside, large, key, max_rounds=max_rounds))
    return found


def _whole_components(edges: DataFrame, key: list[str], small: int) -> DataFrame:
    """Distance sums in components that are small enough for one task; edges carry ``comp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch.to_pandas())
            if sum(map(len, held)) < 4 * small:
                continue
            rows = pd.concat(held, ignore_index=True)
            # the last component may go on in the next batch
            ends = np.nonzero(np.diff(rows["__group"].to_numpy()))[0]
            cut = ends[-1] + 1 if len(ends) else 0
            held = [rows.iloc[cut:]]
            yield from _searched(rows.iloc[:cut], key, small)
        if held:
            yield from _searched(pd.concat(held, ignore_index=True), key, small)

    group = F.xxhash64(*key, "comp").alias("__group")
    dealt = edges.select(*key, group, "comp", "src", "dst").repartition("__group").sortWithinPartitions("__group", *key, "comp")
    schema = StructType([*edges.select(*key).schema.fields, *StructType.fromDDL("id long, r long, s long").fields])
    return dealt.mapInArrow(run, schema)


def _searched(rows: pd.DataFrame, key: list[str], small: int) -> Iterator[pa.RecordBatch]:
    """All shortest distances inside the components of ``rows``, about ``small`` vertices at a time."""
    begin = 0
    groups = rows["__group"].to_numpy()
    ends = np.concatenate([np.nonzero(np.diff(groups))[0] + 1, [len(rows)]]) if len(rows) else []
    for end in ends:
        if end - begin < small and end != len(rows):
            continue
        part = rows.iloc[begin:end]
        begin = end
        names = [*key, "comp"]
        vertices = part[[*names, "src"]].drop_duplicates().reset_index(drop=True)
        number = pd.Series(np.arange(len(vertices)), pd.MultiIndex.from_frame(vertices))
        ends_of = lambda end: number.reindex(pd.MultiIndex.from_frame(part[[*names, end]])).to_numpy()  # noqa: B023,E731
        r, s = _bit_search(ends_of("src"), ends_of("dst"), len(vertices))
        found = vertices[key].assign(id=vertices["src"], r=r, s=s)
        yield pa.RecordBatch.from_pandas(found, preserve_index=False)


def _bit_search(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vertex how many it reaches and the sum of distances: all searches at once, a bit each."""
    order = np.argsort(dst, kind="stable")
    src, dst = src[order].astype(np.int64), dst[order].astype(np.int64)
    first = np.nonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))[0]
    seen = np.zeros((n, -(-n // 64)), np.uint64)
    seen[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
    here, r, s, depth = seen.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    while here.any():
        depth += 1
        step = np.zeros_like(seen)
        step[dst[first]] = np.bitwise_or.reduceat(here[src], first, axis=0)
        here = step & ~seen
        seen |= here
        new = np.bitwise_count(here).sum(axis=1, dtype=np.int64)
        r += new
        s += depth * new
    return r, s


def distance_sums(edges: DataFrame, members: DataFrame, key: Sequence[str], max_rounds: int = 1000) -> DataFrame:
    """As :func:`geodesics`, level by level with joins, for components of any size.

    All members search at once.  Between levels only sums are kept, and of the searches only
    the last two levels.
    """
    key = list(key)
    start = checkpoint(members.select(*key, F.col("id").alias("source"), F.col("id").alias("v")).distinct())
    none = F.lit(0).cast("long")
    parts = [start.select(*key, F.col("source").alias("id"), none.alias("r"), none.alias("s"))]
    total = lambda: reduce(DataFrame.union, parts).groupBy(*key, "id").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    for depth, level in levels(edges, start, [*key, "source"], key, max_rounds=max_rounds):
        count = level.groupBy(*key, F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("r"))
        parts.append(count.withColumn("s", F.col("r") * depth))
        if len(parts) > _FOLD:
            parts = [checkpoint(total())]
    return total()


def bit_distance_sums(
    edges: DataFrame, members: DataFrame, key: Sequence[str], worth: DataFrame | None = None, max_rounds: int = 1000
) -> DataFrame:
    """As :func:`distance_sums`, with a row for each vertex and block of ``BLOCK`` members instead of each member.

    The members of a block search at once, a bit each; bits that meet at a vertex are merged by ``bit_or``.
    With ``worth``, which is ``(*key, id, r, floor)``, a search breaks off as soon as its sum can no longer give a centrality of
    ``floor`` (null: none is too small): after ``depth`` levels whoever of the ``r`` others is not yet reached is at least ``depth + 1``
    away.  Members whose search has been broken off have no row.
    """
    key = list(key)
    bit = [*key, "block", "bit"]
    sources = checkpoint(numbered_members(members, key))
    count = sources.count()
    start = checkpoint(sources.selectExpr(*key, "id AS v", "block", *[f"{_in_word(i)} AS {m}" for i, m in enumerate(WORDS)]))
    parts = [sources.selectExpr(*bit, "0L AS r", "0L AS s")]
    total = lambda: reduce(DataFrame.union, parts).groupBy(*bit).agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    bounds = None
    if worth is not None:
        bounds = sources.join(worth.selectExpr(*key, "id", "r AS all", "floor"), [*key, "id"]).select(*bit, "all", "floor")
        bounds = broadcast_small(checkpoint(bounds), count)
    edges = checkpoint(edges.select(*key, "src", "dst").repartition(*key, "src"))
    here, before = start, None
    for depth in range(1, max_rounds + 1):
        level, seen = checkpoint_counted(_next_level(here, before, edges, key), n=F.count(F.lit(1)))
        if not seen["n"]:
            done = total() if bounds is None else total().join(bounds, bit).where("r = all")
            return done.join(sources, bit).select(*key, "id", "r", "s")
        parts.append(_counts_by_bit(level, key).selectExpr(*bit, "r", f"r * {depth} AS s"))
        if bounds is not None:
            can_reach = f"floor IS NULL OR all = 0 OR floor <= all * all * 1D / nullif(s + (all - r) * {depth + 1}, 0)"
            alive = checkpoint(total().join(bounds, bit).where(can_reach).select(*bit, "r", "s"))
            parts = [alive]
            on = alive.groupBy(*key, "block").agg(*[F.expr(f"bit_or({_in_word(i)}) AS on_{m}") for i, m in enumerate(WORDS)])
            masked = level.join(broadcast_small(on, count), [*key, "block"])
            level = masked.selectExpr(*key, "v", "block", *[f"{m} & on_{m} AS {m}" for m in WORDS]).where(_SOME)
        elif len(parts) > _FOLD:
            parts = [checkpoint(total())]
        here, before = level, here
    raise RoundLimitReached(f"some paths are longer than {max_rounds} hops")


#: Any bit is set.
_SOME = " OR ".join(f"{m} != 0" for m in WORDS)


def _in_word(i: int) -> str:
    """The bit numbered ``bit``, if it belongs to word ``i``."""
    return f"if(bit DIV 64 = {i}, shiftleft(1L, bit % 64), 0L)"


def numbered_members(members: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, id, block, bit)``: members of each group in blocks of up to ``BLOCK``, numbered inside ranges of the ids."""
    dealt = members.select(*key, "id").distinct().repartitionByRange(*key, "id")
    ranged = checkpoint(dealt.withColumn("__range", F.spark_partition_id().cast("long")))
    number = F.row_number().over(W.partitionBy(*key, "__range").orderBy("id")) - 1
    block = F.shiftleft("__range", 32) + F.floor(number / BLOCK)
    return ranged.select(*key, "id", block.alias("block"), (number % BLOCK).cast("int").alias("bit"))


def _next_level(here: DataFrame, before: DataFrame | None, edges: DataFrame, key: list[str]) -> DataFrame:
    """The bits that arrive at each vertex one hop further and have not been there in the last two levels."""
    at = [*key, "v", "block"]
    step = here.join(edges.withColumnRenamed("src", "v"), [*key, "v"])
    rows = step.selectExpr(*key, "dst AS v", "block", *WORDS, *[f"0L AS old_{m}" for m in WORDS])
    for old in [here] if before is None else [here, before]:
        rows = rows.union(old.selectExpr(*at, *[f"0L AS {m}" for m in WORDS], *[f"{m} AS old_{m}" for m in WORDS]))
    merged = rows.groupBy(*at).agg(*[F.expr(f"bit_or({m}) & ~bit_or(old_{m}) AS {m}") for m in WORDS])
    return merged.where(_SOME)


def _counts_by_bit(level: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, block, bit, r)``: at how many vertices of a level each bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            group = rows.groupby([*key, "block"], dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.nonzero(np.diff(group[order], prepend=-1))[0]
            if not len(first):
                continue
            masks = rows[WORDS].to_numpy(np.int64)[order].view(np.uint8).reshape(len(rows), -1)
            sums = np.add.reduceat(np.unpackbits(masks, axis=1, bitorder="little"), first, axis=0, dtype=np.int64)
            at, bit = np.nonzero(sums)
            found = rows[[*key, "block"]].iloc[order[first[at]]]
            yield pa.RecordBatch.from_pandas(found.assign(bit=bit.astype(np.int32), r=sums[at, bit]), preserve_index=False)

    names = [*key, "block"]
    schema = StructType([*level.select(*names).schema.fields, *StructType.fromDDL("bit int, r long").fields])
    return level.select(*names, *WORDS).mapInArrow(run, schema).groupBy(*names, "bit").agg(F.sum("r").alias("r"))


def closeness(edges: DataFrame, members: DataFrame, key: Sequence[str], normalize: bool = False, isolated: bool = False) -> DataFrame:
    """``(*key, id, r, s, centrality)`` with centrality ``r * r / s``.

    ``normalize`` divides by the number of other members of the group.  Members who reach nobody are
    left out, or get 0 with ``isolated``.
    """
    return centrality(geodesics(edges, members, key), members, key, normalize, isolated)


def centrality(found: DataFrame, members: DataFrame, key: Sequence[str], normalize: bool = False, isolated: bool = False) -> DataFrame:
    """The score column for :func:`geodesics` rows."""
    key = list(key)
    score = F.when(F.col("s") > 0, F.col("r") * F.col("r") * F.lit(1.0) / F.col("s")).otherwise(F.lit(0.0))
    if normalize:
        sizes = members.select(*key, "id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
        found = found.join(sizes, key)
        score = F.when(F.col("__n") > 1, score / (F.col("__n") - 1)).otherwise(score)
    found = found if isolated else found.where("r > 0")
    return found.select(*key, "id", "r", "s", score.alias("centrality"))


def level_sizes(edges: DataFrame, members: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, id, L1, L2, L3, reach3, partial)``: people at 1, 2 and 3 hops."""
    key = list(key)
    near = h_hop(edges, members.select(*key, F.col("id").alias("source")), 3, key, key)
    at = lambda d: F.count_if(F.col("d") == d).alias(f"L{d}")
    sizes = near.groupBy(*key, F.col("source").alias("id")).agg(at(1), at(2), at(3))
    reach, partial = F.expr("L1 + L2 + L3"), F.expr("L1 + 2 * L2 + 3 * L3")
    return sizes.select(*key, "id", "L1", "L2", "L3", reach.alias("reach3"), partial.alias("partial"))


def with_bound(sizes: DataFrame, components: DataFrame, key: Sequence[str]) -> DataFrame:
    """``sizes`` with ``comp``, ``r`` and ``bound``, the least possible distance sum.

    Whoever is not within three hops is at least four away.
    """
    key = list(key)
    comp_sizes = components.groupBy(*key, "comp").agg((F.count(F.lit(1)) - 1).alias("r"))
    placed = components.join(comp_sizes, [*key, "comp"])
    return sizes.join(placed, [*key, "id"]).withColumn("bound", F.expr("partial + 4 * (r - reach3)"))


def walk_bounds(edges: DataFrame, components: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, id, comp, r, bound)``: as :func:`with_bound`, from counts of walks instead of anybody's neighbourhood.

    Walks of two and three edges that never turn back are sums over edges, and at least as many as people at that distance.
    The bound is the sum if as many people as possible were that near, and the rest four away.
    """
    key = list(key)
    comp_sizes = components.groupBy(*key, "comp").agg((F.count(F.lit(1)) - 1).alias("r"))
    placed = components.join(comp_sizes, [*key, "comp"]).select(*key, "id", "comp", "r")
    edges = edges.select(*key, "src", "dst")
    beside = lambda counts, n: edges.join(counts.withColumnRenamed("id", "dst"), [*key, "dst"]).groupBy(*key, F.col("src").alias("id")).agg(n)
    one = checkpoint(edges.groupBy(*key, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("w1")))
    two = checkpoint(beside(one, F.sum(F.col("w1") - 1).alias("w2")))
    three = beside(two, F.sum("w2").alias("w3"))
    counted = placed.join(one, [*key, "id"], "left").join(two, [*key, "id"], "left").join(three, [*key, "id"], "left").na.fill(0, ["w1", "w2", "w3"])
    # a walk of three edges goes on from a friend's two that do not begin with the way back
    near = counted.withColumn("L2", F.expr("least(w2, r - w1)")).withColumn("L3", F.expr("least(w3 - w1 * (w1 - 1), r - w1 - L2)"))
    return near.select(*key, "id", "comp", "r", F.expr("w1 + 2 * L2 + 3 * L3 + 4 * (r - w1 - L2 - L3)").alias("bound"))


def prune_by_bound(bounded: DataFrame, kth: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates whose best possible centrality reaches ``kth`` ``(*key, floor)``."""
    best = F.col("r") * F.col("r") * F.lit(1.0) / F.col("bound")
    kept = bounded.where("r > 0").join(kth, list(key), "left").where(F.coalesce("floor", F.lit(0.0)) <= best)
    return kept.drop("floor")


def suffix_max(sizes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``sizes`` with the largest L1, L2 and L3 from each candidate to the last of its group.

    Candidates are dealt into ranges of their order, so that a large group lies in many tasks; each range adds
    the maxima of those after it.  Maxima run from the last candidate back: a frame that begins with all rows and ends at the own one grows
    by a row at a time, while Spark goes through all that follow a row anew for each row.
    """
    key = list(key)
    order = [F.desc("reach3"), F.desc("L1"), F.desc("L2"), F.desc("L3"), F.asc("id")]
    back = [F.asc("reach3"), F.asc("L1"), F.asc("L2"), F.asc("L3"), F.desc("id")]
    ranged = checkpoint(sizes.repartitionByRange(*key, *order).withColumn("__range", F.spark_partition_id()))
    after = W.partitionBy(*key, "__range").orderBy(*back).rowsBetween(W.unboundedPreceding, W.currentRow)
    later = W.partitionBy(*key).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    tops = ranged.groupBy(*key, "__range").agg(*[F.max(f"L{d}").alias(f"__top{d}") for d in (1, 2, 3)])
    tops = tops.select(*key, "__range", *[F.max(f"__top{d}").over(later).alias(f"__later{d}") for d in (1, 2, 3)])
    own = ranged.withColumns({f"max_L{d}": F.max(f"L{d}").over(after) for d in (1, 2, 3)}).join(tops, [*key, "__range"])
    return own.select(*sizes.columns, *[F.greatest(f"max_L{d}", f"__later{d}").alias(f"max_L{d}") for d in (1, 2, 3)])
