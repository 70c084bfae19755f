"""Connected components (G1-G4), for one graph or for many keyed graphs at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loop import RoundLimitReached, checkpoint, checkpoint_counted, fingerprint, numbered

#: Edges of one of many keyed graphs that is solved inside one task.
SMALL_EDGES = 200_000

#: Edges that a task gathers before it reduces them to a forest.
FOREST_EDGES = 1 << 20


def connected_components(
    edges: DataFrame,
    vertices: DataFrame,
    key: Sequence[str] = (),
    src: str = "src",
    dst: str = "dst",
    vertex: str = "id",
    max_rounds: int = 50,
    small: int = SMALL_EDGES,
) -> DataFrame:
    """``(*key, id, comp)`` with ``comp`` the smallest id reachable from ``id``.

    Where ids are whole numbers, each task first reduces its edges to a forest with the same components, and again after
    each round, so that no more than a few edges for each vertex are ever shuffled.  The loop alternates large-star and small-star steps
    (Kiveris et al., 2014), which need O(log^2 n) rounds on any graph and only ``min`` aggregations that combine on
    the map side, so a hub or a chain is no special case.  Of many keyed graphs those of up to ``small`` edges are solved whole inside
    tasks, several at a time; a graph without a key always lies in many tasks.  Edges are taken as
    undirected; self loops and rows with a null end are ignored.  A vertex without
    edges is its own component.  Raises :class:`RoundLimitReached` if
    ``max_rounds`` is not enough.
    """
    key = list(key)
    u, v = F.col("u"), F.col("v")
    pairs = edges.select(*key, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (u != v)
    )
    whole = pairs.schema["u"].dataType.typeName() == "long"
    reduced = (lambda some: _forests(some, key)) if whole else (lambda some: some)
    sign = {"n": F.count(F.lit(1)), "s": fingerprint(*key, "u", "v")}
    pairs, before = checkpoint_counted(reduced(pairs).distinct(), **sign)
    solved = None
    if key and whole and before["n"]:
        little, pairs = _by_size(pairs, key, small)
        solved = _solved_in_tasks(little, key)
        pairs, before = checkpoint_counted(pairs, **sign)
    for _ in range(max_rounds):
        if not before["n"]:
            break
        pairs, now = checkpoint_counted(reduced(_small_star(_large_star(pairs, key), key)), **sign)
        if now == before:
            break
        before = now
    else:
        raise RoundLimitReached(f"components did not converge in {max_rounds} rounds")
    pairs = pairs if solved is None else pairs.union(solved)
    roots = pairs.select(*key, u.alias(vertex), v.alias("__root"))
    return (
        vertices.select(*key, vertex)
        .distinct()
        .join(roots, [*key, vertex], "left")
        .select(*key, vertex, F.coalesce("__root", vertex).alias("comp"))
    )


def _by_size(pairs: DataFrame, key: list[str], small: int) -> tuple[DataFrame, DataFrame]:
    """The edges of graphs with up to ``small`` edges, and those of the others."""
    sizes = checkpoint(pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    of = lambda some: pairs.join(sizes.where(some).select(*key), key, "left_semi")
    return of(F.col("n") <= small), of(F.col("n") > small)


def _forests(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Of each task's edges a forest that connects the same vertices: everybody linked to the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) < FOREST_EDGES:
                continue
            held = [_stars(pa.concat_tables(held), key)]
            if len(held[0]) > FOREST_EDGES // 2:  # there is little left to reduce
                yield from held.pop().to_batches()
        if held:
            yield from _stars(pa.concat_tables(held), key).to_batches()

    names = [*key, "u", "v"]
    return pairs.select(*names).mapInArrow(run, pairs.select(*names).schema)


def _solved_in_tasks(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, u, v)`` with ``v`` the smallest id that ``u`` is connected to; each keyed graph lies in one task."""
    group = F.xxhash64(F.lit(0), *key)
    dealt = pairs.select(group.alias("__group"), *key, "u", "v").repartition("__group").sortWithinPartitions("__group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            numbers = held.column("__group").to_numpy()
            ends = np.nonzero(numbers[1:] != numbers[:-1])[0]
            if len(ends):  # the last graph may go on in the next batch
                yield from _stars(held.slice(0, int(ends[-1]) + 1), key).to_batches()
                held = held.slice(int(ends[-1]) + 1)
        if held is not None:
            yield from _stars(held, key).to_batches()

    return dealt.mapInArrow(run, pairs.select(*key, "u", "v").schema)


def _stars(edges: pa.Table, key: list[str]) -> pa.Table:
    """``(*key, u, v)`` with ``v`` the smallest id that these edges connect ``u`` to, for all ids but the smallest ones."""
    graph = np.zeros(len(edges), np.int64)
    for name in key:
        column = edges.column(name).combine_chunks().dictionary_encode()
        codes = column.indices.fill_null(len(column.dictionary)).to_numpy(zero_copy_only=False)
        graph = np.unique(graph * (len(column.dictionary) + 1) + codes, return_inverse=True)[1]
    # a vertex is a pair of its graph's number and its id; pairs sort by graph, then id
    ids, at = np.unique(np.concatenate([edges.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    vertices, number = np.unique(np.concatenate([graph, graph]) * len(ids) + at, return_inverse=True)
    label = _smallest_reachable(number[: len(edges)], number[len(edges) :], len(vertices))
    linked = np.nonzero(label != np.arange(len(vertices)))[0]
    columns = [pa.array(ids[vertices[linked] % len(ids)]), pa.array(ids[vertices[label[linked]] % len(ids)])]
    if key:
        first = np.unique(graph, return_index=True)[1]
        columns = [*edges.select(key).take(pa.array(first[vertices[linked] // len(ids)])).columns, *columns]
    return pa.table(columns, names=[*key, "u", "v"])


def _smallest_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex that each of the vertices from 0 to n - 1 is connected to."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        live = a != b
        if not live.any():
            return label
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := label[label], label):
            label = shorter


def _large_star(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Link every larger neighbour of a vertex to the vertex's smallest neighbour."""
    both = pairs.select(*key, "u", "v").union(pairs.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*key, "u").agg(F.least("u", F.min("v")).alias("m"))
    return (
        both.where("v > u")
        .join(low, [*key, "u"])
        .select(*key, F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )


def _small_star(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    low = pairs.groupBy(*key, "u").agg(F.min("v").alias("m"))
    linked = pairs.join(low, [*key, "u"])
    return (
        linked.select(*key, F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select(*key, "u", F.col("m").alias("v")))
        .where("u != v")
        .distinct()
    )


def component_sizes(comp: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """``(*key, comp, size)``: people in each component."""
    return comp.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("size"))


def largest_component(comp: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, range)``: size of the largest component of each keyed graph."""
    return component_sizes(comp, key).groupBy(*key).agg(F.max("size").alias("range"))


def component_numbers(comp: DataFrame) -> DataFrame:
    """``(comp, number)``: components numbered from 0 by their smallest member (K4)."""
    found = numbered(comp.select("comp").distinct(), [], [F.asc("comp")], "number")
    return found.select("comp", (F.col("number") - 1).alias("number"))
