"""Hop distances by frontier loops.

Edges hold both directions of each friendship.  In such a graph the neighbours of a
breadth-first level lie in that level or in the ones beside it, so a new level is what the
last one reaches without the last two: no visited set is kept or joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import common_tags
from .loop import RoundLimitReached, checkpoint, checkpoint_counted, small


def levels(
    edges: DataFrame,
    start: DataFrame,
    state: Sequence[str],
    join_on: Sequence[str] = (),
    hops: int | None = None,
    allowed: Callable[[int], Column] | None = None,
    max_rounds: int = 1000,
):
    """Yield ``(depth, level)`` from depth 1 on; ``level`` holds ``(*state, v)``, never empty.

    ``start`` is level 0 and ``state`` its columns beside ``v``; ``join_on`` are those that the
    edges have too.  ``allowed(depth)`` filters the rows that a step reaches.  Edges are written once, dealt
    by their start, so no level derives or shuffles them again.
    """
    state, join_on = list(state), list(join_on)
    edges = checkpoint(edges.select(*join_on, "src", "dst").repartition(*join_on, "src"))
    cut = [*state, "v"]
    here, before = start.select(*cut), None
    for depth in range(1, (hops or max_rounds) + 1):
        step = here.join(edges.withColumnRenamed("src", "v"), [*join_on, "v"])
        step = step if allowed is None else step.where(allowed(depth))
        step = step.select(*state, F.col("dst").alias("v")).distinct().join(here, cut, "left_anti")
        step = step if before is None else step.join(before, cut, "left_anti")
        level, seen = checkpoint_counted(step, n=F.count(F.lit(1)))
        if not seen["n"]:
            return
        yield depth, level
        here, before = level, here
    if hops is None:
        raise RoundLimitReached(f"some paths are longer than {max_rounds} hops")


def h_hop(edges: DataFrame, sources: DataFrame, h: int, key: Sequence[str] = (), join_on: Sequence[str] = ()) -> DataFrame:
    """``(*key, source, id, d)``: everybody within ``h`` hops of each source, itself at 0."""
    key = list(key)
    start = checkpoint(sources.select(*key, "source", F.col("source").alias("v")).distinct())
    rings = [start.select(*key, "source", F.col("v").alias("id"), F.lit(0).alias("d"))]
    if h > 0:
        for depth, level in levels(edges, start, [*key, "source"], join_on, hops=h):
            rings.append(level.select(*key, "source", F.col("v").alias("id"), F.lit(depth).alias("d")))
    return reduce(DataFrame.union, rings)


def h_hop_counts(edges: DataFrame, sources: DataFrame, h: int) -> DataFrame:
    """``(source, n)``: how many others are within ``h`` hops."""
    return h_hop(edges, sources, h).groupBy("source").agg(F.count_if(F.col("d") > 0).alias("n"))


def hop_distance(weighted: DataFrame, pairs: DataFrame, max_rounds: int = 1000, heavy: float = 8.0) -> DataFrame:
    """``(qid, hops)`` for each of the ``pairs`` ``(qid, p1, p2, x)``.

    An edge serves a query if both its reply counts exceed the query's ``x``; a negative
    ``x`` allows every edge.  Both ends search at once, so the number of rounds is about half the
    distance; where the two searches first meet, their depths add up to it.  A side whose frontier has more
    than ``heavy`` times the edges of the other side's waits, so a hub is left to the search that comes towards it, and
    is never expanded if that search ends first.  Equal ends are 0 hops apart, ends without a path and negative ids -1.

    Only the edges are joined in a round; what else meets is grouped or semi-joined.  Spark takes the product of both sides for the
    size of a join and keeps it through checkpoints, so a state joined with what comes of it would multiply the digits of that number in each round.
    """
    edges = checkpoint(_with_degrees(weighted.select("src", "dst", F.least("in_cnt", "out_cnt").alias("weight"))))
    pairs = checkpoint(pairs.select("qid", "p1", "p2", "x"))
    asked = pairs.count()
    sought = pairs.where("p1 != p2 AND p1 >= 0 AND p2 >= 0")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p1").alias("v")), F.struct(F.lit(1).alias("side"), F.col("p2").alias("v"))))
    starts = sought.select("qid", "x", ends.alias("e")).select("qid", "x", "e.side", "e.v")
    degrees = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    # of each side its frontier, of age 0, and the level before, of age 1
    state = checkpoint(starts.join(degrees, "v").select("qid", "x", "side", "v", "degree", F.lit(0).alias("d"), F.lit(0).alias("age")))
    status = checkpoint(_status(state))
    for _ in range(max_rounds):
        sides = _sides(status, heavy)
        of = lambda some: state.join(small(sides.where(some).select("qid", "side"), 2 * asked), ["qid", "side"], "left_semi")  # noqa: B023,E731
        state, seen = checkpoint_counted(_next_state(of("moves"), of("NOT moves"), edges), n=F.count_if("moved"))
        state = state.drop("moved")
        if not seen["n"]:
            break
        status = checkpoint(_status(state, status))
    else:
        raise RoundLimitReached(f"some paths are not found in {max_rounds} rounds")
    hops = F.when(F.col("p1") == F.col("p2"), 0).otherwise(F.coalesce("hops", F.lit(-1)))
    return pairs.join(status.select("qid", "hops"), "qid", "left").select("qid", hops.cast("long").alias("hops"))


def _with_degrees(edges: DataFrame) -> DataFrame:
    """``edges``, dealt by ``src``, with the number of edges that leave their ``dst``."""
    degrees = edges.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("degree"))
    return edges.join(degrees, "dst").select("src", "dst", "weight", "degree").repartition("src")


def _status(state: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``(qid, hops, edges0, edges1)``: the answer, if there is one, and the edges that leave the frontier of each side.

    The searches of a query have met where both have a row; answers of the status ``before`` are kept.
    """
    depth = [F.min(F.when(F.col("side") == side, F.col("d"))).alias(f"d{side}") for side in (0, 1)]
    leaving = [F.sum(F.when((F.col("side") == side) & (F.col("age") == 0), F.col("degree"))).alias(f"edges{side}") for side in (0, 1)]
    rows = state.groupBy("qid", "v").agg(*depth, *leaving).selectExpr("qid", "d0 + d1 AS hops", "edges0", "edges1")
    if before is not None:
        rows = rows.union(before.where("hops IS NOT NULL").selectExpr("qid", "hops", "0L AS edges0", "0L AS edges1"))
    return rows.groupBy("qid").agg(F.min("hops").alias("hops"), *[F.coalesce(F.sum(e), F.lit(0)).alias(e) for e in ("edges0", "edges1")])


def _sides(status: DataFrame, heavy: float) -> DataFrame:
    """``(qid, side, moves)`` of the queries that go on: does a side search in this round?

    A query ends when it is answered or when one of its searches has nowhere to go.
    """
    live = status.where("hops IS NULL AND edges0 > 0 AND edges1 > 0")
    most = heavy * F.least("edges0", "edges1")
    both = [F.struct(F.lit(side).alias("side"), (F.col(f"edges{side}") <= most).alias("moves")) for side in (0, 1)]
    return live.select("qid", F.explode(F.array(*both)).alias("s")).select("qid", "s.side", "s.moves")


def _next_state(moving: DataFrame, waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """The state after a round, with ``moved``: has a search come here in it?

    What moving searches reach beyond their last two levels is their frontier; of these two levels the older one goes.
    """
    arrows = edges.select(F.col("src").alias("v"), "dst", "weight", F.col("degree").alias("further"))
    step = moving.where("age = 0").join(arrows, "v").where("x < 0 OR weight > x")
    step = step.selectExpr("qid", "x", "side", "dst AS v", "further AS degree", "d + 1 AS d", "0 AS age", "true AS moved")
    rows = step.union(moving.selectExpr("qid", "x", "side", "v", "degree", "d", "age + 1 AS age", "false AS moved"))
    rows = rows.union(waiting.selectExpr("qid", "x", "side", "v", "degree", "d", "age", "false AS moved"))
    merged = rows.groupBy("qid", "side", "v").agg(
        F.max("x").alias("x"), F.max("degree").alias("degree"), F.min("d").alias("d"), F.max("age").alias("age"), F.bool_and("moved").alias("moved")
    )
    return merged.where("age < 2").select("qid", "x", "side", "v", "degree", "d", "age", "moved")


def within_hops(edges: DataFrame, pairs: DataFrame, h: int) -> DataFrame:
    """``(qid, within)``: are ``a`` and ``b`` of each pair at most ``h`` hops apart?

    Balls of half the radius around both ends meet if and only if they are.
    """
    near = h_hop(edges, pairs.select(F.col("a").alias("source")), (h + 1) // 2)
    far = h_hop(edges, pairs.select(F.col("b").alias("source")), h // 2)
    left = pairs.join(near.select(F.col("source").alias("a"), "id"), "a")
    right = far.select(F.col("source").alias("b"), "id")
    hit = left.join(right, ["b", "id"]).select("qid").distinct().withColumn("within", F.lit(True))
    return pairs.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("within", F.lit(False)).alias("within"))


def near_pairs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(qid, a, b)``: pairs of members, ``a < b``, at most the query's ``h`` hops apart in the whole graph.

    ``members`` is ``(qid, h, id)``.  The last hop, which would reach by far the most, is made along those friendships only that end
    at a member of the query, and towards larger ids only.
    """
    members = checkpoint(members.select("qid", "h", "id").distinct())
    start = members.select("qid", "h", F.col("id").alias("source"), F.col("id").alias("v"))
    deepest = members.agg(F.max("h")).first()[0] or 0
    inside = members.select("qid", F.col("id").alias("b"))
    found = [members.select("qid", F.col("id").alias("a"), F.col("id").alias("b")).where("false")]
    if deepest > 0:
        edges = checkpoint(edges.select("src", "dst").repartition("src"))
        into = checkpoint(edges.join(inside.withColumnRenamed("b", "dst"), "dst").select("qid", F.col("src").alias("v"), F.col("dst").alias("b")).repartition("qid", "v"))
        last = lambda level, depth: level.where(F.col("h") == depth + 1).join(into, ["qid", "v"]).where("source < b").select("qid", F.col("source").alias("a"), "b")
        found.append(last(start, 0))
        if deepest > 1:
            for depth, level in levels(edges, start, ["qid", "h", "source"], hops=deepest - 1, allowed=lambda d: F.col("h") > d):
                near = level.select("qid", F.col("source").alias("a"), F.col("v").alias("b"))
                found.append(near.where("a < b").join(inside, ["qid", "b"], "left_semi").select("qid", "a", "b"))
                found.append(last(level, depth))
    return reduce(DataFrame.union, found).distinct()


def similar_pairs(edges: DataFrame, members: DataFrame, tags: DataFrame) -> DataFrame:
    """``(qid, a, b, common)``: pairs of members at most the query's ``h`` hops apart.

    ``members`` is ``(qid, h, id)``.  Hops are counted in the whole graph; pairs without a
    common tag are kept.  Hops come first: scoring all pairs of a place would be quadratic.
    """
    of = lambda end: tags.select(F.col("person_id").alias(end), F.col("tags").alias(f"tags_{end}"))
    both = near_pairs(edges, members).join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select("qid", "a", "b", common_tags("tags_a", "tags_b").alias("common"))
