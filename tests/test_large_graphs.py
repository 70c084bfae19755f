"""The ways that graphs too large for one task go, on small graphs against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.operators import centrality, components, cover, nested, paths, prepare
from kinweave.operators.loop import RoundLimitReached, numbered

from .graphs import both_ways, distances, random_graph, rows
from .test_graph_operators import N, edges_of, keyed


@pytest.fixture(scope="module")
def graphs():
    return {seed: random_graph(seed, N, 35 + 15 * seed) for seed in range(4)} | {9: both_ways([(i, i + 1) for i in range(7)])}


def test_a_graph_without_a_key_lies_in_many_tasks(spark, monkeypatch):
    def one_task(*_):
        raise AssertionError("a whole graph in one task")

    monkeypatch.setattr(components, "_solved_in_tasks", one_task)
    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(100)]
    edges, people = edges_of(spark, pairs).repartition(8), spark.range(1101)
    largest = {}

    def counted(step, seen=largest):
        def run(pairs, key):
            parts = pairs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
            seen.setdefault(step.__name__, []).append((len(parts), max(p["count"] for p in parts), sum(p["count"] for p in parts)))
            return step(pairs, key)

        return run

    monkeypatch.setattr(components, "_large_star", counted(components._large_star))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few edges are put together
    found = dict(rows(components.connected_components(edges, people)))
    both = both_ways(pairs)
    assert found == {i: min(distances(both, i)) for i in range(1101)}
    rounds = largest.pop("_large_star")
    assert rounds[0][0] > 1 and rounds[0][1] < rounds[0][2]
    monkeypatch.setattr(components, "_forests", lambda pairs, key: pairs)
    assert dict(rows(components.connected_components(edges, people))) == found
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rounds) < len(largest["_large_star"])  # stars alone need more rounds


def test_forests_are_passed_on_when_they_are_large(spark, graphs, monkeypatch):
    monkeypatch.setattr(components, "FOREST_EDGES", 4)
    edges, members = keyed(spark, graphs)
    found = components.connected_components(edges, members, ["key"], small=0)
    assert rows(found.select("key", "id", "comp")) == sorted((k, i, min(distances(g, i))) for k, g in graphs.items() for i in range(N))
    with_nulls = edges.withColumn("key", F.when(F.col("key") != 2, F.col("key")))
    forest = components._forests(with_nulls.select("key", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")), ["key"])
    assert {r.key for r in forest.collect()} == {None, 0, 1, 3, 9}


def test_bits_give_the_same_sums(spark, graphs, monkeypatch):
    edges, members = keyed(spark, graphs)
    expected = sorted((k, i, len(d) - 1, sum(d.values())) for k, g in graphs.items() for i in range(N) for d in [distances(g, i)])
    assert rows(centrality.bit_distance_sums(edges, members, ["key"]).select("key", "id", "r", "s")) == expected
    assert rows(centrality.bit_distance_sums(edges, members.limit(0), ["key"])) == []
    some = members.where("id % 3 = 1")  # not all members search, yet all are found
    assert rows(centrality.bit_distance_sums(edges, some, ["key"]).select("key", "id", "r", "s")) == [x for x in expected if x[1] % 3 == 1]
    chain = edges_of(spark, both_ways([(i, i + 1) for i in range(9)])).withColumn("key", F.lit(0))
    with pytest.raises(RoundLimitReached):
        centrality.bit_distance_sums(chain, chain.select("key", F.col("src").alias("id")), ["key"], max_rounds=5)


def test_bits_need_few_rows(spark):
    draw = random.Random(1)
    pairs = both_ways((draw.randrange(600), draw.randrange(600)) for _ in range(2400))
    edges = edges_of(spark, pairs).withColumn("key", F.lit(1))
    members = edges.select("key", F.col("src").alias("id")).distinct().coalesce(1)
    start = members.select("key", F.col("id").alias("source"), F.col("id").alias("v"))
    plain = {d: level.count() for d, level in paths.levels(edges, start, ["key", "source"], ["key"])}
    seen = []
    step = centrality._next_level

    def counting(*args):
        out = step(*args)
        seen.append(out.count())
        return out

    centrality._next_level = counting
    try:
        found = dict(rows(centrality.bit_distance_sums(edges, members, ["key"]).select("id", "s")))
    finally:
        centrality._next_level = step
    assert found == {i: sum(distances(pairs, i).values()) for i in found} and len(found) > 500
    assert max(n / seen[d - 1] for d, n in plain.items()) > 50 and sum(plain.values()) > 30 * sum(seen)


def test_searches_break_off(spark, graphs):
    edges, members = keyed(spark, graphs)
    exact = {(k, i): (len(d) - 1, sum(d.values())) for k, g in graphs.items() for i in range(N) for d in [distances(g, i)]}
    floors = {k: sorted((r * r / s for (q, i), (r, s) in exact.items() if q == k and r), reverse=True)[2] for k in graphs if k != 1}
    worth = [(k, i, r, floors.get(k)) for (k, i), (r, _) in exact.items()]
    limits = spark.createDataFrame(worth, "key int, id long, r long, floor double")
    found = {(r.key, r.id): (r.r, r.s) for r in centrality.bit_distance_sums(edges, members, ["key"], limits).collect()}
    assert all(exact[x] == v for x, v in found.items())
    kept = Counter(k for k, _ in found)
    assert kept[1] == N and all(kept[k] < N for k in floors)  # without a floor nobody is dropped
    best = {x for x, (r, s) in exact.items() if r and r * r / s >= floors.get(x[0], 0)}
    assert best <= set(found)


def test_walks_bound_the_sums(spark, graphs):
    edges, members = keyed(spark, graphs)
    comp = components.connected_components(edges, members, ["key"])
    levels = {(r.key, r.id): r for r in centrality.with_bound(centrality.level_sizes(edges, members, ["key"]), comp, ["key"]).collect()}
    tight = 0
    for r in centrality.walk_bounds(edges, comp, ["key"]).collect():
        d = distances(graphs[r.key], r.id)
        assert r.r == len(d) - 1 and r.bound <= levels[r.key, r.id].bound <= sum(d.values())
        tight += r.r > 0 and r.bound == levels[r.key, r.id].bound
    assert tight > 30


def plain_ranges(edges, vertices):
    out = []
    for n in sorted(set(vertices.values())):
        alive = {v for v, w in vertices.items() if w >= n}
        near = both_ways((a, b) for a, b, w in edges if w >= n)
        out.append((n, max(len(distances(near, v)) for v in alive)))
    return out


@pytest.mark.parametrize("small, numbers", [(components.SMALL_EDGES, 60), (components.SMALL_EDGES, 1), (45, 20), (0, 5)])
def test_nested_graphs(spark, small, numbers):
    draw, edges, vertices, expected = random.Random(numbers), [], [], []
    for key in (1, 2, 3, None):
        own = {i: draw.randint(1, numbers) for i in range(50)}
        pairs = {tuple(sorted((draw.randrange(50), draw.randrange(50)))) for _ in range(15 + 25 * (key or 4))}
        weighted = [(a, b, min(own[a], own[b])) for a, b in pairs if a != b]
        edges += [(key, x, y, w) for a, b, w in weighted for x, y in ((a, b), (b, a))]
        vertices += [(key, v, w) for v, w in own.items()]
        expected += [(key, n, size) for n, size in plain_ranges(weighted, own)] if key else []
    edges = spark.createDataFrame(edges, "key int, src long, dst long, weight long").where("key IS NOT NULL")
    vertices = spark.createDataFrame(vertices, "key int, id long, weight long").where("key IS NOT NULL")
    assert rows(nested.nested_ranges(edges, vertices, ["key"], small)) == sorted(expected)
    alone = nested.nested_ranges(edges.where("false"), vertices.where("key = 1"), ["key"], small)
    assert set(rows(alone.select("key", "range"))) == {(1, 1)}


def test_hundreds_of_dates_take_eight_rounds(spark, monkeypatch):
    """Rounds grow with the binary digits of the numbers, not with the numbers."""
    draw = random.Random(9)
    own = {i: draw.randint(1, 255) for i in range(120)}
    pairs = {tuple(sorted((draw.randrange(120), draw.randrange(120)))) for _ in range(300)}
    weighted = [(a, b, min(own[a], own[b])) for a, b in pairs if a != b]
    calls = []
    plain = nested.connected_components
    monkeypatch.setattr(nested, "connected_components", lambda *a: calls.append(1) or plain(*a))
    edges = spark.createDataFrame([(7, *e) for e in weighted], "key int, src long, dst long, weight long")
    vertices = spark.createDataFrame([(7, v, w) for v, w in own.items()], "key int, id long, weight long")
    assert rows(nested.nested_ranges(edges, vertices, ["key"], 0)) == [(7, n, s) for n, s in plain_ranges(weighted, own)]
    assert len(calls) <= 8


def test_a_share_of_the_cover_takes_fewer_rounds(spark, monkeypatch):
    """Stars of falling size first, then a long tail of pairs in a chain that is never picked."""
    stars = [(1000 * k, 1000 * k + i) for k in range(1, 6) for i in range(1, 30 - 4 * k)]
    pairs = both_ways([*stars, *[(i, i + 1) for i in range(60)]])
    edges = edges_of(spark, pairs).withColumn("key", F.lit(1)).union(edges_of(spark, both_ways([(1, 2), (2, 3)])).withColumn("key", F.lit(2)))
    rounds = []
    plain = cover.checkpoint_counted
    monkeypatch.setattr(cover, "checkpoint_counted", lambda df, **a: rounds.append(1) or plain(df, **a))
    whole = cover.vertex_cover(edges, ["key"])
    taken, best = len(rounds), {}
    for key, found in ((k, [r for r in whole.collect() if r.key == k]) for k in (1, 2)):
        n = len({a for a, _ in pairs}) if key == 1 else 3
        best[key] = sorted(found, key=lambda r: (-r.pick_degree, r.id))[: max(1, int(n * 0.03))]
    rounds.clear()
    part = cover.vertex_cover(edges, ["key"], limit=0.03)
    assert rows(part.select("key", "id")) == sorted((k, r.id) for k, rs in best.items() for r in rs)
    assert len(rounds) < taken
    assert rows(cover.vertex_cover(edges_of(spark, pairs), limit=0.03)) == sorted((r.id, r.pick_degree) for r in best[1])


def test_numbered_rows(spark):
    draw = random.Random(2)
    values = [(draw.choice("ab"), i, draw.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(values, "k string, i int, v int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = rows(numbered(df, ["k"], [F.desc("v"), F.asc("i")]))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = {k: sorted((x for x in values if x[0] == k), key=lambda x: (-x[2], x[1])) for k in "ab"}
    assert found == sorted((*x, n) for xs in ordered.values() for n, x in enumerate(xs, 1))


def test_chunks_of_audiences(spark):
    people = [(i % 2, 0, f"19{60 + i % 30}-01-01", i) for i in range(100)]
    table = spark.createDataFrame(people, "tag_id int, comp int, birthday string, person_id int").withColumn("birthday", F.to_date("birthday"))
    chunks = prepare.audience_chunks(table, 7)
    assert chunks.agg(F.max(F.size("audience"))).first()[0] == 7 and chunks.count() == 16
    for day in ("1950-01-01", "1975-01-01", "1989-01-01", "2000-01-01"):
        want = Counter(t for t, _, b, _ in people if b >= day)
        assert dict((t, n) for t, _, n in rows(prepare.chunks_born_since(chunks, F.lit(day).cast("date")))) == dict(want)
