import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import centrality, components, cover, paths, prepare, sketch, topk
from kinweave.operators.loop import RoundLimitReached

from .graphs import both_ways, distances, greedy_cover, random_graph, rows

N = 40


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def keyed(spark, graphs):
    rows_ = [(k, a, b) for k, pairs in graphs.items() for a, b in pairs]
    members = [(k, i) for k in graphs for i in range(N)]
    return spark.createDataFrame(rows_, "key int, src long, dst long"), spark.createDataFrame(members, "key int, id long")


@pytest.fixture(scope="module")
def graphs():
    return {seed: random_graph(seed, N, 30 + 5 * seed) for seed in range(4)} | {9: both_ways([(i, i + 1) for i in range(14)])}


@pytest.mark.parametrize("small", [components.SMALL_EDGES, 40, 0])
def test_components_of_keyed_graphs(spark, graphs, small):
    edges, members = keyed(spark, graphs)
    found = components.connected_components(edges, members, ["key"], small=small)
    expected = sorted((k, i, min(distances(g, i))) for k, g in graphs.items() for i in range(N))
    assert rows(found.select("key", "id", "comp")) == expected
    largest = {k: max(len(distances(g, i)) for i in range(N)) for k, g in graphs.items()}
    assert dict(rows(components.largest_component(found, ["key"]))) == largest


@pytest.mark.parametrize("small", [components.SMALL_EDGES, 0])
def test_components_of_one_graph(spark, small):
    draw = random.Random(5)
    pairs = [(draw.randrange(3000), draw.randrange(3000)) for _ in range(2000)] + [(10_000 + i, 10_001 + i) for i in range(50)]
    people = spark.range(3000).union(spark.range(10_000, 10_051))
    found = dict(rows(components.connected_components(edges_of(spark, pairs), people, small=small)))
    group = {i: i for i in found}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    assert found == {i: root(i) for i in group}
    numbers = dict(rows(components.component_numbers(components.connected_components(edges_of(spark, pairs), people, small=small))))
    assert numbers == {c: n for n, c in enumerate(sorted(set(found.values())))}


def test_components_of_graphs_named_by_words(spark):
    """Several key columns, not all of them numbers, and large ids."""
    big = 1 << 60
    rows_ = [("a", 1, big + 5, big + 3), ("a", 1, big + 3, 7), ("a", 2, 7, 8), ("b", 1, 7, 9), ("b", 1, -4, 9)]
    edges = spark.createDataFrame(rows_, "k string, q int, src long, dst long").repartition(3)
    ends = edges.select("k", "q", F.col("src").alias("id")).union(edges.select("k", "q", "dst"))
    for small in (components.SMALL_EDGES, 0):
        found = rows(components.connected_components(edges, ends, ["k", "q"], small=small))
        assert found == [("a", 1, 7, 7), ("a", 1, big + 3, 7), ("a", 1, big + 5, 7), ("a", 2, 7, 7), ("a", 2, 8, 7), ("b", 1, -4, -4), ("b", 1, 7, -4), ("b", 1, 9, -4)]


def test_cover_of_a_long_chain_takes_few_rounds(spark):
    chain = edges_of(spark, both_ways([(i, i + 1) for i in range(400)]))
    picked = {r.id for r in cover.vertex_cover(chain, max_rounds=25).collect()}
    assert all(i in picked or i + 1 in picked for i in range(400))


def test_top_k_by_a_column(spark):
    df = spark.range(60).selectExpr("id % 3 AS q", "id AS v", "cast(id % 3 + 1 AS int) AS k")
    for most in (None, 3):
        assert rows(topk.top_k(df, ["q"], [F.desc("v")], "k", most).select("q", "rank", "v")) == [(0, 1, 57), (1, 1, 58), (1, 2, 55), (2, 1, 59), (2, 2, 56), (2, 3, 53)]


def test_components_edge_cases(spark):
    people = spark.createDataFrame([(5,), (7,), (7,)], "id long")
    nothing = edges_of(spark, [])
    assert rows(components.connected_components(nothing, people)) == [(5, 5), (7, 7)]
    odd = edges_of(spark, [(5, 5), (7, None), (None, 5)])
    assert rows(components.connected_components(odd, people)) == [(5, 5), (7, 7)]
    assert rows(components.connected_components(nothing, people.limit(0))) == []
    numbers = components.component_numbers(components.connected_components(nothing, people))
    assert rows(numbers) == [(5, 0), (7, 1)]


def test_round_cap_raises(spark):
    chain = edges_of(spark, [(i, i + 1) for i in range(200)])
    with pytest.raises(RoundLimitReached):
        components.connected_components(chain, chain.select(F.col("src").alias("id")), max_rounds=1, small=0)


def test_hop_distance(spark):
    """A line of 26: paths over 20 hops, strict thresholds, equal and negative ends, no path."""
    pairs = both_ways([(i, i + 1) for i in range(25)])
    weighted = spark.createDataFrame([(a, b, min(a, b) % 4, 3) for a, b in pairs], "src long, dst long, out_cnt long, in_cnt long")
    asked = [(0, 0, 25, -1), (1, 3, 3, 5), (2, -1, 3, -1), (3, 0, 25, 0), (4, 1, 4, 0), (5, 1, 4, 1), (6, 2, 3, 1), (7, 0, 99, -1), (8, 4, 0, -1)]
    params = spark.createDataFrame(asked, "qid long, p1 long, p2 long, x int")
    assert dict(rows(paths.hop_distance(weighted, params))) == {0: 25, 1: 0, 2: -1, 3: -1, 4: 3, 5: -1, 6: 1, 7: -1, 8: 4}
    assert rows(paths.hop_distance(weighted, params.limit(0))) == []


def test_hop_distance_random(spark, graphs):
    pairs = graphs[2]
    weighted = edges_of(spark, pairs).selectExpr("src", "dst", "0L out_cnt", "0L in_cnt")
    asked = [(i * N + j, i, j, -1) for i in range(0, N, 7) for j in range(N)]
    found = dict(rows(paths.hop_distance(weighted, spark.createDataFrame(asked, "qid long, p1 long, p2 long, x int"))))
    assert found == {q: distances(pairs, i).get(j, -1) for q, i, j, _ in asked}


@pytest.mark.parametrize("heavy", [1.0, 2.0, 1e9])
def test_hop_distance_whichever_side_waits(spark, graphs, heavy):
    pairs = graphs[1]
    draw = random.Random(5)
    counts = {frozenset(p): draw.randrange(4) for p in pairs}
    weighted = spark.createDataFrame([(a, b, counts[frozenset((a, b))], 3) for a, b in pairs], "src long, dst long, out_cnt long, in_cnt long")
    asked = [(i * N + j, i, j, (i + j) % 4 - 1) for i in range(0, N, 9) for j in range(0, N, 2)]
    found = dict(rows(paths.hop_distance(weighted, spark.createDataFrame(asked, "qid long, p1 long, p2 long, x int"), heavy=heavy)))
    open_for = lambda x: [p for p in pairs if x < 0 or counts[frozenset(p)] > x]
    near = {(i, x): distances(open_for(x), i) for i in range(0, N, 9) for x in range(-1, 3)}
    assert found == {q: 0 if i == j else near[i, x].get(j, -1) for q, i, j, x in asked}


def test_hop_distance_leaves_hubs_to_the_lighter_side(spark, monkeypatch):
    """A hub of 5,000 with a tail, and a component apart: neither query expands the hub."""
    star = [(0, i) for i in range(1, 5001)] + [(0, 9001), (9001, 9002), (9002, 9003)]
    weighted = edges_of(spark, both_ways([*star, (9100, 9101)])).selectExpr("src", "dst", "0L out_cnt", "0L in_cnt")
    sizes, counted = [], paths.checkpoint_counted
    def noted(df, **aggregates):
        out = counted(df, **aggregates)
        sizes.append(out[0].count())
        return out

    monkeypatch.setattr(paths, "checkpoint_counted", noted)
    asked = spark.createDataFrame([(0, 0, 9003, -1), (1, 0, 9101, -1), (2, 7, 8, -1)], "qid long, p1 long, p2 long, x int")
    assert dict(rows(paths.hop_distance(weighted, asked))) == {0: 3, 1: -1, 2: 2}
    assert max(sizes) < 20 and len(sizes) <= 4
    sizes.clear()
    assert dict(rows(paths.hop_distance(weighted, asked, heavy=1e9))) == {0: 3, 1: -1, 2: 2}
    assert max(sizes) > 5000


def test_hop_distance_keeps_rounds_alike(spark, monkeypatch):
    """A line of 61: Spark's estimate of the size of a round's state gets few digits longer, and a state does not lie in more and more partitions."""
    weighted = edges_of(spark, both_ways([(i, i + 1) for i in range(60)])).selectExpr("src", "dst", "0L out_cnt", "0L in_cnt")
    bits, counted = [], paths.checkpoint_counted
    def noted(df, **aggregates):
        out = counted(df, **aggregates)
        bits.append(out[0]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        assert bits[-1] <= bits[0] * len(bits) and out[0].rdd.getNumPartitions() <= 4
        return out

    monkeypatch.setattr(paths, "checkpoint_counted", noted)
    asked = spark.createDataFrame([(0, 0, 60, -1), (1, 7, 7, 0), (2, 3, 60, 0), (3, 60, 58, -1)], "qid long, p1 long, p2 long, x int")
    assert dict(rows(paths.hop_distance(weighted, asked))) == {0: 60, 1: 0, 2: -1, 3: 2}
    assert len(bits) <= 31

def test_h_hop_and_within(spark, graphs):
    pairs = graphs[3]
    edges = edges_of(spark, pairs)
    sources = spark.createDataFrame([(i,) for i in range(0, N, 3)], "source long")
    expected = sorted((s, v, d) for s in range(0, N, 3) for v, d in distances(pairs, s).items() if d <= 2)
    assert rows(paths.h_hop(edges, sources, 2)) == expected
    counts = dict(rows(paths.h_hop_counts(edges, sources, 2)))
    assert counts == {s: sum(1 for x in expected if x[0] == s) - 1 for s in range(0, N, 3)}
    asked = spark.createDataFrame([(i * N + j, i, j) for i in range(5) for j in range(N)], "qid long, a long, b long")
    for h in (0, 1, 3):
        near = dict(rows(paths.within_hops(edges, asked, h)))
        assert near == {i * N + j: distances(pairs, i).get(j, 99) <= h for i in range(5) for j in range(N)}


def test_closeness_three_ways(spark, graphs):
    edges, members = keyed(spark, graphs)
    expected = []
    for k, g in graphs.items():
        for i in range(N):
            d = distances(g, i)
            expected.append((k, i, len(d) - 1, sum(d.values())))
    expected.sort()
    columns = ["key", "id", "r", "s"]
    assert rows(centrality.geodesics(edges, members, ["key"]).select(*columns)) == expected
    assert rows(centrality.geodesics(edges, members, ["key"], small=4).select(*columns)) == expected
    assert rows(centrality.distance_sums(edges, members, ["key"]).select(*columns)) == expected
    scored = {(r.key, r.id): r.centrality for r in centrality.closeness(edges, members, ["key"]).collect()}
    assert scored == {(k, i): r * r / s for k, i, r, s in expected if r}
    everybody = centrality.closeness(edges, members, ["key"], normalize=True, isolated=True)
    assert {(r.key, r.id): r.centrality for r in everybody.collect()} == {
        (k, i): (r * r / s if s else 0.0) / (N - 1) for k, i, r, s in expected
    }


def test_levels_bound_and_suffix(spark, graphs):
    edges, members = keyed(spark, graphs)
    sizes = centrality.level_sizes(edges, members, ["key"])
    for r in sizes.collect():
        d = list(distances(graphs[r.key], r.id).values())
        assert (r.L1, r.L2, r.L3) == tuple(d.count(x) for x in (1, 2, 3))
        assert r.partial == r.L1 + 2 * r.L2 + 3 * r.L3
    comp = components.connected_components(edges, members, ["key"])
    exact = {(r.key, r.id): r.s for r in centrality.geodesics(edges, members, ["key"]).collect()}
    assert all(r.bound <= exact[r.key, r.id] for r in centrality.with_bound(sizes, comp, ["key"]).collect())
    ordered = {}
    for r in centrality.suffix_max(sizes, ["key"]).collect():
        ordered.setdefault(r.key, []).append(r)
    for group in ordered.values():
        group.sort(key=lambda r: (-r.reach3, -r.L1, -r.L2, -r.L3, r.id))
        for i, r in enumerate(group):
            assert (r.max_L1, r.max_L2, r.max_L3) == tuple(max(x[c] for x in group[i:]) for c in ("L1", "L2", "L3"))


def test_suffix_maxima_of_a_large_group(spark):
    """A group of 60,000 and a small one: no frame reaches from a row to the end, as Spark would go through it anew for each row."""
    numbers = spark.range(60_000).selectExpr("if(id < 59990, 1, 2) AS key", "id", "id * 7919 % 1009 AS L1", "id * 104729 % 2003 AS L2", "id * 31 % 503 AS L3")
    sizes = numbers.selectExpr("*", "L1 + L2 + L3 AS reach3")
    found = centrality.suffix_max(sizes, ["key"])
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    order = sorted(found.collect(), key=lambda r: (r.key, -r.reach3, -r.L1, -r.L2, -r.L3, r.id), reverse=True)
    most, key = [0, 0, 0], None
    for r in order:
        most = [max(a, b) for a, b in zip(most if r.key == key else [0, 0, 0], (r.L1, r.L2, r.L3))]
        key = r.key
        assert [r.max_L1, r.max_L2, r.max_L3] == most
    assert len(order) == 60_000

def test_cover_equals_greedy(spark, graphs):
    edges, _ = keyed(spark, graphs)
    found = {}
    for r in cover.vertex_cover(edges, ["key"]).collect():
        found.setdefault(r.key, {})[r.id] = r.pick_degree
    assert found == {k: greedy_cover(g) for k, g in graphs.items()}
    star = edges_of(spark, both_ways([(0, i) for i in range(1, 51)]))
    assert rows(cover.vertex_cover(star)) == [(0, 50)]
    assert rows(cover.vertex_cover(star.limit(0))) == []
    part = cover.vertex_cover(edges, ["key"], limit=0.1)
    assert all(n <= N * 0.1 for _, n in rows(part.groupBy("key").count()))
    assert rows(cover.vertex_cover(star, limit=0.01)) == [(0, 50)]


def test_sketch_is_close(spark, graphs):
    pairs = graphs[3]
    for r in sketch.approx_neighbourhood(edges_of(spark, pairs), 3).collect():
        exact = sum(d <= 3 for d in distances(pairs, r.id).values())
        assert abs(r.estimate - exact) <= 1


def test_sketches_without_a_limit_and_what_travels(spark, graphs, monkeypatch):
    """Whole components are counted; a path that hangs on a clique goes on alone once the clique stands still."""
    pairs = graphs[2]
    for r in sketch.approx_neighbourhood(edges_of(spark, pairs), None).collect():
        assert abs(r.estimate - len(distances(pairs, r.id))) <= 2
    assert rows(sketch.approx_neighbourhood(edges_of(spark, []), 2)) == []
    with pytest.raises(ValueError):
        sketch.approx_neighbourhood(edges_of(spark, pairs), 2, lg_k=6)
    with pytest.raises(RoundLimitReached):
        sketch.approx_neighbourhood(edges_of(spark, both_ways((i, i + 1) for i in range(9))), None, max_rounds=3)

    grown, counted = [], sketch.checkpoint_counted
    def noted(df, **aggregates):
        out = counted(df, **aggregates)
        grown.append(out[1]["n"])
        return out

    monkeypatch.setattr(sketch, "checkpoint_counted", noted)
    apart = both_ways([(i, j) for i in range(30) for j in range(i)] + [(100 + i, 101 + i) for i in range(12)])
    found = dict(rows(sketch.approx_neighbourhood(edges_of(spark, apart), None)))
    assert all(abs(n - (30 if i < 100 else 13)) <= 1 for i, n in found.items())
    assert grown[-1] == 0 and len(grown) == 13 and max(grown[1:]) <= 26 < grown[0]  # the clique grows in the first hop only


def test_sketches_of_components_equal_those_that_travel(spark, graphs, monkeypatch):
    """One component, many, and a chain of 300, which takes few rounds as no sketch goes along it."""
    for seed in (3,):
        edges = edges_of(spark, graphs[seed])
        assert rows(sketch.approx_reach(edges)) == rows(sketch.approx_neighbourhood(edges, None))
    assert rows(sketch.approx_reach(edges_of(spark, []))) == []
    assert rows(sketch.approx_reach(edges_of(spark, both_ways([(1, 2)]) + [(5, 5), (None, 3)]))) == [(1, 2), (2, 2), (5, 1)]
    with pytest.raises(ValueError):
        sketch.approx_reach(edges_of(spark, []), lg_k=17)
    monkeypatch.setattr(sketch, "checkpoint_counted", None)  # no hop is made
    for r in sketch.approx_reach(edges_of(spark, both_ways((i, i + 1) for i in range(300)))).collect():
        assert abs(r.estimate - 301) <= 10

def test_similar_pairs(spark):
    """Members joined through an outsider; a pair without common tags; ties by id; hop limits by query."""
    edges = edges_of(spark, both_ways([(1, 9), (9, 2), (2, 3)]))
    members = spark.createDataFrame([(0, 2, 1), (0, 2, 2), (0, 2, 3), (5, 1, 1), (5, 1, 2), (5, 1, 3), (6, 0, 1)], "qid long, h int, id long")
    tags = prepare.person_tags(
        spark.createDataFrame([(1, 7), (2, 7), (2, 8), (1, 8)], "person_id long, tag_id long"),
        spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long"),
    )
    found = paths.similar_pairs(edges, members, tags)
    assert rows(found) == [(0, 1, 2, 2), (0, 2, 3, 0), (5, 2, 3, 0)]
    assert rows(paths.similar_pairs(edges, members.limit(0), tags)) == []


def test_near_pairs_make_the_last_hop_to_members_only(spark, graphs, monkeypatch):
    """Hops of 0 to 4 and their pairs; levels hold balls of one hop less, so a hub of 400 outsiders is not entered."""
    draw = random.Random(11)
    pairs, members = graphs[2], [(q, h, i) for q, h in enumerate((0, 1, 2, 3, 4, 2)) for i in draw.sample(range(N), 25)]
    found = rows(paths.near_pairs(edges_of(spark, pairs), spark.createDataFrame(members, "qid long, h int, id long")))
    near = {i: distances(pairs, i) for i in range(N)}
    of = lambda q: [i for p, _, i in members if p == q]
    assert found == sorted({(q, a, b) for q, h, a in members for b in of(q) if a < b and near[a].get(b, 99) <= h})

    sizes, counted = [], paths.checkpoint_counted
    def noted(df, **aggregates):
        out = counted(df, **aggregates)
        sizes.append(out[1]["n"])
        return out

    monkeypatch.setattr(paths, "checkpoint_counted", noted)
    star = edges_of(spark, both_ways([(0, i) for i in range(1, 403)]))
    members = spark.createDataFrame([(0, 2, 401), (0, 2, 402)], "qid long, h int, id long")
    assert rows(paths.near_pairs(star, members)) == [(0, 401, 402)] and sizes == [2]

def test_preparation(spark):
    knows = edges_of(spark, both_ways([(1, 2), (2, 3)]))
    author = spark.createDataFrame([(10, 1), (11, 2), (12, 1), (13, 3)], "comment_id long, person_id long")
    reply = spark.createDataFrame([(10, 11), (12, 11), (11, 10), (12, 10), (13, 10), (99, 10)], "comment_id long, parent_id long")
    friends = prepare.reply_counts(reply, author, knows)
    assert rows(friends) == [(1, 2, 2), (2, 1, 1)]  # not oneself, not strangers, not without author
    assert rows(prepare.reply_counts(reply, author)) == [(1, 2, 2), (2, 1, 1), (3, 1, 1)]
    weights = prepare.edge_weights(knows, friends)
    assert rows(weights) == [(1, 2, 2, 1), (2, 1, 1, 2), (2, 3, 0, 0), (3, 2, 0, 0)]
    assert rows(prepare.mutual_edges(weights, 0)) == [(1, 2), (2, 1)]
    assert rows(prepare.mutual_edges(weights, 1)) == []
    assert rows(prepare.friends_by_replies(weights, 1)) == [(1, 1, 2, 2), (2, 1, 1, 1), (3, 1, 2, 0)]
    assert rows(prepare.adjacency(knows)) == [(1, [2], 1), (2, [1, 3], 2), (3, [2], 1)]


def test_places_merge_by_name(spark):
    place = spark.createDataFrame([(1, "Land"), (2, "Town"), (3, "Town"), (4, "Street")], "id long, name string")
    canon = prepare.canonical_by_name(place)
    assert rows(canon) == [(1, 1, "Land"), (2, 2, "Town"), (3, 2, "Town"), (4, 4, "Street")]
    part_of = spark.createDataFrame([(3, 2), (3, 1), (4, 3), (1, 4)], "child long, parent long")
    children = prepare.place_children(part_of, canon)
    assert rows(children) == [(1, 4), (2, 1), (4, 2)]  # a cycle; 3 in 2 is the same town
    roots = spark.createDataFrame([(1,)], "root long")
    assert rows(prepare.place_closure(children, roots)) == [(1, 1), (1, 2), (1, 4)]


def test_top_k(spark):
    table = spark.createDataFrame([("a", i, i % 3, 2) for i in range(9)] + [("b", 1, 1, 2)], "key string, id int, score int, k int")
    best = topk.top_k(table, ["key"], [F.desc("score"), F.asc("id")], "k").select("key", "rank", "id")
    assert rows(best) == [("a", 1, 2), ("a", 2, 5), ("b", 1, 1)]
    parts = topk.top_k_by_part(table.withColumn("part", F.col("id") % 2), ["key"], "part", [F.desc("score"), F.asc("id")], 2)
    assert rows(parts.select("key", "rank", "id")) == [("a", 1, 2), ("a", 2, 5), ("b", 1, 1)]
    assert [r.id for r in topk.first_rows(table, [F.desc("id")], 2).collect()] == [8, 7]
