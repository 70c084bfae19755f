"""The five end-to-end queries, each over a table of parameters (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import prepare
from ..operators.centrality import BLOCK, SMALL, bit_distance_sums, centrality, geodesics, prune_by_bound, walk_bounds
from ..operators.components import SMALL_EDGES, connected_components
from ..operators.loop import checkpoint, checkpoint_counted
from ..operators.nested import nested_ranges
from ..operators.paths import hop_distance, similar_pairs
from ..operators.topk import largest, top_k, top_k_by_part
from ..sources.io import format_answers, read_queries
from ..sources.schema import Network


def shortest_paths(net: Network, params: DataFrame) -> DataFrame:
    """``(qid, hops)`` for ``params`` ``(qid, p1, p2, x)`` (Q1)."""
    counts = prepare.reply_counts(net.reply_of, net.comment_creator, net.knows)
    return hop_distance(prepare.edge_weights(net.knows, counts), params)


def date_numbers(dates: DataFrame, days: DataFrame) -> DataFrame:
    """``(day, since)`` for different ``days`` (one column): how many of the different ``dates`` (one column) are not after it.

    Both are days of the calendar, so what is ordered in one place has a row for each day at most.
    """
    asked = dates.toDF("day").where("day IS NOT NULL").distinct().withColumn("date", F.lit(1))
    every = asked.union(days.toDF("day").where("day IS NOT NULL").distinct().withColumn("date", F.lit(0)))
    merged = every.groupBy("day").agg(F.max("date").alias("date"))
    return merged.select("day", F.sum("date").over(W.orderBy("day")).alias("since"))


def audiences(net: Network, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tag_id, person_id, since)``, and ``(qid, tag_id, since, own, size)`` of every query and tag with an audience.

    ``since`` numbers the different dates of the parameter table from 1; a person with number n was
    born on or after the first n dates, so people and queries meet by numbers and nobody is copied for each query.
    ``own`` is the number of the oldest person of the audience, by which all dates with the same audience are known.
    """
    numbers = checkpoint(date_numbers(params.select("d"), net.person.select("birthday").union(params.select("d"))))
    born = net.person.select(F.col("id").alias("person_id"), F.col("birthday").alias("day")).join(numbers.where("since > 0"), "day")
    people = net.interest.select("person_id", "tag_id").distinct().join(born.select("person_id", "since"), "person_id")
    people = checkpoint(people.select("tag_id", "person_id", "since"))
    later = W.partitionBy("tag_id").orderBy(F.desc("since"))  # one row for each date
    counted = people.groupBy("tag_id", "since").agg(F.count(F.lit(1)).alias("n"))
    # born on or after the k-th date: those of the smallest number from k on, and all beyond
    reached = counted.select("tag_id", F.col("since").alias("own"), F.sum("n").over(later).alias("size"), F.coalesce(F.lead("since").over(later), F.lit(0)).alias("below"))
    spread = reached.select("tag_id", "own", "size", F.explode(F.sequence(F.col("below") + 1, F.col("own"))).alias("since"))
    number = params.select("qid", F.col("d").alias("day")).join(numbers, "day").select("qid", "since")
    return people, number.join(spread, "since").select("qid", "tag_id", "since", "own", "size")


def audience_members(people: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(qid, tag_id, id)`` for the wanted ``(qid, tag_id, since)``."""
    asked = wanted.select("qid", "tag_id", F.col("since").alias("least"))
    members = people.join(asked, "tag_id").where(F.col("since") >= F.col("least"))
    return members.select("qid", "tag_id", F.col("person_id").alias("id"))


def tag_ranges(net: Network, params: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """``(qid, tag_id, range)``: the largest connected young audience of every tag.

    Tags nobody born on or after ``d`` is interested in do not appear.  A friendship counts from the earlier of its two birthdays
    on, so the graphs of a tag contain one another and are solved together, however many dates are asked for.
    """
    people, sizes = audiences(net, params)
    end = lambda name: people.select("tag_id", F.col("person_id").alias(name), F.col("since").alias(f"since_{name}"))
    edges = net.knows.where("src < dst").join(end("src"), "src").join(end("dst"), ["tag_id", "dst"])
    edges = edges.select("tag_id", "src", "dst", F.least("since_src", "since_dst").alias("weight"))
    vertices = people.select("tag_id", F.col("person_id").alias("id"), F.col("since").alias("weight"))
    ranges = nested_ranges(edges, vertices, ["tag_id"], small).withColumnRenamed("weight", "own")
    return sizes.join(ranges, ["tag_id", "own"]).select("qid", "tag_id", "range")


def top_tags(net: Network, params: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """``(qid, rank, tag, range)`` for ``params`` ``(qid, k, d)``: range descending, name ascending (Q2)."""
    params, order = checkpoint(params), [F.desc("range"), F.asc("tag"), F.asc("tag_id")]
    names = net.tag.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    found = tag_ranges(net, params, small).join(names, "tag_id").join(params.select("qid", "k"), "qid")
    return top_k(found, ["qid"], order, "k", largest(params)).select("qid", "rank", "tag", "range")


def place_members(net: Network, wanted: DataFrame) -> DataFrame:
    """``(place, person_id)``: people in each wanted place name or anywhere inside it."""
    canon = checkpoint(prepare.canonical_by_name(net.place))
    roots = wanted.select("place").distinct().join(canon.select(F.col("name").alias("place"), F.col("canon_id").alias("root")).distinct(), "place")
    children = checkpoint(prepare.place_children(net.place_part_of, canon))
    closure = prepare.place_closure(children, roots)
    at = prepare.person_place(net.located, net.study_at, net.work_at, net.org_place, canon)
    return prepare.people_in_place(closure, at).join(roots, "root").select("place", "person_id")


#: Members of a place who are searched first: so many for each pair wanted.
HEAD = 32


def similar_pairs_in_place(net: Network, params: DataFrame) -> DataFrame:
    """``(qid, rank, a, b, common)`` for ``params`` ``(qid, k, h, place)`` (Q3).

    Two people have at most as many tags in common as either has.  So the members with the most tags are searched first, and
    the k-th score among them is the least number of tags that another member must have to matter: pairs near each
    other are sought only among those who do.  Where the first have fewer than k pairs, everybody is searched.
    """
    params = checkpoint(params)
    most, asked = largest(params), params.select("qid", "k")
    tags = checkpoint(prepare.person_tags(net.interest, net.person))
    members = place_members(net, params).join(params, "place").select("qid", "k", "h", "person_id")
    members = checkpoint(members.join(tags.select("person_id", "n_tags"), "person_id").withColumn("head", F.col("k") * HEAD))
    best = [F.desc("common"), F.asc("a"), F.asc("b")]
    head = top_k(members, ["qid"], [F.desc("n_tags"), F.asc("person_id")], "head", most * HEAD)
    first = _best_pairs(net, head, tags, asked, best, most)
    floor = first.where("rank = k").select("qid", F.col("common").alias("floor"))
    worth = members.join(floor, "qid", "left").where(F.col("n_tags") >= F.coalesce("floor", F.lit(0)))
    return _best_pairs(net, checkpoint(worth), tags, asked, best, most).select("qid", "rank", "a", "b", "common")


def _best_pairs(net: Network, members: DataFrame, tags: DataFrame, asked: DataFrame, best: list, most: int) -> DataFrame:
    """The ``k`` best of the near pairs of some members."""
    found = similar_pairs(net.knows, members.select("qid", "h", F.col("person_id").alias("id")), tags).join(asked, "qid")
    return checkpoint(top_k(found, ["qid"], best, "k", most))


def tag_people(net: Network, wanted: DataFrame) -> DataFrame:
    """``(tag, id)``: members of any forum about a wanted tag name."""
    first = net.tag.groupBy(F.col("name").alias("tag")).agg(F.min("id").alias("tag_id"))
    chosen = wanted.select("tag").distinct().join(first, "tag")
    people = prepare.forum_people(net.forum_member, prepare.forums_for_tags(net.forum_tag, chosen))
    return people.join(chosen, "tag_id").select("tag", F.col("person_id").alias("id"))


def central_people(net: Network, params: DataFrame, prune: bool = True, small: int = SMALL, wave: int = BLOCK) -> DataFrame:
    """``(qid, rank, id, r, s, centrality)`` for ``params`` ``(qid, k, tag)`` (Q4).

    Each wanted tag is searched once, however many queries name it.  With ``prune``, members of
    components of more than ``small`` people are searched in waves, those with the best bounds first; after each, the k-th
    best score so far drops all whose bound does not reach it, and searches that can no longer reach it break off; the
    result is the same.
    """
    key = ["tag"]
    members = checkpoint(tag_people(net, params))
    edges = checkpoint(prepare.induced_edges(net.knows, members, key))
    comp = checkpoint(connected_components(edges, members, key))
    sizes = comp.groupBy("tag", "comp").agg(F.count(F.lit(1)).alias("n"))
    placed = comp.join(sizes, ["tag", "comp"])
    large = checkpoint(placed.where(F.col("n") > small).select("tag", "id", "comp"))
    if not prune or large.isEmpty():
        found = centrality(geodesics(edges, members, key, comp, small), members, key)
    else:
        rest = comp.join(large, ["tag", "id"], "left_anti")
        found = centrality(geodesics(edges, rest, key, rest, small), rest, key)
        found = found.union(search_in_waves(edges, large, params, key, wave))
    placed = found.join(comp, ["tag", "id"]).join(params, "tag")
    ranked = top_k_by_part(placed, ["qid"], "comp", [F.desc("centrality"), F.asc("id")], "k", largest(params))
    return ranked.select("qid", "rank", "id", "r", "s", "centrality")


def search_in_waves(edges: DataFrame, large: DataFrame, params: DataFrame, key: list[str], wave: int = BLOCK, growth: int = 4) -> DataFrame:
    """Scores of the members ``(*key, id, comp)`` of large components who can be among the best of their tag.

    A wave takes of each tag the candidates with the best bounds, ``growth`` times as many as the one before, so there are
    few waves and a wave is not much larger than what a search one by one would have tried.  Bounds come from counts of walks;
    what a search has seen so far takes their place once it runs.
    """
    wanted = checkpoint(params.groupBy(*key).agg(F.max("k").alias("most")))
    left = checkpoint(walk_bounds(edges, large, key).where("r > 0"))
    promising = [F.desc(F.col("r") * F.col("r") / F.col("bound")), F.asc("id")]
    size, most = max(wave, largest(wanted, "most")), largest(wanted, "most")
    floors = found = None
    while True:
        tried, seen = checkpoint_counted(top_k(left, key, promising, size).select(*key, "id", "r"), n=F.count(F.lit(1)))
        if not seen["n"]:
            return found if found is not None else centrality(bit_distance_sums(edges, tried, key), tried, key)
        worth = None if floors is None else tried.join(floors, key, "left")
        scored = centrality(bit_distance_sums(edges, tried, key, worth), tried, key)
        found = checkpoint(scored if found is None else found.union(scored))
        best = top_k(found.join(wanted, key), key, [F.desc("centrality"), F.asc("id")], "most", most)
        floors = checkpoint(best.where("rank = most").select(*key, F.col("centrality").alias("floor")))
        left = checkpoint(prune_by_bound(left.join(tried, [*key, "id"], "left_anti"), floors, key))
        size *= growth


def answer_batch(spark: SparkSession, net: Network, path: str) -> DataFrame:
    """``(qid, answer)`` for a batch file of mixed queries, in query order (Q5)."""
    q1, q2, q3, q4, lines = read_queries(spark, path)
    return answers(net, q1, q2, q3, q4, lines)


def answers(net: Network, q1: DataFrame, q2: DataFrame, q3: DataFrame, q4: DataFrame, lines: DataFrame) -> DataFrame:
    """``(qid, answer)`` for the rows of ``lines`` from the parameter tables of the four kinds.

    All four kinds go along friendships, which are written once and not derived again for each.
    """
    net = net.but(knows=checkpoint(net.knows))
    return format_answers(
        lines,
        (shortest_paths(net, q1).withColumn("rank", F.lit(1)), F.col("hops")),
        (top_tags(net, q2), F.col("tag")),
        (similar_pairs_in_place(net, q3), F.concat_ws("|", "a", "b")),
        (central_people(net, q4), F.col("id")),
    ).orderBy("qid")
