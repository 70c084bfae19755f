"""Relations that the graph operators start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import born_since_in, mutual
from .loop import RoundLimitReached, checkpoint, checkpoint_counted, numbered


def adjacency(knows: DataFrame) -> DataFrame:
    """``(id, neighbours, degree)``: sorted neighbour list of each person."""
    lists = knows.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return lists.withColumn("degree", F.size("neighbours").cast("long"))


def reply_counts(reply_of: DataFrame, comment_creator: DataFrame, knows: DataFrame | None = None) -> DataFrame:
    """``(src, dst, n)``: how often ``src`` replied to ``dst`` (C2), of friends only if ``knows`` is given (else C4).

    Replies to oneself and replies with an unknown author do not count.  Counting comes
    before the semi-join, so that only one row for each pair is joined with the friendships.
    Replies of a store have their author as ``src`` and are joined once, bucket by bucket.
    """
    authored = reply_of
    if "src" not in reply_of.columns:
        authored = reply_of.join(comment_creator.select("comment_id", F.col("person_id").alias("src")), "comment_id")
    parent = comment_creator.select(F.col("comment_id").alias("parent_id"), F.col("person_id").alias("dst"))
    counts = (
        authored.select("parent_id", "src")
        .join(parent, "parent_id")
        .where("src != dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts if knows is None else counts.join(knows, ["src", "dst"], "left_semi")


def edge_weights(knows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(src, dst, out_cnt, in_cnt)`` for each friendship, 0 where nobody replied."""
    out = counts.select("src", "dst", F.col("n").alias("out_cnt"))
    back = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("in_cnt"))
    joined = knows.join(out, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("src", "dst", zero("out_cnt"), zero("in_cnt"))


def mutual_edges(weights: DataFrame, x: int) -> DataFrame:
    """Friendships with more than ``x`` replies in both directions."""
    return weights.where(mutual(x)).select("src", "dst")


def friends_by_replies(weights: DataFrame, k: int | None = None) -> DataFrame:
    """``(src, rank, dst, out_cnt)``: friends by replies to them, most first."""
    order = W.partitionBy("src").orderBy(F.desc("out_cnt"), "dst")
    ranked = weights.select("src", F.row_number().over(order).cast("long").alias("rank"), "dst", "out_cnt")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def canonical_by_name(named: DataFrame) -> DataFrame:
    """``(id, canon_id, name)``: the smallest id of each name."""
    first = named.groupBy("name").agg(F.min("id").alias("canon_id"))
    return named.select("id", "name").join(first, "name").select("id", "canon_id", "name")


def place_children(part_of: DataFrame, canon: DataFrame) -> DataFrame:
    """``(child, parent)`` on canonical ids, a place never inside itself."""
    child = canon.select(F.col("id").alias("child"), F.col("canon_id").alias("canon_child"))
    parent = canon.select(F.col("id").alias("parent"), F.col("canon_id").alias("canon_parent"))
    merged = part_of.select("child", "parent").join(child, "child").join(parent, "parent")
    return (
        merged.select(F.col("canon_child").alias("child"), F.col("canon_parent").alias("parent"))
        .where("child != parent")
        .distinct()
    )


def place_closure(children: DataFrame, roots: DataFrame, max_depth: int = 100) -> DataFrame:
    """``(root, place)``: all places inside each ``root``, itself included, at any depth.

    Containment may be cyclic after places are merged by name; a place is entered once.
    """
    level = checkpoint(roots.select("root", F.col("root").alias("place")).distinct())
    found = level
    for _ in range(max_depth):
        step = level.join(children, level["place"] == children["parent"]).select("root", F.col("child").alias("place"))
        level, seen = checkpoint_counted(
            step.distinct().join(found, ["root", "place"], "left_anti"), n=F.count(F.lit(1))
        )
        if not seen["n"]:
            return found
        found = found.union(level)
    raise RoundLimitReached(f"places are nested more than {max_depth} deep")


def person_place(located: DataFrame, study_at: DataFrame, work_at: DataFrame, org_place: DataFrame, canon: DataFrame) -> DataFrame:
    """``(person_id, place)`` from residence, study and work, once each, canonical ids."""
    at = study_at.select("person_id", "org_id").union(work_at.select("person_id", "org_id")).join(org_place, "org_id")
    everywhere = located.select("person_id", "place_id").union(at.select("person_id", "place_id"))
    names = canon.select(F.col("id").alias("place_id"), F.col("canon_id").alias("place"))
    return everywhere.join(names, "place_id").select("person_id", "place").distinct()


def people_in_place(closure: DataFrame, person_at: DataFrame) -> DataFrame:
    """``(root, person_id)``: people of each root and of the places inside it, once (C11)."""
    return person_at.join(closure, "place").select("root", "person_id").distinct()


def person_tags(interest: DataFrame, person: DataFrame) -> DataFrame:
    """``(person_id, tags, n_tags)``: sorted interests of everybody, possibly none."""
    lists = interest.groupBy("person_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))
    everybody = person.select(F.col("id").alias("person_id")).join(lists, "person_id", "left")
    tags = F.coalesce("tags", F.array().cast("array<bigint>"))
    return everybody.select("person_id", tags.alias("tags"), F.size(tags).cast("long").alias("n_tags"))


def audience_table(interest: DataFrame, person: DataFrame, components: DataFrame) -> DataFrame:
    """``(tag_id, comp, birthday, person_id)``: interested people of each component, a row each."""
    people = person.select(F.col("id").alias("person_id"), "birthday")
    where = components.select(F.col("id").alias("person_id"), "comp")
    joined = interest.distinct().join(people, "person_id").join(where, "person_id")
    return joined.select("tag_id", "comp", "birthday", "person_id")


def tag_audience(interest: DataFrame, person: DataFrame, components: DataFrame) -> DataFrame:
    """``(tag_id, comp, audience, n)``: interested people of a component in one list, youngest first.

    For tags whose audience is too large for a row there is :func:`audience_table`.
    """
    # youngest first, equal birthdays by id
    order = F.struct(F.datediff(F.lit("1970-01-01").cast("date"), "birthday").alias("age"), "person_id", "birthday")
    joined = audience_table(interest, person, components)
    grouped = joined.groupBy("tag_id", "comp").agg(F.sort_array(F.collect_list(order)).alias("a"), F.count(F.lit(1)).alias("n"))
    members = F.transform("a", lambda m: F.struct(m["birthday"].alias("birthday"), m["person_id"].alias("person_id")))
    return grouped.select("tag_id", "comp", members.alias("audience"), "n")


def audience_chunks(audience: DataFrame, size: int = 1000) -> DataFrame:
    """``(tag_id, comp, chunk, youngest, oldest, audience)``: the lists of :func:`tag_audience` in rows of up to ``size`` people.

    ``audience`` is :func:`audience_table`.  Chunks are numbered from 0, youngest first, so a prefix of a list is found in few of them.
    """
    placed = numbered(audience, ["tag_id", "comp"], [F.desc("birthday"), F.asc("person_id")])
    dealt = placed.withColumn("chunk", F.expr(f"(rank - 1) DIV {size}"))
    listed = dealt.groupBy("tag_id", "comp", "chunk").agg(
        F.max("birthday").alias("youngest"), F.min("birthday").alias("oldest"), F.sort_array(F.collect_list(F.struct("rank", "birthday", "person_id"))).alias("a")
    )
    members = F.transform("a", lambda m: F.struct(m["birthday"].alias("birthday"), m["person_id"].alias("person_id")))
    return listed.select("tag_id", "comp", "chunk", "youngest", "oldest", members.alias("audience"))


def chunks_born_since(chunks: DataFrame, d) -> DataFrame:
    """``(tag_id, comp, n)``: as :func:`audience_born_since`, from chunks: those that are old as a whole are not opened."""
    young = chunks.where(F.col("youngest") >= d)
    whole = F.when(F.col("oldest") >= d, F.size("audience")).otherwise(F.size(born_since_in("audience", d)))
    return young.groupBy("tag_id", "comp").agg(F.sum(whole).alias("n"))


def audience_born_since(audience: DataFrame, d) -> DataFrame:
    """``(tag_id, comp, n)``: how many of each audience were born on or after ``d``."""
    return audience.groupBy("tag_id", "comp").agg(F.count_if(F.col("birthday") >= d).alias("n"))


def forums_for_tags(forum_tag: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(tag_id, forum_id)`` of the forums that carry a wanted ``tag_id`` (C14)."""
    return forum_tag.join(wanted.select("tag_id").distinct(), "tag_id", "left_semi").select("tag_id", "forum_id").distinct()


def members_for_forums(forum_member: DataFrame, forums: DataFrame) -> DataFrame:
    """Memberships of the given forums."""
    return forum_member.join(forums.select("forum_id").distinct(), "forum_id", "left_semi")


def forum_people(forum_member: DataFrame, forums: DataFrame) -> DataFrame:
    """``(tag_id, person_id)``: members of any forum with the tag, once."""
    return members_for_forums(forum_member, forums).join(forums, "forum_id").select("tag_id", "person_id").distinct()


def induced_edges(knows: DataFrame, members: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, src, dst)``: friendships inside each keyed set of ``id``s (C17)."""
    key = list(key)
    start = members.select(*key, F.col("id").alias("src"))
    end = members.select(*key, F.col("id").alias("dst"))
    return knows.join(start, "src").join(end, [*key, "dst"]).select(*key, "src", "dst")


def induced_degree(edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, id, degree)`` inside each keyed graph."""
    return edges.groupBy(*key, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
