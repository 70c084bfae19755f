"""Registered queries over the derived network, each with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import centrality, components, cover, paths, prepare, sketch, topk
from ..operators.loop import checkpoint, ensure_checkpoint_dir
from ..sources import bindings, io, store
from ..sources.schema import FILES, Network
from . import queries as plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Parameter tables of the reports, made from the given tables; both engines read them alike.
PAIRS = """SELECT CAST(c_nationkey AS BIGINT) AS qid, MIN(c_custkey) AS p1, MAX(c_custkey) AS p2,
    CAST(c_nationkey % 4 - 1 AS INT) AS x FROM {customer} GROUP BY c_nationkey"""
YOUNG = """SELECT CAST(r_regionkey AS BIGINT) AS qid, CAST(5 + r_regionkey AS INT) AS k,
    DATE '1960-01-01' + CAST(r_regionkey * 2500 AS INT) AS d FROM {region}"""
NEARBY = """SELECT CAST(r_regionkey AS BIGINT) AS qid, 5 AS k, 2 AS h, r_name AS place FROM {region}
    UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 4, 3, n_name FROM {nation}"""
TOPICS = "SELECT MIN(p_partkey) AS qid, 3 AS k, p_name AS tag FROM {part} GROUP BY p_name"


def params(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A parameter table."""
    given = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in bindings.GIVEN if f"{{{n}}}" in sql}
    return spark.sql(sql, **given)


def query(name: str, oracle: str | None = None):
    """Register a function of the derived network; its oracle sees the relations as views."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, sf_dir, bindings.derived_network(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            tables = {n: n for n in bindings.GIVEN}
            own = {"PAIRS": PAIRS, "YOUNG": YOUNG, "NEARBY": NEARBY, "TOPICS": TOPICS}
            sql = oracle
            for key, text in own.items():
                sql = sql.replace(f"[{key}]", text.format(**tables))
            head, _, tail = sql.partition("=>")
            ctes = ",\n".join([bindings.PLAIN_SQL, *_needed(head + tail), *[head.strip()] * bool(head.strip())])
            ORACLES[name] = f"WITH RECURSIVE {ctes}\n{tail.strip()}"
        return build

    return register


#: Relations that several oracles share, in an order in which each needs only earlier ones.
SHARED = {
    "replies": """replies AS (SELECT a.person_id AS src, b.person_id AS dst, COUNT(*) AS n FROM reply_of r
        JOIN comment_creator a ON a.comment_id = r.comment_id JOIN comment_creator b ON b.comment_id = r.parent_id
        WHERE a.person_id <> b.person_id GROUP BY 1, 2)""",
    "weights": """weights AS (SELECT k.src, k.dst, COALESCE(o.n, 0) AS out_cnt, COALESCE(i.n, 0) AS in_cnt FROM knows k
        LEFT JOIN replies o ON o.src = k.src AND o.dst = k.dst LEFT JOIN replies i ON i.src = k.dst AND i.dst = k.src)""",
    "comp": """comp(id, label) USING KEY (id) AS (SELECT id, id FROM person
        UNION SELECT k.dst, MIN(c.label) FROM comp c JOIN knows k ON k.src = c.id JOIN recurring.comp r ON r.id = k.dst
        WHERE c.label < r.label GROUP BY k.dst)""",
    "tags_of": """tags_of AS (SELECT p.id AS person_id, COALESCE(i.tags, []) AS tags FROM person p LEFT JOIN
        (SELECT person_id, list(tag_id ORDER BY tag_id) AS tags FROM interest GROUP BY 1) i ON i.person_id = p.id)""",
    "canon_place": "canon_place AS (SELECT id, MIN(id) OVER (PARTITION BY name) AS canon_id, name FROM place)",
    "children": """children AS (SELECT DISTINCT a.canon_id AS child, b.canon_id AS parent FROM place_part_of
        JOIN canon_place a ON a.id = child JOIN canon_place b ON b.id = parent WHERE a.canon_id <> b.canon_id)""",
    "inside": """inside(root, place) AS (SELECT DISTINCT canon_id, canon_id FROM canon_place
        UNION SELECT i.root, c.child FROM inside i JOIN children c ON c.parent = i.place)""",
    "at_place": """at_place AS (SELECT DISTINCT person_id, c.canon_id AS place FROM (SELECT person_id, place_id FROM located
        UNION ALL SELECT person_id, place_id FROM study_at JOIN org_place USING (org_id)
        UNION ALL SELECT person_id, place_id FROM work_at JOIN org_place USING (org_id)) e JOIN canon_place c ON c.id = e.place_id)""",
    "people_in": "people_in AS (SELECT DISTINCT root, person_id FROM inside JOIN at_place USING (place))",
    "fans": """fans AS (SELECT DISTINCT f.tag_id, m.person_id AS id FROM forum_tag f JOIN forum_member m USING (forum_id))""",
    "fan_edges": """fan_edges AS (SELECT a.tag_id, k.src, k.dst FROM knows k JOIN fans a ON a.id = k.src
        JOIN fans b ON b.id = k.dst AND b.tag_id = a.tag_id)""",
    "fan_dist": """fan_dist(tag_id, s, t, d) USING KEY (tag_id, s, t) AS (SELECT tag_id, id, id, 0 FROM fans
        UNION SELECT b.tag_id, b.s, e.dst, MIN(b.d) + 1 FROM fan_dist b JOIN fan_edges e ON e.src = b.t AND e.tag_id = b.tag_id
        WHERE NOT EXISTS (SELECT 1 FROM recurring.fan_dist r WHERE r.tag_id = b.tag_id AND r.s = b.s AND r.t = e.dst) GROUP BY 1, 2, 3)""",
    "fan_levels": """fan_levels AS (SELECT tag_id, s AS id, COUNT(*) FILTER (d = 1) AS "L1", COUNT(*) FILTER (d = 2) AS "L2",
        COUNT(*) FILTER (d = 3) AS "L3", COUNT(*) - 1 AS r, CAST(SUM(d) AS BIGINT) AS s FROM fan_dist GROUP BY 1, 2)""",
    "cover_step": """cover_step(tag_id, src, dst, pick) AS (SELECT tag_id, src, dst, CAST(NULL AS BIGINT) FROM fan_edges
        UNION ALL (WITH cur AS (SELECT tag_id, src, dst FROM cover_step WHERE pick IS NULL),
        deg AS (SELECT tag_id, src, COUNT(*) AS d, md5(CAST(src AS VARCHAR)) AS h FROM cur GROUP BY 1, 2),
        best AS (SELECT c.tag_id, c.src, MAX(a.d) AS d FROM cur c JOIN deg a ON a.tag_id = c.tag_id AND a.src = c.src
        JOIN deg b ON b.tag_id = c.tag_id AND b.src = c.dst GROUP BY 1, 2
        HAVING bool_and(a.d > b.d OR a.d = b.d AND (a.h < b.h OR a.h = b.h AND c.src < c.dst)))
        SELECT c.tag_id, c.src, c.dst, CAST(NULL AS BIGINT) FROM cur c
        WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.tag_id = c.tag_id AND (b.src = c.src OR b.src = c.dst))
        UNION ALL SELECT tag_id, src, NULL, d FROM best))""",
    "cover": "cover AS (SELECT tag_id, src AS id, pick AS pick_degree FROM cover_step WHERE pick IS NOT NULL)",
    "young": """young AS (SELECT q.qid, i.tag_id, p.id FROM interest i JOIN person p ON p.id = i.person_id
        JOIN ([YOUNG]) q ON p.birthday >= q.d)""",
    "young_edges": """young_edges AS (SELECT (a.qid * 100000000 + a.tag_id) * 1000000000 + k.src AS src,
        (a.qid * 100000000 + a.tag_id) * 1000000000 + k.dst AS dst FROM knows k JOIN young a ON a.id = k.src
        JOIN young b ON b.id = k.dst AND b.tag_id = a.tag_id AND b.qid = a.qid)""",
    "young_labels": """young_labels(v, label) USING KEY (v) AS (SELECT (qid * 100000000 + tag_id) * 1000000000 + id,
        (qid * 100000000 + tag_id) * 1000000000 + id FROM young
        UNION SELECT k.dst, MIN(c.label) FROM young_labels c JOIN young_edges k ON k.src = c.v
        JOIN recurring.young_labels r ON r.v = k.dst WHERE c.label < r.label GROUP BY k.dst)""",
    "young_comp": """young_comp AS (SELECT v // 100000000000000000 AS qid, v // 1000000000 % 100000000 AS tag_id,
        v % 1000000000 AS id, label % 1000000000 AS label FROM young_labels)""",
    "young_range": """young_range AS (SELECT qid, tag_id, MAX(n) AS "range" FROM
        (SELECT qid, tag_id, label, COUNT(*) AS n FROM young_comp GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
    "seeds": "seeds AS (SELECT p1 AS s FROM ([PAIRS]))",
    "balls": """balls(s, t, d) USING KEY (s, t) AS (SELECT s, s, 0 FROM seeds
        UNION SELECT b.s, k.dst, MIN(b.d) + 1 FROM balls b JOIN knows k ON k.src = b.t WHERE b.d < 3 AND NOT EXISTS
        (SELECT 1 FROM recurring.balls r WHERE r.s = b.s AND r.t = k.dst) GROUP BY 1, 2)""",
    "search": """search(qid, p2, x, v, d) USING KEY (qid, v) AS (SELECT qid, p2, x, p1, 0 FROM ([PAIRS])
        UNION SELECT b.qid, b.p2, b.x, k.dst, MIN(b.d) + 1 FROM search b JOIN weights k ON k.src = b.v
        WHERE (b.x < 0 OR LEAST(k.in_cnt, k.out_cnt) > b.x)
        AND NOT EXISTS (SELECT 1 FROM recurring.search r WHERE r.qid = b.qid AND r.v = k.dst) GROUP BY b.qid, b.p2, b.x, k.dst)""",
    "hops": """hops AS (SELECT q.qid, COALESCE(MIN(s.d), -1) AS hops FROM ([PAIRS]) q
        LEFT JOIN search s ON s.qid = q.qid AND s.v = q.p2 GROUP BY q.qid)""",
    "place_people": """place_people AS (SELECT DISTINCT q.qid, q.h, i.person_id AS id FROM ([NEARBY]) q
        JOIN canon_place c ON c.name = q.place AND c.id = c.canon_id JOIN people_in i ON i.root = c.canon_id)""",
    "reach": """reach(qid, h, s, t, d) USING KEY (qid, s, t) AS (SELECT qid, h, id, id, 0 FROM place_people
        UNION SELECT b.qid, b.h, b.s, k.dst, MIN(b.d) + 1 FROM reach b JOIN knows k ON k.src = b.t WHERE b.d < b.h AND NOT EXISTS
        (SELECT 1 FROM recurring.reach r WHERE r.qid = b.qid AND r.s = b.s AND r.t = k.dst) GROUP BY b.qid, b.h, b.s, k.dst)""",
    "alike": """alike AS (SELECT r.qid, r.s AS a, r.t AS b, CAST(len(list_intersect(x.tags, y.tags)) AS BIGINT) AS common FROM reach r
        JOIN place_people m ON m.qid = r.qid AND m.id = r.t JOIN tags_of x ON x.person_id = r.s JOIN tags_of y ON y.person_id = r.t
        WHERE r.s < r.t)""",
    "best_tags": """best_tags AS (SELECT qid, "rank", tag, "range" FROM (SELECT y.qid, t.name AS tag, y."range", q.k,
        ROW_NUMBER() OVER (PARTITION BY y.qid ORDER BY y."range" DESC, t.name, t.id) AS "rank"
        FROM young_range y JOIN tag t ON t.id = y.tag_id JOIN ([YOUNG]) q ON q.qid = y.qid) WHERE "rank" <= k)""",
    "best_pairs": """best_pairs AS (SELECT qid, "rank", a, b, common FROM (SELECT alike.*, q.k,
        ROW_NUMBER() OVER (PARTITION BY alike.qid ORDER BY common DESC, a, b) AS "rank" FROM alike JOIN ([NEARBY]) q ON q.qid = alike.qid) WHERE "rank" <= k)""",
    "best_people": """best_people AS (SELECT qid, "rank", id, r, s, centrality FROM (SELECT q.qid, q.k, f.id, f.r, f.s,
        f.r * f.r * 1.0::DOUBLE / f.s AS centrality,
        ROW_NUMBER() OVER (PARTITION BY q.qid ORDER BY f.r * f.r * 1.0::DOUBLE / f.s DESC, f.id) AS "rank" FROM fan_levels f
        JOIN canon_tag t ON t.id = f.tag_id JOIN ([TOPICS]) q ON q.tag = t.name WHERE f.r > 0) WHERE "rank" <= k)""",
}


def _needed(sql: str) -> list[str]:
    """Shared relations that ``sql`` names, directly or through others."""
    import re

    tables = {n: n for n in bindings.GIVEN}
    wanted, text = set(), sql
    for name in reversed(SHARED):
        if re.search(rf"\b{name}\b", text):
            wanted.add(name)
            text += SHARED[name]
    out = []
    for name, body in SHARED.items():
        if name in wanted:
            for key, own in (("PAIRS", PAIRS), ("YOUNG", YOUNG), ("NEARBY", NEARBY)):
                body = body.replace(f"[{key}]", own.format(**tables))
            out.append(body.replace("[TOPICS]", TOPICS.format(**tables)))
    return out


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, COUNT(*) AS \"rows\" FROM {n}" for n in FILES)


def _through_files(spark: SparkSession, net: Network) -> Network:
    """The network written as CSV files and read back."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/network-{uuid.uuid4().hex}"
    for name, (file, columns) in FILES.items():
        last = max(p for _, _, p in columns)
        at = {p: c for c, _, p in columns}
        row = [F.col(at[i]) if i in at else F.lit("-").alias(f"other{i}") for i in range(last + 1)]
        net.tables()[name].select(*row, F.lit("more").alias("further")).write.csv(f"{folder}/{file}", sep="|", header=True)
    return io.read_network(spark, folder)


def _stored(spark: SparkSession, net: Network) -> str:
    """The network written into a store."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    store.write(net, folder, buckets=8)
    return folder


@query("a1_store_profile", _COUNTS.join(["=> ", ""]))
def _(spark, sf_dir, net):
    """The relations of a store, by its manifest and by what is read from it."""
    folder = _stored(spark, net)
    counted = io.profile(store.read_store(spark, folder))
    return counted.join(store.manifest(spark, folder).select("name", "rows"), ["name", "rows"])


@query("a1_quarantine", """=> SELECT 'person' AS name, COUNT(*) FILTER (id % 7 <> 0) AS "rows", COUNT(*) FILTER (id % 7 = 0) AS bad_rows FROM person
    UNION ALL SELECT 'knows', COUNT(*) FILTER (src % 7 <> 0), COUNT(*) FILTER (src % 7 = 0) FROM knows""")
def _(spark, sf_dir, net):
    """People without a birthday and friendships of nobody known are set aside and counted."""
    person = net.person.select(F.col("id").cast("string"), F.when(F.col("id") % 7 != 0, F.col("birthday").cast("string")).otherwise("1970-13-01").alias("birthday"))
    knows = net.knows.select(F.when(F.col("src") % 7 != 0, F.col("src").cast("string")).otherwise("x").alias("src"), F.col("dst").cast("string"))
    counted = []
    for name, raw in (("person", person), ("knows", knows)):
        good, bad = store.typed(raw, name)
        rows = good.select(F.lit(True).alias("good")).union(bad.select(F.lit(False)))
        counted.append(rows.agg(F.count_if("good").alias("rows"), F.count_if(~F.col("good")).alias("bad_rows")).select(F.lit(name).alias("name"), "*"))
    return counted[0].union(counted[1])


@query("a1_read_network", _COUNTS.join(["=> ", ""]))
def _(spark, sf_dir, net):
    return io.profile(_through_files(spark, net))


_VALUES = " UNION ALL ".join(
    f"SELECT '{name}' AS name, {', '.join(f'CAST({c} AS VARCHAR) AS v{i}' for i, c in enumerate([c for c, _, _ in columns] + ['NULL'] * (3 - len(columns))))} FROM {name}"
    for name, (_, columns) in FILES.items()
)


@query("a1_read_values", f"=> {_VALUES}")
def _(spark, sf_dir, net):
    """Every value of every relation after a round trip through files."""
    parts = []
    for name, table in _through_files(spark, net).tables().items():
        values = [F.col(c).cast("string") for c, _, _ in FILES[name][1]] + [F.lit(None).cast("string")] * 3
        parts.append(table.select(F.lit(name).alias("name"), *[v.alias(f"v{i}") for i, v in enumerate(values[:3])]))
    return reduce(DataFrame.union, parts)


@query("a4_profile", _COUNTS.join(["=> ", ""]))
def _(spark, sf_dir, net):
    return io.profile(net)


@query("b1_date_key", "=> SELECT id, CAST(strftime(birthday, '%Y%m%d') AS INT) AS day FROM person")
def _(spark, sf_dir, net):
    return net.person.select("id", scalars.date_key("birthday").alias("day"))


@query("b2_born_since", "=> SELECT id FROM person WHERE birthday >= DATE '1980-01-01'")
def _(spark, sf_dir, net):
    return scalars.born_since(net.person, "1980-01-01").select("id")


@query("b3_canonical_pair", "=> SELECT LEAST(src, dst) AS a, GREATEST(src, dst) AS b, CAST(SUM(n) AS BIGINT) AS n FROM replies GROUP BY 1, 2")
def _(spark, sf_dir, net):
    a, b = scalars.canonical_pair("src", "dst")
    counts = prepare.reply_counts(net.reply_of, net.comment_creator)
    return counts.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("n").alias("n"))


@query("b4_by_name", "=> SELECT id, name FROM tag WHERE name = 'hot ring'")
def _(spark, sf_dir, net):
    return scalars.by_name(net.tag, "hot ring").select("id", "name")


def _weights(net: Network) -> DataFrame:
    return prepare.edge_weights(net.knows, prepare.reply_counts(net.reply_of, net.comment_creator, net.knows))


@query("b5_mutual_edges_x0", "=> SELECT src, dst FROM weights WHERE LEAST(in_cnt, out_cnt) > 0")
def _(spark, sf_dir, net):
    return prepare.mutual_edges(_weights(net), 0)


@query("b6_common_tags", """=> SELECT src AS a, dst AS b, CAST(len(list_intersect(x.tags, y.tags)) AS BIGINT) AS common FROM knows
    JOIN tags_of x ON x.person_id = src JOIN tags_of y ON y.person_id = dst WHERE src < dst""")
def _(spark, sf_dir, net):
    tags = prepare.person_tags(net.interest, net.person).drop("n_tags")
    of = lambda end: tags.toDF(end, f"tags_{end}")
    pairs = net.knows.where("src < dst").toDF("a", "b").join(of("a"), "a").join(of("b"), "b")
    return pairs.select("a", "b", scalars.common_tags("tags_a", "tags_b").alias("common"))


_AUDIENCE = "SELECT i.tag_id, c.label AS comp, p.id, p.birthday FROM interest i JOIN person p ON p.id = i.person_id JOIN comp c ON c.id = p.id"


def _audience(net: Network) -> DataFrame:
    comp = components.connected_components(net.knows, net.person)
    return prepare.tag_audience(net.interest, net.person, comp)


@query("b7_audience_born_since", f"=> SELECT tag_id, comp, COUNT(*) FILTER (birthday >= DATE '1985-01-01') AS n FROM ({_AUDIENCE}) GROUP BY 1, 2")
def _(spark, sf_dir, net):
    comp = components.connected_components(net.knows, net.person)
    return prepare.audience_born_since(prepare.audience_table(net.interest, net.person, comp), F.lit("1985-01-01").cast("date"))


@query("b7_audience_list_born_since", f"=> SELECT tag_id, comp, COUNT(*) FILTER (birthday >= DATE '1985-01-01') AS n FROM ({_AUDIENCE}) GROUP BY 1, 2")
def _(spark, sf_dir, net):
    since = scalars.born_since_in("audience", F.lit("1985-01-01").cast("date"))
    return _audience(net).select("tag_id", "comp", F.size(since).cast("long").alias("n"))


@query("c1_adjacency", "=> SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS neighbours, COUNT(*) AS degree FROM knows GROUP BY 1")
def _(spark, sf_dir, net):
    return prepare.adjacency(net.knows).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query("c2_reply_counts_friends", "=> SELECT r.* FROM replies r JOIN knows k ON k.src = r.src AND k.dst = r.dst")
def _(spark, sf_dir, net):
    return prepare.reply_counts(net.reply_of, net.comment_creator, net.knows)


@query("c2_reply_counts_from_store", "=> SELECT r.* FROM replies r JOIN knows k ON k.src = r.src AND k.dst = r.dst")
def _(spark, sf_dir, net):
    """Replies with their authors, in buckets: no shuffle before the counting."""
    kept = store.read_store(spark, _stored(spark, net))
    return prepare.reply_counts(kept.reply_of, kept.comment_creator, kept.knows)


@query("c3_edge_weights", "=> SELECT * FROM weights")
def _(spark, sf_dir, net):
    return _weights(net)


@query("c4_reply_counts_all", "=> SELECT * FROM replies")
def _(spark, sf_dir, net):
    return prepare.reply_counts(net.reply_of, net.comment_creator)


@query("c5_friends_by_replies", """=> SELECT * FROM (SELECT src, ROW_NUMBER() OVER (PARTITION BY src ORDER BY out_cnt DESC, dst) AS "rank", dst, out_cnt
    FROM weights) WHERE "rank" <= 3""")
def _(spark, sf_dir, net):
    return prepare.friends_by_replies(_weights(net), 3)


@query("c5_all_friends_by_replies", """=> SELECT src, ROW_NUMBER() OVER (PARTITION BY src ORDER BY out_cnt DESC, dst) AS "rank", dst, out_cnt
    FROM weights""")
def _(spark, sf_dir, net):
    return prepare.friends_by_replies(_weights(net))


@query("c6_canonical_places", "=> SELECT id, canon_id, name FROM canon_place")
def _(spark, sf_dir, net):
    return prepare.canonical_by_name(net.place)


@query("c7_canonical_tags", "=> SELECT t.id, c.id AS canon_id, t.name FROM tag t JOIN canon_tag c ON c.name = t.name")
def _(spark, sf_dir, net):
    return prepare.canonical_by_name(net.tag)


@query("c8_place_children", "=> SELECT * FROM children")
def _(spark, sf_dir, net):
    return prepare.place_children(net.place_part_of, prepare.canonical_by_name(net.place))


def _closure(net: Network) -> tuple[DataFrame, DataFrame]:
    canon = checkpoint(prepare.canonical_by_name(net.place))
    children = checkpoint(prepare.place_children(net.place_part_of, canon))
    return canon, prepare.place_closure(children, canon.select(F.col("canon_id").alias("root")).distinct())


@query("c9_place_closure", "=> SELECT * FROM inside")
def _(spark, sf_dir, net):
    return _closure(net)[1]


@query("c10_person_place", "=> SELECT * FROM at_place")
def _(spark, sf_dir, net):
    return prepare.person_place(net.located, net.study_at, net.work_at, net.org_place, prepare.canonical_by_name(net.place))


@query("c11_people_in_place", "=> SELECT * FROM people_in")
def _(spark, sf_dir, net):
    canon, closure = _closure(net)
    return prepare.people_in_place(closure, prepare.person_place(net.located, net.study_at, net.work_at, net.org_place, canon))


@query("c12_person_tags", "=> SELECT person_id, array_to_string(tags, ',') AS tags, CAST(len(tags) AS BIGINT) AS n_tags FROM tags_of")
def _(spark, sf_dir, net):
    return prepare.person_tags(net.interest, net.person).withColumn("tags", F.array_join(F.col("tags").cast("array<string>"), ","))


@query("c13_audience_table", f"=> SELECT tag_id, comp, CAST(strftime(birthday, '%Y%m%d') AS INT) AS day, id AS person_id FROM ({_AUDIENCE})")
def _(spark, sf_dir, net):
    table = prepare.audience_table(net.interest, net.person, components.connected_components(net.knows, net.person))
    return table.select("tag_id", "comp", scalars.date_key("birthday").alias("day"), "person_id")


@query("c13_tag_audience", f"""=> SELECT tag_id, comp, string_agg(id, ',' ORDER BY birthday DESC, id) AS people, COUNT(*) AS n
    FROM ({_AUDIENCE}) GROUP BY 1, 2""")
def _(spark, sf_dir, net):
    people = F.array_join(F.col("audience.person_id").cast("array<string>"), ",")
    return _audience(net).select("tag_id", "comp", people.alias("people"), "n")


def _chunks(net: Network) -> DataFrame:
    return prepare.audience_chunks(prepare.audience_table(net.interest, net.person, components.connected_components(net.knows, net.person)), 50)


@query("c13_audience_chunks", f"""=> SELECT tag_id, comp, chunk, string_agg(id, ',' ORDER BY birthday DESC, id) AS people, COUNT(*) AS n
    FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY tag_id, comp ORDER BY birthday DESC, id) - 1) // 50 AS chunk FROM ({_AUDIENCE})) GROUP BY 1, 2, 3""")
def _(spark, sf_dir, net):
    people = F.array_join(F.col("audience.person_id").cast("array<string>"), ",")
    return _chunks(net).select("tag_id", "comp", "chunk", people.alias("people"), F.size("audience").cast("long").alias("n"))


@query("b7_audience_chunks_born_since", f"""=> SELECT tag_id, comp, COUNT(*) AS n FROM ({_AUDIENCE})
    WHERE birthday >= DATE '1980-01-01' GROUP BY 1, 2""")
def _(spark, sf_dir, net):
    return prepare.chunks_born_since(_chunks(net), F.lit("1980-01-01").cast("date"))


def _wanted(net: Network) -> DataFrame:
    return scalars.by_name(net.tag, "hot ring").agg(F.min("id").alias("tag_id"))


@query("c14_forums_for_tags", "=> SELECT DISTINCT f.tag_id, f.forum_id FROM forum_tag f JOIN canon_tag c ON c.id = f.tag_id WHERE c.name = 'hot ring'")
def _(spark, sf_dir, net):
    return prepare.forums_for_tags(net.forum_tag, _wanted(net))


@query("c15_members_for_forums", """=> SELECT * FROM forum_member WHERE forum_id IN
    (SELECT f.forum_id FROM forum_tag f JOIN canon_tag c ON c.id = f.tag_id WHERE c.name = 'hot ring')""")
def _(spark, sf_dir, net):
    return prepare.members_for_forums(net.forum_member, prepare.forums_for_tags(net.forum_tag, _wanted(net)))


def _all_wanted(net: Network) -> DataFrame:
    """The canonical tag of every name."""
    return prepare.canonical_by_name(net.tag).select(F.col("canon_id").alias("tag_id")).distinct()


@query("c14_forums_for_all_tags", "=> SELECT DISTINCT f.tag_id, f.forum_id FROM forum_tag f JOIN canon_tag c ON c.id = f.tag_id")
def _(spark, sf_dir, net):
    return prepare.forums_for_tags(net.forum_tag, _all_wanted(net))


@query("c15_members_for_all_tags", """=> SELECT * FROM forum_member WHERE forum_id IN
    (SELECT f.forum_id FROM forum_tag f JOIN canon_tag c ON c.id = f.tag_id)""")
def _(spark, sf_dir, net):
    return prepare.members_for_forums(net.forum_member, prepare.forums_for_tags(net.forum_tag, _all_wanted(net)))


def _fans(net: Network) -> DataFrame:
    """Forum people of every tag."""
    forums = prepare.forums_for_tags(net.forum_tag, net.tag.select(F.col("id").alias("tag_id")))
    return prepare.forum_people(net.forum_member, forums).select("tag_id", F.col("person_id").alias("id"))


@query("c16_forum_people", "=> SELECT tag_id, id AS person_id FROM fans")
def _(spark, sf_dir, net):
    return _fans(net).select("tag_id", F.col("id").alias("person_id"))


KEY = ["tag_id"]


def _fan_graph(net: Network) -> tuple[DataFrame, DataFrame]:
    members = checkpoint(_fans(net))
    return checkpoint(prepare.induced_edges(net.knows, members, KEY)), members


@query("c17_induced_edges", "=> SELECT * FROM fan_edges")
def _(spark, sf_dir, net):
    return prepare.induced_edges(net.knows, _fans(net), KEY)


@query("c18_induced_degree", "=> SELECT tag_id, src AS id, COUNT(*) AS degree FROM fan_edges GROUP BY 1, 2")
def _(spark, sf_dir, net):
    return prepare.induced_degree(prepare.induced_edges(net.knows, _fans(net), KEY), KEY)


@query("g1_components", "=> SELECT id, label AS comp FROM comp")
def _(spark, sf_dir, net):
    return components.connected_components(net.knows, net.person)


@query("g1_component_numbers", "=> SELECT label AS comp, ROW_NUMBER() OVER (ORDER BY label) - 1 AS number FROM (SELECT DISTINCT label FROM comp)")
def _(spark, sf_dir, net):
    return components.component_numbers(components.connected_components(net.knows, net.person))


@query("g2_component_sizes", "=> SELECT label AS comp, COUNT(*) AS size FROM comp GROUP BY 1")
def _(spark, sf_dir, net):
    return components.component_sizes(components.connected_components(net.knows, net.person))


def _young(spark, sf_dir, net) -> DataFrame:
    people, wanted = plans.audiences(net, params(spark, sf_dir, YOUNG))
    return checkpoint(plans.audience_members(people, wanted))


@query("g3_tag_components", "=> SELECT qid, tag_id, id, label AS comp FROM young_comp")
def _(spark, sf_dir, net):
    key = ["qid", "tag_id"]
    members = _young(spark, sf_dir, net)
    return components.connected_components(prepare.induced_edges(net.knows, members, key), members, key)


@query("g4_tag_largest_component", '=> SELECT qid, tag_id, "range" FROM young_range')
def _(spark, sf_dir, net):
    return plans.tag_ranges(net, params(spark, sf_dir, YOUNG))


@query("g4_tag_largest_component_halved", '=> SELECT qid, tag_id, "range" FROM young_range')
def _(spark, sf_dir, net):
    """The way of tags with more friendships than one task shall hold, for all tags."""
    return plans.tag_ranges(net, params(spark, sf_dir, YOUNG), small=0)


@query("g5_hop_distance", "=> SELECT qid, CAST(hops AS BIGINT) AS hops FROM hops")
def _(spark, sf_dir, net):
    return paths.hop_distance(_weights(net), params(spark, sf_dir, PAIRS))


@query("g6_vertex_cover", "=> SELECT tag_id, id, pick_degree FROM cover")
def _(spark, sf_dir, net):
    edges, _ = _fan_graph(net)
    return cover.vertex_cover(edges, KEY)


@query("g6_vertex_cover_share", """=> SELECT tag_id, id, pick_degree FROM (SELECT c.*, n, ROW_NUMBER() OVER (PARTITION BY c.tag_id
    ORDER BY pick_degree DESC, id) AS "rank" FROM cover c JOIN (SELECT tag_id, COUNT(DISTINCT src) AS n FROM fan_edges GROUP BY 1) v
    ON v.tag_id = c.tag_id) WHERE "rank" <= GREATEST(1, FLOOR(n * 0.25))""")
def _(spark, sf_dir, net):
    edges, _ = _fan_graph(net)
    return cover.vertex_cover(edges, KEY, limit=0.25)


@query("g6_vertex_cover_checks", """=> SELECT tag_id, COUNT(*) AS edges, COUNT(*) AS picked, CAST(0 AS BIGINT) AS uncovered
    FROM fan_edges WHERE src < dst GROUP BY 1""")
def _(spark, sf_dir, net):
    """The pick degrees of a tag add up to its edges, as each edge goes with one pick, and no edge is uncovered."""
    edges, _ = _fan_graph(net)
    picks = checkpoint(cover.vertex_cover(edges, KEY))
    once = edges.where("src < dst")
    end = lambda name: picks.select(*KEY, F.col("id").alias(name))
    bare = once.join(end("src"), [*KEY, "src"], "left_anti").join(end("dst"), [*KEY, "dst"], "left_anti")
    counted = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("edges"))
    picked = picks.groupBy(*KEY).agg(F.sum("pick_degree").alias("picked"))
    missed = bare.groupBy(*KEY).agg(F.count(F.lit(1)).alias("uncovered"))
    joined = counted.join(picked, KEY, "left").join(missed, KEY, "left")
    return joined.select(*KEY, "edges", "picked", F.coalesce("uncovered", F.lit(0).cast("long")).alias("uncovered"))


def _seeds(spark, sf_dir) -> DataFrame:
    return params(spark, sf_dir, PAIRS).select(F.col("p1").alias("source"))


@query("g7_within_hops", "=> SELECT q.qid, b.d IS NOT NULL AS within FROM ([PAIRS]) q LEFT JOIN balls b ON b.s = q.p1 AND b.t = q.p2 AND b.d <= 3")
def _(spark, sf_dir, net):
    pairs = params(spark, sf_dir, PAIRS).select("qid", F.col("p1").alias("a"), F.col("p2").alias("b"))
    return paths.within_hops(net.knows, pairs, 3)


@query("g8_h_hop", "=> SELECT s AS source, t AS id, d FROM balls")
def _(spark, sf_dir, net):
    return paths.h_hop(net.knows, _seeds(spark, sf_dir), 3)


@query("g8_h_hop_counts", "=> SELECT s AS source, COUNT(*) - 1 AS n FROM balls GROUP BY 1")
def _(spark, sf_dir, net):
    return paths.h_hop_counts(net.knows, _seeds(spark, sf_dir), 3)


#: Balls around every person whose id is divisible by 20; they grow in number with the people.
_MANY = """many(s, t, d) USING KEY (s, t) AS (SELECT id, id, 0 FROM person WHERE id % 20 = 0
    UNION SELECT b.s, k.dst, MIN(b.d) + 1 FROM many b JOIN knows k ON k.src = b.t WHERE b.d < 3 AND NOT EXISTS
    (SELECT 1 FROM recurring.many r WHERE r.s = b.s AND r.t = k.dst) GROUP BY 1, 2)"""


def _many(net: Network) -> DataFrame:
    return net.person.where(F.col("id") % 20 == 0).select(F.col("id").alias("source"))


@query("g7_within_hops_many", f"""{_MANY} => SELECT a.id AS qid, m.d IS NOT NULL AS within FROM person a JOIN person b ON b.id = a.id + 7
    LEFT JOIN many m ON m.s = a.id AND m.t = b.id WHERE a.id % 20 = 0""")
def _(spark, sf_dir, net):
    ends = net.person.select(F.col("id").alias("b"))
    pairs = _many(net).select(F.col("source").alias("qid"), F.col("source").alias("a"), (F.col("source") + 7).alias("b")).join(ends, "b")
    return paths.within_hops(net.knows, pairs.select("qid", "a", "b"), 3)


@query("g8_h_hop_many", f"{_MANY} => SELECT s AS source, t AS id, d FROM many")
def _(spark, sf_dir, net):
    return paths.h_hop(net.knows, _many(net), 3)


@query("g8_h_hop_counts_many", f"{_MANY} => SELECT s AS source, COUNT(*) - 1 AS n FROM many GROUP BY 1")
def _(spark, sf_dir, net):
    return paths.h_hop_counts(net.knows, _many(net), 3)


@query("g9_geodesics", "=> SELECT tag_id, id, r, s FROM fan_levels")
def _(spark, sf_dir, net):
    return centrality.geodesics(*_fan_graph(net), KEY)


@query("g9_geodesics_by_levels", "=> SELECT tag_id, id, r, s FROM fan_levels")
def _(spark, sf_dir, net):
    return centrality.distance_sums(*_fan_graph(net), KEY)


@query("g9_geodesics_by_bits", "=> SELECT tag_id, id, r, s FROM fan_levels")
def _(spark, sf_dir, net):
    return centrality.bit_distance_sums(*_fan_graph(net), KEY)


@query("g10_closeness", "=> SELECT tag_id, id, r, s, r * r * 1.0::DOUBLE / s AS centrality FROM fan_levels WHERE r > 0")
def _(spark, sf_dir, net):
    return centrality.closeness(*_fan_graph(net), KEY)


_REACH = '"L1" + "L2" + "L3" AS reach3, "L1" + 2 * "L2" + 3 * "L3" AS partial'


@query("g11_level_sizes", f'=> SELECT tag_id, id, "L1", "L2", "L3", {_REACH} FROM fan_levels')
def _(spark, sf_dir, net):
    return centrality.level_sizes(*_fan_graph(net), KEY)


_BOUND = f"""bounded AS (SELECT *, partial + 4 * (r - reach3) AS bound FROM (SELECT *, {_REACH} FROM fan_levels) WHERE r > 0),
    kth AS (SELECT tag_id, centrality AS low FROM (SELECT tag_id, r * r * 1.0::DOUBLE / s AS centrality,
    ROW_NUMBER() OVER (PARTITION BY tag_id ORDER BY r * r * 1.0::DOUBLE / s DESC, id) AS n FROM fan_levels WHERE r > 0) WHERE n = 3)"""


@query("g12_prune_by_bound", f"""{_BOUND} => SELECT b.tag_id, b.id, b.r, b.bound FROM bounded b LEFT JOIN kth k ON k.tag_id = b.tag_id
    WHERE COALESCE(k.low, 0) <= b.r * b.r * 1.0::DOUBLE / b.bound""")
def _(spark, sf_dir, net):
    edges, members = _fan_graph(net)
    exact = topk.top_k(centrality.closeness(edges, members, KEY), KEY, [F.desc("centrality"), F.asc("id")], 3)
    kth = exact.where("rank = 3").select("tag_id", F.col("centrality").alias("floor"))
    comp = components.connected_components(edges, members, KEY)
    bounded = centrality.with_bound(centrality.level_sizes(edges, members, KEY), comp, KEY)
    return centrality.prune_by_bound(bounded, kth, KEY).select("tag_id", "id", "r", "bound")


@query("g13_suffix_max", f"""=> SELECT *, MAX("L1") OVER w AS "max_L1", MAX("L2") OVER w AS "max_L2", MAX("L3") OVER w AS "max_L3" FROM
    (SELECT tag_id, id, "L1", "L2", "L3", {_REACH} FROM fan_levels)
    WINDOW w AS (PARTITION BY tag_id ORDER BY reach3 DESC, "L1" DESC, "L2" DESC, "L3" DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(spark, sf_dir, net):
    return centrality.suffix_max(centrality.level_sizes(*_fan_graph(net), KEY), KEY)


#: Sketches of 4,096 registers of the people ``t`` that are within reach of ``s``, and their estimates.
_SKETCHED = """marks AS (SELECT id AS t, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 4) AS INT) // 16 AS slot,
        ltrim(substr(md5(CAST(id AS VARCHAR)), 5, 16), '0') AS digits FROM person),
    filled AS (SELECT r.s, m.slot, MAX(4 * (16 - length(digits)) + CASE WHEN digits >= '8' THEN 0 WHEN digits >= '4' THEN 1
        WHEN digits >= '2' THEN 2 ELSE 3 END + 1) AS top FROM within_reach r JOIN marks m ON m.t = r.t GROUP BY 1, 2),
    means AS (SELECT s, COUNT(*) AS n, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (4096 - COUNT(*) + SUM(pow(2.0::DOUBLE, -top))) AS mean
        FROM filled GROUP BY 1)"""
_ESTIMATED = "SELECT s AS id, CAST(ROUND(IF(mean <= 10240 AND n < 4096, 4096 * ln(4096.0::DOUBLE / (4096 - n)), mean)) AS BIGINT) AS estimate FROM means"


@query("g14_approx_neighbourhood", f"""hop1 AS (SELECT src AS s, dst AS t FROM knows UNION SELECT src, src FROM knows),
    hop2 AS (SELECT * FROM hop1 UNION SELECT r.s, k.dst FROM hop1 r JOIN knows k ON k.src = r.t),
    within_reach AS (SELECT * FROM hop2 UNION SELECT r.s, k.dst FROM hop2 r JOIN knows k ON k.src = r.t), {_SKETCHED} => {_ESTIMATED}""")
def _(spark, sf_dir, net):
    return sketch.approx_neighbourhood(net.knows, 3)


@query("g14_approx_within_reach", f"""friendly AS (SELECT DISTINCT src AS id FROM knows), within_reach AS (SELECT a.id AS s, b.id AS t FROM friendly f
    JOIN comp a ON a.id = f.id JOIN comp b ON b.label = a.label), {_SKETCHED} => {_ESTIMATED}""")
def _(spark, sf_dir, net):
    """However many hops away."""
    return sketch.approx_reach(net.knows)


@query("g14_approx_within_error", f"{_MANY} => SELECT s AS id, COUNT(*) AS exact, true AS close FROM many GROUP BY 1")
def _(spark, sf_dir, net):
    """Sketches of 4,096 registers are off by 1.6 % as a rule; five times that and one person are allowed here."""
    exact = paths.h_hop_counts(net.knows, _many(net), 3).select(F.col("source").alias("id"), (F.col("n") + 1).alias("exact"))
    found = exact.join(sketch.approx_neighbourhood(net.knows, 3), "id", "left").withColumn("estimate", F.coalesce("estimate", F.lit(1)))
    return found.select("id", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 1 + 0.08 * F.col("exact")).alias("close"))


@query("g15_similar_pairs", "=> SELECT * FROM alike")
def _(spark, sf_dir, net):
    wanted = params(spark, sf_dir, NEARBY)
    members = plans.place_members(net, wanted).join(wanted, "place").select("qid", "h", F.col("person_id").alias("id"))
    return paths.similar_pairs(net.knows, members, prepare.person_tags(net.interest, net.person))


@query("t1_top_tags", """=> SELECT born, "rank", tag, "range" FROM (SELECT CAST(year(p.birthday) AS BIGINT) AS born, t.name AS tag, COUNT(*) AS "range",
    ROW_NUMBER() OVER (PARTITION BY year(p.birthday) ORDER BY COUNT(*) DESC, t.name, t.id) AS "rank"
    FROM interest i JOIN person p ON p.id = i.person_id JOIN tag t ON t.id = i.tag_id GROUP BY year(p.birthday), t.id, t.name) WHERE "rank" <= 3""")
def _(spark, sf_dir, net):
    """The tags that most people of each year of birth are interested in."""
    born = net.person.select(F.col("id").alias("person_id"), F.year("birthday").cast("long").alias("born"))
    names = net.tag.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    counted = net.interest.join(born, "person_id").groupBy("born", "tag_id").agg(F.count(F.lit(1)).alias("range")).join(names, "tag_id")
    return topk.top_k(counted, ["born"], [F.desc("range"), F.asc("tag"), F.asc("tag_id")], 3).select("born", "rank", "tag", "range")


@query("t2_top_pairs", """=> SELECT city, "rank", a, b, common FROM (SELECT l.place_id AS city, k.src AS a, k.dst AS b,
    CAST(len(list_intersect(x.tags, y.tags)) AS BIGINT) AS common,
    ROW_NUMBER() OVER (PARTITION BY l.place_id ORDER BY len(list_intersect(x.tags, y.tags)) DESC, k.src, k.dst) AS "rank"
    FROM knows k JOIN located l ON l.person_id = k.src JOIN tags_of x ON x.person_id = k.src JOIN tags_of y ON y.person_id = k.dst
    WHERE k.src < k.dst) WHERE "rank" <= 4""")
def _(spark, sf_dir, net):
    """Of each place the pairs of friends with the most interests in common."""
    tags = prepare.person_tags(net.interest, net.person).drop("n_tags")
    of = lambda end: tags.toDF(end, f"tags_{end}")
    home = net.located.select(F.col("person_id").alias("a"), F.col("place_id").alias("city"))
    pairs = net.knows.where("src < dst").toDF("a", "b").join(home, "a").join(of("a"), "a").join(of("b"), "b")
    scored = pairs.select("city", "a", "b", scalars.common_tags("tags_a", "tags_b").alias("common"))
    return topk.top_k(scored, ["city"], [F.desc("common"), F.asc("a"), F.asc("b")], 4).select("city", "rank", "a", "b", "common")


@query("t3_top_people", """=> SELECT tag_id, "rank", id, centrality FROM (SELECT tag_id, id, r * r * 1.0::DOUBLE / s AS centrality,
    ROW_NUMBER() OVER (PARTITION BY tag_id ORDER BY r * r * 1.0::DOUBLE / s DESC, id) AS "rank" FROM fan_levels WHERE r > 0) WHERE "rank" <= 5""")
def _(spark, sf_dir, net):
    """The most central people of each tag, the best of each component first."""
    edges, members = _fan_graph(net)
    comp = checkpoint(components.connected_components(edges, members, KEY))
    found = centrality.centrality(centrality.geodesics(edges, members, KEY, comp), members, KEY).join(comp, [*KEY, "id"])
    return topk.top_k_by_part(found, KEY, "comp", [F.desc("centrality"), F.asc("id")], 5).select(*KEY, "rank", "id", "centrality")


@query("t4_people_by_interests", "=> SELECT person_id, CAST(len(tags) AS BIGINT) AS n_tags FROM tags_of WHERE len(tags) >= 5")
def _(spark, sf_dir, net):
    return topk.people_by_interests(prepare.person_tags(net.interest, net.person), 5)


@query("t4_pairs_worth_scoring", """=> SELECT src AS a, dst AS b, len(x.tags) AS n_tags_a, len(y.tags) AS n_tags_b, CAST(8 AS BIGINT) AS kth FROM knows
    JOIN tags_of x ON x.person_id = src JOIN tags_of y ON y.person_id = dst WHERE src < dst AND LEAST(len(x.tags), len(y.tags)) >= 8""")
def _(spark, sf_dir, net):
    tags = prepare.person_tags(net.interest, net.person).drop("tags")
    of = lambda end: tags.toDF(end, f"n_tags_{end}")
    pairs = net.knows.where("src < dst").toDF("a", "b").join(of("a"), "a").join(of("b"), "b")
    return topk.pairs_worth_scoring(pairs.withColumn("kth", F.lit(8).cast("long")), "kth").select("a", "b", "n_tags_a", "n_tags_b", "kth")


@query("t4_pairs_over_kth", """=> SELECT p.qid, p.a, p.b, len(x.tags) AS n_tags_a, len(y.tags) AS n_tags_b, COALESCE(t.common, 0) AS kth FROM alike p
    JOIN tags_of x ON x.person_id = p.a JOIN tags_of y ON y.person_id = p.b JOIN ([NEARBY]) q ON q.qid = p.qid
    LEFT JOIN best_pairs t ON t.qid = q.qid AND t."rank" = q.k WHERE LEAST(len(x.tags), len(y.tags)) >= COALESCE(t.common, 0)""")
def _(spark, sf_dir, net):
    """The k-th best common count of each place query is the floor of its pairs."""
    wanted = params(spark, sf_dir, NEARBY)
    tags = prepare.person_tags(net.interest, net.person)
    members = plans.place_members(net, wanted).join(wanted, "place").select("qid", "h", F.col("person_id").alias("id"))
    pairs = checkpoint(paths.similar_pairs(net.knows, members, tags))
    ranked = topk.top_k(pairs.join(wanted.select("qid", "k"), "qid"), ["qid"], [F.desc("common"), F.asc("a"), F.asc("b")], "k")
    kth = ranked.where("rank = k").select("qid", F.col("common").alias("kth"))
    of = lambda end: tags.drop("tags").toDF(end, f"n_tags_{end}")
    counted = pairs.select("qid", "a", "b").join(of("a"), "a").join(of("b"), "b").join(kth, "qid", "left")
    known = counted.withColumn("kth", F.coalesce("kth", F.lit(0).cast("long")))
    return topk.pairs_worth_scoring(known, "kth").select("qid", "a", "b", "n_tags_a", "n_tags_b", "kth")


@query("t5_first_rows", "=> SELECT src AS id, COUNT(*) AS degree FROM knows GROUP BY 1 ORDER BY degree DESC, id LIMIT 10")
def _(spark, sf_dir, net):
    return topk.first_rows(prepare.adjacency(net.knows).select("id", "degree"), [F.desc("degree"), F.asc("id")], 10)


@query("q1_shortest_paths", "=> SELECT qid, CAST(hops AS BIGINT) AS hops FROM hops")
def _(spark, sf_dir, net):
    return plans.shortest_paths(net, params(spark, sf_dir, PAIRS))


@query("q2_top_tags", "=> SELECT * FROM best_tags")
def _(spark, sf_dir, net):
    return plans.top_tags(net, params(spark, sf_dir, YOUNG))


@query("q3_similar_pairs_in_place", "=> SELECT * FROM best_pairs")
def _(spark, sf_dir, net):
    return plans.similar_pairs_in_place(net, params(spark, sf_dir, NEARBY))


@query("q4_central_people", "=> SELECT * FROM best_people")
def _(spark, sf_dir, net):
    return plans.central_people(net, params(spark, sf_dir, TOPICS))


@query("q4_central_people_by_waves", "=> SELECT * FROM best_people")
def _(spark, sf_dir, net):
    """Every component of more than eight people is searched in waves, beginning with its tag's 64 best bounds."""
    return plans.central_people(net, params(spark, sf_dir, TOPICS), small=8, wave=64)


def _batch(spark: SparkSession, sf_dir: str) -> str:
    """A batch file with the parameters of all four kinds."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/batch-{uuid.uuid4().hex}"
    call = lambda sql, kind, *args: params(spark, sf_dir, sql).select(
        F.lit(kind).alias("kind"), "qid", F.format_string(f"query{kind}({', '.join(['%s'] * len(args))})", *[F.col(a).cast("string") for a in args]).alias("call")
    )
    calls = (
        call(PAIRS, 1, "p1", "p2", "x")
        .union(call(YOUNG, 2, "k", "d"))
        .union(call(NEARBY, 3, "k", "h", "place"))
        .union(call(TOPICS, 4, "k", "tag"))
    )
    calls.orderBy("kind", "qid").coalesce(1).select("call").write.text(path)  # a file of parameters
    return path


@query("a2_read_queries", """=> SELECT CAST(ROW_NUMBER() OVER (ORDER BY kind, qid) - 1 AS BIGINT) AS qid, kind, v0, v1, v2 FROM (
    SELECT CAST(1 AS BIGINT) AS kind, qid, CAST(p1 AS VARCHAR) AS v0, CAST(p2 AS VARCHAR) AS v1, CAST(x AS VARCHAR) AS v2 FROM ([PAIRS])
    UNION ALL SELECT 2, qid, CAST(k AS VARCHAR), CAST(CAST(d AS DATE) AS VARCHAR), NULL FROM ([YOUNG])
    UNION ALL SELECT 3, qid, CAST(k AS VARCHAR), CAST(h AS VARCHAR), place FROM ([NEARBY])
    UNION ALL SELECT 4, qid, CAST(k AS VARCHAR), tag, NULL FROM ([TOPICS]))""")
def _(spark, sf_dir, net):
    """The parameters of a batch file after it has been read."""
    tables = io.read_queries(spark, _batch(spark, sf_dir))[:4]
    text = lambda t: [F.col(c).cast("string") for c in t.columns[1:]] + [F.lit(None).cast("string")]
    return reduce(
        DataFrame.union,
        [
            t.select("qid", F.lit(kind).cast("long").alias("kind"), *[v.alias(f"v{i}") for i, v in enumerate(text(t)[:3])])
            for kind, t in enumerate(tables, 1)
        ],
    )


@query("a3_format_answers", """=> SELECT p.id AS qid, COALESCE(string_agg(dst, ' ' ORDER BY out_cnt DESC, dst), '') AS answer FROM person p
    LEFT JOIN weights w ON w.src = p.id GROUP BY 1""")
def _(spark, sf_dir, net):
    """The friends of everybody by replies, as answers."""
    ranked = prepare.friends_by_replies(_weights(net)).withColumnRenamed("src", "qid")
    return io.format_answers(net.person.select(F.col("id").alias("qid")), (ranked, F.col("dst")))


_ANSWERS = """=> SELECT CAST(ROW_NUMBER() OVER (ORDER BY kind, qid) - 1 AS BIGINT) AS qid, answer FROM (
    SELECT 1 AS kind, qid, CAST(hops AS VARCHAR) AS answer FROM hops
    UNION ALL SELECT 2, qid, COALESCE(answer, '') FROM ([YOUNG]) LEFT JOIN (SELECT qid, string_agg(tag, ' ' ORDER BY "rank") AS answer FROM best_tags GROUP BY 1) USING (qid)
    UNION ALL SELECT 3, qid, COALESCE(answer, '') FROM ([NEARBY]) LEFT JOIN (SELECT qid, string_agg(a || '|' || b, ' ' ORDER BY "rank") AS answer FROM best_pairs GROUP BY 1) USING (qid)
    UNION ALL SELECT 4, qid, COALESCE(answer, '') FROM ([TOPICS]) LEFT JOIN (SELECT qid, string_agg(id, ' ' ORDER BY "rank") AS answer FROM best_people GROUP BY 1) USING (qid))"""


@query("q5_answer_batch", _ANSWERS)
def _(spark, sf_dir, net):
    """A batch file with the parameters of all four kinds, written, read and answered."""
    return plans.answer_batch(spark, net, _batch(spark, sf_dir))


@query("q5_answer_batch_from_store", _ANSWERS)
def _(spark, sf_dir, net):
    """All four reports read the same stored relations."""
    return plans.answer_batch(spark, store.read_store(spark, _stored(spark, net)), _batch(spark, sf_dir))
