"""A social network derived from the given star-schema tables.

The relations are written as SQL that Spark and other engines read alike, so that a
test can derive the same network elsewhere.  ``{orders}`` and the like stand for the
given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .schema import FILES, Network

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: The reply chain runs over all orders by key.  The plain form ranks them in one window.
_CHAIN_PLAIN = """SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
    LAG(o_orderkey) OVER (ORDER BY o_orderkey) AS prev FROM {orders}"""

#: The same by ranges of keys: only one row for each range is ordered in one place.
_CHAIN_RANGES = """SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
    COALESCE(LAG(o_orderkey) OVER (PARTITION BY ranged.r ORDER BY o_orderkey), edge.top) AS prev
    FROM ranged JOIN edge ON ranged.r = edge.r"""

#: Each relation may name earlier ones.
_RELATIONS = {
    "ranged": "SELECT o_orderkey, o_custkey, o_orderkey DIV 1000000 AS r FROM {orders}",
    "edge": """SELECT r, LAG(top) OVER (ORDER BY r) AS top
    FROM (SELECT r, MAX(o_orderkey) AS top FROM ranged GROUP BY r)""",
    "person": """SELECT c_custkey AS id, DATE '1960-01-01' + CAST((c_custkey * 7919) % 14600 AS INT) AS birthday FROM {customer}""",
    "buy": """SELECT DISTINCT l_partkey, o_orderkey, o_custkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R' AND l_quantity >= 40""",
    "chain": """SELECT o_custkey AS a, LEAD(o_custkey) OVER (PARTITION BY l_partkey ORDER BY o_orderkey) AS b FROM buy""",
    "knows": """SELECT a AS src, b AS dst FROM chain WHERE b IS NOT NULL AND a <> b
    UNION SELECT b, a FROM chain WHERE b IS NOT NULL AND a <> b""",
    "comment_creator": """SELECT o_orderkey AS comment_id, o_custkey AS person_id FROM {orders}""",
    "ord": _CHAIN_RANGES,
    "reply_of": """SELECT x.o_orderkey AS comment_id, y.o_orderkey AS parent_id FROM knows k
    JOIN ord x ON x.o_custkey = k.src JOIN ord y ON y.o_custkey = k.dst AND x.rn = y.rn
    WHERE x.rn <= (k.src * 7 + k.dst * 3) % 4
    UNION ALL SELECT o_orderkey, prev FROM ord WHERE prev IS NOT NULL""",
    "tag": """SELECT p_partkey AS id, p_name AS name FROM {part}""",
    "canon_tag": """SELECT MIN(id) AS id, name FROM tag GROUP BY name""",
    "interest": """SELECT DISTINCT o_custkey AS person_id, t.id AS tag_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    JOIN {part} ON p_partkey = l_partkey JOIN canon_tag t ON t.name = p_name WHERE l_quantity >= 35""",
    "forum_tag": """SELECT DISTINCT l_suppkey AS forum_id, t.id AS tag_id FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
    JOIN canon_tag t ON t.name = p_name WHERE l_quantity = 50 AND l_returnflag = 'A'""",
    "forum_member": """SELECT DISTINCT l_suppkey AS forum_id, o_custkey AS person_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    WHERE l_quantity >= 45 AND l_returnflag = 'R'""",
    "place": """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM {region}
    UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), n_name FROM {nation}
    UNION SELECT CAST(1000 + c_nationkey * 10 + LENGTH(c_mktsegment) AS BIGINT), CONCAT(n_name, ' ', CAST(LENGTH(c_mktsegment) AS VARCHAR(9)))
    FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
    "place_part_of": """SELECT CAST(100 + n_nationkey AS BIGINT) AS child, CAST(n_regionkey AS BIGINT) AS parent FROM {nation}
    UNION SELECT CAST(1000 + c_nationkey * 10 + LENGTH(c_mktsegment) AS BIGINT), CAST(100 + c_nationkey AS BIGINT) FROM {customer}""",
    "located": """SELECT c_custkey AS person_id, CAST(1000 + c_nationkey * 10 + LENGTH(c_mktsegment) AS BIGINT) AS place_id FROM {customer}""",
    "org_place": """SELECT s_suppkey AS org_id, CAST(100 + s_nationkey AS BIGINT) AS place_id FROM {supplier}""",
    "work_at": """SELECT DISTINCT o_custkey AS person_id, l_suppkey AS org_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'N' AND l_quantity = 50""",
    "study_at": """SELECT DISTINCT o_custkey AS person_id, l_suppkey AS org_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'N' AND l_quantity = 49""",
}


def _expressions(relations: dict[str, str]) -> str:
    return ",\n".join(f"{name} AS ({body})" for name, body in relations.items())


def _needed(relation: str) -> dict[str, str]:
    """``relation`` and the earlier ones that it is made from."""
    wanted, text = {relation}, _RELATIONS[relation]
    for name in reversed(_RELATIONS):
        if re.search(rf"\b{name}\b", text):
            wanted.add(name)
            text += _RELATIONS[name]
    return {name: body for name, body in _RELATIONS.items() if name in wanted}


#: The relations over tables of the same names, as common table expressions.
PLAIN_SQL = _expressions(
    {name: body for name, body in (_RELATIONS | {"ord": _CHAIN_PLAIN}).items() if name not in ("ranged", "edge")}
).format(**{name: name for name in GIVEN})


def derive(given: dict[str, DataFrame], relation: str) -> DataFrame:
    """One relation of the derived network from the given tables."""
    used = _needed(relation)
    tables = {n: df for n, df in given.items() if any(f"{{{n}}}" in body for body in used.values())}
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(f"WITH {_expressions(used)}\nSELECT * FROM {relation}", **tables)


def derived_network(spark: SparkSession, sf_dir: str) -> Network:
    """The derived network; each relation is planned on its own, when it is first used."""
    given = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in GIVEN}
    return Network(**{name: (lambda name=name: derive(given, name)) for name in FILES})
