"""The five reports on a small network, through files."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import scalars
from kinweave.plans import queries as plans
from kinweave.sources import io
from kinweave.sources.schema import FILES

from .graphs import rows

#: Two islands of equal shape, one isolated person; tags with equal names; nested places.
CONTENT = {
    "person": [(i, "x", "y", "z", f"19{80 + i}-01-01", "more") for i in range(8)],
    "knows": [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (4, 3)],
    "comment_creator": [(100, 0), (101, 1), (102, 0)],
    "reply_of": [(100, 101), (101, 102)],
    "place": [(1, "Land"), (2, "Big Town"), (3, "Big Town"), (4, "Far")],
    "place_part_of": [(2, 1), (3, 1)],
    "located": [(i, 3 if i < 3 else 4) for i in range(8)],
    "org_place": [(50, 2)],
    "study_at": [(0, 50, 1999), (6, 50, 2001)],
    "work_at": [(6, 50, 2001)],
    "tag": [(1, "beta"), (2, "alpha"), (3, "alpha"), (4, "old")],
    "interest": [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (0, 2), (0, 4)],
    "forum_tag": [(9, 2), (9, 1), (8, 2), (7, 3)],
    "forum_member": [(9, i, "2011") for i in range(5)] + [(8, 5, "2011"), (8, 4, "2012"), (7, 7, "2012")],
}


@pytest.fixture(scope="module")
def net(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("network")
    for name, (file, _) in FILES.items():
        lines = ["header|" * 3, *("|".join(map(str, row)) for row in CONTENT[name])]
        (folder / file).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return io.read_network(spark, str(folder))


def test_reading(spark, net, tmp_path):
    assert dict(rows(io.profile(net))) == {k: len(v) for k, v in CONTENT.items()} | {"knows": 12}
    assert [str(r.birthday) for r in net.person.orderBy("id").limit(1).collect()] == ["1980-01-01"]
    for name, table in net.tables().items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    again = io.read_network(spark, str(tmp_path), "parquet")
    assert rows(io.profile(again)) == rows(io.profile(net))
    with pytest.raises(ValueError):
        io.read_network(spark, str(tmp_path), "orc")
    assert rows(io.read_network(spark, str(tmp_path), "parquet", symmetrize=False).knows) == rows(net.knows)
    net.knows.where("src < dst").write.mode("overwrite").parquet(f"{tmp_path}/knows.parquet")
    with pytest.raises(ValueError):
        io.read_network(spark, str(tmp_path), "parquet", symmetrize=False)


def test_bad_fields_are_errors(spark, tmp_path):
    file, _ = FILES["knows"]
    (tmp_path / file).parent.mkdir(parents=True, exist_ok=True)
    (tmp_path / file).write_text("a|b\n1|2\n3|x4\n")
    with pytest.raises(Exception, match="x4"):
        io.read_table(spark, str(tmp_path), "knows").collect()


def test_scalars(net):
    assert [r[0] for r in net.person.orderBy("id").select(scalars.date_key("birthday")).limit(2).collect()] == [19800101, 19810101]
    assert rows(scalars.born_since(net.person, "1986-01-01").select("id")) == [(6,), (7,)]  # the day itself counts
    assert rows(scalars.by_name(net.tag, "alpha")) == [(2, "alpha"), (3, "alpha")]
    assert rows(scalars.by_name(net.tag, "Alpha")) == []


def test_top_tags(spark, net):
    params = spark.createDataFrame([(0, 5, "1980-01-01"), (1, 1, "1983-01-01"), (2, 9, "1999-01-01")], "qid long, k int, d string")
    found = plans.top_tags(net, params.withColumn("d", F.col("d").cast("date")))
    # equal ranges go by name; a tag in two components counts once; old people drop out
    assert rows(found) == [(0, 1, "alpha", 3), (0, 2, "beta", 3), (0, 3, "old", 1), (1, 1, "alpha", 3)]


def test_similar_pairs_in_place(spark, net):
    params = spark.createDataFrame([(0, 9, 1, "Land"), (1, 2, 3, "Far"), (2, 3, 1, "Nowhere")], "qid long, k int, h int, place string")
    found = rows(plans.similar_pairs_in_place(net, params))
    assert found == [(0, 1, 0, 1, 1), (0, 2, 0, 2, 1), (0, 3, 1, 2, 1), (1, 1, 3, 4, 1), (1, 2, 3, 5, 1)]


def test_central_people(spark, net):
    params = spark.createDataFrame([(0, 9, "alpha"), (1, 1, "beta"), (2, 2, "none"), (3, 2, "old")], "qid long, k int, tag string")
    found = rows(plans.central_people(net, params))
    # forum 7 carries the second id of the name and does not count; isolated members are not reported
    assert [(q, n, i) for q, n, i, *_ in found if q == 0] == [(0, n + 1, i) for n, i in enumerate(range(6))]
    assert all(r == 2 and s == 2 and c == 2.0 for q, _, _, r, s, c in found if q == 0)
    assert [(q, i) for q, _, i, *_ in found if q] == [(1, 0)]
    assert rows(plans.central_people(net, params, prune=False)) == found


def test_pruned_search_of_large_components(spark, net):
    params = spark.createDataFrame([(0, 2, "alpha"), (1, 3, "beta")], "qid long, k int, tag string")
    plain = rows(plans.central_people(net, params))
    for wave in (1, 8):
        assert rows(plans.central_people(net, params, small=1, wave=wave)) == plain


def test_batch(spark, net, tmp_path):
    lines = [
        "query1(0, 2, -1)",
        "query2(2, 1980-01-01)",
        "what is this",
        "query3(2, 1, Big Town)",
        "query4(2, beta)",
        "query1(0, 1, 0)",
        "query1(0, 5, -1)",
        "query4(2, no such tag)",
        "query3(2, 1, Nowhere)",
        "query1(-1, 5, -1)",
        "query1(0, 2, 0)",
    ]
    batch = tmp_path / "batch.txt"
    batch.write_text("\n".join(lines) + "\n")
    answers = plans.answer_batch(spark, net, str(batch))
    expected = ["1", "alpha beta", "", "0|1 0|2", "0 1", "1", "-1", "", "", "-1", "-1"]
    assert rows(answers) == list(enumerate(expected))
    io.write_answers(answers, str(tmp_path / "answers"))
    written = next((tmp_path / "answers").glob("part-*")).read_text().split("\n")
    assert written == [*expected, ""]
    (tmp_path / "empty.txt").write_text("\n")
    assert rows(plans.answer_batch(spark, net, str(tmp_path / "empty.txt"))) == []
