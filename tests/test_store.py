"""Networks that are taken in once."""

import pytest

from kinweave.operators import prepare
from kinweave.plans import queries as plans
from kinweave.sources import io, store
from kinweave.sources.schema import FILES

from .graphs import rows
from .test_reports import CONTENT, net  # noqa: F401

BAD = {
    "person": ["x|a|b|c|1980-01-01", "50|a|b|c|1980-02-30", "51|a|b|c|"],
    "knows": ["0|many|", "|1|"],
    "reply_of": ["100|", "no|no"],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("files")
    for name, (file, _) in FILES.items():
        lines = ["header|" * 3, *("|".join(map(str, row)) for row in CONTENT[name]), *BAD.get(name, [])]
        (out / file).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(out)


def test_ingest_sets_bad_rows_aside(spark, net, folder, tmp_path):  # noqa: F811
    kept = str(tmp_path / "store")
    found = {r.name: (r["rows"], r.bad_rows) for r in store.ingest(spark, folder, kept, buckets=3).collect()}
    assert found == {n: (len(c), len(BAD.get(n, []))) for n, c in CONTENT.items()} | {"knows": (12, 2)}
    faults = {n: sorted(r.fault for r in store.quarantine(spark, kept, n).collect()) for n in ("person", "knows", "reply_of", "tag")}
    assert faults == {"person": ["birthday", "birthday", "id"], "knows": ["dst", "src"], "reply_of": ["comment_id,parent_id", "parent_id"], "tag": []}
    again = store.read_store(spark, kept)
    for name, table in net.tables().items():
        assert rows(again.tables()[name].select(table.columns)) == rows(table)


def test_replies_meet_without_a_shuffle(spark, net, tmp_path):  # noqa: F811
    kept = str(tmp_path / "store")
    store.write(net, kept, buckets=4)
    stored = store.read_store(spark, kept)
    counts = prepare.reply_counts(stored.reply_of, stored.comment_creator)
    assert rows(counts) == rows(prepare.reply_counts(net.reply_of, net.comment_creator))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = prepare.reply_counts(stored.reply_of, stored.comment_creator)
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    below = plan[plan.index("SortMergeJoin") :]
    assert "Exchange" not in below and plan.count("SortMergeJoin") == 1 and below.count("FileScan") == 2


def test_a_store_in_another_session(spark, net, tmp_path):  # noqa: F811
    kept = str(tmp_path / "store")
    store.write(net, kept, buckets=4)
    for name in store.BUCKETED:
        spark.sql(f"DROP TABLE {store._table_name(kept, name)}")
    stored = store.read_store(spark, kept)
    assert rows(stored.reply_of.select("comment_id", "parent_id")) == rows(net.reply_of)
    params = spark.createDataFrame([(0, 0, 2, -1), (1, 0, 5, -1)], "qid long, p1 long, p2 long, x int")
    assert rows(plans.shortest_paths(stored, params)) == rows(plans.shortest_paths(net, params))


def test_unfinished_stores_are_refused(spark, net, tmp_path):  # noqa: F811
    with pytest.raises(store.StoreError, match="no finished store"):
        store.read_store(spark, str(tmp_path))
    store.write(net, str(tmp_path / "a"), buckets=2)
    part = store.manifest(spark, str(tmp_path / "a")).where("name != 'tag'")
    part.write.parquet(str(tmp_path / "b" / "manifest"))
    with pytest.raises(store.StoreError, match="other tables"):
        store.read_store(spark, str(tmp_path / "b"))
    assert rows(io.profile(store.read_store(spark, str(tmp_path / "a")))) == rows(io.profile(net))
