"""The driver's contract, and some registered queries against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
FAST = ["a4_profile", "c3_edge_weights", "c5_friends_by_replies", "c9_place_closure", "c13_tag_audience", "c17_induced_edges"]
LOOPS = ["g1_components", "g5_hop_distance", "g10_closeness", "q2_top_tags", "q3_similar_pairs_in_place", "q4_central_people"]

WHOLE = ["c5_all_friends_by_replies", "c14_forums_for_all_tags", "c15_members_for_all_tags", "g7_within_hops_many", "g8_h_hop_many"]
WHOLE += ["g8_h_hop_counts_many", "t4_pairs_over_kth"]
OWN = ["a1_read_values", "a2_read_queries", "a3_format_answers", "b7_audience_born_since", "c13_audience_table", "g1_component_numbers"]
OWN += ["g3_tag_components", "g4_tag_largest_component", "g6_vertex_cover", "g6_vertex_cover_share", "g6_vertex_cover_checks", "g13_suffix_max", "g14_approx_within_error", "g14_approx_neighbourhood", "g14_approx_within_reach", "t1_top_tags"]
OWN += ["t2_top_pairs", "t3_top_people", "g4_tag_largest_component_halved", "g9_geodesics_by_bits", "q4_central_people_by_waves"]
OWN += ["a1_store_profile", "a1_quarantine", "c2_reply_counts_from_store", "q5_answer_batch_from_store", "c13_audience_chunks", "b7_audience_chunks_born_since"]


def text(df):
    return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", FAST + LOOPS + WHOLE + OWN)
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    found = driver.queries()[name](spark, DATA).toPandas()
    assert text(found) == text(con.execute(driver.oracle_sql()[name]).fetchdf())


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
