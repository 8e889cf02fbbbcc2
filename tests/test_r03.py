"""Findings of round 3: registered queries against their SQL on small odd tables, and plans that grow with the input."""

import datetime as dt
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.operators import merge, ranking, vector

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DAY = dt.datetime(1995, 3, 1)


def same_as_sql(spark, folder, name, **tables):
    """The query's rows on the tables (rows and schema), which must be those of its SQL."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    out = entry.queries()[name](spark, str(folder))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in out.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(want, key=repr)
    return got


def plan(out):
    return out._jdf.queryExecution().optimizedPlan().toString()


def test_f7_halves_round_as_in_sql(spark, tmp_path):
    events = [(k, DAY, k % 3, f"e{k}", v, None) for k, v in enumerate((0.5, 1.5, 2.5, 3.5, 6.5, 4.5, 8.5, 7.5, 9.25), 1)]
    assert len(same_as_sql(spark, tmp_path, "monotonic_replay", events=(events, EVENTS))) == 3


def test_f5_bills_are_ranked_once_for_equal_profiles(spark):
    bills = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c"], i % 4, dt.date(2024, 1, 1), i % 2) for i in range(40)], "id int, topics array<string>, n_flags int, last_action_date date, k int")
    users = spark.createDataFrame([(u, u % 2, ["a"] if u % 3 else None) for u in range(6)], "user_id int, k int, tags array<string>")
    out = ranking.rank_bills(bills, users, F.lit("2024-01-02").cast("date"), 3, "k")
    alone = [tuple(r) for u in users.collect() for r in ranking.rank_bills(bills, users.where(F.col("user_id") == u.user_id), F.lit("2024-01-02").cast("date"), 3, "k").select("user_id", "id", "rank").collect()]
    assert sorted(tuple(r) for r in out.select("user_id", "id", "rank").collect()) == sorted(alone) and len(alone) == 18
    window = next(line for line in plan(out).splitlines() if "row_number()" in line)
    assert "tags#" in window and "user_id#" not in window


def test_f6_measures_are_ranked_once_for_equal_profiles(spark):
    measures = spark.createDataFrame([(i, f"the tenants of town {i}" if i % 2 else "wages of parents", dt.date(2024, 2, 1), "active", None, i % 2) for i in range(20)], "id int, text string, election_date date, status string, deleted_at string, k int")
    users = spark.createDataFrame([(u, u % 2, ["is_renter"] if u % 3 else ["is_parent"], ["town"] if u % 5 else []) for u in range(6)], "user_id int, k int, flags array<string>, tags array<string>")
    day = F.lit("2024-01-01").cast("date")
    out = ranking.rank_propositions(measures, users, day, 3, "k")
    alone = [tuple(r) for u in users.collect() for r in ranking.rank_propositions(measures, users.where(F.col("user_id") == u.user_id), day, 3, "k").select("user_id", "id", "rank").collect()]
    assert sorted(tuple(r) for r in out.select("user_id", "id", "rank").collect()) == sorted(alone) and alone
    window = next(line for line in plan(out).splitlines() if "row_number()" in line)
    assert "flags#" in window and "user_id#" not in window


def customers(n, nations=2):
    return [(k, f"c{k}", k % nations, float(k * 997 % 9000 - 500), ("MACHINERY", "BUILDING", "AUTOMOBILE")[k % 3]) for k in range(n)], CUSTOMER


def suppliers(n, nations=2):
    return [(k, f"s{k % 7}", k % nations, float(k % 5 - 1)) for k in range(n)], SUPPLIER


def test_f1_namesakes_are_gathered_before_committees_meet_them(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "candidate_committees", customer=customers(160), supplier=suppliers(300))
    assert {r[2] for r in got} >= {"ambiguous", "withdrawn"}
    joins = [x for x in plan(entry.queries()["candidate_committees"](spark, str(tmp_path))).splitlines() if "Join Inner" in x]
    assert joins and all("rep_id" not in x for x in joins)
    assert plan(entry.queries()["candidate_committees"](spark, str(tmp_path))).count("Aggregate [key") >= 1


def orders(n, customers_):
    return [(k, k % customers_, "FOP"[k % 3], k * 1.25, DAY, ("1-URGENT", "3-MEDIUM", "5-LOW")[k % 3]) for k in range(n)], ORDERS


def lines(n, orders_, part=7):
    return [(k % orders_, part + k, k * 5 % 40, k // orders_ + 1, float(k % 30), 10.0 + k, (k % 10) / 20, 0.0, "RAN"[k % 3], "FO"[k % 2], DAY) for k in range(n)], LINES


def test_f13_rows_without_a_filing_are_not_dealt_to_one_task(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "independent_attribution", lineitem=lines(90, 30), orders=orders(30, 9), customer=customers(9))
    assert "Union" in plan(entry.queries()["independent_attribution"](spark, str(tmp_path)))


def test_f17_rows_without_a_filing_are_not_dealt_to_one_task(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "cover_attribution", lineitem=lines(90, 30), orders=orders(30, 9), customer=customers(9))
    assert "Union" in plan(entry.queries()["cover_attribution"](spark, str(tmp_path)))


def test_f8_numbers_of_seven_digits_are_read_whole(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "journal_places", lineitem=lines(40, 5, 1_234_567), orders=orders(5, 3))
    assert any(r[3] == "SB 1234568" for r in got)


def test_f14_a_roll_call_is_taken_apart_once(spark, tmp_path):
    assert len(same_as_sql(spark, tmp_path, "journal_presence", customer=customers(12))) == 60
    assert plan(entry.queries()["journal_presence"](spark, str(tmp_path))).count("morning rollcall|rollcall was") == 1


def test_f2_journals_are_read_once_for_both_goes(spark, tmp_path):
    nation = [(k, f"N{k}", k % 2, ) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"
    part = [(k, f"p{k}", "b", "t", k % 50, 1.0) for k in range(60)], PART
    assert same_as_sql(spark, tmp_path, "journal_actions", lineitem=lines(40, 8), orders=orders(8, 3), supplier=suppliers(70), part=part, nation=nation)
    assert "rollcall" not in plan(entry.queries()["journal_actions"](spark, str(tmp_path)))


def not_dealt_again(spark, folder, name):
    """Whether pairs of user and entity stay where they were made: no exchange by both."""
    shown = entry.queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    return "REPARTITION_BY_NUM" in shown and not re.search(r"hashpartitioning\(user_id#\w+, (entity|rep)_id#", shown)


def test_f4_pairs_with_cached_scores_are_dealt_once(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "cached_scores", customer=customers(12), supplier=suppliers(10))
    assert not_dealt_again(spark, tmp_path, "cached_scores")


def test_f11_pairs_of_the_cache_are_dealt_once(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "rerank_cache", customer=customers(12), supplier=suppliers(10))
    assert not_dealt_again(spark, tmp_path, "rerank_cache")


def test_f12_candidates_are_dealt_once(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "rerank_candidates", customer=customers(12), supplier=suppliers(10))
    assert not_dealt_again(spark, tmp_path, "rerank_candidates")


def test_f15_supervisors_are_sent_to_users(spark, tmp_path):
    nation = [(k, f"N{k}", k % 2 * 2) for k in range(2)], "n_nationkey int, n_name string, n_regionkey int"
    assert same_as_sql(spark, tmp_path, "county_supervisors", customer=customers(12), supplier=suppliers(10), nation=nation)
    assert not_dealt_again(spark, tmp_path, "county_supervisors")


def test_f3_bills_meet_before_representatives(spark, tmp_path):
    nation = [(0, "UNITED STATES", 0), (1, "CHINA", 1)], "n_nationkey int, n_name string, n_regionkey int"
    region = [(0, "AMERICA"), (1, "ASIA")], "r_regionkey int, r_name string"
    rows = [(k % 6, k % 3, k % 4, k % 5, 20.0, 1.0, 0.0, 0.0, "A", "F", DAY) for k in range(60)]
    assert any(r[3] for r in same_as_sql(spark, tmp_path, "representative_ranking", customer=customers(6), supplier=suppliers(4), nation=nation, region=region, orders=orders(6, 6), lineitem=(rows, LINES)))
    assert "LeftSemi" in plan(entry.queries()["representative_ranking"](spark, str(tmp_path)))


def test_f19_meetings_are_chosen_before_they_meet_committees(spark, tmp_path):
    nation = [(k, n, k) for k, n in enumerate(("FRANCE", "CHINA"))], "n_nationkey int, n_name string, n_regionkey int"
    assert any(r[3] for r in same_as_sql(spark, tmp_path, "committee_details", nation=nation, supplier=suppliers(9), customer=customers(40)))
    windows = [x for x in plan(entry.queries()["committee_details"](spark, str(tmp_path))).splitlines() if "row_number()" in x]
    assert windows and all("url" not in x.split("row_number()")[1] for x in windows)


def test_f3_interests_meet_parts_by_nation_and_bill(spark, tmp_path):
    nation = [(0, "UNITED STATES", 0), (1, "CHINA", 1)], "n_nationkey int, n_name string, n_regionkey int"
    region = [(0, "AMERICA"), (1, "ASIA")], "r_regionkey int, r_name string"
    rows = [(k % 6, k % 3, k % 4, k % 5, 20.0, 1.0, 0.0, 0.0, "A", "F", DAY) for k in range(60)]
    same_as_sql(spark, tmp_path, "representative_ranking", customer=customers(6), supplier=suppliers(4), nation=nation, region=region, orders=orders(6, 6), lineitem=(rows, LINES))
    joins = [x for x in plan(entry.queries()["representative_ranking"](spark, str(tmp_path))).splitlines() if "Join Inner" in x and "bill#" in x]
    assert joins and all("nation#" in x for x in joins)


def test_f3_pairs_have_no_fewer_partitions_than_a_shuffle(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        users = spark.createDataFrame([(1, 0), (2, 0)], "user_id int, k int")
        assert "300), REPARTITION_BY_NUM" in merge.pairs_of(users, users.select(F.col("user_id").alias("b"), "k"), "k", "user_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_f11_pairs_of_a_partition_do_not_grow_with_entities(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merge, "PAIRS", 4)
    assert same_as_sql(spark, tmp_path, "rerank_cache", customer=customers(80), supplier=suppliers(60))
    users, entities = spark.range(80).selectExpr("id AS user_id", "id % 5 AS k"), spark.range(60).selectExpr("id AS b", "id % 5 AS k")
    assert merge.pairs_of(users, entities, "k", "user_id")._jdf.queryExecution().executedPlan().toString().count("240), REPARTITION_BY_NUM") == 1


def test_f18_f20_pairs_held_at_once_are_bounded(monkeypatch):
    """Whatever the number of queries: the same result with few pairs at once, which were not bounded by themselves before."""
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(300, 4)), 1)
    asked = vectors[::6].copy()
    batches = lambda: iter([pa.RecordBatch.from_pydict({"vec_id": pa.array(range(low, low + 100)), "embedding": pa.array(vectors[low : low + 100].tolist())}) for low in (200, 0, 100)])
    found = lambda: [x.to_pydict() for x in vector._best(list(range(50)), asked, 7, None)(batches())]
    whole = found()
    monkeypatch.setattr(vector, "CELLS", 1000)
    assert found() == whole and len(whole[0]["vec_id"]) == 350
    near = np.round(asked @ vectors.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(vectors, axis=1), 6)
    want = [i for q in range(50) for i in sorted(range(300), key=lambda i: (-near[q, i], i))[:7]]
    assert whole[0]["vec_id"] == want
