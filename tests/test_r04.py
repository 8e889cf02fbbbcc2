"""Findings of round 4: registered queries against their SQL on small odd tables, and plans that grow with the input."""

import re

from test_r03 import DAY, LINES, PART, customers, lines, orders, plan, same_as_sql, suppliers

import __spark_entry__ as entry
from tallyspark.operators import minutes, ranking


def test_f3_lines_are_dealt_before_they_become_texts(spark, tmp_path):
    rows, schema = lines(60, 8)
    rows += [(*r[:3], 1, *r[4:]) for r in rows[::3]]  # lines of one number, in the order of their texts
    nation = [(k, f"N{k}", k % 2) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"
    part = [(k, f"p{k}", "b", "t", k % 50, 1.0) for k in range(60)] + [(7, "again", "b", "t", 49, 1.0)], PART
    assert same_as_sql(spark, tmp_path, "journal_actions", lineitem=(rows, schema), orders=orders(8, 3), supplier=suppliers(70), part=part, nation=nation)
    assert same_as_sql(spark, tmp_path, "journal_places", lineitem=(rows, schema), orders=orders(8, 3))
    shown = entry.queries()["journal_places"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in shown and "partial_collect_list" not in shown.split("Exchange hashpartitioning(l_orderkey")[-1]


def test_f3_bills_and_propositions_meet_actions_at_once(spark):
    journal = "REPORTS OF STANDING COMMITTEES\nCommittee on Water\nDate of Hearing: May 1\nAssembly Bill No. 12\nSenate Bill No. 7\nROLLCALL\nThe following were placed upon the morning rollcall:\nLi\nMr. Speaker"
    docs = spark.createDataFrame([(1, "j1", "Assembly", "2024-05-02", journal)], "id int, external_id string, body string, date string, text string").selectExpr("id", "external_id", "body", "cast(date AS date) AS date", "text")
    reps = spark.createDataFrame([("r", "Li", "Assembly")], "rep_id string, last_name string, chamber string")
    bills = spark.createDataFrame([("a", "AB 12", "2023-2024"), ("b", "AB 12", "2023-2024"), ("old", "AB 12", "2021-2022"), ("none", "SB 7", None), ("no", None, "2023-2024")], "bill_id string, number string, session string")
    committees = spark.createDataFrame([("w", "assembly:water")], "committee_id string, external_id string")
    props = spark.createDataFrame([("p", "SB 7"), ("null", None)], "proposition_id string, external_id string")
    out = minutes.linked(docs, reps, bills, committees, props)
    assert {(r.subject, r.bill_id, r.proposition_id, r.committee_id, r.representative_id) for r in out.collect()} == {("Water", None, None, "w", None), ("AB 12", "b", None, "w", None), ("SB 7", None, "p", "w", None), ("Li", None, None, None, "r"), ("Mr. Speaker", None, None, None, None)}
    joins = [x for x in plan(out).splitlines() if "Join LeftOuter, (bill#" in x]
    assert len(joins) == 1 and not re.search(r"Join \w+, .*session#\d+ = session", plan(out))


def test_f3_a_text_that_holds_the_mark_is_cut_alike(spark):
    text = "ROLLCALL\n￿The rollcall was completed by these names:\nAnn  Bob\n￿\nMr. Speaker\nROLLCALL\nThe following were placed upon the morning rollcall:\n Cy\r\n\tDi  Ed, J. \n\nMr.  Speaker \nEve"
    docs = spark.createDataFrame([(1, text), (2, text.replace("￿", ""))], "id int, t string")
    got = {(r.id, r.name, r.start, text.replace("￿" * (r.id - 1), "")[r.start : r.start + 2]) for r in minutes.presence(minutes.sections(docs, "id", "t"), "id").collect()}
    names = {k: {n for i, n, _, _ in got if i == k} for k in (1, 2)}
    assert names == {1: {"Cy\r", "Ed, J.", "Mr. Speaker"}, 2: {"Ann", "Bob", "Cy\r", "Ed, J.", "Mr. Speaker"}}
    assert all(n[:2] == at for _, n, _, at in got)


def test_f1_pairs_are_made_of_all_that_is_known_of_either(spark, tmp_path):
    nation = [(0, "UNITED STATES", 0), (1, "CHINA", 1), (2, "PERU", 0)], "n_nationkey int, n_name string, n_regionkey int"
    region = [(0, "AMERICA"), (1, "ASIA")], "r_regionkey int, r_name string"
    rows = [(k % 7, k % 5, k % 9, k % 5, 20.0, 1.0, 0.0, 0.0, "A", "F", DAY) for k in range(120)]
    got = same_as_sql(spark, tmp_path, "representative_ranking", customer=customers(9, 3), supplier=suppliers(10, 3), nation=nation, region=region, orders=orders(7, 6), lineitem=(rows, LINES))
    assert len({r[2] for r in got}) > 4 and any(r[3] for r in got) and any(not r[3] for r in got)
    out = entry.queries()["representative_ranking"](spark, str(tmp_path))
    assert sum("Join Inner, (rep_id" in x for x in plan(out).splitlines()) == 1  # parts and representatives; before, pairs and representatives too
    assert "round(" not in plan(out).splitlines()[0] and "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_f1_seats_that_fit_no_tag_count_as_seats(spark):
    users = spark.createDataFrame([(1, ["water", "Rules"], 0), (2, [], 0), (3, ["fire"], 0), (4, ["water"], 1)], "user_id int, tags array<string>, k int")
    reps = spark.createDataFrame([(10, "A", 0), (11, "A", 0), (12, None, 0), (13, "A", 1)], "rep_id int, chamber string, k int")
    seats = spark.createDataFrame([(10, "Water Board"), (10, "Fire"), (10, "Rules and Water"), (11, "Roads"), (13, "water"), (13, "Roads")], "rep_id int, committee string")
    parts = spark.createDataFrame([(10, 5, "author"), (10, 6, "no")], "rep_id int, bill int, role string")
    interest = spark.createDataFrame([(1, 5, "A"), (1, 6, "B"), (3, 6, None)], "user_id int, bill int, chamber string")
    asked = users.join(reps, "k").select("user_id", "rep_id")
    shown = lambda *on: sorted((r.user_id, r.rep_id, round(r.chamber_score, 6), round(r.committee_score, 6), round(r.action_score, 6), r.recent, r["rank"]) for r in ranking.rank_representatives(asked if not on else None, users, reps, seats, parts, interest, *on).collect())
    got = shown("k")
    assert got == shown() and len(got) == 10
    assert {r[:4] for r in got if r[3]} == {(1, 10, 0.5, round(2 / 3, 6)), (3, 10, 0.0, round(1 / 3, 6)), (4, 13, 0.0, 0.5)}
    assert next(r for r in got if r[:2] == (1, 10))[5] == [5, 6]
