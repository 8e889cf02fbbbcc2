"""Journals end to end, archives, the ledger, alerts, healing, positions and lists, against plain versions."""

import datetime as dt
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import alerts, healing, lifecycle, lists, merge, minutes, positions, ranking
from tallyspark.sources import archive, commits, records
from tallyspark.streaming import ingest

# --- journals

JOURNAL = """ROLLCALL
The following were placed upon the morning rollcall:
  Addis   de la Cruz    O’Hara
Rodriguez, M.
page 3 lower
Mr.  Speaker
Not counted

LEAVES OF ABSENCE FOR THE DAY
Personal business: Assembly Members Addis, Davies, and Celeste
Rodriguez. Illness: Member Li

Unrelated: Members Nobody
REPORTS OF STANDING COMMITTEES
Committee on Water
Date of Hearing: April 2, 2024
Mr. Speaker: Your Committee on Water reports:
Assembly Bill
No. 12
Senate  Bill No.7
With the recommendation: Do pass. Above bills ordered.
Committee on Rules
Assembly Bill 2
AUTHOR’S AMENDMENTS
Committee on Health
Senate Constitutional Amendment No. 1
THIRD READING OF ASSEMBLY BILLS
ASSEMBLY BILL NO. 12
Read; amendments proposed by the Committee on Ways and Means read and adopted; and
amendments proposed by the Committee on  Health  read and adopted
ENGROSSMENT AND ENROLLMENT REPORTS
  Mr.Speaker: examined
Assembly Bill No. 3
And reports the same correctly
enrolled.
Mr. Speaker: examined
Senate Joint Resolution No. 4
And reports the same correctly engrossed.
Mr. Speaker: nothing of
Assembly Bill No. 99
RESOLUTIONS
  ASSEMBLY JOINT RESOLUTION NO. 8–Li. Relative to roads.
ASSEMBLY RESOLUTION NO. 9 - no subject
"""


def test_places_of_a_journal(spark):
    docs = spark.createDataFrame([("j", JOURNAL), ("none", None), ("empty", ""), ("odd", "ROLLCALL\nThe following were placed upon the morning rollcall:\nAddis\nno end")], "id string, t string")
    got = minutes.worded(minutes.actions(minutes.sections(docs, "id", "t"), "id")).collect()
    assert {r.id for r in got} == {"j"}
    found = sorted((r.start, r.kind, r.position, r.subject, " ".join(JOURNAL[r.start : r.end].split())) for r in got)
    assert [f[1:] for f in found] == [
        ("presence", "yes", "Addis", "Addis"), ("presence", "yes", "O’Hara", "O’Hara"), ("presence", "yes", "Rodriguez, M.", "Rodriguez, M."), ("presence", "yes", "Mr. Speaker", "Mr. Speaker"[:11]),
        *(("presence", "absent", n, "Personal business: Assembly Members Addis, Davies, and Celeste Rodriguez") for n in ("Addis", "Celeste Rodriguez", "Davies")), ("presence", "absent", "Li", "Illness: Member Li"),
        ("committee_hearing", None, "Water", "Date of Hearing: April 2, 2024"), ("committee_report", None, "AB 12", "Assembly Bill No. 12"), ("committee_report", None, "SB 7", "Senate Bill No.7"), ("committee_report", None, "AB 2", "Assembly Bill 2"),
        ("amendment", None, "SCA 1", "Senate Constitutional Amendment No. 1"), ("amendment", None, "AB 12", "amendments proposed by the Committee on Ways and Means read and adopted"), ("amendment", None, "AB 12", "amendments proposed by the Committee on Health read and adopted"),
        ("enrollment", None, "AB 3", "Assembly Bill No. 3"), ("engrossment", None, "SJR 4", "Senate Joint Resolution No. 4"), ("resolution", None, "AJR 8", "ASSEMBLY JOINT RESOLUTION NO. 8–Li. Relative to roads."),
    ] or [f[1:] for f in found]
    texts = {r.text for r in got}
    assert {"AB 12: Do pass.", "AB 2: reported by Committee on Rules.", "Committee on Water — Date of Hearing: April 2, 2024", "SCA 1: author's amendments adopted in Committee on Health.", "AB 12: amendments by Committee on Health read and adopted.", "AB 3: Chief Clerk reports enrolled.", "Li: Relative to roads.", "Illness: Li"} <= texts


def test_links_and_numbers_over_increments(spark):
    day = dt.date(2024, 3, 4)
    line = lambda n: f"ENGROSSMENT AND ENROLLMENT REPORTS\nMr. Speaker:\nAssembly Bill No. {n}\ncorrectly engrossed"
    roll = "ROLLCALL\nThe following were placed upon the morning rollcall:\nAddis\nLi, A.\nCeleste Cruz\nNew Cruz\nMr. Speaker\n"
    table = [(1, "m1", "Assembly", day, roll + line(5)), (2, "m2", "Assembly", day, line(5) + "\nSenate Bill No. 6\n"), (3, "m3", "Senate", dt.date(2022, 1, 1), roll + line(5))]
    schema = "id int, external_id string, body string, date date, text string"
    reps = spark.createDataFrame([(1, "Addis", "Assembly"), (2, "LI ", "Assembly"), (3, "Li", "Assembly"), (4, "cruz", "Assembly"), (5, "Addis", "Senate"), (6, None, "Senate")], "rep_id int, last_name string, chamber string")
    bills = spark.createDataFrame([(10, "AB 5", "2023-2024"), (11, "AB 5", "2021-2022")], "bill_id int, number string, session string")
    committees = spark.createDataFrame([], "committee_id int, external_id string")
    props = spark.createDataFrame([(9, "SB 6")], "proposition_id int, external_id string")
    found = lambda rows: minutes.linked(spark.createDataFrame(rows, schema), reps, bills, committees, props)
    links = {(r.id, r.subject): (r.representative_id, r.bill_id, r.proposition_id) for r in found(table).collect()}
    assert [links[1, n][0] for n in ("Addis", "Li, A.", "Celeste Cruz", "Mr. Speaker")] == [1, None, 4, None] and links[3, "Addis"][0] == 5 and links[3, "Celeste Cruz"][0] is None
    assert links[1, "AB 5"][1] == 10 and links[3, "AB 5"][1] == 11 and links[2, "SB 6"] == (None, None, 9)
    rows = lambda df: sorted((r.action_id, r.subject) for r in df.collect())
    after = lambda asked, stored=None: minutes.stored_after(found(asked), spark.createDataFrame(asked, schema), stored)
    full = after(table)
    assert [r for r in rows(full) if r[0].startswith("m2")] == [("m2-0001", "SB 6")] and len([r for r in rows(full) if r[0].startswith("m1")]) == 6
    step = after(table[1:], after(table[:1]))
    assert rows(step) == rows(full) == rows(after(table[:2], full)) == rows(after(table, full))
    gone = [(1, "m1", "Assembly", day, "nothing any more")]
    assert [r[0] for r in rows(after(gone + table[1:2], full)) if r[0][:2] != "m3"] == ["m2-0001", "m2-0002"]


# --- archives


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, lines in members.items():
            z.writestr(name, lines)


def test_archives_by_member(spark, tmp_path):
    many = "".join(f"{k}\tx\r\n" for k in range(25_000))
    zipped(tmp_path / "a.zip", {"d/": "", "d/DATA.tsv": many, "other.txt": "one\ntwo", "empty": ""})
    zipped(tmp_path / "b.zip", {"x/DATA.tsv": "é\x00\n\nlast"})
    (tmp_path / "note.txt").write_text("no archive")
    rows = archive.read(spark, f"{tmp_path}/*.zip", "DATA.tsv")
    assert rows.columns == ["path", "member", "line", "value"] and rows.rdd.getNumPartitions() == 2
    got = rows.collect()
    assert len(got) == 25_003 and sorted((r.line, r.value) for r in got if r.path.endswith("b.zip")) == [(0, "é\x00"), (1, ""), (2, "last")]
    assert all(r.value == f"{r.line}\tx" for r in got if r.path.endswith("a.zip"))
    assert {(r.member, r.n) for r in archive.read(spark, f"{tmp_path}/a.zip").groupBy("member").agg(F.count(F.lit(1)).alias("n")).collect()} == {("d/DATA.tsv", 25_000), ("other.txt", 2)}
    rest = archive.read(spark, f"{tmp_path}/a.zip", "DATA.tsv", after={f"{tmp_path}/a.zip!d/DATA.tsv": 24_990})
    assert [(r.line, r.value) for r in rest.orderBy("line").collect()] == [(k, f"{k}\tx") for k in range(24_990, 25_000)]
    for path, wanted, limit in ((f"{tmp_path}/a.zip", "absent", None), (f"{tmp_path}/no.zip", None, None), (f"{tmp_path}/a.zip", "../x", None), (f"{tmp_path}/a.zip", "DATA.tsv", 1000)):
        with pytest.raises(Exception, match="absent is not in|no.zip|not a member|too large"):
            archive.read(spark, path, wanted, max_bytes=limit).count()


# --- the ledger


class Lost(RuntimeError):
    pass


@pytest.mark.parametrize("where", ["before data", "after data", "after positions", "after the ledger"])
def test_no_batch_is_lost_or_doubled(spark, tmp_path, monkeypatch, where):
    """A batch is cut off after each of its writes, and taken up again."""
    src, target, ledger = (str(tmp_path / x) for x in ("src", "target", "ledger"))
    schema = "k string, v int, x string, seq bigint, site string, item bigint"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: ingest.ingest(spark, spark.readStream.schema(schema).parquet(src), target, ledger, str(tmp_path / "ck"), (["site"], "item")).awaitTermination()
    add([("a", 1, "one", 1, "s", 5), ("b", 1, "one", 2, "t", 7)])
    run()
    add([("a", 2, "two", 1, "s", 9), ("c", 1, "one", 2, "s", 3)])
    with monkeypatch.context() as m:
        real = commits.CommitLog.append

        def cut(self, entry, seq):
            if where == "after the ledger":
                real(self, entry, seq)
            raise Lost

        if where == "before data":
            m.setattr(ingest, "_done", lambda held: (_ for _ in ()).throw(Lost()))
        elif where == "after data":
            m.setattr(ingest, "watermark", lambda *a: (_ for _ in ()).throw(Lost()))
        else:
            m.setattr(ingest.CommitLog, "append", cut)
        with pytest.raises(Exception, match="Lost"):
            run()
    now = lambda: sorted(map(tuple, ingest.current(spark, target, ledger, ["k"], "v", "seq").select("k", "v", "x").collect()))
    run()
    assert now() == [("a", 2, "two"), ("b", 1, "one"), ("c", 1, "one")]
    known = ingest.positions(spark, target, ledger, ["site"])
    assert {(r.site, r.last_external_id, r.items_ingested) for r in known.collect()} == {("s", 9, 3), ("t", 7, 1)}
    more = spark.createDataFrame([("s", 9), ("s", 10), ("t", 1), ("u", 1)], "site string, item bigint")
    assert {tuple(r) for r in ingest.beyond(more, known, ["site"], "item").collect()} == {("s", 10), ("u", 1)}
    left = ingest.vacuum(spark, target, ledger)
    assert len(left) == {"before data": 0, "after data": 1, "after positions": 2, "after the ledger": 0}[where] and now() == [("a", 2, "two"), ("b", 1, "one"), ("c", 1, "one")]


def test_folding_survives_a_cut(spark, tmp_path, monkeypatch):
    src, target, ledger = (str(tmp_path / x) for x in ("src", "target", "ledger"))
    schema = "k string, v int, x string, seq bigint"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: ingest.ingest(spark, spark.readStream.schema(schema).parquet(src), target, ledger, str(tmp_path / "ck")).awaitTermination()
    now = lambda: sorted(map(tuple, ingest.current(spark, target, ledger, ["k"], "v", "seq").select("k", "v", "x").collect()))
    ingest.compact(spark, target, ledger, ["k"], "v", "seq")  # nothing there yet
    for k in range(3):
        add([("a", k, f"a{k}", 1), (f"b{k}", 1, "b", 2)])
        run()
    before = now()
    with monkeypatch.context() as m:
        m.setattr(ingest.CommitLog, "append", lambda *a: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            ingest.compact(spark, target, ledger, ["k"], "v", "seq")
    assert now() == before
    ingest.compact(spark, target, ledger, ["k"], "v", "seq")
    assert now() == before and len(ingest.vacuum(spark, target, ledger)) == 1
    add([("a", 9, "last", 1)])
    run()
    ingest.compact(spark, target, ledger, ["k"], "v", "seq", keep=True)
    assert now() == [("a", 9, "last"), *before[1:]] and len(commits.CommitLog(spark, ledger).entries()) == 6


# --- alerts


def test_quantiles_and_merging(spark):
    rng = random.Random(5)
    groups = {g: [rng.lognormvariate(0, 2) for _ in range(rng.randint(1, 400))] for g in "abcdef"} | {"zero": [0.0, 0.0, 5.0], "big": [1e12]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("b", alerts.bucket(F.col("v")))
    hist = df.where("b IS NOT NULL").groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct(F.col("b").alias("bucket"), "n"))).alias("h"))
    for q in (0.0, 0.5, 0.95, 1.0):
        for r in hist.select("g", alerts.quantile(F.col("h"), q).alias("x")).collect():
            own = sorted(groups[r.g])
            want = own[max(1, math.ceil(round(q * len(own), 9))) - 1]
            assert abs(r.x - want) <= max(alerts.ERROR * want * 1.0001, 1.01 * alerts.LEAST)
    both = hist.alias("p").crossJoin(hist.select(F.col("g").alias("g2"), F.col("h").alias("h2"))).where("g < g2").select("g", "g2", alerts.quantile(alerts.merged(F.col("h"), F.col("h2")), 0.9).alias("x")).collect()
    for r in both:
        own = sorted(groups[r.g] + groups[r.g2])
        assert abs(r.x - own[math.ceil(round(0.9 * len(own), 9)) - 1]) <= alerts.ERROR * max(own[math.ceil(round(0.9 * len(own), 9)) - 1], alerts.LEAST) * 1.0001
    assert spark.range(1).select(alerts.quantile(F.array().cast("array<struct<bucket: int, n: bigint>>"), 0.5).alias("x")).first().x is None


def events(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=m), "scan", "s", m in range(20, 45), 1.0 + m % 7) for m in range(120)] + [(at + dt.timedelta(minutes=m), "other", "s", True, 9.0) for m in (3, 4)] + [(None, "scan", "s", True, 1.0), (at, "scan", None, True, 1.0)]
    return spark.createDataFrame(rows, "ts timestamp, kind string, service string, failed boolean, took double")


RULE = alerts.Rule("failing", "failures", 0.5, ("scan",), "10 minutes", "1 minute", "5 minutes")


def test_fired_alerts(spark):
    found = alerts.measured(events(spark), RULE, "ts", "service", "kind", F.col("failed"), "took")
    at = dt.datetime(2024, 1, 1)
    share = {e: sum(m in range(20, 45) for m in range(max(0, e - 10), min(120, e))) / len(range(max(0, e - 10), min(120, e))) for e in range(1, 130)}
    assert {(r.end, round(r.measure, 9)) for r in found.collect()} == {(at + dt.timedelta(minutes=e), round(s, 9)) for e, s in share.items()}
    (one,) = alerts.fired(found, "1 minute", "5 minutes").collect()
    above = [e for e, s in share.items() if s > 0.5]
    assert (one.since, one.fired_at, one.until, one.windows, one.worst) == (at + dt.timedelta(minutes=min(above)), at + dt.timedelta(minutes=min(above) + 5), at + dt.timedelta(minutes=max(above)), len(above), 1.0)
    assert alerts.fired(found, "1 minute", "3 hours").count() == 0


def test_alerts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = events(spark).where("ts IS NOT NULL")
    rule = alerts.Rule("slow", 0.9, 6.0, None, "10 minutes", "5 minutes", "5 minutes")
    for k, part in enumerate((rows.where("ts < '2024-01-01 01:00:00'"), rows.where("ts >= '2024-01-01 01:00:00'"), spark.createDataFrame([(dt.datetime(2024, 1, 2), "scan", "s", False, 1.0)], rows.schema))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = alerts.measured(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), rule, "ts", "service", "kind", F.col("failed"), "took", "10 minutes")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.start, r.n, round(r.measure, 9), r.above) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.n, round(r.measure, 9), r.above) for r in alerts.measured(rows, rule, "ts", "service", "kind", F.col("failed"), "took").collect()}
    assert got == want and len(want) > 20


# --- healing


def test_heal_decisions(spark):
    runs = [("s", str(k), k, *r) for k, r in enumerate([
        (True, 100, 0, 0, 0, "x"), (True, 40, 0, 0, 0, "x"), (True, 45, 0, 0, 0, "x"), (True, 30, 0, 0, 0, "x"), (True, 20, 0, 0, 0, "y"), (True, 70, 20, 0, 0, "y"), (True, 60, 31, 0, 0, "y"), (False, 60, 0, 0, 0, "y"), (True, 0, 0, 0, 0, "y"), (None, None, None, None, None, None), (True, 60, 0, 31, 200, "y"), (True, 50, 0, 0, 101, "y"),
    ])] + [("t", "1", 1, True, 5, 0, 0, 0, None)]
    df = spark.createDataFrame(runs, "source string, run string, at int, ok boolean, items bigint, worst_missing bigint, rejected bigint, warnings bigint, structure string")
    got = {(r.source, r.run): (r.decision, r.previous, r.structure_changed, r.errors, r.warnings) for r in healing.decisions(df, ["source"]).collect()}
    assert [got["s", str(k)] for k in range(12)] == [
        ("ok", None, None, [], []), ("heal", 100, False, ["fewer_items"], []), ("heal", 100, False, ["fewer_items"], []), ("give_up", 100, False, ["fewer_items"], []), ("heal", 100, True, ["fewer_items"], []), ("ok", 100, True, [], ["missing_fields", "fewer_items"]),
        ("heal", 70, False, ["missing_fields"], []), ("heal", 70, False, ["failed"], []), ("give_up", 70, False, ["no_items"], []), ("heal", 70, True, ["failed", "no_items"], []), ("heal", 70, False, ["rejected_items"], ["many_warnings"]), ("ok", 70, False, [], ["fewer_items", "many_warnings"]),
    ]
    assert got["t", "1"] == ("ok", None, None, [], [])
    items = spark.createDataFrame([("s", "a", None, True, 2), ("s", " ", "b", False, None), ("s", None, "c", None, 1)], "source string, x string, y string, bad boolean, w int")
    assert tuple(healing.run_of(items, ["source"], ["x", "y"], F.col("bad"), F.col("w")).first()) == ("s", 3, 2, 1, 3)


# --- positions


def test_relinking_equals_a_full_run(spark):
    rng = random.Random(3)
    title = lambda: " ".join(rng.choice(["Water", "roads", "schools!", "Tax"]) for _ in range(2))
    P, R = "proposition_id int, external_id string, title string, seq int", "kind string, row_id string, committee_id int, said array<string>, side string"
    props = {k: (k, f"Prop {k}", title(), k) for k in range(12)}
    row = lambda k: ("filing" if k % 4 == 0 else "payment", str(k), rng.choice([None, 1, 2, 3]), [rng.choice([None, "", f"PROP {rng.randrange(14)}"]), title()], rng.choice(["S", "oppose", None, "?"]))
    rows = {k: row(k) for k in range(150)}
    named = lambda: positions.titles(spark.createDataFrame(list(props.values()), P))
    frame = lambda some: spark.createDataFrame(list(some), R)
    plain = lambda df: sorted(map(str, df.collect()))
    before = named()
    stored = positions.evidence(frame(rows.values()), before)
    first = positions.positions(stored)
    assert sum(r.is_primary for r in first.collect()) > 0
    for k in (1, 5, 7):
        props[k] = (k, f"Prop {k + 20}", title(), k)
    del props[9]
    props[30] = (30, "Prop 13", title(), 30)
    changed = {k: row(k) for k in (3, 8, 149, 150, 151)}
    rows |= changed
    for k in (10, 11, 12):
        del rows[k]
    gone = spark.createDataFrame([("payment", "10"), ("payment", "11"), ("filing", "12"), ("payment", "777")], "kind string, row_id string")
    after = named()
    now, full = positions.updated(stored, frame(changed.values()), gone, before, after), positions.evidence(frame(rows.values()), after)
    assert plain(now) == plain(full)
    moved = positions.changes(first, positions.positions(now)).collect()
    old, new = ({tuple(r)[:3]: tuple(r)[3:] for r in x.collect()} for x in (first, positions.positions(full)))
    assert {tuple(r)[:3]: r.action for r in moved} == {k: "withdrawn" if k not in new else "created" if k not in old else "kept" if old[k] == new[k] else "updated" for k in {*old, *new}}
    assert {r.action for r in moved} >= {"withdrawn", "created", "kept"}


# --- lists, names and sources


def test_hearings_find_names_inside_words(spark):
    committees = spark.createDataFrame([(1, "Rule", "A"), (2, "Ü", "A"), (3, "Water, Parks", "A"), (4, "", "A"), (5, "Rule", "S"), (6, "a%", "A")], "committee_id int, name string, chamber string")
    at = dt.datetime(2024, 1, 1)
    meetings = spark.createDataFrame([(1, "A", "Rules hearing", at, None), (2, "A", "Rules hearing", at, "https://x"), (3, "A", "über WATER, PARKS and a%b", at, "/rel"), (4, "A", None, at, None), (5, "A", "overruled", dt.datetime(2020, 1, 1), None), (6, "A", "schedules", at, None)], "meeting_id int, body string, title string, scheduled_at timestamp, agenda_url string")
    got = lists.hearings(committees, meetings, F.lit("2024-01-02").cast("date")).collect()
    assert sorted((r.committee_id, r.meeting_id, r.url) for r in got) == [(1, 2, "https://x"), (2, 3, None), (3, 3, None), (6, 3, None)]


def test_names_of_users_stay(spark):
    df = spark.createDataFrame([(1, 2, 3, "p"), (1, 1, 4, "q"), (2, 5, 5, "r")], "k int, v int, _n int, _p string")
    assert sorted(map(tuple, merge.first_by(df, ["k"], F.asc("v")).collect())) == [(1, 1, 4, "q"), (2, 5, 5, "r")]
    assert merge.union_first_wins([df, df], ["k"]).columns == df.columns and merge.free("_N", df) == "_N_"
    both = df.withColumnsRenamed({"v": "_v", "_p": "_known"})
    assert lifecycle.changed(both, both.where("k = 1 AND _n = 4"), "k", ["_v", "_known"]).columns == both.columns


def test_ranked_measures(spark):
    measures = spark.createDataFrame([(1, "Rent help for TENANTS", dt.date(2024, 1, 11), "active", None), (2, "tenants and k-12 (water)", dt.date(2024, 3, 1), "pending", None), (3, "tenants", dt.date(2023, 1, 1), "active", None), (4, "tenants", dt.date(2024, 2, 1), "closed", None), (5, "tenantship", dt.date(2024, 1, 2), "active", None), (6, "tenants", dt.date(2024, 2, 1), "active", "x"), (7, None, dt.date(2024, 2, 1), "active", None)], "id int, text string, election_date date, status string, deleted_at string").withColumn("state", F.lit("CA"))
    profiles = spark.createDataFrame([("u", ["is_renter", "is_parent"], ["water", "c++ ("]), ("w", [], [])], "user_id string, flags array<string>, tags array<string>").withColumn("state", F.lit("CA"))
    got = ranking.rank_propositions(measures, profiles, F.lit("2024-01-01").cast("date"), 5, "state").collect()
    assert [(r.user_id, r.id, round(r.material, 6), r.alignment, round(r.proximity, 6), r["rank"]) for r in got] == [("u", 2, 0.4, 0.5, 0.7, 1), ("u", 1, 0.2, 0.0, 1.0, 2)]


def test_sources_fail_alone(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"k": "1"}, {"k": null}, {"j": 2}]}')
    good = {"type": "api", "source": "good", "path": str(tmp_path / "a.json"), "fields": {"k": "string", "j": "int"}}
    rows, failed = records.accumulated(spark, [good, {"type": "api", "source": "gone", "path": str(tmp_path / "none.json"), "fields": {"k": "string"}}, {"type": "what", "source": "odd"}, {**good, "source": "again", "fields": {"k": "string"}}])
    assert sorted(map(str, ((r.source, r.k, r.j) for r in rows.collect()))) == ["('again', '1', None)", "('good', '1', None)", "('good', None, 2)"]
    assert set(failed) == {"gone", "odd"} and "unknown type" in failed["odd"]


def test_crawl_stays_in_scope(spark):
    page = lambda *links: "".join(f"<a href='{x}'>x</a>" for x in links)
    pages = spark.createDataFrame([("https://h.example/a/start", page("b", "/c", "https://other.example/x", "../a/b/", "b?p=1#f")), ("https://h.example/a/b", page("d/e", "start")), ("https://h.example/c", page("deep")), ("https://h.example/a/d/e", page("f"))], "url string, html string")
    start = pages.where("url LIKE '%start'").select("url")
    reach = lambda **k: {(r.url.removeprefix("https://h.example"), r.depth) for r in records.crawl(pages, start, **k).collect()}
    assert reach(depth=1) == {("/a/start", 0), ("/a/b", 1), ("/c", 1), ("/a/b?p=1", 1)}
    assert reach(depth=2, below=True) == {("/a/start", 0), ("/a/b", 1), ("/a/b?p=1", 1), ("/a/d/e", 2)}
    assert reach(depth=2, prefixes=["/c", "/deep"]) == {("/a/start", 0), ("/c", 1), ("/deep", 2)}
    assert reach(depth=5, most=2) == {("/a/start", 0), ("/a/b", 1)} and reach(depth=0) == {("/a/start", 0)}


def test_archives_are_taken_in_by_lines(spark, tmp_path, monkeypatch):
    """Cut off before and after an entry is written: no line is lost or doubled."""
    zipped(tmp_path / "a.zip", {"d/x.tsv": "".join(f"k{k % 7}\t{k}\n" for k in range(50))})
    zipped(tmp_path / "b.zip", {"x.tsv": "".join(f"m{k}\t{k}\n" for k in range(9))})
    target, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    rows_of = lambda lines: lines.select(F.split("value", "\t")[0].alias("k"), F.split("value", "\t")[1].cast("int").alias("v"), F.concat_ws(":", "path", "line").alias("x"), F.col("line").alias("seq"))
    run = lambda **k: ingest.ingest_archive(spark, f"{tmp_path}/*.zip", "x.tsv", target, ledger, rows_of, 20, **k)
    assert run(rounds=1) == 1
    real = commits.CommitLog.append
    for after in (False, True):
        with monkeypatch.context() as m:
            m.setattr(ingest.CommitLog, "append", lambda self, entry, seq: (real(self, entry, seq) if after else None, (_ for _ in ()).throw(Lost()))[0])  # noqa: B023
            with pytest.raises(Lost):
                run(rounds=1)
    assert run() == 1 and run() == 0
    held = commits.CommitLog(spark, ledger).entries()
    assert [e["batch"] for e in held] == [0, 1, 2] and held[-1]["after"] == {f"{tmp_path}/a.zip!d/x.tsv": 50}
    every = spark.read.parquet(*(f"{target}/{e['folder']}" for e in held))
    assert every.count() == 59 and every.select("x").distinct().count() == 59
    assert {(r.k, r.v) for r in ingest.current(spark, target, ledger, ["k"], "v", "seq").where("k LIKE 'k%'").select("k", "v").collect()} == {(f"k{k % 7}", k) for k in range(43, 50)}


def test_transforms_by_name(spark):
    from tallyspark.functions.text import transformed

    said = {"trim": " a b ", "lowercase": "ÀB", "uppercase": "àb", "strip_html": "<p>x</p> y<", "name_format": "Doe,  Ann", "date_parse": "due 4/2/24", "typo": " a "}
    got = spark.range(1).select(*(transformed(F.lit(t), k).alias(k) for k, t in said.items()), transformed(F.lit("a1b2"), "regex_replace", pattern=r"\d", replacement="-").alias("r"), transformed(F.lit("x("), "regex_replace", pattern="(").alias("bad"), transformed(F.lit("no day"), "date_parse").alias("none"), transformed(F.lit("../c"), "url_resolve", base=F.lit("http://h/a/b/")).alias("u"), transformed(F.lit("../c"), "url_resolve").alias("nobase")).first()
    assert tuple(got) == ("a b", "àb", "ÀB", "x y", "Ann Doe", "2024-04-02", " a ", "a-b-", "x(", "no day", "http://h/a/c", "../c")


def test_petitions_with_holes(spark):
    from tallyspark.operators import petitions

    now = dt.datetime(2024, 1, 2)
    rows = [(k, "petition", "h", None, 1.001 + k, 2.0, now, None) for k in range(3)] + [(3, "petition", "h", None, None, 2.0, now, None), (4, "petition", None, "s", 1.0, 2.0, now, None), (5, "petition", "few", "s", 1.0, 2.0, now, None), (6, "other", "h", "s", 1.0, 2.0, now, None), (7, "petition", "h", "s", 1.0, 2.0, now, 1), (8, "petition", "h", "s", 1.0, 2.0, dt.datetime(2023, 1, 1), None)]
    df = spark.createDataFrame(rows, "id int, type string, content_hash string, summary string, lon double, lat double, created_at timestamp, deleted_at int")
    (one,) = petitions.feed(df, F.lit(now)).collect()
    assert (one.content_hash, one.summary, one.scans, one.locations) == ("h", "Petition scan recorded", 4, 3)
    day = petitions.day(df, F.lit(now)).first()
    assert len(day["items"]) == 1 and [h.scans for h in day["hours"]] == [6] and (day.total_scans, day.active_petitions) == (6, 2)
    assert tuple(petitions.stats(df, F.lit(now)).first()) == (7, 6, 6) and petitions.markers(df, most=2).first().total == 8
    nothing = petitions.day(df.limit(0), F.lit(now)).first()
    assert (nothing["items"], nothing["hours"], nothing.total_scans, nothing.active_petitions) == ([], [], 0, 0)


# --- candidates' committees


def plain_relinked(committees, reps):
    """Committee by committee, in plain Python."""
    import re

    from tallyspark.operators import controlled as c

    soft = lambda t: " ".join(re.sub(r"[^a-z0-9]+", " ", t.lower()).split())
    key = lambda t: re.sub(r"[^a-z0-9]", "", (t or "").lower())

    def last_of(name):
        name = (name or "").strip()
        if "," in name:
            return name.split(",")[0].strip()
        words = [w for w in name.split() if re.sub(r"[^a-z]", "", w.lower()) not in c.SUFFIXES]
        return words[-1] if words else name

    given = lambda full: next((w for w in soft(full or "").split() if w not in c.TITLES), "")
    group = {n: g[0] for g in c.NICKNAMES for n in g}

    def match(a, b):
        a, b = sorted((key(a), key(b)), key=len)
        return not a or a == b or group.get(a, 1) == group.get(b, 2) or len(a) >= 3 and b.startswith(a)

    def own(name, last, first):
        if any(m in soft(name) for m in c.MARKERS):
            return False
        if len(key(last)) < 3:
            return True
        if key(last) not in key(name):
            return False
        words = soft(last).split()
        keep = lambda ws: [w for w in ws if w not in c.NO_GIVEN and w not in words and not w.isdigit()]
        head, *rest = name.split(";")
        head = soft(head).split()
        at = head.index(words[-1]) if words[-1] in head else -1
        named = keep(head[:at] if at >= 1 else []) + keep(soft(" ".join(rest)).split())
        return not first or not named or any(match(g, first) for g in named)

    here = [r for r in reps if r["deleted_at"] is None and r["region"] != "federal" and r["chamber"]]
    lasts = lambda r: r["last_name"] or r["name"].split()[-1]
    for x in committees:
        if x["source_system"] != "cal_access" or x["deleted_at"] is not None:
            continue
        rep = next((r for r in reps if r["rep_id"] == x["rep_id"]), None)
        last = last_of(x["candidate_name"]) or (rep and (rep["last_name"] or rep["name"].split()[-1])) or ""
        if x["rep_id"] is not None and own(x["name"], last, given(rep["name"]) if rep else ""):
            yield x["id"], x["rep_id"], "kept"
            continue
        body = c.OFFICES.get((x["candidate_office"] or "").upper().strip()) or next((b for b in ("Assembly", "Senate") if b.lower() in soft(x["name"])), None)
        if x["candidate_name"]:
            hits = [(r, last_of(x["candidate_name"])) for r in here if body and r["chamber"].lower().strip() == body.lower() and key(lasts(r)) == key(last_of(x["candidate_name"])) and key(lasts(r))]
        else:
            hits = [(r, lasts(r)) for r in here if body and r["chamber"].lower().strip() == body.lower() and len(key(lasts(r))) >= 3 and key(lasts(r)) in key(x["name"])]
        outcome = "unmatched" if not hits else "ambiguous" if len(hits) > 1 else "linked" if own(x["name"], hits[0][1], given(hits[0][0]["name"])) else "not_controlled"
        found = hits[0][0]["rep_id"] if outcome == "linked" else None
        yield x["id"], found, outcome if x["rep_id"] is None else "withdrawn" if found is None else "kept" if found == x["rep_id"] else "moved"


def test_committees_of_candidates(spark):
    rng = random.Random(12)
    people = [("Robert De León", "De León"), ("Dr. Corey A. Jackson", "Jackson"), ("Bob O'Brien", "O'Brien"), ("Ann Li", "Li"), ("Daniel Ng Jr.", None), ("Liz Alvarado-Gil", "Alvarado-Gil"), ("Kate Jackson", "Jackson"), ("Sam Gil", "Gil"), ("Tom Smith", "Smith")]
    reps = [{"rep_id": k, "name": n, "last_name": s, "chamber": rng.choice(["Assembly", "Senate", " senate"]), "region": "federal" if k % 11 == 10 else rng.choice(["ca", None]), "deleted_at": "x" if k % 13 == 12 else None} for k, (n, s) in enumerate(people * 2)] + [{"rep_id": 99, "name": "No Chamber", "last_name": "Chamber", "chamber": None, "region": "ca", "deleted_at": None}]
    start = ["", "Friends of ", "Re-elect ", "Citizens supporting ", "Senator ", "Committee to Elect ", "Thomas ", "Dan "]
    named = ["Bob De Leon", "Corey Jackson", "Jackson", "Elizabeth Alvarado-Gil", "Ann Li", "OBRIEN", "Dan Ng", "Tommy Smith", "Steve Smith", "Gil"]
    end = ["", " for Assembly 2024", " for Senate", "; Robert", "; Kate for Senate 2026", " Ballot Measure Committee", " for Assembly Recall"]
    committees = [{"id": k, "name": rng.choice(start) + rng.choice(named) + rng.choice(end), "candidate_name": rng.choice([None, None, "", "Jackson, Corey", "Tom Smith Jr.", "De León", "Bob OBrien", "LI, A"]), "candidate_office": rng.choice([None, "ASM", " sen ", "GOV"]), "rep_id": rng.choice([None, None, 1, 3, 8, 14, 500]), "source_system": "fec" if k % 19 == 0 else "cal_access", "deleted_at": "x" if k % 23 == 0 else None} for k in range(700)]
    from tallyspark.operators import controlled

    C, R = "id int, name string, candidate_name string, candidate_office string, rep_id int, source_system string, deleted_at string", "rep_id int, name string, last_name string, chamber string, region string, deleted_at string"
    frame = lambda rows, schema: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = controlled.relinked(frame(committees, C), frame(reps, R)).collect()
    want = set(plain_relinked(committees, reps))
    assert {tuple(r) for r in got} == want and {a for _, _, a in want} == {"kept", "linked", "moved", "withdrawn", "ambiguous", "unmatched", "not_controlled"}
    linked = {i: r for i, r, _ in want}
    again = [{**x, "rep_id": linked[x["id"]]} for x in committees if x["id"] in linked]
    assert {(r.id, r.rep_id) for r in controlled.relinked(frame(again, C), frame(reps, R)).collect()} == {(i, r) for i, r, _ in want}


def test_links_by_hand_stay(spark):
    from tallyspark.operators import linkers

    texts = spark.createDataFrame([(1, "Water and ROADS"), (2, "roads"), (3, None), (4, "none"), (1, "schools")], "id int, t string")
    names = spark.createDataFrame([("w", "water"), ("r", "Roads"), ("r2", "roads"), ("s", "school"), (None, "none"), ("e", "")], "n string, name string")
    want = {(1, "w"), (1, "r"), (1, "r2"), (1, "s"), (2, "r"), (2, "r2")}
    for most in (1, 2, 100):
        found = linkers.all_containing(texts, names, "t", "name", "n", "id", most)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
        assert {tuple(r) for r in linkers.first_containing(texts, names, "t", "name", "n", "id", most).collect()} == {(1, "r"), (2, "r")}
    stored = spark.createDataFrame([(1, "x", "auto"), (1, "w", "manual"), (2, "y", "manual"), (2, "r", "auto"), (9, "z", "auto")], "id int, n string, source string")
    got = linkers.links_after(stored, found, texts, "id", "n")
    assert sorted(map(tuple, got.collect())) == [(1, "r", "auto"), (1, "r2", "auto"), (1, "s", "auto"), (1, "w", "manual"), (2, "r", "auto"), (2, "r2", "auto"), (2, "y", "manual"), (9, "z", "auto")]
