"""Journals, codes and explanations on small texts."""

from pyspark.sql import functions as F

from tallyspark.functions import codes
from tallyspark.operators import minutes

JOURNAL = """IN ASSEMBLY
words
LEAVES OF ABSENCE FOR THE DAY
Personal business: Assembly Members Addis, Davies, and Rogers.
Illness: Assembly Member Li.
REPORTS OF STANDING COMMITTEES
Committee on Water
Date of Hearing: April 2, 2024
Mr. Speaker: Your Committee on Water reports:
Assembly Bill No. 12
Senate Bill No. 7
With the recommendation: Do pass.
ENGROSSMENT AND ENROLLMENT REPORTS
Mr. Speaker: examined
Assembly Bill No. 3
And reports the same correctly engrossed.
Mr. Speaker: examined
Senate Joint Resolution No. 4
And reports the same correctly enrolled."""


def test_journal(spark):
    docs = spark.createDataFrame([("j", JOURNAL), ("empty", ""), ("none", None)], "id string, t string")
    parts = minutes.sections(docs, "id", "t")
    got = sorted((r.start, r.end, r.heading, r.body) for r in parts.collect())
    assert [g[2] for g in got] == ["IN ASSEMBLY", "LEAVES OF ABSENCE FOR THE DAY", "REPORTS OF STANDING COMMITTEES", "ENGROSSMENT AND ENROLLMENT REPORTS"]
    assert "".join(g[3] for g in got) == JOURNAL and all(JOURNAL[a:b] == body for a, b, _, body in got)
    assert {(r.reason, r.name) for r in minutes.absences(parts, "id").collect()} == {("Personal business", "Addis"), ("Personal business", "Davies"), ("Personal business", "Rogers"), ("Illness", "Li")}
    assert {(r.action, r.bill) for r in minutes.engrossments(parts, "id").collect()} == {("engrossment", "AB 3"), ("enrollment", "SJR 4")}
    assert {tuple(r)[1:] for r in minutes.committee_reports(parts, "id").collect()} == {("Water", "April 2, 2024", b, "Do pass.") for b in ("AB 12", "SB 7")}
    assert sorted(r.external_id for r in minutes.numbered(minutes.absences(parts, "id"), "id", F.asc("name")).collect()) == [f"j-000{k}" for k in (1, 2, 3, 4)]


def test_roll_calls_and_blocks(spark):
    bills = spark.createDataFrame([("b", [("m", [("Ann", "AYE"), ("Bob", "Noes"), ("Cy", "Absent"), ("Di", None)])])], "id string, votes array<struct<motion: string, members: array<struct<name: string, position: string>>>>")
    assert {(r.name, r.position) for r in minutes.roll_calls(bills, "id", "votes").collect()} == {("Ann", "yes"), ("Bob", "no"), ("Cy", "absent"), ("Di", "abstain")}
    blocks = spark.createDataFrame([("r", 1, [("a", "old"), ("b", "only old")]), ("r", 2, [("a", "new"), ("a", "second"), (None, "no key"), ("", "no key")])], "region string, at int, glossary array<struct<slug: string, term: string>>")
    assert {(r.slug, r.term) for r in minutes.merge_blocks(blocks, "region", "at", "glossary", "slug").collect()} == {("a", "new"), ("b", "only old")}


def test_codes(spark):
    r = spark.range(1).select(
        codes.party(F.lit("(D)")), codes.party(F.lit("Green")), codes.party(F.lit(None).cast("string")), codes.side(F.lit("o")), codes.side(F.lit("x"), "support"), codes.donor_type(F.lit("scc")), codes.donor_type(F.lit(None).cast("string")),
        codes.representative_id(F.lit("/members/2024/22"), F.lit("Assembly ")), codes.representative_id(F.lit("CA-Senate-3"), F.lit("x")), codes.representative_id(F.lit("none"), F.lit("x")),
        codes.meeting_id(F.lit("05/04/26"), F.lit("Rules Hearing"), F.lit(None).cast("string"), F.lit("Assembly")), codes.meeting_id(F.lit("MTG-001"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")), codes.meeting_id(F.lit("Rules"), F.lit("T"), F.lit(None).cast("string"), F.lit("B")),
        codes.clean_title(F.lit("SCA 1 (Newman) Elections: recall. (Res. Ch. 1 (2024)) (PDF)")), codes.clean_title(F.lit("SB 1 (X)")),
    ).first()
    assert tuple(r) == ("Democratic", "Green", "Unknown", "oppose", "support", "individual", "other", "ca-assembly-22", "ca-senate-3", "none", "assembly-rules-hearing-05/04/26", "MTG-001", None, "Elections: recall", "SB 1 (X)")


def test_explanations(spark):
    base = "This bill changes how water is priced for homes near the river and for farms in"
    rows = [("", []), ("too short", []), (f"{base} town and you should act", []), (f"{base} town where veterans live", []), (f"{base} town where veterans live", ["isVeteran"]), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, f array<string>")
    assert [r.x for r in sorted(df.select("i", codes.explanation_fault(F.col("t"), F.col("f")).alias("x")).collect())] == ["empty", "word-count", "opinion-language", "protected-class-leak", None, "empty"]


def test_passages(spark):
    text = " ".join(f"word{i:04d}" for i in range(1000))
    (p,) = spark.createDataFrame([(text,)], "t string").select(codes.passage(F.col("t"), F.lit(4000), F.lit(9000)).alias("p")).first()
    assert p.passage == text[4000:5024] and p.passage in p.context and text[4000 - 500 - 10 : 3500].split()[-1] and len(p.context) <= 1024 + 1100
    assert p.context.split(" ")[0].startswith("word") and len(p.context.split(" ")[-1]) == 8
