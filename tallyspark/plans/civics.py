"""Registered queries of lists, attribution, journals and profiles, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, names, records, scores, text
from ..operators import checks, feeds, finance, geo, linkers, lists, merge, minutes
from .catalog import _CANON, _money, _t, query

# --- finance


@query("""WITH ie AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 9 <> 0 THEN l_orderkey END AS filing_id, CASE WHEN l_suppkey % 8 = 0 THEN 'S' || l_suppkey END AS owner, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS candidate FROM lineitem),
c AS (SELECT o_orderkey AS filing_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS filer, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS candidate, CASE o_orderkey % 4 WHEN 0 THEN 'oppose' WHEN 1 THEN 'support' END AS side FROM orders WHERE o_orderpriority <> '5-LOW'),
k AS (SELECT c_custkey AS filer, 'C' || c_custkey AS cid, c_name FROM customer WHERE c_acctbal >= 0), j AS (SELECT ie.*, c.filing_id IS NOT NULL AS covered, c.candidate AS cc, c.side AS cs, cid, c_name FROM ie LEFT JOIN c USING (filing_id) LEFT JOIN k USING (filer)),
x AS (SELECT *, CASE WHEN owner IS NOT NULL THEN 'kept' WHEN filing_id IS NULL THEN 'no_filing' WHEN NOT covered THEN 'no_cover' WHEN cid IS NULL THEN 'no_committee' ELSE 'linked' END AS link FROM j)
SELECT id, link, CASE WHEN link = 'linked' THEN cid ELSE owner END AS committee_id, CASE WHEN link = 'linked' THEN c_name END AS committee_name, CASE WHEN link = 'linked' THEN coalesce(cc, candidate) ELSE candidate END AS candidate_name, CASE WHEN link = 'linked' THEN coalesce(cs, 'support') ELSE 'support' END AS side FROM x""")
def independent_attribution(spark, d):
    k = lambda c: F.col(c)
    rows = _t(spark, d, "lineitem").select((k("l_orderkey") * 10 + k("l_linenumber")).alias("id"), F.when(k("l_suppkey") % 9 != 0, k("l_orderkey")).alias("filing_id"), F.when(k("l_suppkey") % 8 == 0, F.concat(F.lit("S"), "l_suppkey")).alias("committee_id"), F.lit(None).cast("string").alias("committee_name"), F.when(k("l_partkey") % 2 == 0, k("l_returnflag")).alias("candidate_name"), F.lit(None).cast("string").alias("proposition_title"), F.lit("support").alias("side"))
    covers = _t(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(k("o_orderkey").alias("filing_id"), F.when(k("o_orderstatus") != "F", k("o_custkey").cast("string")).alias("filer_id"), F.when(k("o_orderkey") % 3 != 0, k("o_orderpriority")).alias("candidate_name"), F.lit(None).cast("string").alias("proposition_title"), F.when(k("o_orderkey") % 4 == 0, "oppose").when(k("o_orderkey") % 4 == 1, "support").alias("side"), F.lit(0).alias("seq"))
    committees = _t(spark, d, "customer").where("c_acctbal >= 0").select(k("c_custkey").cast("string").alias("external_id"), F.concat(F.lit("C"), "c_custkey").alias("id"), k("c_name").alias("name"))
    return finance.attribute_independent(rows, covers, committees).select("id", "link", "committee_id", "committee_name", "candidate_name", "side")


@query(f"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS rep FROM customer WHERE c_mktsegment <> 'MACHINERY'), g AS (SELECT rep, CASE WHEN o_orderkey % 2 = 0 THEN 'Donor ' || (o_orderkey % 37) || ', Inc' ELSE 'The Donor ' || (o_orderkey % 37) END AS donor, CAST(o_totalprice AS DECIMAL(14,2)) AS amount FROM orders JOIN c ON k = o_custkey WHERE o_orderstatus = 'F'),
e AS (SELECT rep, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS spent FROM orders JOIN c ON k = o_custkey WHERE o_orderstatus <> 'F' GROUP BY 1),
s AS (SELECT rep, donor, sum(amount) AS a, count(*) AS n, coalesce(nullif({_CANON.format(c='donor')}, ''), lower(donor)) AS dk FROM g GROUP BY 1, 2), b AS (SELECT rep, dk, first(donor ORDER BY a DESC, donor) AS donor, sum(a) AS total, sum(n) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY total DESC, dk) AS rank FROM b), t AS (SELECT rep, string_agg(donor || ':' || n, ',' ORDER BY rank) AS top FROM r WHERE rank <= 10 GROUP BY 1)
SELECT c.rep AS representative_id, CAST(coalesce((SELECT sum(amount) FROM g WHERE g.rep = c.rep), 0) AS DOUBLE) AS raised, CAST(coalesce(any_value(spent), 0) AS DOUBLE) AS spent, count(*) AS committees, coalesce((SELECT count(*) FROM b WHERE b.rep = c.rep), 0) AS donors, any_value(top) AS top FROM c LEFT JOIN e USING (rep) LEFT JOIN t USING (rep) GROUP BY c.rep""")
def representative_funding(spark, d):
    committees = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("representative_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "2024-01-01").alias("deleted_at"))
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("committee_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Donor "), F.col("o_orderkey") % 37, F.lit(", Inc"))).otherwise(F.concat(F.lit("The Donor "), F.col("o_orderkey") % 37)).alias("donor_name"), _money("o_totalprice").alias("amount"), "o_orderstatus")
    out = finance.representative_funding(committees, orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"))
    top = F.array_join(F.transform("top_donors", lambda x: F.concat_ws(":", x["donor"], x["contributions"])), ",")
    return out.select("representative_id", F.col("raised").cast("double"), F.col("spent").cast("double"), "committees", "donors", top.alias("top"))


@query("WITH t AS (SELECT trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k, max(p_partkey) AS id FROM part GROUP BY 1 HAVING k <> ''), n AS (SELECT trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k, max(id) AS id FROM (SELECT p_name AS x, p_partkey AS id FROM part) GROUP BY 1) SELECT s.p_partkey AS k, coalesce(t.id, n.id) AS proposition_id FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'No. ' || p_name ELSE upper(p_name) || '!' END AS number, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name || '.' END AS name FROM part) s LEFT JOIN t ON t.k = trim(regexp_replace(regexp_replace(lower(number), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) LEFT JOIN n ON n.k = trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
def ballot_links(spark, d):
    p = _t(spark, d, "part")
    even = F.col("p_size") % 2 == 0
    rows = p.select(F.col("p_partkey").alias("k"), F.when(even, F.concat(F.lit("No. "), "p_name")).otherwise(F.concat(F.upper("p_name"), F.lit("!"))).alias("number"), F.when(F.col("p_size") % 5 != 0, F.concat("p_name", F.lit("."))).alias("name"))
    return linkers.first_key_that_links(rows, p.select("p_name", F.col("p_partkey").alias("proposition_id")), ["number", "name"], "p_name", "proposition_id").select("k", "proposition_id")


@query("""WITH f AS (SELECT o_custkey AS c, o_orderkey % 20 AS p, CASE o_orderstatus WHEN 'F' THEN 'support' WHEN 'O' THEN 'oppose' END AS s, o_orderpriority FROM orders), r AS (SELECT c, p, s, false AS inferred FROM f WHERE o_orderpriority = '1-URGENT' AND s IS NOT NULL UNION ALL SELECT c, p, s, true FROM f WHERE o_orderpriority <> '1-URGENT' AND s IS NOT NULL)
SELECT c AS committee_id, p AS proposition_id, s AS position, NOT inferred AS is_primary FROM (SELECT *, row_number() OVER (PARTITION BY c, p ORDER BY inferred, s) AS n FROM r) WHERE n = 1""")
def measure_positions(spark, d):
    side = F.when(F.col("o_orderstatus") == "F", "support").when(F.col("o_orderstatus") == "O", "oppose")
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("committee_id"), (F.col("o_orderkey") % 20).alias("proposition_id"), side.alias("side"), "o_orderpriority")
    return finance.measure_positions(rows.where("o_orderpriority = '1-URGENT'"), [rows.where("o_orderpriority <> '1-URGENT' AND o_orderpriority < '3'"), rows.where("o_orderpriority >= '3'")])


@query("WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS committee_id, o_orderdate AS date, CAST(o_totalprice AS DOUBLE) AS amount, o_orderpriority AS source_system FROM orders) SELECT id, amount, (SELECT count(*) FROM c WHERE committee_id IS NOT NULL AND source_system = '2-HIGH') AS total, 50 + 25 < (SELECT count(*) FROM c WHERE committee_id IS NOT NULL AND source_system = '2-HIGH') AS has_more FROM c WHERE committee_id IS NOT NULL AND source_system = '2-HIGH' ORDER BY date DESC, amount DESC, id LIMIT 25 OFFSET 50")
def contributions_page(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("committee_id"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").cast("double").alias("amount"), F.col("o_orderpriority").alias("source_system"))
    return lists.contributions(rows, 50, 25, source="2-HIGH").select("id", "amount", "total", "has_more")


@query("""WITH s AS (SELECT 'C' || s_suppkey AS external_id, s_name AS name, 'cal_access' AS source_system FROM supplier), f AS (SELECT 'C' || c_custkey AS external_id, first(c_name ORDER BY q DESC) AS nn, first(c_mktsegment ORDER BY q DESC) AS ns FROM (SELECT c_custkey // 3 AS c_custkey, c_name, c_mktsegment, c_custkey AS q FROM customer) GROUP BY 1),
n AS (SELECT coalesce(s.external_id, f.external_id) AS external_id, coalesce(nn, name) AS name, coalesce(ns, source_system) AS source_system, CASE WHEN nn IS NULL THEN 'kept' WHEN name IS NULL THEN 'created' ELSE 'updated' END AS action FROM s FULL JOIN f ON s.external_id = f.external_id),
r AS (SELECT 'C' || o_custkey AS external_id, arg_min(o_orderpriority, o_orderkey) AS source_system FROM orders GROUP BY 1) SELECT * FROM n UNION ALL SELECT external_id, external_id, source_system, 'stub' FROM r WHERE external_id NOT IN (SELECT external_id FROM n)""")
def committee_roster(spark, d):
    key = lambda c: F.concat(F.lit("C"), c)
    stored = _t(spark, d, "supplier").select(key(F.col("s_suppkey")).alias("external_id"), F.col("s_name").alias("name"), F.lit("cal_access").alias("source_system"))
    found = _t(spark, d, "customer").select(key(F.expr("c_custkey div 3")).alias("external_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("source_system"), F.col("c_custkey").alias("seq"))
    cited = _t(spark, d, "orders").select(key(F.col("o_custkey")).alias("external_id"), F.col("o_orderpriority").alias("source_system"), F.col("o_orderkey").alias("seq"))
    return lists.roster(stored, found, cited)


# --- lists of the region


@query("WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS chamber, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_nationkey AS VARCHAR), 2, '0') ELSE CAST(s_nationkey AS VARCHAR) END AS district FROM supplier) SELECT * FROM r WHERE (chamber = 'Assembly' AND CAST(district AS INT) = 7) OR (chamber = 'Senate' AND CAST(district AS INT) = 12)")
def district_representatives(spark, d):
    n = F.col("s_nationkey").cast("string")
    reps = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "Assembly").otherwise("Senate").alias("chamber"), F.when(F.col("s_suppkey") % 3 == 0, F.lpad(n, 2, "0")).otherwise(n).alias("district"))
    return lists.by_districts(reps, F.lit("Assembly District 07"), F.lit("District 12, Senate"))


_ASSIGNED = "SELECT s_suppkey AS rep, CASE WHEN s_suppkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS chamber, unnest([{'n': 'Committee on ' || n_name, 'r': 'Chair'}, {'n': CASE WHEN s_suppkey % 3 = 0 THEN 'Standing Committee on the ' ELSE '' END || n_name, 'r': 'Vice Chair'}, {'n': ' ', 'r': NULL}]) AS a FROM supplier JOIN nation ON n_nationkey = s_nationkey"


def _assigned(spark, d):
    assign = lambda name, role: F.struct(name.alias("name"), F.lit(role).cast("string").alias("role"))
    full = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "Standing Committee on the ").otherwise(""), "n_name")
    rows = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = rows.select(F.col("s_suppkey").alias("rep_id"), F.when(F.col("s_suppkey") % 2 == 0, "Assembly").otherwise("Senate").alias("chamber"), F.array(assign(F.concat(F.lit("Committee on "), "n_name"), "Chair"), assign(full, "Vice Chair"), assign(F.lit(" "), None)).alias("committees"))
    return lists.committees_of(rows, "rep_id", "chamber", "committees")


@query(f"WITH a AS ({_ASSIGNED}), k AS (SELECT chamber, trim(a.n) AS name, lower(chamber) || ':' || lower(replace(regexp_replace(trim(a.n), '^(Standing Committee on the|Committee on) ', ''), '_', ' ')) AS external_id FROM a WHERE trim(a.n) <> '') SELECT external_id, min(chamber) AS chamber, first(name ORDER BY length(name) DESC, name) AS name FROM k GROUP BY 1")
def committee_normalisation(spark, d):
    return _assigned(spark, d)[0]


@query(f"WITH a AS ({_ASSIGNED}) SELECT DISTINCT rep, lower(chamber) || ':' || lower(replace(regexp_replace(trim(a.n), '^(Standing Committee on the|Committee on) ', ''), '_', ' ')) AS external_id, a.r AS role FROM a WHERE trim(a.n) <> ''")
def committee_members(spark, d):
    return _assigned(spark, d)[1]


@query("""WITH c AS (SELECT n_nationkey AS committee_id, n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS body FROM nation), m AS (SELECT c_custkey AS meeting_id, CASE WHEN c_custkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS body, 'Hearing of ' || lower(n_name) || ' and others' AS title, TIMESTAMP '2024-01-01' - INTERVAL 1 DAY * (c_custkey % 700) AS dt, CASE c_custkey % 3 WHEN 0 THEN 'https://x/' || c_custkey WHEN 1 THEN '/relative' END AS u FROM customer JOIN nation ON n_nationkey = c_nationkey),
j AS (SELECT committee_id, meeting_id, title, dt, CASE WHEN u LIKE 'http%' THEN u END AS url FROM m JOIN c ON m.body = c.body AND contains(lower(title), lower(name)) WHERE dt >= TIMESTAMP '2023-01-01'), o AS (SELECT *, row_number() OVER (PARTITION BY committee_id, title, dt ORDER BY url IS NULL, meeting_id) AS n FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY committee_id ORDER BY dt DESC, title) AS rank FROM o WHERE n = 1) SELECT committee_id, meeting_id, title, dt AS scheduled_at, url, rank FROM r WHERE rank <= 5""")
def committee_hearings(spark, d):
    nation = _t(spark, d, "nation")
    chamber = lambda c: F.when(c % 2 == 0, "Assembly").otherwise("Senate")
    committees = nation.select(F.col("n_nationkey").alias("committee_id"), F.col("n_name").alias("name"), chamber(F.col("n_regionkey")).alias("chamber"))
    k = F.col("c_custkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://x/"), k)).when(k % 3 == 1, "/relative")
    at = F.lit("2024-01-01").cast("timestamp_ntz") - F.make_dt_interval((k % 700).cast("int"))
    meetings = _t(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(k.alias("meeting_id"), chamber(k).alias("body"), F.concat(F.lit("Hearing of "), F.lower("n_name"), F.lit(" and others")).alias("title"), at.alias("scheduled_at"), url.alias("agenda_url"))
    return lists.hearings(committees, meetings, F.lit("2024-01-01").cast("date")).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_active FROM lineitem")
def active_revision(spark, d):
    return lists.active_revision(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("WITH a AS (SELECT event_id, ts, event_type, value <= 90 AS success FROM events WHERE user_id = 7 AND event_type IN ('view', 'click') AND value <= 90) SELECT event_id, (SELECT count(*) FROM a) AS total, 5 + 10 < (SELECT count(*) FROM a) AS has_more FROM a ORDER BY ts DESC, event_id LIMIT 10 OFFSET 5")
def activity_log(spark, d):
    rows = feeds.filtered(_t(spark, d, "events").withColumn("success", F.col("value") <= 90), user_id=7, event_type=["view", "click"], success=True)
    return lists.page_with_total(rows, 5, 10, F.desc("ts"), F.asc("event_id")).select("event_id", "total", "has_more")


@query("SELECT user_id, count(*) AS actions, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value > 90) AS failures, max(ts) FILTER (WHERE event_type = 'signup') AS last_signup, max(ts) AS last_action FROM events GROUP BY 1")
def activity_summary(spark, d):
    return lists.activity_summary(_t(spark, d, "events").withColumn("success", F.col("value") <= 90), "user_id", "event_type", "ts", "success")


@query("SELECT doc_id, sha256(text) AS said FROM documents WHERE lang <> 'de' AND contains(lower(text), 'license') AND n_chars >= 500")
def scan_search(spark, d):
    rows = _t(spark, d, "documents").withColumn("deleted_at", F.when(F.col("lang") == "de", "2024-01-01")).withColumn("created_at", F.col("n_chars"))
    return lists.search(rows, "text", "LICENSE", since=F.lit(500)).select("doc_id", F.sha2("text", 256).alias("said"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0 AND o_orderpriority <> '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def missing_summaries(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("is_active"), F.when(F.col("o_orderkey") % 3 != 0, "text").alias("raw_text"), F.when(F.col("o_orderpriority") == "1-URGENT", "said").alias("summary"), F.col("o_orderdate").alias("date"))
    return lists.missing_summaries(rows, 100).select("id")


@query("WITH c AS (SELECT user_id, ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 900 END AS a, event_id % 300 AS b FROM events), m AS (SELECT date_trunc('day', max(ts)) AS t FROM events) SELECT user_id, CAST(sum(coalesce(a, 0) + b) AS BIGINT) AS used, sum(coalesce(a, 0) + b) + 2000 <= 3000 AS within FROM c, m WHERE ts >= t GROUP BY 1")
def token_budgets(spark, d):
    e = _t(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    calls = e.select("user_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 900).alias("tokens_in"), (F.col("event_id") % 300).alias("tokens_out"))
    return lists.token_budgets(calls, "user_id", "ts", now, 3000)


@query("SELECT c_custkey, CAST(floor(((CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) + 1) * 100 / 5 + 0.5) AS INT) AS per_cent, concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN 'name' END, CASE WHEN c_custkey % 3 <> 0 THEN 'photo' END, CASE WHEN NOT c_acctbal > 0 THEN 'address' END, 'demographic') AS missing FROM customer")
def profile_completion(spark, d):
    k = F.col("c_custkey")
    share, left = lists.completion({"name": k % 2 == 0, "photo": k % 3 == 0, "address": F.col("c_acctbal") > 0, "civic": F.lit(True), "demographic": F.lit(None).cast("boolean")})
    return _t(spark, d, "customer").select("c_custkey", share.alias("per_cent"), F.array_join(left, ",").alias("missing"))


_FLAGS = """k % 2 = 0 AS is_renter, k % 2 = 1 AS is_homeowner, k % 3 = 0 AS is_parent, k % 11 = 4 AS is_caregiver, k % 13 < 3 AS is_student, k % 17 = 2 AS is_educator, k % 5 <> 4 AND k % 5 <> 0 AS is_worker, k % 5 = 3 AS is_business_owner, k % 19 < 4 AS is_union_member, k % 23 = 5 AS is_gig_worker,
k % 9 = 1 AS is_transit_rider, k % 7 = 1 AS is_driver, k % 8 = 3 AS has_special_license, k % 10 IN (1, 2) AND k % 6 <> 0 AS has_immigration_concern, k % 12 = 5 AND k % 6 <> 0 AS has_health_condition, k % 14 = 3 AND k % 6 <> 0 AS has_public_health_insurance, k % 4 = 2 AND k % 6 <> 0 AS is_veteran, k % 15 = 7 AND k % 6 <> 0 AS has_justice_involvement, k % 4 = 1 AND k % 6 <> 0 AS is_low_income, k % 16 = 9 AND k % 6 <> 0 AS receives_public_benefits"""


@query(f"SELECT s_suppkey, {_FLAGS} FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)")
def ranking_flags(spark, d):
    """All twenty flags; profiles whose number divides by six are masked, others lack some fields."""
    k = F.col("s_suppkey")
    some = lambda c: F.when(c, F.array(F.lit("x"))).when(k % 2 == 0, F.array().cast("array<string>"))
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    signal = F.struct(
        F.when(k % 2 == 0, "renter").otherwise("owner").alias("tenure"), some(k % 6 == 0).alias("children"), some(k % 6 == 3).alias("parent_of"), F.when(k % 11 < 8, k % 11 == 4).alias("eldercare"), F.when(k % 13 < 3, "college").alias("student_level"), (k % 17 == 2).alias("educator"),
        pick(5, "retired", "w2", "1099", "business_owner").alias("employment"), F.when(k % 19 < 9, k % 19 < 4).alias("union_member"), (k % 23 == 5).alias("gig_worker"), pick(9, "car", "transit", "bike").alias("transit_mode"),
        F.when(k % 7 == 1, F.array(F.lit("none"), F.lit("car"))).when(k % 7 == 2, F.array(F.lit("none"))).when(k % 7 == 3, F.array().cast("array<string>")).alias("vehicles"), some(k % 8 == 3).alias("licenses"),
    )
    private = F.struct(
        pick(10, "citizen", "daca", "visa_holder").alias("citizenship"), some(k % 12 == 5).alias("conditions"), pick(14, "employer", "none", "marketplace", "medicaid").alias("insurance"), F.when(k % 4 == 2, "yes").when(k % 4 == 1, "").alias("veteran"), some(k % 15 == 7).alias("justice"), F.when(k % 4 == 1, "low").otherwise("high").alias("income"), some(k % 16 == 9).alias("benefits"),
    )
    rows = _t(spark, d, "supplier").select("s_suppkey", signal.alias("signal"), private.alias("private"), F.when(k % 6 < 4, k % 6 == 0).alias("masked"))
    return rows.select("s_suppkey", *lists.ranking_flags("signal", "private", F.col("masked")).values())


@query("SELECT c_custkey, c_name, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def user_export(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    out = lists.export(_t(spark, d, "customer").select("c_custkey", "c_name"), {"orders": orders}, "c_custkey")
    back = F.from_json("data", "profile struct<c_name: string>, orders array<struct<o_orderkey: bigint, o_orderstatus: string>>")
    return out.select("c_custkey", back.alias("b")).select("c_custkey", "b.profile.c_name", F.array_join(F.transform("b.orders", lambda o: F.concat_ws(":", o["o_orderkey"], o["o_orderstatus"])), ",").alias("orders"))


@query("SELECT count(*) AS items, count(*) FILTER (WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING') AS rejected, count(*) FILTER (WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING') / count(*) AS ratio, 'negative,segment' AS issues FROM customer")
def schema_rejects(spark, d):
    out = lists.rejects(_t(spark, d, "customer"), {"segment": F.col("c_mktsegment") != "BUILDING", "negative": F.col("c_acctbal") >= 0, "never": F.lit(True)})
    return out.withColumn("issues", F.array_join("issues", ","))


@query("SELECT count(*) AS items, avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END) AS worst, CASE WHEN avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END) > 0.1 THEN 'warn' ELSE 'ok' END AS verdict FROM events")
def run_verdict(spark, d):
    rows = _t(spark, d, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("a"), F.col("event_type").alias("b"))
    return checks.verdict(rows, ["a", "b"], 10)


# --- journals and pages

_JOURNAL = "ROLLCALL\nThe following were placed upon the morning rollcall:\nAddis   Member{n}\nThe following page 3\n  De León     O'Hara\nMr. Speaker\nLater\nAUTHOR'S AMENDMENTS\nCommittee on Water\nMr. Speaker: amended\nAssembly Bill No. {k}\nSenate Bill No. 7\nCommittee on Rules\nAssembly Bill No. 2\nSECOND READING OF ASSEMBLY BILLS\nASSEMBLY BILL NO. {k}\nRead; amendments proposed by the Committee on Health read and adopted; and amendments proposed by the Committee on Ways and Means read and adopted\nRESOLUTIONS\nASSEMBLY CONCURRENT RESOLUTION NO. {k}—Addis. Relative to rivers.\nASSEMBLY RESOLUTION NO. 9 - no subject\nASSEMBLY JOINT RESOLUTION NO. 8-Li. Relative to roads."


def _journals(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.replace(F.replace(F.lit(_JOURNAL), F.lit("{k}"), F.col("c_custkey").cast("string")), F.lit("{n}"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")).alias("t"))
    return minutes.sections(rows, "c_custkey", "t")


@query("WITH n AS (SELECT c_custkey, length('Addis   Member' || c_custkey) + 1 AS w, 'Member' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS m FROM customer) SELECT c_custkey, unnest(['Addis', m, 'De León', 'O''Hara', 'Mr. Speaker']) AS name, CAST(unnest([62, 70, 62 + w + 23, 62 + w + 35, 62 + w + 42]) AS INT) AS start FROM n")
def journal_presence(spark, d):
    return minutes.presence(_journals(spark, d), "c_custkey")


@query("SELECT c_custkey, unnest(['Water', 'Water', 'Rules']) AS committee, unnest(['AB ' || c_custkey, 'SB 7', 'AB 2']) AS bill FROM customer")
def journal_author_amendments(spark, d):
    return minutes.author_amendments(_journals(spark, d), "c_custkey")


@query("SELECT c_custkey, unnest(['Health', 'Ways and Means']) AS committee, 'AB ' || c_custkey AS bill FROM customer")
def journal_reading_amendments(spark, d):
    return minutes.reading_amendments(_journals(spark, d), "c_custkey").drop("start")


@query("SELECT c_custkey, unnest(['ACR ' || c_custkey, 'AJR 8']) AS resolution, unnest(['Addis', 'Li']) AS introducer, unnest(['Relative to rivers.', 'Relative to roads.']) AS subject FROM customer")
def journal_resolutions(spark, d):
    return minutes.resolutions(_journals(spark, d), "c_custkey")


_SESSION = "LEAVES OF ABSENCE FOR THE DAY\nPersonal business: Assembly Members Addis, Davies, and Member{k}.\nIllness: Assembly Member Li.\nREPORTS OF STANDING COMMITTEES\nCommittee on Water\nDate of Hearing: April 2, 2024\nAssembly Bill No. {k}\nWith the recommendation: Do pass.\nENGROSSMENT AND ENROLLMENT REPORTS\nMr. Speaker: examined\nAssembly Bill No. {k}\nAnd reports the same correctly engrossed."


def _session(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.replace(F.lit(_SESSION), F.lit("{k}"), F.col("c_custkey").cast("string")).alias("t"))
    return minutes.sections(rows, "c_custkey", "t")


@query("SELECT c_custkey, unnest(['Personal business', 'Personal business', 'Personal business', 'Illness']) AS reason, unnest(['Addis', 'Davies', 'Member' || c_custkey, 'Li']) AS name FROM customer")
def journal_absences(spark, d):
    return minutes.absences(_session(spark, d), "c_custkey")


@query("SELECT c_custkey, 'Water' AS committee, 'April 2, 2024' AS hearing, 'AB ' || c_custkey AS bill, 'Do pass.' AS recommendation FROM customer")
def journal_reports(spark, d):
    return minutes.committee_reports(_session(spark, d), "c_custkey")


@query("SELECT c_custkey, 'engrossment' AS action, 'AB ' || c_custkey AS bill FROM customer")
def journal_engrossments(spark, d):
    return minutes.engrossments(_session(spark, d), "c_custkey")


@query("SELECT o_orderkey, 'Read & heard ' || o_orderkey AS last_action, CAST(o_orderdate AS DATE) AS last_action_date FROM orders")
def status_pages(spark, d):
    day = F.col("o_orderdate").cast("date")
    html = F.concat(F.lit('<span id="lastAction" class="x"> '), F.date_format(day, "M/d/yyyy"), F.lit(' </span><td scope="row">01/02/24</td><td> Read&nbsp;&amp;\nheard '), "o_orderkey", F.lit(" </td><td scope=\"row\">1/1/20</td><td>old</td>"))
    return _t(spark, d, "orders").select("o_orderkey", records.status_fields(html).alias("s")).select("o_orderkey", "s.*")


@query("SELECT c_custkey, 'finding' AS kind, 'Title ' || c_custkey AS title, CAST(0 AS INT) AS start, CAST(least(c_custkey, 40) AS INT) AS end FROM customer WHERE c_custkey > 0")
def text_claims(spark, d):
    k = F.col("c_custkey")
    said = F.concat(F.lit('[{"kind":" Finding","title":"Title '), k, F.lit('","start":-5,"end":'), k, F.lit('},{"kind":"other","title":"t","start":0,"end":9},{"kind":"finding","title":" ","start":0,"end":9},{"kind":"finding","title":"late","start":90,"end":99}]'))
    rows = _t(spark, d, "customer").select("c_custkey", F.explode(records.claims(said, F.lit(40), ("finding", "fiscal"))).alias("c"))
    return rows.select("c_custkey", "c.kind", "c.title", "c.start", "c.end")


@query("SELECT c_custkey, 'j' || repeat('*', length(CAST(c_custkey AS VARCHAR)) + 1) || 'x@example.com' AS email, CAST(c_custkey % 250 AS VARCHAR) || '.x.x.x' AS ip, '[REDACTED]' AS password, c_name AS name FROM customer")
def masked_fields(spark, d):
    k = F.col("c_custkey").cast("string")
    inner = F.struct(F.concat(F.lit("j."), k, F.lit("x@example.com")).alias("Email"), F.concat((F.col("c_custkey") % 250).cast("string"), F.lit(".1.2.3")).alias("ip"), F.struct(F.lit("secret").alias("PASSWORD"), F.col("c_name").alias("name")).alias("deep"))
    rows = records.mask_fields(_t(spark, d, "customer").select("c_custkey", F.array(inner).alias("a")), ("password", "token"), {"email": records.mask_email, "ip": records.mask_ip})
    return rows.select("c_custkey", F.col("a")[0]["Email"].alias("email"), F.col("a")[0]["ip"].alias("ip"), F.col("a")[0]["deep"]["PASSWORD"].alias("password"), F.col("a")[0]["deep"]["name"].alias("name"))


@query("SELECT p_partkey, p_name AS first, CASE WHEN p_partkey % 2 = 0 THEN 'https://x#' || p_brand || '#api' ELSE 'https://x#api' END AS session, CASE WHEN p_partkey % 3 = 0 THEN 'cal_access' WHEN p_partkey % 3 = 1 THEN 'fec' END AS system, CASE WHEN p_partkey % 2 = 0 THEN 'Doe, ' || p_brand ELSE p_name END AS donor, CAST(0.5 + 0.1 * ((CASE WHEN p_size >= 3 THEN 1 ELSE 0 END) + (CASE WHEN p_size >= 5 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END)) AS DOUBLE) AS confidence, length(trim(p_name)) * 10 >= 100 AS bio FROM part")
def source_fields(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.concat(F.lit('["", "'), "p_name", F.lit('"]'))).when(k % 3 == 1, F.concat(F.lit('{"name": "'), "p_name", F.lit('"}'))).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    kind = F.when(k % 3 == 0, "CAL-ACCESS bulk").when(k % 3 == 1, "FEC api").otherwise("other")
    return _t(spark, d, "part").select(
        "p_partkey", records.first_string(value).alias("first"), codes.session_key(F.lit("https://x"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(""), F.lit("api")).alias("session"), codes.source_system(kind).alias("system"),
        codes.donor_name(F.when(k % 2 != 0, F.col("p_name")), F.lit("Doe"), F.col("p_brand")).alias("donor"), codes.rules_confidence(F.col("p_size"), k % 2 == 0, F.lit("div"), F.lit(None).cast("string")).alias("confidence"), codes.valid_bio(F.repeat(F.trim("p_name"), F.lit(10))).alias("bio"),
    )


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'gi') AS starred, p_name AS same FROM part")
def safe_patterns(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.safe_replace(F.col("p_name"), "(?x)(?-m)(?i)[AEIOU]", "*").alias("starred"), text.safe_replace(F.col("p_name"), "(?s)(a", "-").alias("same"))


@query("SELECT c_custkey, c_name || ',x,' || c_mktsegment AS leaves FROM customer")
def json_leaves(spark, d):
    said = F.concat(F.lit('{"a":"'), "c_name", F.lit('","b":[1,"x",{"c":"'), "c_mktsegment", F.lit('","d":null}],"e":{"f":{"g":{"h":{"i":"deep"}}}}}'))
    return _t(spark, d, "customer").select("c_custkey", F.array_join(records.string_leaves(said), ",").alias("leaves"))


@query("WITH t AS (SELECT c_custkey, length(c_name) AS n FROM customer) SELECT c_custkey, unnest([' ONE ', 'TWO', 'ONE']) AS heading, CAST(unnest([0, n + 11, n + 20]) AS INT) AS start, CAST(unnest([n + 11, n + 20, n + 29]) AS INT) AS end FROM t")
def section_spans(spark, d):
    section = lambda heading, start: F.struct(F.lit(heading).alias("heading"), F.lit(start).alias("start"))
    told = F.array(section(" ONE ", 40), section("TWO", 0), section("ONE", 0), section("missing", 9999))
    whole = F.concat(F.lit("Intro ONE "), "c_name", F.lit(" TWO body ONE again"))
    return _t(spark, d, "customer").select("c_custkey", F.inline(records.section_spans(whole, told)))


@query("SELECT s_suppkey, '{\"name\":\"' || s_name || '\",\"seat\":{\"nation\":{\"key\":' || s_nationkey || '},\"id\":' || s_suppkey || '}}' AS nested FROM supplier")
def nested_fields(spark, d):
    fields = {"name": F.col("s_name"), "seat": F.lit(1), "seat.nation.key": F.col("s_nationkey"), "seat.id": F.col("s_suppkey")}
    return _t(spark, d, "supplier").select("s_suppkey", F.to_json(records.nested(fields)).alias("nested"))


@query("SELECT c_custkey, true AS near, true AS moved FROM customer")
def location_noise(spark, d):
    lat, lon = F.col("c_custkey") % 90 + 0.0, F.col("c_custkey") % 180 + 0.0
    rows = _t(spark, d, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"), geo.with_noise(lat, lon, F.col("c_custkey")).alias("p"))
    off = F.hypot(F.col("p.lat") - F.col("lat"), F.col("p.lon") - F.col("lon"))
    return rows.select("c_custkey", (off <= 0.001 + 1e-9).alias("near"), (off > 0).alias("moved"))


# --- names and codes


@query("WITH r AS (SELECT s_suppkey AS id, 'Person' || (s_suppkey % 40) AS last, CASE WHEN s_suppkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS chamber FROM supplier), u AS (SELECT chamber, lower(last) AS k, min(id) AS id FROM r GROUP BY 1, 2 HAVING count(DISTINCT id) = 1) SELECT c_custkey, u.id AS rep_id FROM (SELECT c_custkey, 'person' || (c_custkey % 60) AS k, CASE WHEN c_custkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS chamber FROM customer) c LEFT JOIN u USING (chamber, k)")
def surname_links(spark, d):
    chamber = lambda c: F.when(c % 2 == 0, "Assembly").otherwise("Senate")
    reps = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("rep_id"), F.concat(F.lit("Person"), F.col("s_suppkey") % 40).alias("last_name"), chamber(F.col("s_suppkey")).alias("chamber"))
    k = F.col("c_custkey")
    rows = _t(spark, d, "customer").select("c_custkey", F.concat(F.when(k % 5 == 0, "A. ").otherwise(""), F.lit("PERSON"), k % 60).alias("name"), chamber(k).alias("chamber"))
    return linkers.by_surname(rows, reps, "name", "chamber", "rep_id", "last_name").select("c_custkey", "rep_id")


@query("WITH r AS (SELECT s_suppkey AS seq, 'ann p' || (s_suppkey % 30) AS n FROM supplier), w AS (SELECT n AS key, arg_max(seq, seq) AS rep_id FROM r GROUP BY 1), l AS (SELECT split_part(n, ' ', 2) AS key, arg_min(seq, seq) AS rep_id FROM r GROUP BY 1) SELECT * FROM w UNION ALL SELECT * FROM l WHERE key NOT IN (SELECT key FROM w)")
def name_index(spark, d):
    reps = _t(spark, d, "supplier").select(F.concat(F.lit("Ann P"), F.col("s_suppkey") % 30).alias("name"), F.col("s_suppkey").alias("rep_id"), F.col("s_suppkey").alias("seq"))
    return linkers.name_index(reps, "name", "rep_id", "seq")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Democratic' WHEN 1 THEN 'Republican' ELSE 'Unknown' END AS party, CASE s_suppkey % 2 WHEN 0 THEN 'support' ELSE 'oppose' END AS side, CASE s_suppkey % 4 WHEN 0 THEN 'individual' WHEN 1 THEN 'committee' ELSE 'other' END AS donor, 'ca-senate-' || s_suppkey AS rep, 'Water supply' AS title, 'P' || s_suppkey AS last, CASE s_suppkey % 2 WHEN 0 THEN 'word-count' END AS fault, s_suppkey % 2 = 0 AS given FROM supplier")
def code_lists(spark, d):
    k = F.col("s_suppkey")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    said = F.when(k % 2 == 0, "Too short").otherwise("This bill changes how water is priced for homes near the river and for farms in the town")
    return _t(spark, d, "supplier").select(
        "s_suppkey", codes.party(pick(3, "(D)", "r", None)).alias("party"), codes.side(pick(2, "s", "OPPOSE")).alias("side"), codes.donor_type(pick(4, "IND", "com", "x", None)).alias("donor"),
        codes.representative_id(F.concat(F.lit("/members/"), k), F.lit("Senate ")).alias("rep"), codes.clean_title(F.concat(F.lit("SB "), k, F.lit(" (Li) Water supply. (PDF)"))).alias("title"), names.last_name(F.concat(F.lit("Ann P"), k, F.lit(", Jr."))).alias("last"),
        codes.explanation_fault(said, F.array().cast("array<string>")).alias("fault"), names.given_names_match(F.lit("Ann"), F.when(k % 2 == 0, "Annabel").otherwise("Bob")).alias("given"),
    )


@query("WITH r AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'Committee on ' ELSE '' END || n_name AS name FROM nation) SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_nationkey ELSE n_nationkey END AS committee_id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def committee_links(spark, d):
    nation = _t(spark, d, "nation")
    right = nation.select(F.col("n_nationkey").alias("committee_id"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Committee on ").otherwise(""), "n_name").alias("name"))
    left = _t(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "Standing Committee on ").otherwise(""), "n_name").alias("name"))
    return linkers.exact_then_unique(left, right, "name", "committee_id").select("c_custkey", "committee_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey * 3 % 360 - 180 > -82.5 THEN 'America/New_York' WHEN s_suppkey * 3 % 360 - 180 > -97.5 THEN 'America/Chicago' WHEN s_suppkey * 3 % 360 - 180 > -112.5 THEN 'America/Denver' WHEN s_suppkey * 3 % 360 - 180 > -127.5 THEN 'America/Los_Angeles' WHEN s_suppkey * 3 % 360 - 180 > -145 THEN 'America/Anchorage' ELSE 'Pacific/Honolulu' END AS zone, CASE s_suppkey % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'tablet' WHEN 2 THEN 'desktop' END AS device, 'Smith Ann' AS name, lpad(CAST(s_suppkey % 90 AS VARCHAR), 2, '0') AS district, CAST(round((1 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END) * 100 / 3) AS INT) AS complete FROM supplier")
def small_functions(spark, d):
    k = F.col("s_suppkey")
    agent = F.get(F.array(*[F.lit(v) for v in ("Chrome Mobile", "iPad Safari", "Firefox", None)]), (k % 4).cast("int"))
    return _t(spark, d, "supplier").select("s_suppkey", scores.time_zone(k * 3 % 360 - 180).alias("zone"), text.device(agent).alias("device"), text.name_order(F.lit("Ann,  Smith")).alias("name"), names.trailing_number(F.concat(F.lit("ca-senate-"), k % 90), 2).alias("district"), scores.completeness([F.lit(True), k % 2 == 0, F.lit(None).cast("boolean")]).alias("complete"))


@query("WITH d AS (SELECT c_custkey AS id, c_name AS a, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS b FROM customer) SELECT id, a, coalesce(b, 'detail ' || id) AS b FROM d")
def detail_enrichment(spark, d):
    from ..sources.records import enrich

    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("b"))
    return enrich(rows, rows.select("id", F.concat(F.lit("detail "), "id").alias("b")), "id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def cited_bills(spark, d):
    cited = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return minutes.to_recheck(_t(spark, d, "customer").select("c_custkey"), cited, "c_custkey").where("recheck").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_by_key(spark, d):
    return merge.first_by(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.asc("o_orderkey"))
