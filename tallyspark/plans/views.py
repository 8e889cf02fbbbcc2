"""Registered queries of the region's lists, details, rankings and forms of filters and groups, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bills, text
from ..operators import checks, feeds, finance, geo, lifecycle, linkers, lists, merge, minutes, petitions, ranking
from .catalog import _t, query

# --- pages


def _paged(columns: str, source: str, where: str, order: str, skip: int, take: int) -> str:
    return f"WITH c AS ({source}), k AS (SELECT * FROM c WHERE {where}) SELECT {columns}, (SELECT count(*) FROM k) AS total, {skip + take} < (SELECT count(*) FROM k) AS has_more FROM k ORDER BY {order} LIMIT {take} OFFSET {skip}"


_SPENT = "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS committee_id, o_orderdate AS date, CAST(o_totalprice AS DOUBLE) AS amount, o_orderpriority AS source_system, CASE WHEN o_orderkey % 3 = 0 THEN 'support' WHEN o_orderkey % 3 = 1 THEN 'oppose' END AS support_or_oppose FROM orders"


def _spent(spark, d):
    o = F.col("o_orderkey")
    return _t(spark, d, "orders").select(o.alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("committee_id"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").cast("double").alias("amount"), F.col("o_orderpriority").alias("source_system"), F.when(o % 3 == 0, "support").when(o % 3 == 1, "oppose").alias("support_or_oppose"))


@query(_paged("id, amount", _SPENT, "committee_id IS NOT NULL AND source_system = '3-MEDIUM'", "date DESC, amount DESC, id", 20, 30))
def expenditures_page(spark, d):
    return lists.attributed(_spent(spark, d), 20, 30, source="3-MEDIUM").select("id", "amount", "total", "has_more")


@query(_paged("id, amount", _SPENT, "committee_id IS NOT NULL AND support_or_oppose = 'oppose'", "date DESC, amount DESC, id", 0, 40))
def independent_page(spark, d):
    return lists.attributed(_spent(spark, d), 0, 40, side="oppose").select("id", "amount", "total", "has_more")


@query(_paged("id, name", "SELECT c_custkey AS id, c_mktsegment AS source_system, c_name AS name FROM customer", "source_system = 'BUILDING'", "name, id", 5, 10))
def committees_page(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("source_system"), F.col("c_name").alias("name"))
    return lists.committees(rows, 5, 10, "BUILDING").select("id", "name", "total", "has_more")


@query(_paged("id, election_date", "SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN DATE '2024-01-01' + CAST(p_size AS INT) END AS election_date, p_retailprice AS created_at FROM part", "true", "election_date DESC NULLS FIRST, created_at DESC NULLS FIRST, id", 10, 60))
def propositions_page(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 > 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int"))).alias("election_date"), F.col("p_retailprice").alias("created_at"))
    return lists.propositions(rows, 10, 60).select("id", "election_date", "total", "has_more")


@query(_paged("id", "SELECT event_id AS id, ts AS scheduled_at FROM events", "true", "scheduled_at DESC NULLS FIRST, id", 3, 25))
def meetings_page(spark, d):
    return lists.meetings(_t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("scheduled_at")), 3, 25).select("id", "total", "has_more")


@query(_paged("id", "SELECT o_orderkey AS id, o_orderdate AS date, o_orderstatus AS body, o_custkey % 2 = 0 AS is_active FROM orders", "is_active AND body = 'O'", "date DESC NULLS FIRST, id", 0, 25))
def minutes_page(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("body"), (F.col("o_custkey") % 2 == 0).alias("is_active"))
    return lists.minutes(rows, 0, 25, "O").select("id", "total", "has_more")


@query(_paged("id", "SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS chamber, s_name AS last_name FROM supplier", "true", "chamber, last_name, id", 4, 20))
def representatives_page(spark, d):
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "Assembly").otherwise("Senate").alias("chamber"), F.col("s_name").alias("last_name"))
    return lists.representatives(rows, 4, 20).select("id", "total", "has_more")


# --- counties, committees, sessions


@query("""WITH h AS (SELECT c_custkey AS user_id, n_nationkey AS j, '06' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS fips, n_name AS region, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 AND n_regionkey < 4)
SELECT user_id, s_suppkey AS rep_id FROM h JOIN supplier ON s_nationkey = j WHERE n_regionkey <> 1 AND s_suppkey % 2 = 0 AND s_acctbal >= 0""")
def county_supervisors(spark, d):
    nation = _t(spark, d, "nation")
    fips = F.concat(F.lit("06"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    homes = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("jurisdiction_id"), (F.col("c_acctbal") > 0).alias("is_primary"))
    jurisdictions = nation.select(F.col("n_nationkey").alias("jurisdiction_id"), F.when(F.col("n_regionkey") < 4, "COUNTY").otherwise("CITY").alias("type"), fips.alias("fips_code"))
    plugins = nation.select(fips.alias("fips_code"), F.col("n_name").alias("region"), (F.col("n_regionkey") != 1).alias("enabled"))
    reps = _t(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("rep_id"), F.col("n_name").alias("region"), F.when(F.col("s_suppkey") % 2 == 0, lists.SUPERVISORS).otherwise("Senate").alias("chamber"), F.when(F.col("s_acctbal") < 0, F.lit("2024-01-01")).alias("deleted_at"))
    return lists.county_supervisors(homes, jurisdictions, plugins, reps).select("user_id", "rep_id")


_SEATED = "SELECT s_nationkey AS committee_id, s_suppkey AS rep_id, s_name AS last_name, CASE s_suppkey % 4 WHEN 0 THEN 'Chair' WHEN 1 THEN 'Vice Chair' WHEN 2 THEN 'Member' END AS role FROM supplier"
_HEARD = "SELECT c_custkey AS meeting_id, 'Assembly' AS body, 'The ' || n_name || 's hearing ' || c_mktsegment AS title, DATE '2024-01-01' - CAST(c_custkey % 500 AS INT) AS held, CASE WHEN c_custkey % 2 = 0 THEN 'https://x/' || c_custkey END AS url FROM customer JOIN nation ON n_nationkey = c_nationkey"


@query(f"""WITH c AS (SELECT n_nationkey AS committee_id, left(n_name, 5) AS name FROM nation WHERE n_regionkey <> 2), m AS (SELECT committee_id, string_agg(coalesce(role, '-') || ':' || rep_id, ',' ORDER BY CASE role WHEN 'Chair' THEN 0 WHEN 'Vice Chair' THEN 1 WHEN 'Member' THEN 2 ELSE 3 END, last_name, rep_id) AS members, count(*) AS n FROM ({_SEATED}) GROUP BY 1),
j AS (SELECT c.committee_id, h.*, row_number() OVER (PARTITION BY c.committee_id, title, held ORDER BY url IS NULL, meeting_id) AS k FROM c JOIN ({_HEARD}) h ON contains(lower(title), lower(name)) WHERE held >= DATE '2023-01-01'), o AS (SELECT *, row_number() OVER (PARTITION BY committee_id ORDER BY held DESC, title) AS rank FROM j WHERE k = 1),
g AS (SELECT committee_id, string_agg(CAST(meeting_id AS VARCHAR), ',' ORDER BY rank) AS hearings FROM o WHERE rank <= 5 GROUP BY 1)
SELECT committee_id, coalesce(n, 0) AS member_count, coalesce(members, '') AS members, coalesce(hearings, '') AS hearings FROM c LEFT JOIN m USING (committee_id) LEFT JOIN g USING (committee_id)""")
def committee_details(spark, d):
    nation = _t(spark, d, "nation")
    committees = nation.select(F.col("n_nationkey").alias("committee_id"), F.left("n_name", F.lit(5)).alias("name"), F.lit("Assembly").alias("chamber"), F.when(F.col("n_regionkey") == 2, F.lit("2024-01-01")).alias("deleted_at"))
    s = F.col("s_suppkey") % 4
    seats = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("committee_id"), F.col("s_suppkey").alias("rep_id"), F.when(s == 0, "Chair").when(s == 1, "Vice Chair").when(s == 2, "Member").alias("role"))
    reps = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("rep_id"), F.col("s_name").alias("name"), F.col("s_name").alias("last_name"), F.lit("x").alias("party"))
    k = F.col("c_custkey")
    meetings = _t(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(k.alias("meeting_id"), F.lit("Assembly").alias("body"), F.concat(F.lit("The "), "n_name", F.lit("s hearing "), "c_mktsegment").alias("title"), F.date_sub(F.lit("2024-01-01").cast("date"), (k % 500).cast("int")).alias("scheduled_at"), F.when(k % 2 == 0, F.concat(F.lit("https://x/"), k)).alias("agenda_url"))
    out = lists.committee_details(committees, seats, reps, meetings, F.lit("2024-01-01").cast("date"))
    return out.select("committee_id", "member_count", F.array_join(F.transform("members", lambda m: F.concat_ws(":", F.coalesce(m["role"], F.lit("-")), m["rep_id"])), ",").alias("members"), F.array_join(F.transform("hearings", lambda h: h["meeting_id"].cast("string")), ",").alias("hearings"))


@query("WITH s AS (SELECT user_id, event_id, ts, event_type = 'view' AS current FROM events WHERE value > 30) SELECT user_id, event_id AS session_id, current AS is_current, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM s")
def user_sessions(spark, d):
    rows = _t(spark, d, "events").select("user_id", F.col("event_id").alias("session_id"), F.col("event_type").alias("token"), (F.col("value") > 30).alias("is_active"), F.col("ts").alias("last_activity_at"), F.col("ts").alias("created_at"))
    return lists.sessions(rows, F.lit("view")).select("user_id", "session_id", "is_current", F.col("place").cast("long"), "total")


# --- rankings


def _asked_of(spark, d):
    """Customers as users beside all suppliers of their nation, with every user's pairs in one partition."""
    users = _t(spark, d, "customer").withColumnsRenamed({"c_custkey": "user_id", "c_nationkey": "nation"})
    return merge.pairs_of(users, _t(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation"), "nation", "user_id")


_WORDS = {"is_renter": ("steel", "brushed"), "is_parent": ("economy",), "is_driver": ("small plated", "tin"), "is_worker": ("nickel",)}
_ON = lambda words: "(?i)(^|[^A-Za-z0-9_])(" + "|".join(words) + ")([^A-Za-z0-9_]|$)"


@query(f"""WITH m AS (SELECT p_partkey AS id, p_brand, p_type || '. ' || p_name AS text, p_size * 8 AS days FROM part WHERE p_size % 10 > 1 AND p_size % 7 <> 0),
u AS (SELECT s_suppkey AS user_id, 'Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) AS p_brand, s_suppkey % 2 = 0 AS renter, s_suppkey % 3 = 0 AS driver FROM supplier),
s AS (SELECT user_id, id, least(((renter AND regexp_matches(text, '{_ON(_WORDS["is_renter"])}'))::INT + (driver AND regexp_matches(text, '{_ON(_WORDS["is_driver"])}'))::INT + regexp_matches(text, '{_ON(_WORDS["is_worker"])}')::INT) * 0.2::DOUBLE, 1.0) AS material,
(regexp_matches(text, '{_ON(["copper"])}')::INT + regexp_matches(text, '{_ON(["standard"])}')::INT) / 2 AS alignment, CASE WHEN days <= 30 THEN 1.0 WHEN days <= 90 THEN 1.0::DOUBLE - (days - 30)::DOUBLE / 60 * 0.6::DOUBLE WHEN days <= 365 THEN 0.4::DOUBLE - (days - 90)::DOUBLE / 275 * 0.4::DOUBLE ELSE 0.0 END::DOUBLE AS proximity FROM m JOIN u USING (p_brand)),
c AS (SELECT *, material * 0.5::DOUBLE + alignment * 0.3::DOUBLE + proximity * 0.2::DOUBLE AS score FROM s WHERE material > 0 OR alignment > 0), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS rank FROM c) SELECT user_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def proposition_ranking(spark, d):
    day = F.lit("2024-01-01").cast("date")
    size = F.col("p_size")
    measures = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.concat("p_type", F.lit(". "), "p_name").alias("text"), F.date_add(day, (size * 8).cast("int")).alias("election_date"), F.when(size % 10 > 1, "active").otherwise("closed").alias("status"), F.when(size % 7 == 0, F.lit("gone")).alias("deleted_at"))
    k = F.col("s_suppkey")
    flags = F.filter(F.array(F.when(k % 2 == 0, "is_renter"), F.when(k % 3 == 0, "is_driver"), F.lit("is_worker")), lambda x: x.isNotNull())
    profiles = _t(spark, d, "supplier").select(k.alias("user_id"), F.concat(F.lit("Brand#"), k % 5 + 1, F.col("s_nationkey") % 5 + 1).alias("p_brand"), flags.alias("flags"), F.array(F.lit("copper"), F.lit("Standard")).alias("tags"))
    return ranking.rank_propositions(measures, profiles, day, 10, "p_brand", _WORDS).select("user_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("""WITH asked AS (SELECT c_custkey AS user_id, s_suppkey AS rep_id, s_nationkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS chamber FROM customer JOIN supplier ON s_nationkey = c_nationkey),
i AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS bill, CASE WHEN l_partkey % 3 = 0 THEN 'Senate' ELSE 'Assembly' END AS chamber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10), ic AS (SELECT user_id, chamber, count(*) AS n FROM i GROUP BY 1, 2), ia AS (SELECT user_id, count(*) AS n FROM i GROUP BY 1),
p AS (SELECT DISTINCT l_suppkey AS rep_id, l_partkey AS bill, CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.4 ELSE 0.2 END::DOUBLE AS w FROM lineitem),
b AS (SELECT a.user_id, a.rep_id, i.bill, max(w) AS w FROM asked a JOIN i ON i.user_id = a.user_id JOIN p ON p.rep_id = a.rep_id AND p.bill = i.bill GROUP BY 1, 2, 3),
bb AS (SELECT *, row_number() OVER (PARTITION BY user_id, rep_id ORDER BY w DESC, bill) AS k FROM b), ac AS (SELECT user_id, rep_id, least(round(sum(w), 9) / 3, 1.0) AS action, string_agg(bill, ',' ORDER BY k) FILTER (WHERE k <= 3) AS recent FROM bb GROUP BY 1, 2),
sc AS (SELECT a.user_id, a.rep_id, coalesce(ic.n / ia.n, 0) AS chamber_score, (contains(' ' || lower(n_name) || ' ', ' united ') OR lower(n_name) = 'china')::INT / 2 + 0.5 * (r_name = 'ASIA')::INT AS committee_score, coalesce(action, 0) AS action_score, coalesce(recent, '') AS recent
FROM asked a JOIN nation ON n_nationkey = a.n JOIN region ON r_regionkey = n_regionkey LEFT JOIN ic ON ic.user_id = a.user_id AND ic.chamber = a.chamber LEFT JOIN ia ON ia.user_id = a.user_id LEFT JOIN ac ON ac.user_id = a.user_id AND ac.rep_id = a.rep_id)
SELECT user_id, rep_id, round(chamber_score * 0.2::DOUBLE + committee_score * 0.3::DOUBLE + action_score * 0.5::DOUBLE, 6) AS score, recent FROM sc""")
def representative_ranking(spark, d):
    supplier, nation = _t(spark, d, "supplier"), _t(spark, d, "nation")
    users = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.array(F.lit("united"), F.lit("China"), F.lit("asia")).alias("tags"), F.col("c_nationkey").alias("nation"))
    reps = supplier.select(F.col("s_suppkey").alias("rep_id"), F.when(F.col("s_suppkey") % 2 == 0, "Assembly").otherwise("Senate").alias("chamber"), F.col("s_nationkey").alias("nation"))
    named = nation.join(_t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    seats = supplier.join(named, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("rep_id"), F.explode(F.array("n_name", "r_name")).alias("committee"))
    lines = _t(spark, d, "lineitem")
    role = F.element_at(F.array(*map(F.lit, ("author", "co_author", "yes", "no"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    parts = lines.select(F.col("l_suppkey").alias("rep_id"), F.col("l_partkey").alias("bill"), role.alias("role"))
    bought = lines.where("l_quantity > 10").join(_t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    interest = bought.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("bill"), F.when(F.col("l_partkey") % 3 == 0, "Senate").otherwise("Assembly").alias("chamber")).repartition("user_id").distinct()
    rounded = F.floor(F.col("score") * 1e6 + 0.5) / F.lit(1e6)  # scores are not negative; round() would write each as decimal digits and read them again
    recent = F.when(F.size("recent") > 0, F.array_join("recent", ",")).otherwise("")
    return ranking.rank_representatives(None, users, reps, seats, parts, interest, "nation").select("user_id", "rep_id", rounded.alias("score"), recent.alias("recent"))


# --- forms of filters and groups


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view') AND json_extract_string(props, '$.k') IS NOT NULL AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def excluded_kinds(spark, d):
    e = _t(spark, d, "events")
    rows = feeds.with_json(feeds.excluded(e, event_type=["click", "view"]), "props", "$.k")
    return feeds.with_some(rows, e, "user_id", (F.col("event_type") == "purchase") & (F.col("value") > 90)).select("event_id")


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS n, c_mktsegment AS s, CAST(c_acctbal AS DOUBLE) AS b FROM customer)
SELECT n, min(b) FILTER (WHERE s = 'BUILDING') AS least, count(DISTINCT CAST(floor(b) AS BIGINT) % 97) FILTER (WHERE b > 0) AS kinds, count(DISTINCT (n, s)) AS segments, max(CASE WHEN s = 'AUTOMOBILE' THEN b END) AS most FROM c GROUP BY 1""")
def filtered_groups(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), F.col("c_acctbal").cast("double").alias("b"))
    whole = F.floor("b").cast("long")
    kinds = merge.first_by(c.select("n", "s").withColumn("one", F.lit(1)), ["n", "s"], F.asc("one")).groupBy("n").agg(F.count(F.lit(1)).alias("segments"))
    return c.groupBy("n").agg(F.min(F.when(F.col("s") == "BUILDING", F.col("b"))).alias("least"), F.countDistinct(F.when(F.col("b") > 0, whole % 97)).alias("kinds"), F.max(F.when(F.col("s") == "AUTOMOBILE", F.col("b"))).alias("most")).join(kinds, "n")


@query("""SELECT doc_id, sha256(text) AS checksum, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS words, left(text, 80) AS shown, lower(lang) = 'en' AS english, contains(lower(text), 'tion') AS holds FROM documents WHERE text IS NOT NULL""")
def text_forms(spark, d):
    c = F.col("text")
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(c, 256).alias("checksum"), text.word_count(F.regexp_replace(c, r"^\s+|\s+$", "")).cast("long").alias("words"), F.left(c, F.lit(80)).alias("shown"), (F.lower("lang") == "en").alias("english"), text.contains_ci(c, "TION").alias("holds"))


@query("""WITH r AS (SELECT c_custkey AS user_id, s_suppkey AS entity_id, CAST(c_acctbal AS DOUBLE) / 100 AS score FROM customer JOIN supplier ON s_nationkey = c_nationkey)
SELECT user_id, entity_id, CASE WHEN (user_id + entity_id) % 5 = 0 AND entity_id % 2 = 0 THEN 1.5 ELSE score END AS score, CASE WHEN (user_id + entity_id) % 5 = 0 AND entity_id % 2 = 0 THEN 'because ' || entity_id END AS explanation FROM r""")
def cached_scores(spark, d):
    """Cached scores and explanations laid over the rows' own while they last."""
    rows = _asked_of(spark, d).select("user_id", F.col("s_suppkey").alias("entity_id"), (F.col("c_acctbal").cast("double") / 100).alias("score"))
    some = rows.where((F.col("user_id") + F.col("entity_id")) % 5 == 0)
    cache = some.select("user_id", "entity_id", F.lit(1.5).alias("score"), F.concat(F.lit("because "), "entity_id").alias("explanation"), F.when(F.col("entity_id") % 2 == 0, "2024-06-01").otherwise("2023-06-01").cast("timestamp").alias("expires_at"))
    return ranking.with_cache(rows, cache, F.lit("2024-01-01").cast("timestamp"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' AND o_orderpriority = '1-URGENT'")
def valid_briefings(spark, d):
    cache = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("expires_at"), F.col("o_orderpriority").alias("template_hash"))
    return lifecycle.valid(cache, F.lit("1995-06-01").cast("timestamp"), "1-URGENT").select("id")


@query("SELECT unnest(['name', 'phone', 'balance']) AS field, unnest([0.0, avg(CASE WHEN c_nationkey % 4 = 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END)]) AS ratio, unnest([false, avg(CASE WHEN c_nationkey % 4 = 0 THEN 1.0 ELSE 0.0 END) >= 0.5, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) >= 0.5]) AS reported FROM customer")
def field_misses(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_name")).alias("phone"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return checks.missing_ratios(c, ["name", "phone", "balance"]).withColumn("reported", F.col("ratio") >= checks.MISSING_ERROR)


@query("SELECT event_id, round(CAST((event_id * 37) % 3600 AS DOUBLE) / 10 - 180 + 0.00123, 2) AS lon, round(CAST((event_id * 91) % 1700 AS DOUBLE) / 10 - 85 + 0.00123, 2) AS lat FROM events")
def map_grid(spark, d):
    e = F.col("event_id")
    return _t(spark, d, "events").select("event_id", geo.grid(((e * 37) % 3600).cast("double") / 10 - 180 + 0.00123).cast("double").alias("lon"), geo.grid(((e * 91) % 1700).cast("double") / 10 - 85 + 0.00123).cast("double").alias("lat"))


@query("SELECT o_custkey, max(o_shippriority_v) AS version, max(o_shippriority_v) + 1 AS next FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o_shippriority_v FROM orders) GROUP BY 1")
def next_versions(spark, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return finance.latest_version(_t(spark, d, "orders").select("o_custkey", place.alias("version")), "o_custkey", "version").withColumn("next", F.col("version") + 1)


# --- petitions, members, bills

_SCANS = "SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'petition' ELSE 'other' END AS type, CASE WHEN user_id % 9 <> 0 THEN 'h' || user_id % 60 END AS content_hash, CASE WHEN event_id % 3 = 0 THEN 'summary ' || event_id % 7 END AS summary, CASE WHEN event_id % 4 <> 1 THEN floor(value * 100)::DOUBLE / 1000::DOUBLE - 100.0002::DOUBLE END AS lon, floor(value * 50)::DOUBLE / 1000::DOUBLE + 30.0002::DOUBLE AS lat, ts AS created_at, CASE WHEN event_id % 10 = 7 THEN 1 END AS deleted_at FROM events"
_NOW = "(SELECT max(ts) FROM events)"


def _scans(spark, d):
    e, k = _t(spark, d, "events"), F.col("event_id")
    rows = e.select(
        k.alias("id"), F.when(F.col("event_type").isin("click", "view", "purchase"), "petition").otherwise("other").alias("type"), F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("h"), F.col("user_id") % 60)).alias("content_hash"), F.when(k % 3 == 0, F.concat(F.lit("summary "), k % 7)).alias("summary"),
        F.when(k % 4 != 1, F.floor(F.col("value") * 100) / 1000 - 100.0002).alias("lon"), (F.floor(F.col("value") * 50) / 1000 + 30.0002).alias("lat"), F.col("ts").alias("created_at"), F.when(k % 10 == 7, 1).alias("deleted_at"),
    )
    return rows, F.lit(e.agg(F.max("ts")).first()[0])


@query(f"""WITH s AS ({_SCANS}), b AS (SELECT * FROM s WHERE type = 'petition' AND deleted_at IS NULL AND created_at >= {_NOW} - INTERVAL 240 HOURS)
SELECT content_hash, coalesce(max(summary), 'Petition scan recorded') AS summary, count(*) AS scans, count(DISTINCT (round(lat, 2), round(lon, 2))) FILTER (WHERE lon IS NOT NULL) AS locations, max(created_at) AS latest, min(created_at) AS earliest FROM b WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def petition_feed(spark, d):
    rows, now = _scans(spark, d)
    return petitions.feed(rows, now, hours=240)


@query(f"""WITH s AS ({_SCANS}), b AS (SELECT * FROM s WHERE type = 'petition' AND deleted_at IS NULL AND created_at >= {_NOW} - INTERVAL 24 HOURS), f AS (SELECT content_hash, count(*) AS n, max(created_at) AS latest FROM b WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), h AS (SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM b GROUP BY 1)
SELECT (SELECT coalesce(string_agg(content_hash || ':' || n, ',' ORDER BY latest DESC, content_hash), '') FROM f) AS items, (SELECT coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY hour), '') FROM h) AS hours, count(*) AS total_scans, count(DISTINCT content_hash) AS active_petitions FROM b""")
def petition_day(spark, d):
    rows, now = _scans(spark, d)
    out = petitions.day(rows, now, least=2)
    return out.select(F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["content_hash"], x["scans"])), ",").alias("items"), F.array_join(F.transform("hours", lambda x: x["scans"].cast("string")), ",").alias("hours"), "total_scans", "active_petitions")


@query(f"WITH s AS ({_SCANS}), m AS (SELECT * FROM s WHERE lon > -98 AND lon < -92 AND lat > 31 AND lat < 34 AND type = 'petition' AND created_at >= {_NOW} - INTERVAL 20 DAYS) SELECT id, lat, lon, (SELECT count(*) FROM m) AS total FROM m ORDER BY created_at DESC, id LIMIT 50")
def petition_markers(spark, d):
    rows, now = _scans(spark, d)
    return petitions.markers(rows, (-98.0, 31.0, -92.0, 34.0), "petition", now - F.make_dt_interval(F.lit(20)), most=50).select("id", "lat", "lon", "total")


@query(f"WITH s AS ({_SCANS}) SELECT count(*) AS total, count(lon) AS with_location, count(*) FILTER (WHERE created_at >= {_NOW} - INTERVAL 7 DAYS) AS recent FROM s WHERE type = 'petition' AND deleted_at IS NULL")
def petition_stats(spark, d):
    rows, now = _scans(spark, d)
    return petitions.stats(rows, now)


_ACTS = "SELECT l_suppkey AS representative_id, CASE WHEN l_partkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS body, CAST(l_shipdate AS DATE) AS date, CASE l_linenumber % 5 WHEN 0 THEN 'presence' WHEN 1 THEN 'presence' WHEN 2 THEN 'vote' WHEN 3 THEN 'amendment' ELSE 'resolution' END AS kind, CASE WHEN l_returnflag = 'A' THEN 'absent' WHEN l_returnflag = 'R' THEN 'yes' END AS position FROM lineitem"


@query(f"""WITH a AS (SELECT * FROM ({_ACTS}) WHERE date >= DATE '1995-01-01'), r AS (SELECT s_suppkey AS rep_id, CASE WHEN s_nationkey % 2 = 0 THEN 'Assembly' ELSE 'Senate' END AS chamber FROM supplier), b AS (SELECT body, count(DISTINCT date) AS n FROM a WHERE kind = 'presence' GROUP BY 1),
o AS (SELECT representative_id, count(DISTINCT date) FILTER (WHERE kind = 'presence' AND position = 'yes') AS p, count(DISTINCT date) FILTER (WHERE kind = 'presence' AND position = 'absent') AS x, count(*) FILTER (WHERE kind = 'vote') AS v, count(*) FILTER (WHERE kind = 'amendment') AS m, count(*) FILTER (WHERE kind = 'resolution') AS s FROM a GROUP BY 1)
SELECT rep_id, coalesce(p, 0) AS present_days, coalesce(x, 0) AS absent_days, coalesce(b.n, 0) AS session_days, coalesce(v, 0) AS n_vote, coalesce(m, 0) AS n_amendment, coalesce(s, 0) AS n_resolution, 0 AS n_speech FROM r LEFT JOIN o ON representative_id = rep_id LEFT JOIN b ON body = chamber""")
def member_activity(spark, d):
    n = F.col("l_linenumber") % 5
    acts = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("representative_id"), F.when(F.col("l_partkey") % 2 == 0, "Assembly").otherwise("Senate").alias("body"), F.col("l_shipdate").cast("date").alias("date"), F.when(n < 2, "presence").when(n == 2, "vote").when(n == 3, "amendment").otherwise("resolution").alias("kind"), F.when(F.col("l_returnflag") == "A", "absent").when(F.col("l_returnflag") == "R", "yes").alias("position"))
    reps = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("rep_id"), F.when(F.col("s_nationkey") % 2 == 0, "Assembly").otherwise("Senate").alias("chamber"))
    out = feeds.member_activity(acts, reps, F.lit("1995-01-01").cast("date"))
    return out.select("rep_id", "present_days", "absent_days", "session_days", "n_vote", "n_amendment", "n_resolution", F.col("n_speech").cast("int"))


@query("""WITH b AS (SELECT o_orderkey AS bill_id, 'AB ' || o_orderkey AS number, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 10 = 3) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 4 = 1)),
p AS (SELECT * FROM b ORDER BY day DESC NULLS FIRST, number, bill_id LIMIT 30 OFFSET 10), v AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_shipdate DESC, l_linenumber DESC, l_returnflag DESC) AS votes FROM lineitem GROUP BY 1), w AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT bill_id, votes, n AS co_authors, (SELECT count(*) FROM b) AS total, 40 < (SELECT count(*) FROM b) AS has_more FROM p LEFT JOIN v ON v.l_orderkey = bill_id LEFT JOIN w ON w.l_orderkey = bill_id""")
def bills_page(spark, d):
    lines = _t(spark, d, "lineitem")
    bills = _t(spark, d, "orders").select(F.col("o_orderkey").alias("bill_id"), F.concat(F.lit("AB "), "o_orderkey").alias("number"), F.col("o_orderdate").cast("date").alias("last_action_date"), (F.col("o_orderstatus") == "O").alias("is_active"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "AB").otherwise("SB").alias("measure_type"))
    votes = lines.select(F.col("l_orderkey").alias("bill_id"), F.col("l_shipdate").alias("vote_date"), F.col("l_linenumber").alias("name"), F.col("l_returnflag").alias("position"))
    wrote = lines.select(F.col("l_orderkey").alias("bill_id"), (F.col("l_suppkey") % 10).alias("representative_id"), F.col("l_linenumber").alias("name"))
    referred = lines.select(F.col("l_orderkey").alias("bill_id"), (F.col("l_partkey") % 4).alias("committee_id"))
    out = feeds.bills_page(bills, votes, wrote, referred, 10, 30, measure="AB", committee=1, co_author=3)
    return out.select("bill_id", F.array_join(F.transform("votes", lambda v: F.concat_ws(":", v["name"], v["position"])), ",").alias("votes"), F.size("co_authors").cast("long").alias("co_authors"), "total", "has_more")


@query("""WITH r AS (SELECT c_custkey AS user_id, s_suppkey AS entity_id, CAST(c_acctbal AS DOUBLE) AS score FROM customer JOIN supplier ON s_nationkey = c_nationkey)
SELECT user_id, entity_id, score, CASE WHEN entity_id % 4 = 0 THEN NULL ELSE 'new ' || entity_id END AS explanation, CASE WHEN entity_id % 4 = 0 THEN TIMESTAMP '2024-01-01 00:30:00' ELSE TIMESTAMP '2024-01-08' END AS expires_at FROM r WHERE user_id % 3 = 0 UNION ALL SELECT user_id, entity_id, score, 'old', TIMESTAMP '2024-01-02' FROM r WHERE user_id % 3 <> 0 AND entity_id % 2 = 0""")
def rerank_cache(spark, d):
    """The cache of scores after a run's answers have come."""
    rows = _asked_of(spark, d).select("user_id", F.col("s_suppkey").alias("entity_id"), F.col("c_acctbal").cast("double").alias("score"))
    cache = rows.withColumn("explanation", F.lit("old")).withColumn("expires_at", F.when(F.col("entity_id") % 2 == 0, "2024-01-02").otherwise("2023-12-31").cast("timestamp_ntz"))
    answers = rows.where("user_id % 3 = 0").withColumn("explanation", F.when(F.col("entity_id") % 4 != 0, F.concat(F.lit("new "), "entity_id")))
    return ranking.cache_after(cache, answers, F.lit("2024-01-01").cast("timestamp_ntz"))


@query("""WITH r AS (SELECT s_suppkey AS seq, 'ann p' || (s_suppkey % 30) AS n FROM supplier), w AS (SELECT n AS key, max(seq) AS rep FROM r GROUP BY 1), l AS (SELECT split_part(n, ' ', 2) AS key, min(seq) AS rep FROM r GROUP BY 1), i AS (SELECT * FROM w UNION ALL SELECT * FROM l WHERE key NOT IN (SELECT key FROM w))
SELECT c_custkey, coalesce(a.rep, b.rep) AS rep_id FROM customer LEFT JOIN i a ON a.key = CASE WHEN c_custkey % 2 = 0 THEN 'ann p' ELSE 'bob p' END || c_custkey % 40 LEFT JOIN i b ON b.key = 'p' || c_custkey % 40""")
def name_links(spark, d):
    reps = _t(spark, d, "supplier").select(F.concat(F.lit("Ann P"), F.col("s_suppkey") % 30).alias("name"), F.col("s_suppkey").alias("rep_id"), F.col("s_suppkey").alias("seq"))
    rows = _t(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, " Ann  P").otherwise("BOB p"), F.col("c_custkey") % 40).alias("name"))
    return linkers.by_name_index(rows, linkers.name_index(reps, "name", "rep_id", "seq"), "name", "rep_id").select("c_custkey", "rep_id")


@query("SELECT page_id, upper(u) AS upper, lower(u) AS lower, regexp_replace(html, '<[^>]*(>|$)', '', 'g') = regexp_replace(html, '<[^>]*(>|$)', '', 'g') AS plain, regexp_replace(u, '[0-9]+', '#', 'g') AS numbers, u AS same, regexp_extract(u, '^(https?://[^/?#]*)', 1) || '/x/y' AS whole FROM (SELECT *, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_replace(url, '^https?://[^/?#]*', '') AS u FROM pages)")
def rule_transforms(spark, d):
    """The transforms that rules may name, on every page's address."""
    site = F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)
    rows = _t(spark, d, "pages").select("page_id", "html", F.concat(F.lower(site), F.regexp_replace("url", r"^https?://[^/?#]*", "")).alias("u"))
    c = F.col("u")
    return rows.select(
        "page_id", text.transformed(c, "uppercase").alias("upper"), text.transformed(c, "lowercase").alias("lower"), text.transformed(F.col("html"), "strip_html").isNotNull().alias("plain"), text.transformed(c, "regex_replace", pattern="[0-9]+", replacement="#").alias("numbers"),
        text.transformed(c, "regex").alias("same"), text.transformed(F.lit("/a/../x/./y"), "url_resolve", base=c).alias("whole"),
    )


# --- bills' keys and analyses


@query("""SELECT o_orderkey, regexp_replace(CASE WHEN o_custkey % 4 > 0 THEN '2023-2024' ELSE '' END, '[^0-9]', '', 'g') || CASE o_orderstatus WHEN 'F' THEN 'AB' WHEN 'O' THEN 'scr' ELSE '' END || o_orderkey AS external_id, CASE o_orderstatus WHEN 'F' THEN 'AB' WHEN 'O' THEN 'SCR' END AS measure,
CASE WHEN o_custkey % 3 = 0 THEN '2021-2022' WHEN o_custkey % 3 = 1 THEN year(o_orderdate) || '-' || year(o_orderdate) + 1 ELSE '2019-2020' END AS session FROM orders""")
def bill_keys(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.concat(F.when(F.col("o_orderstatus") == "F", "AB ").when(F.col("o_orderstatus") == "O", " scr  ").otherwise(""), k)
    url = F.when(c % 3 == 0, F.concat(F.lit("https://x.example/b?v=20192020&bill_id=20212022AB"), k)).when(c % 3 == 1, F.concat(F.lit("https://x.example/b?bill_id=19991234"), F.lit("AB"))).otherwise(F.concat(F.lit("https://x.example/20192020/"), k))
    rows = _t(spark, d, "orders").select("o_orderkey", number.alias("number"), url.alias("url"), F.when(c % 4 > 0, "2023-2024").alias("session"), F.year("o_orderdate").alias("year"))
    return rows.select("o_orderkey", bills.external_id(F.col("session"), F.col("number")).alias("external_id"), bills.measure_type(F.col("number")).alias("measure"), bills.session_of(F.col("url"), F.col("year")).alias("session"))


_ANALYSIS = "'{{\"skip\": ' || CASE {k} % 5 WHEN 0 THEN 'true' WHEN 1 THEN '\"true\"' ELSE 'false' END || ', \"topics\": [\"' || {t} || '\", 3, null, \"b\"], \"whoItAffects\": ' || CASE WHEN {k} % 2 = 0 THEN '[]' ELSE '\"all\"' END || CASE WHEN {k} % 3 = 0 THEN ', \"plainEnglishSummary\": \"p\", \"stakeholderImpact\": \"s\", \"fiscalImpact\": {{\"level\": \"low\", \"summary\": \"' || {t} || '\"}}' ELSE '' END || '}}'"


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_type || ',b' END AS topics, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 6 = 0 THEN p_type END AS fiscal FROM part")
def bill_analyses(spark, d):
    """What may be ranked of analyses, and which are whole; some are to be skipped, some lack parts, and their arrays hold other things than texts."""
    rows = _t(spark, d, "part").select("p_partkey", F.expr(_ANALYSIS.format(k="p_partkey", t="p_type")).alias("j"))
    return rows.select("p_partkey", F.array_join(bills.rankable(F.col("j"))["topics"], ",").alias("topics"), bills.summary(F.col("j"))["fiscal"]["summary"].alias("fiscal"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS b FROM orders")
def archive_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    name = F.concat(F.lit("/adj"), F.when(F.year(day) < 2000, F.date_format(day, "MMdd")).otherwise(F.date_format(day, "MMdd")), F.date_format(day, "yyyy"), F.lit(".pdf"))
    long = bills.archive_date(name, F.lit(""), r"adj(\d\d)(\d\d)(\d{4})", "MM/DD/YYYY")
    anchor = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("of "), F.date_format(day, "yyyy-MM-dd"))).otherwise("of 2020-02-31")
    return _t(spark, d, "orders").select("o_orderkey", long.alias("a"), bills.archive_date(F.lit("/none"), anchor, r"(\d{4})-(\d\d)-(\d\d)", "YYYY-MM-DD").alias("b"))


@query("SELECT c_custkey, c_nationkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' END AS at FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, NULL, c_mktsegment, NULL FROM customer WHERE c_custkey % 5 > 0")
def json_array_rows(spark, d):
    """Objects of JSON arrays as rows; what is no array has none."""
    k = F.col("c_custkey")
    at = F.when(k % 2 == 0, '"2024-01-01 10:00:00"').otherwise("null")
    said = F.concat(F.lit('[{"k": '), "c_nationkey", F.lit(', "name": "'), "c_name", F.lit('", "at": '), at, F.lit('}, {"k": "x", "name": "'), "c_mktsegment", F.lit('"}]'))
    rows = _t(spark, d, "customer").select("c_custkey", F.when(k % 5 > 0, said).otherwise('{"k": 1}').alias("j"))
    return bills.json_rows(rows, "j", {"k": "bigint", "name": "string", "at": "timestamp_ntz"}, ("c_custkey",))


# --- links of texts, merged blocks, votes

_NAMED_TEXTS = "SELECT d.doc_id, n.n_nationkey AS id FROM documents d, (SELECT n_nationkey, left(n_name, 4) AS name FROM nation) n WHERE contains(lower(d.text), lower(n.name))"


@query(f"""WITH f AS ({_NAMED_TEXTS}), s AS (SELECT doc_id, CAST(doc_id % 25 AS INT) AS id, CASE WHEN doc_id % 3 = 0 THEN 'manual' ELSE 'auto' END AS source FROM documents)
SELECT doc_id, id, source FROM s WHERE source = 'manual' OR (doc_id, id) IN (SELECT doc_id, id FROM f) UNION ALL SELECT doc_id, id, 'auto' FROM f WHERE (doc_id, id) NOT IN (SELECT doc_id, id FROM s)""")
def text_links(spark, d):
    """Links of texts to names they hold, after all texts have been read again; some links were made by hand."""
    docs, nation = _t(spark, d, "documents"), _t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.left("n_name", F.lit(4)).alias("name"))
    found = linkers.all_containing(docs, nation, "text", "name", "id", "doc_id", most=7)
    stored = docs.select("doc_id", (F.col("doc_id") % 25).cast("int").alias("id"), F.when(F.col("doc_id") % 3 == 0, "manual").otherwise("auto").alias("source"))
    return linkers.links_after(stored, found, docs, "doc_id", "id")


@query("""WITH r AS (SELECT o_custkey AS region, o_orderkey AS made, l_linenumber AS n, 'w' || l_partkey % 9 AS slug, l_suppkey AS term, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey), k AS (SELECT *, row_number() OVER (PARTITION BY region, slug ORDER BY made DESC, place) AS i FROM r) SELECT region, slug, term FROM k WHERE i = 1""")
def civics_blocks(spark, d):
    """One entry for each word of a region: that of the newest block that has it."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    blocks = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items")).join(_t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    blocks = blocks.select(F.col("o_custkey").alias("region"), F.col("o_orderkey").alias("at"), F.transform("items", lambda x: F.struct(F.concat(F.lit("w"), x["l_partkey"] % 9).alias("slug"), x["l_suppkey"].alias("term"))).alias("glossary"))
    return minutes.merge_blocks(blocks, "region", "at", "glossary", "slug")


@query("SELECT l_orderkey AS id, 'motion ' || l_linenumber AS motion, 'm' || l_suppkey AS name, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'absent' END AS position FROM lineitem")
def roll_call_votes(spark, d):
    said = F.when(F.col("l_returnflag") == "A", " Ayes").when(F.col("l_returnflag") == "R", "NAY ").otherwise("excused, absent")
    member = F.struct(F.concat(F.lit("m"), "l_suppkey").alias("name"), said.alias("position"))
    motions = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(member).alias("members"))
    bills_ = motions.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.concat(F.lit("motion "), "l_linenumber").alias("motion"), "members")).alias("votes"))
    return minutes.roll_calls(bills_, "id", "votes")


_COMMITTEE_ACTS = "SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS action_id, l_suppkey % 40 AS committee_id, CAST(l_shipdate AS DATE) AS date, CASE l_linenumber % 4 WHEN 0 THEN 'committee_hearing' WHEN 1 THEN 'committee_report' WHEN 2 THEN 'amendment' ELSE 'presence' END AS kind, CASE WHEN l_returnflag = 'R' THEN 'yes' WHEN l_returnflag = 'A' THEN 'absent' END AS position, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS proposition_id FROM lineitem"


def _committee_acts(spark, d):
    n = F.col("l_linenumber") % 4
    return _t(spark, d, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("action_id"), (F.col("l_suppkey") % 40).alias("committee_id"), F.col("l_shipdate").cast("date").alias("date"), F.when(n == 0, "committee_hearing").when(n == 1, "committee_report").when(n == 2, "amendment").otherwise("presence").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "absent").alias("position"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")).alias("proposition_id"),
    )


@query(f"WITH a AS (SELECT * FROM ({_COMMITTEE_ACTS}) WHERE date >= DATE '1996-01-01'), g AS (SELECT committee_id, count(*) FILTER (WHERE kind = 'committee_hearing') AS h, count(*) FILTER (WHERE kind = 'committee_report') AS r, count(*) FILTER (WHERE kind = 'amendment') AS m, count(DISTINCT proposition_id) AS p FROM a GROUP BY 1) SELECT n_nationkey AS committee_id, coalesce(h, 0) AS hearings, coalesce(r, 0) AS reports, coalesce(m, 0) AS amendments, coalesce(p, 0) AS measures FROM nation LEFT JOIN g ON g.committee_id = n_nationkey")
def committee_activity(spark, d):
    committees = _t(spark, d, "nation").select(F.col("n_nationkey").alias("committee_id"))
    return feeds.committee_activity(_committee_acts(spark, d), committees, F.lit("1996-01-01").cast("date"))


@query(f"WITH k AS (SELECT * FROM ({_COMMITTEE_ACTS}) WHERE committee_id = 3 AND NOT coalesce(kind = 'presence' AND position = 'yes', false)) SELECT action_id, (SELECT count(*) FROM k) AS total, 70 < (SELECT count(*) FROM k) AS has_more FROM k ORDER BY date DESC NULLS FIRST, action_id LIMIT 50 OFFSET 20")
def committee_feed(spark, d):
    return feeds.action_page(_committee_acts(spark, d), 20, 50, committee_id=3).select("action_id", "total", "has_more")
