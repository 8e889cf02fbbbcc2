"""Registered queries: each operator of the library on the benchmark tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names, records, scores, text
from ..operators import checks, feeds, finance, geo, lifecycle, linkers, merge, ranking, vector
from ..sources import delimited, html
from ..sources import records as source_records

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _money(c: str):
    return F.col(c).cast("decimal(14,2)")


def _day():
    return F.lit("2024-01-01").cast("timestamp_ntz")

# --- finance

_SUMMARIES = "SELECT o_orderkey AS filing_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS INT) END AS amend_id, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DECIMAL(14,2)) END AS reported FROM orders"
_DETAIL = "SELECT l_orderkey AS filing_id, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END AS code, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount FROM lineitem"
_RECONCILED = f"""WITH r AS ({_SUMMARIES}), d AS (SELECT filing_id, sum(amount) FILTER (WHERE code = 'R') AS amt, count(code) AS coded, count(*) AS total FROM ({_DETAIL}) GROUP BY 1),
j AS (SELECT r.filing_id, r.amend_id, r.reported, d.amt, coalesce(d.coded, 0) AS coded, coalesce(d.total, 0) AS total FROM r LEFT JOIN d USING (filing_id)),
s AS (SELECT *, NOT (total > 0 AND coded = 0) AS judged, CASE WHEN reported IS NULL THEN 'NO_SUMMARY' WHEN total > 0 AND coded = 0 THEN 'UNKNOWN_SCHEDULE' WHEN amt IS NULL AND reported <> 0 THEN 'NO_DETAIL'
WHEN coalesce(amt, 0) > reported + 0.01 THEN 'OVER_ITEMIZED' WHEN coalesce(amt, 0) < reported - 0.01 THEN 'UNITEMIZED' ELSE 'MATCH' END AS status FROM j)"""


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    summaries = _t(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"), F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 3).cast("int")).alias("amend_id"), F.lit("F460").alias("form_type"), F.lit("5").alias("line_item"), F.when(F.col("o_orderpriority") != "5-LOW", _money("o_totalprice")).alias("amount_a"))
    detail = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("schedule_code"), _money("l_extendedprice").alias("amount"))
    return finance.reconcile(finance.reported(summaries, {"contributions": "5"}), {"contributions": finance.itemized(detail, "R", "contributions", owner=None)})


@query(_RECONCILED + " SELECT filing_id, amend_id, CAST(reported AS DOUBLE) AS reported, CAST(CASE WHEN judged THEN coalesce(amt, 0) END AS DOUBLE) AS itemized, CAST(CASE WHEN judged AND reported - coalesce(amt, 0) > 0.01 THEN reported - coalesce(amt, 0) END AS DOUBLE) AS unitemized, status FROM s")
def filing_reconciliation(spark, d):
    c = lambda x: F.col(f"contributions_{x}").cast("double")
    return _reconciled(spark, d).select("filing_id", "amend_id", F.col("contributions").cast("double").alias("reported"), c("itemized").alias("itemized"), c("unitemized").alias("unitemized"), F.col("contributions_status").alias("status"))


@query(_RECONCILED + " SELECT count(*) AS filings, count(*) FILTER (WHERE status = 'NO_SUMMARY') AS no_summary, count(*) FILTER (WHERE status = 'UNKNOWN_SCHEDULE') AS unknown_schedule, count(*) FILTER (WHERE status = 'NO_DETAIL') AS no_detail, count(*) FILTER (WHERE status = 'OVER_ITEMIZED') AS over_itemized, count(*) FILTER (WHERE status = 'UNITEMIZED') AS unitemized, count(*) FILTER (WHERE status = 'MATCH') AS match FROM s")
def reconciliation_summary(spark, d):
    return finance.reconciliation_summary(_reconciled(spark, d), "contributions_status")


_VERSIONS = "SELECT l_orderkey AS filing_id, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_linenumber END AS amend_id, l_partkey, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount FROM lineitem"


def _versions(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.when(F.col("l_partkey") % 10 != 0, F.col("l_linenumber")).alias("amend_id"), "l_partkey", _money("l_extendedprice").alias("amount"))


@query(f"WITH v AS ({_VERSIONS}), m AS (SELECT filing_id, max(amend_id) AS m FROM v GROUP BY 1) SELECT filing_id, amend_id, l_partkey, CAST(amount AS DOUBLE) AS amount FROM v JOIN m USING (filing_id) WHERE amend_id IS NULL OR amend_id >= m")
def amendment_supersession(spark, d):
    return finance.supersede(_versions(spark, d), "filing_id", "amend_id").withColumn("amount", F.col("amount").cast("double"))


@query(f"WITH v AS ({_VERSIONS}), m AS (SELECT filing_id, max(amend_id) AS m, count(DISTINCT amend_id) AS versions FROM v GROUP BY 1) SELECT filing_id, any_value(versions) AS versions, count(*) FILTER (WHERE amend_id < m) AS superseded FROM v JOIN m USING (filing_id) WHERE versions > 1 GROUP BY 1")
def amendment_restated(spark, d):
    return finance.restated(_versions(spark, d), "filing_id", "amend_id").select("filing_id", "versions", F.col("superseded").cast("long"))


@query("""WITH f AS (SELECT o_orderkey AS filing_id, CAST(o_custkey AS VARCHAR) AS filer FROM orders WHERE o_orderpriority <> '5-LOW'),
c AS (SELECT CAST(c_custkey AS VARCHAR) AS filer, 'C' || c_custkey AS id FROM customer WHERE c_acctbal >= 0),
l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_orderkey END AS filing_id, CASE WHEN l_suppkey % 8 = 0 THEN 'S' || l_suppkey END AS owner FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(owner, id) AS committee_id, CASE WHEN owner IS NOT NULL THEN 'kept' WHEN filing_id IS NULL THEN 'no_filing' WHEN f.filer IS NULL THEN 'no_cover' WHEN id IS NULL THEN 'unknown_filer' ELSE 'linked' END AS link
FROM l LEFT JOIN f USING (filing_id) LEFT JOIN c ON c.filer = f.filer""")
def cover_attribution(spark, d):
    covers = _t(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").cast("string").alias("filer_id"), F.lit(0).alias("seq"))
    committees = _t(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("external_id"), F.concat(F.lit("C"), "c_custkey").alias("id"))
    detail = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 9 != 0, F.col("l_orderkey")).alias("filing_id"), F.when(F.col("l_suppkey") % 8 == 0, F.concat(F.lit("S"), "l_suppkey")).alias("committee_id"))
    return finance.attribute(detail, covers, committees).select("l_orderkey", "l_linenumber", "committee_id", "link")


_GIFTS = "SELECT c_mktsegment AS side, c_name AS donor_name, CAST(o_totalprice AS DECIMAL(14,2)) AS amount, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey"


def _gifts(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("side"), F.col("c_name").alias("donor_name"), _money("o_totalprice").alias("amount"), "o_orderstatus", "o_orderpriority")


@query(f"""WITH g AS ({_GIFTS}), c AS (SELECT side, sum(amount) AS a, count(DISTINCT donor_name) AS donors FROM g WHERE o_orderstatus = 'F' GROUP BY 1),
e AS (SELECT side, sum(amount) AS a FROM g WHERE o_orderstatus = 'O' GROUP BY 1), i AS (SELECT side, sum(amount) AS a FROM g WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT side, CAST(coalesce(c.a, 0) + coalesce(i.a, 0) AS DOUBLE) AS raised, CAST(coalesce(e.a, 0) + coalesce(i.a, 0) AS DOUBLE) AS spent, coalesce(donors, 0) AS donors FROM c FULL JOIN e USING (side) FULL JOIN i USING (side)""")
def measure_funding(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", finance.GIFT).when(F.col("o_orderstatus") == "O", finance.PAYMENT).when(F.col("o_orderstatus") == "P", finance.INDEPENDENT)
    return finance.funding_of(_gifts(spark, d), "side", kind).select("side", F.col("raised").cast("double"), F.col("spent").cast("double"), "donors")


_CANON = "list_aggregate(list_sort(list_filter(string_split_regex(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN ('pac','inc','llc','corp','co','ltd','committee','the','a','of','on','and','for'))), 'string_agg', ' ')"


@query(f"WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 2 = 0 THEN 'The ' || p_type || ' & Co.' ELSE p_type || ', Inc' END AS donor, CAST(p_retailprice AS DECIMAL(14,2)) AS amount FROM part), k AS (SELECT p_brand, donor, sum(amount) AS raw, count(*) AS n, coalesce(nullif({_CANON.format(c='donor')}, ''), lower(donor)) AS donor_key FROM n GROUP BY p_brand, donor), g AS (SELECT p_brand, donor_key, arg_max(donor, raw ORDER BY raw DESC, donor) AS x, first(donor ORDER BY raw DESC, donor) AS donor, sum(raw) AS total, sum(n) AS contributions FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY total DESC, donor_key) AS rank FROM g) SELECT p_brand, donor_key, donor, CAST(total AS DOUBLE) AS total, CAST(contributions AS BIGINT) AS contributions, rank FROM r WHERE rank <= 8")
def top_donors(spark, d):
    donor = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("The "), "p_type", F.lit(" & Co."))).otherwise(F.concat("p_type", F.lit(", Inc")))
    rows = _t(spark, d, "part").select("p_brand", donor.alias("donor"), _money("p_retailprice").alias("amount"))
    rows = rows.withColumnRenamed("donor", "raw_name")
    return finance.top_donors(rows, "raw_name", "amount", 8, ["p_brand"]).select("p_brand", "donor_key", "donor", F.col("total").cast("double"), "contributions", F.col("rank").cast("long"))


# --- keyed writes


@query("WITH s AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_acctbal >= 0) SELECT c_custkey, coalesce(b.c_name, s.c_name) AS c_name, coalesce(b.c_acctbal, s.c_acctbal) AS c_acctbal, CASE WHEN b.c_custkey IS NULL THEN 'kept' WHEN s.c_custkey IS NULL THEN 'created' ELSE 'updated' END AS action FROM s FULL JOIN b USING (c_custkey)")
def upsert(spark, d):
    c = _t(spark, d, "customer")
    return merge.upsert(c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_acctbal"), c.where("c_acctbal >= 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal")), ["c_custkey"])


@query("""WITH e AS (SELECT user_id, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(value AS INT) % 7 END AS version, event_type FROM events),
r AS (SELECT user_id, max(seq) AS reset FROM e WHERE version IS NULL GROUP BY 1), k AS (SELECT e.* FROM e LEFT JOIN r USING (user_id) WHERE reset IS NULL OR seq >= reset)
SELECT user_id, version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC NULLS LAST, seq DESC) AS n FROM k) WHERE n = 1""")
def monotonic_replay(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 != 0, F.rint("value").cast("int") % 7).alias("version"), "event_type")
    return merge.replay(e, ["user_id"], "version", "seq").drop("seq")


@query("WITH n AS (SELECT l_orderkey, l_linenumber + 100 AS l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n")
def replace_children(spark, d):
    l = _t(spark, d, "lineitem")  # noqa: E741
    new = l.where("l_returnflag = 'R' AND l_linenumber = 1").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"))
    return merge.replace_children(l.select("l_orderkey", "l_linenumber"), new, "l_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def prune_stale(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return merge.prune(c, _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", F.col("c_mktsegment") == "BUILDING")


@query("WITH u AS (SELECT l_orderkey AS k, l_suppkey AS v, 0 AS p FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_suppkey, 1 FROM lineitem WHERE l_returnflag = 'R') SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, v) AS n FROM u) WHERE n = 1")
def union_first_wins(spark, d):
    l = _t(spark, d, "lineitem")  # noqa: E741
    of = lambda f: l.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v"))
    return merge.union_first_wins([of("A"), of("R")], ["k"])


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS")
def retention(spark, d):
    e = _t(spark, d, "events")
    return merge.retain(e, "ts", _as_of(e), 10).select("event_id")


# --- linking


@query("WITH o AS (SELECT DISTINCT n_name, n_regionkey FROM nation), u AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey) = 1) SELECT s_suppkey, s_nationkey AS c_nationkey, c_custkey FROM (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS c_mktsegment FROM supplier) s LEFT JOIN u ON u.c_nationkey = s.s_nationkey AND u.c_mktsegment = s.c_mktsegment")
def unique_match(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"))
    return linkers.unique_match(s, _t(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], "c_custkey").select("s_suppkey", "c_nationkey", "c_custkey")


@query("WITH t AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM part), x AS (SELECT t, max(p_partkey) AS last, min(p_partkey) AS seq FROM t GROUP BY 1), p AS (SELECT array_to_string(list_slice(string_split(t, ' '), 1, 2), ' ') AS p, arg_min(last, seq) AS near FROM x WHERE len(string_split(t, ' ')) >= 2 GROUP BY 1), l AS (SELECT p_partkey AS k, trim(regexp_replace(lower(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || ' extra' END), '\\s+', ' ', 'g')) AS t FROM part) SELECT k, coalesce(x.last, p.near) AS p_partkey FROM l LEFT JOIN x USING (t) LEFT JOIN p ON p.p = array_to_string(list_slice(list_filter(string_split(l.t, ' '), lambda w: len(w) > 1), 1, 2), ' ')")
def title_links(spark, d):
    part = _t(spark, d, "part")
    left = part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit(" extra"))).alias("p_type"))
    right = part.select("p_type", "p_partkey", F.col("p_partkey").alias("seq"))
    return linkers.link_titles(left, right, "p_type", "p_partkey", "seq").select("k", "p_partkey")


@query("SELECT c_custkey, 'C' || lpad(CAST(c_custkey % 50 AS VARCHAR), 2, '0') AS name, CASE WHEN c_custkey % 50 < 40 THEN c_custkey % 50 END AS rep_id FROM customer")
def candidate_links(spark, d):
    key = F.lpad((F.col("c_custkey") % 50).cast("string"), 2, "0")
    committees = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Friends of Ann Person"), key, F.lit(" for Assembly 2024")).alias("name"), F.lit("Assembly").alias("chamber"), F.concat(F.lit("C"), key).alias("short"))
    reps = spark.range(80).select((F.col("id") % 40).alias("rep_id"), F.concat(F.lit("Person"), F.lpad((F.col("id") % 40).cast("string"), 2, "0")).alias("last_name"), F.when(F.col("id") < 40, "Ann").otherwise("Bob").alias("first_name"), F.lit("Assembly").alias("chamber"))
    return linkers.link_candidates(committees, reps).select(F.col("id").alias("c_custkey"), F.col("short").alias("name"), "rep_id")


@query("SELECT s_suppkey, s_name, s_suppkey % 100 AS c FROM supplier WHERE s_suppkey % 100 NOT IN (SELECT DISTINCT n_nationkey FROM nation)")
def not_elsewhere(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 100).cast("int").alias("c"))
    out = linkers.existing_elsewhere(s.withColumn("k", F.col("s_suppkey")), _t(spark, d, "nation").select(F.col("n_nationkey").alias("c")), ["c"])
    return s.join(out.select("c").distinct(), "c", "left_semi").select("s_suppkey", "s_name", F.col("c").cast("long"))


@query("SELECT doc_id, min(region.r_regionkey) AS r_regionkey FROM documents JOIN region ON contains(lower(text), lower(substr(r_name, 1, 3))) GROUP BY 1")
def first_containing(spark, d):
    needles = _t(spark, d, "region").select("r_regionkey", F.substring("r_name", 1, 3).alias("needle"))
    return linkers.first_containing(_t(spark, d, "documents"), needles, "text", "needle", "r_regionkey", "doc_id")


# --- feeds and lists

_MAX_TS = "(SELECT max(ts) FROM events)"


def _as_of(events: DataFrame):
    return F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


@query(f"SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS people, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts > {_MAX_TS} - INTERVAL 240 HOURS GROUP BY 1 HAVING count(*) >= 3")
def activity_feed(spark, d):
    e = _t(spark, d, "events")
    return feeds.threshold_feed(e, "user_id", "event_type", "ts", _as_of(e), 240)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_histogram(spark, d):
    return feeds.hourly(_t(spark, d, "events"), "ts")


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in _KINDS) + ", count(*) AS n_all FROM events GROUP BY 1")
def activity_pivot(spark, d):
    return feeds.pivot_counts(_t(spark, d, "events"), "user_id", "event_type", list(_KINDS))


@query("SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 25")
def latest_activity(spark, d):
    return feeds.latest(_t(spark, d, "events"), "user_id", 25, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", F.col("rank").cast("long"))


@query("WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'yes' ELSE 'no' END AS position FROM events) SELECT * FROM e WHERE NOT (event_type = 'view' AND position = 'yes')")
def presence_hidden(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, "yes").otherwise("no").alias("position"))
    return feeds.hide(e, F.col("event_type") == "view", F.col("position") == "yes")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 51 OFFSET 100")
def filtered_page(spark, d):
    rows = feeds.filtered(_t(spark, d, "orders"), o_orderstatus="O", o_orderpriority=["1-URGENT", "2-HIGH"], o_totalprice=(1000, None), o_custkey=None)
    return feeds.page(rows, 100, 50, F.desc_nulls_first("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY 1 LIMIT 20")
def keyset_page(spark, d):
    return feeds.after(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 20)


@query("SELECT o_orderkey, coalesce(array_to_string(list(l_linenumber || ':' || l_suppkey ORDER BY l_linenumber, l_suppkey), ','), '') AS items, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_children(spark, d):
    out = feeds.nest(_t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_linenumber", "l_suppkey"], "items")
    return out.select("o_orderkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_suppkey"])), ",").alias("items"), F.size("items").cast("long").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY 1")
def share_of_total(spark, d):
    return feeds.share(_t(spark, d, "customer"), "c_mktsegment")


# --- ranking

_BILLS = "SELECT p_partkey AS id, string_split(p_type, ' ') AS topics, p_size % 4 AS n_flags, CASE WHEN p_size % 7 = 0 THEN NULL ELSE DATE '2024-01-01' - CAST(p_size * 2 AS INT) END AS last_action_date, p_brand FROM part"


@query(f"""WITH b AS ({_BILLS}), u AS (SELECT s_suppkey AS user_id, 'Brand#' || CAST(s_suppkey % 5 + 1 AS VARCHAR) || '1' AS p_brand, ['STEEL', 'BRUSHED', 'ECONOMY'] AS tags FROM supplier),
s AS (SELECT user_id, id, least(n_flags * 0.2::DOUBLE, 1.0) AS material, len(list_filter(topics, lambda t: list_contains(tags, t))) / 3 AS alignment, CASE WHEN last_action_date IS NULL THEN 0.0 WHEN DATE '2024-01-01' - last_action_date <= 30 THEN 1.0 WHEN DATE '2024-01-01' - last_action_date <= 60 THEN 0.5 ELSE 0.0 END::DOUBLE AS action FROM b JOIN u USING (p_brand)),
c AS (SELECT *, material * 0.5::DOUBLE + alignment * 0.3::DOUBLE + action * 0.2::DOUBLE AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM c WHERE score > 0) SELECT user_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def bill_ranking(spark, d):
    p = _t(spark, d, "part")
    bills = p.select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("topics"), (F.col("p_size") % 4).alias("n_flags"), F.when(F.col("p_size") % 7 != 0, F.date_sub(F.lit("2024-01-01").cast("date"), F.col("p_size") * 2)).alias("last_action_date"), "p_brand")
    users = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), F.lit("1")).alias("p_brand"), F.array(F.lit("STEEL"), F.lit("BRUSHED"), F.lit("ECONOMY")).alias("tags"))
    return ranking.rank_bills(bills, users, F.lit("2024-01-01").cast("date"), 5, "p_brand").select("user_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("""WITH p AS (SELECT l_suppkey AS rep, l_partkey AS bill, CASE l_linenumber % 4 WHEN 0 THEN 'author' WHEN 1 THEN 'co_author' WHEN 2 THEN 'yes' ELSE 'no' END AS role, l_discount AS interest FROM lineitem),
w AS (SELECT rep, bill, max(CASE role WHEN 'author' THEN 1.0 WHEN 'co_author' THEN 0.6 WHEN 'yes' THEN 0.4 ELSE 0.2 END::DOUBLE * interest) AS w FROM p WHERE interest >= 0.1 GROUP BY 1, 2)
SELECT rep, round(least(round(sum(w), 9) / 3, 1.0), 6) AS action_score, count(*) AS bills FROM w GROUP BY 1""")
def representative_activity(spark, d):
    role = F.element_at(F.array(*map(F.lit, ("author", "co_author", "yes", "no"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    parts = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("rep"), F.col("l_partkey").alias("bill"), role.alias("role"), F.col("l_discount").alias("interest"))
    return ranking.representative_activity(parts, "rep", "bill", "role", "interest").withColumn("action_score", F.round("action_score", 6))


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_per_entity(spark, d):
    return ranking.top_per_entity(_t(spark, d, "customer"), "c_nationkey", 3, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_nationkey", "c_custkey", F.col("rank").cast("long"))


@query("WITH s AS (SELECT l_orderkey AS e, CASE l_returnflag WHEN 'A' THEN 'chamber' WHEN 'R' THEN 'committee' ELSE 'action' END AS axis, l_extendedprice AS w, l_linenumber AS i FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY e, axis ORDER BY w DESC, i) AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY w DESC, i) AS rank FROM a WHERE k <= CASE axis WHEN 'chamber' THEN 3 ELSE 1 END) SELECT e, axis, i, rank FROM r WHERE rank <= 5")
def capped_signals(spark, d):
    axis = F.when(F.col("l_returnflag") == "A", "chamber").when(F.col("l_returnflag") == "R", "committee").otherwise("action")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("e"), axis.alias("axis"), F.col("l_extendedprice").alias("w"), F.col("l_linenumber").alias("i"))
    return ranking.capped_signals(rows, "e", "axis", "w", "i").select("e", "axis", "i", F.col("rank").cast("long"))


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])license([^A-Za-z0-9_]|$)') AS license, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])token([^A-Za-z0-9_]|$)') AS token FROM documents")
def keyword_flags(spark, d):
    flags = ranking.keyword_flags(F.col("text"), {"license": "license", "token": "token"})
    return _t(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query("WITH u AS (SELECT c_custkey AS user_id, c_nationkey AS k FROM customer WHERE c_custkey % 3 <> 0), e AS (SELECT s_suppkey AS entity_id, s_nationkey AS k FROM supplier) SELECT user_id, entity_id FROM u JOIN e USING (k) WHERE NOT (user_id % 2 = 0 AND entity_id % 2 = 0)")
def rerank_candidates(spark, d):
    users = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    items = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("k"))
    cache = merge.pairs_of(users, items, "k", "user_id").select("user_id", "entity_id", F.when((F.col("user_id") % 2 == 0) & (F.col("entity_id") % 2 == 0), F.lit("2024-02-01")).otherwise(F.lit("2023-01-01")).cast("timestamp_ntz").alias("expires_at"))
    return ranking.rerank_candidates(users, items, "k", cache, _day()).select("user_id", "entity_id")


_PROXIMITY = "CASE WHEN days < 0 OR days > 365 THEN 0.0 WHEN days <= 30 THEN 1.0 WHEN days <= 90 THEN 1.0::DOUBLE - (days - 30)::DOUBLE / 60 * 0.6::DOUBLE ELSE 0.4::DOUBLE - (days - 90)::DOUBLE / 275 * 0.4::DOUBLE END"


@query(f"SELECT p_partkey, round({_PROXIMITY}::DOUBLE, 6) AS proximity FROM (SELECT p_partkey, p_size * 10 - 50 AS days FROM part)")
def election_proximity(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(scores.election_proximity(F.col("p_size") * 10 - 50), 6).alias("proximity"))


# --- geography and vectors

_PLACES = "SELECT event_id, user_id, CAST((event_id * 37) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((event_id * 91) % 1700 AS DOUBLE) / 10 - 85 AS lat FROM events"
_HAVERSINE = "2 * 6371008.8 * asin(least(sqrt(pow(sin((radians({lat2}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians(lon)) / 2), 2)), 1.0))"


def _places(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", "user_id", (((F.col("event_id") * 37) % 3600).cast("double") / 10 - 180).alias("lon"), (((F.col("event_id") * 91) % 1700).cast("double") / 10 - 85).alias("lat"))


@query(f"SELECT event_id FROM ({_PLACES}) WHERE lon > -125 AND lon < -66 AND lat > 24 AND lat < 50")
def in_box(spark, d):
    return _places(spark, d).where(geo.in_box(F.col("lon"), F.col("lat"), -125, 24, -66, 50)).select("event_id")


@query(f"SELECT event_id, round({_HAVERSINE.format(lat2='38.5', lon2='-121.5')}, 2) AS metres FROM ({_PLACES}) WHERE {_HAVERSINE.format(lat2='38.5', lon2='-121.5')} <= 2000000")
def within_radius(spark, d):
    rows = _places(spark, d).where(geo.within(F.col("lon"), F.col("lat"), -121.5, 38.5, 2_000_000))
    return rows.select("event_id", F.round(scores.haversine(F.col("lon"), F.col("lat"), F.lit(-121.5), F.lit(38.5)), 2).alias("metres"))


@query(f"SELECT event_id, CAST(a.i AS BIGINT) AS area FROM ({_PLACES}) p JOIN range(12) a(i) ON p.lat > -30.05 AND p.lat < 40.05 AND lon > -170.05 + a.i * 28 AND lon - (-170.05 + a.i * 28) < 20 * (40.05 - lat) / 70.1")
def point_in_polygon(spark, d):
    x = F.lit(-170.05) + F.col("id") * 28
    pt = lambda dx, y: F.struct((x + dx).alias("x"), F.lit(y).alias("y"))
    areas = spark.range(12).select(F.col("id").alias("area"), F.array(F.array(pt(0, -30.05), pt(20, -30.05), pt(0, 40.05), pt(0, -30.05))).alias("rings"))
    return geo.locate(_places(spark, d), areas, "event_id", "area", 10.0)


@query(f"SELECT event_id, round({_HAVERSINE.format(lat2='0.0', lon2='0.0')}, 2) AS metres FROM ({_PLACES}) WHERE user_id = 7 AND {_HAVERSINE.format(lat2='0.0', lon2='0.0')} <= 9000000")
def nearby_same_content(spark, d):
    return geo.nearby_same_content(_places(spark, d), "user_id", "lon", "lat", {"user_id": 7, "lon": 0.0, "lat": 0.0}, 9_000_000).select("event_id", F.round("metres", 2).alias("metres"))


_SIM = "round(list_dot_product(e::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6)"


_FOUND = f"WITH x AS (SELECT q.vec_id AS query_id, x.vec_id, {{label}} x.embedding AS e, q.embedding AS q FROM embeddings x JOIN embeddings q ON q.vec_id % 50 = 0), s AS (SELECT *, {_SIM} AS similarity FROM x {{where}}), r AS (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)"


def _asked(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_FOUND.format(label="x.label,", where="WHERE label <> 3") + " SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10")
def vector_top_k(spark, d):
    v = _t(spark, d, "embeddings")
    return vector.search(v.where("label <> 3"), _asked(v), 10)


@query(_FOUND.format(label="", where="") + " SELECT query_id, vec_id, similarity, rank - 20 AS rank FROM r WHERE rank > 20 AND rank <= 26")
def vector_page(spark, d):
    v = _t(spark, d, "embeddings")
    return vector.search(v, _asked(v), 26).where("rank > 20").withColumn("rank", F.col("rank") - 20)


@query()
def vector_list_index(spark, d):
    v = _t(spark, d, "embeddings")
    return vector.ListIndex(v, lists=16).search_all(_asked(v), 10, probes=12)


# --- texts


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS content_hash FROM documents")
def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


_REDACT = "text"
for _p, _r in text.REDACTIONS:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '{_r.replace('$', chr(92))}', 'g')"


@query(f"SELECT doc_id, sha256({_REDACT}) AS redacted FROM documents")
def pii_redaction(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("redacted"))


@query("WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200 - 1, 0) + 1, 800)) AS s FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(s // 800 AS BIGINT) AS place, md5(substr(text, CAST(s + 1 AS INT), 1000)) AS chunk FROM c")
def text_chunks(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("place", "piece")).select("doc_id", F.col("place").cast("long"), F.md5("piece").alias("chunk"))


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body FROM pages")
def body_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha2(text.body_text(F.col("html")), 256).alias("body"))


_HREFS = """list_filter(list_transform(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*[''"]([^''"]+)[''"]', 1), lambda x: replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '&amp;', '&')), lambda x: NOT regexp_matches(x, '^(javascript:|mailto:|tel:|#)') AND x <> '')"""


@query(f"SELECT page_id, array_to_string({_HREFS}, ' ') AS links FROM pages")
def page_links(spark, d):
    return _t(spark, d, "pages").select("page_id", F.array_join(text.links(F.col("html")), " ").alias("links"))


# Addresses of the table have a path without steps; a slash at the end of a path goes, the query stays.
_CANONICAL = "lower(regexp_extract({u}, '^(https?://[^/?#]*)', 1)) || CASE WHEN regexp_matches({u}, '^https?://[^/?#]*([?#]|$)') THEN '/' ELSE '' END || regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '^https?://[^/?#]*', ''), '([^/])/(\\?|$)', '\\1\\2')"


@query(f"SELECT page_id, {_CANONICAL.format(u='url')} AS url FROM pages")
def canonical_urls(spark, d):
    return _t(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS title FROM pages WHERE contains(html, '<h1>')")
def html_items(spark, d):
    pages = _t(spark, d, "pages")
    found = html.extract(pages.select(F.col("page_id").cast("string").alias("url"), "html"), "article", "h1", {"title": "_text"})
    return found.select(F.col("url").cast("long").alias("page_id"), "title")


@query()
def page_structures(spark, d):
    return html.structure_hash(_t(spark, d, "pages"))


@query(f"""WITH RECURSIVE p AS (SELECT page_id, {_CANONICAL.format(u='url')} AS url, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) AS site, {_HREFS} AS hrefs FROM pages), l AS (SELECT DISTINCT url, {_CANONICAL.format(u="CASE WHEN h LIKE '/%' THEN site || h ELSE h END")} AS target FROM (SELECT url, site, unnest(hrefs) AS h FROM p)),
s AS (SELECT arg_min(url, page_id) AS url, site FROM p GROUP BY site), k AS (SELECT DISTINCT url, 0 AS depth FROM s UNION SELECT l.target, k.depth + 1 FROM k JOIN l ON l.url = k.url WHERE k.depth < 2 AND regexp_extract(l.target, '^(https?://[^/?#]*)', 1) IN (SELECT site FROM s)) SELECT url, min(depth) AS depth FROM k GROUP BY 1""")
def crawl_frontier(spark, d):
    pages = _t(spark, d, "pages")
    first = pages.groupBy(F.lower(F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)).alias("site")).agg(F.min_by("url", "page_id").alias("url")).select("url")
    return source_records.crawl(pages, first, depth=2)


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title, regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]', '', 'g') AS k FROM part")
def name_keys(spark, d):
    c = F.concat("p_name", F.lit(" & "), "p_brand")
    return _t(spark, d, "part").select("p_partkey", text.slug(c).alias("slug"), text.normal_title(c).alias("title"), text.alnum_key(c).alias("k"))


@query("WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Assembly Standing Committee on the ' || s_name WHEN 1 THEN 'Senate Committee on ' || s_name WHEN 2 THEN s_name || ' Subcommittee' ELSE 'Committee' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Vice-Chair' WHEN 1 THEN 'Co-chair' ELSE NULL END AS role FROM supplier) SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'senate:' || trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(name, 'Assembly Standing Committee on the |Senate Committee on | Subcommittee', ''), '#', ' ')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) END AS external_id, CASE s_suppkey % 3 WHEN 0 THEN 'Vice Chair' WHEN 1 THEN 'Chair' ELSE 'Member' END AS role, CASE s_suppkey % 4 WHEN 0 THEN 'Assembly' WHEN 1 THEN 'Senate' END AS chamber FROM c")
def committee_names(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Assembly Standing Committee on the "), "s_name")).when(k % 4 == 1, F.concat(F.lit("Senate Committee on "), "s_name")).when(k % 4 == 2, F.concat("s_name", F.lit(" Subcommittee"))).otherwise("Committee")
    role = F.when(k % 3 == 0, "Vice-Chair").when(k % 3 == 1, "Co-chair")
    return _t(spark, d, "supplier").select("s_suppkey", names.committee_id(F.lit("Senate"), name).alias("external_id"), names.role(role).alias("role"), names.chamber(name).alias("chamber"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) AS c, CAST(NULL AS DATE) AS bad, CAST(year(o_orderdate) - (1 - year(o_orderdate) % 2) AS VARCHAR) || '-' || CAST(year(o_orderdate) - (1 - year(o_orderdate) % 2) + 1 AS VARCHAR) AS session FROM orders")
def date_forms(spark, d):
    day = F.col("o_orderdate").cast("date")
    return _t(spark, d, "orders").select("o_orderkey", dates.parse_date(F.date_format(day, "M/d/yyyy")).alias("a"), dates.flexible_date(F.date_format(day, "MMddyyyy")).alias("b"), dates.flexible_date(F.date_format(day, "MMMM d, yyyy")).alias("c"), dates.parse_date(F.lit("13/45/2020")).alias("bad"), dates.session_year(day).alias("session"))


@query("WITH t AS (SELECT doc_id, 'Senate Bill No. ' || (doc_id % 90) || ' and Assembly Joint Resolution ' || (doc_id % 7) || '.' AS t FROM documents) SELECT doc_id, unnest(['SB ' || (doc_id % 90), 'AJR ' || (doc_id % 7)]) AS bill FROM t")
def bill_citations(spark, d):
    t = F.concat(F.lit("Senate Bill No. "), F.col("doc_id") % 90, F.lit(" and Assembly Joint Resolution "), F.col("doc_id") % 7, F.lit("."))
    return _t(spark, d, "documents").select("doc_id", F.explode(text.citations(t)).alias("bill"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"answer\": \"yes {' || doc_id || '}\", \"confidence\": 0.5}' ELSE 'plain ' || doc_id END AS raw, CASE WHEN doc_id % 2 = 0 THEN 'yes {' || doc_id || '}' ELSE 'plain ' || doc_id END AS answer, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM documents")
def model_answers(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"answer": "yes {'), "doc_id", F.lit('}", "confidence": 0.5}'))).otherwise(F.concat(F.lit("plain "), "doc_id"))
    rows = _t(spark, d, "documents").select("doc_id", raw.alias("raw"))
    said = rows.withColumn("a", records.answer(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sure: ```json\n"), "raw", F.lit("\n``` done"))).otherwise(F.col("raw"))))
    return said.select("doc_id", "raw", "a.answer", "a.confidence")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1")
def json_fields(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.sum(records.json_field(F.col("props"), "k").cast("long")).alias("k"))


# --- ingestion and checks


@query("SELECT CAST(c_custkey AS VARCHAR) || ':' || c_nationkey AS external_id, 'seg ' || c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_mktsegment = 'BUILDING'")
def delimited_rows(spark, d):
    lines = _t(spark, d, "customer").select(F.concat_ws("|", F.col("c_custkey"), F.concat(F.lit('"seg '), "c_mktsegment", F.lit('"')), F.concat(F.lit(" "), "c_nationkey"), F.lit(""), "c_mktsegment").alias("value"))
    config = delimited.Delimited(["id", "seg", "nation", "none", "kind"], {"seg": "segment", "nation": "nation", "none": "none"}, "|", keep={"kind": "BUILDING", "unknown": "x"}, key=["id", "nation"])
    return delimited.parse(lines, config).drop("none")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'contributions' WHEN event_type = 'signup' THEN 'committees' END AS bucket FROM events")
def record_routing(spark, d):
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.when(F.col("event_type").isin("purchase", "signup"), F.col("user_id")).alias("name"))
    return source_records.route(e, [("contributions", ["amount", "name"]), ("committees", ["name"]), ("none", ["missing"])]).select("event_id", "bucket")


@query("WITH t AS (SELECT c_custkey, unnest([0, 1]) AS block FROM customer) SELECT c_custkey, CAST(block AS INT) AS block, 'item ' || block || ' of ' || c_custkey AS title, CASE WHEN block = 0 THEN 'open' ELSE 'closed' END AS state FROM t")
def block_extraction(spark, d):
    k = F.col("c_custkey").cast("string")
    page = F.concat(F.lit("intro\nBEGIN\n- Title: item 0 of "), k, F.lit("\nPage 1\nState: open\n- Title: item 1 of "), k, F.lit("\nEND\nTitle: no"))
    rules = source_records.Blocks(r"^- ", {"title": r"Title: (.*)", "state": r"State: (\w+)"}, start="BEGIN\n", end="END", skip=r"^Page \d+$", defaults={"state": "closed"}, required=["title"])
    return source_records.text_blocks(_t(spark, d, "customer").select("c_custkey", page.alias("t")), "c_custkey", "t", rules)


@query("SELECT unnest(['a', 'b']) AS field, unnest([avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN event_id % 10 = 3 THEN 1.0 ELSE 0.0 END)]) AS ratio FROM events")
def missing_ratios(spark, d):
    e = _t(spark, d, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 10 == 3, F.lit(" ")).otherwise(F.col("event_type")).alias("b"))
    return checks.missing_ratios(e, ["a", "b"])


@query("SELECT event_type, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS failure_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def failure_rates(spark, d):
    out = checks.rates(_t(spark, d, "events"), "event_type", F.col("value") > 50, "value")
    return out.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


_BILL = "SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 'Inactive Bill - Died' WHEN 1 THEN 'Active Bill - In Floor' WHEN 2 THEN 'Vetoed' WHEN 3 THEN NULL WHEN 4 THEN 'Withdrawn' ELSE 'Chaptered' END AS status, CASE WHEN o_custkey % 6 = 5 THEN 'chaptered' WHEN o_custkey % 13 = 0 THEN 'failed-passage' END AS stage, CASE WHEN o_orderkey % 2 = 0 THEN '2023-2024' ELSE '2021-2022' END AS session, CASE WHEN o_orderkey % 3 = 0 THEN 'Veto overridden' END AS last_action, CASE WHEN o_orderkey % 5 = 0 THEN DATE '2024-03-01' WHEN o_orderkey % 5 = 1 THEN DATE '2020-03-01' END AS last_date FROM orders"


@query(f"WITH b AS ({_BILL}), x AS (SELECT *, coalesce(stage = 'failed-passage', false) OR coalesce(regexp_matches(status, '(?i)died|failed deadline|inactive file|withdrawn|failed passage'), false) OR (coalesce(status = 'Vetoed', false) AND last_action IS NULL) OR (session <> '2023-2024' AND NOT coalesce(stage = 'chaptered', false) AND NOT coalesce(year(last_date) = 2024, false)) AS dead FROM b) SELECT o_orderkey, dead, coalesce(starts_with(status, 'Active Bill'), false) AND NOT dead AS active, CASE WHEN status = 'Chaptered' THEN 'law' WHEN status LIKE 'Active%' THEN 'floor' WHEN status LIKE '%Died' THEN 'dead' END AS stage FROM x")
def bill_lifecycle(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    status = F.when(k % 6 == 0, "Inactive Bill - Died").when(k % 6 == 1, "Active Bill - In Floor").when(k % 6 == 2, "Vetoed").when(k % 6 == 4, "Withdrawn").when(k % 6 == 5, "Chaptered")
    stage = F.when(k % 6 == 5, "chaptered").when(k % 13 == 0, "failed-passage")
    last = F.when(o % 5 == 0, F.lit("2024-03-01").cast("date")).when(o % 5 == 1, F.lit("2020-03-01").cast("date"))
    dead = lifecycle.is_dead(status, stage, F.when(o % 2 == 0, "2023-2024").otherwise("2021-2022"), F.when(o % 3 == 0, "Veto overridden"), last, F.lit("2024-06-01").cast("date"), ["2023-2024"])
    return _t(spark, d, "orders").select("o_orderkey", dead.alias("dead"), lifecycle.is_active(status, dead).alias("active"), lifecycle.stage(status, [("chaptered", "law"), ("^active", "floor"), ("died", "dead")]).alias("stage"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def changed_rows(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("a"), "c_acctbal")
    stored = c.where("c_acctbal >= 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("a", F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(F.col("a")))
    return lifecycle.changed(c, stored, "c_custkey", ["a", "c_acctbal"]).select("c_custkey")


@query("WITH r AS (SELECT c_custkey AS id, c_nationkey AS h, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS result FROM customer) SELECT id, coalesce(r.result, x.result) AS result FROM r LEFT JOIN (SELECT h, arg_max(result, id) AS result FROM r WHERE result IS NOT NULL GROUP BY 1) x USING (h)")
def reuse_by_hash(spark, d):
    r = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("h"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("result"))
    return lifecycle.reuse_by_hash(r, r, "h", "result", "id").select("id", "result")
