"""Campaign finance: reconciliation, amendments, attribution and funding. Tables in, tables out; column names are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_donor
from .merge import free, left_join

#: Money within this of the reported figure matches.
TOLERANCE = "0.01"
STATUSES = ("NO_SUMMARY", "UNKNOWN_SCHEDULE", "NO_DETAIL", "OVER_ITEMIZED", "UNITEMIZED", "MATCH")


def latest_version(rows: DataFrame, key: str, version: str, among: Column | None = None) -> DataFrame:
    """The greatest version of each key, by number; null where a key has null versions only."""
    rows = rows.where(among) if among is not None else rows
    return rows.groupBy(key).agg(F.max(version).alias(version))


def reported(summaries: DataFrame, lines: dict[str, str], form: str = "F460", key: str = "filing_id", version: str = "amend_id") -> DataFrame:
    """One row for each key with its latest version and, for each name in lines, that line's amount_a. Null versions meet null."""
    own = summaries.where(F.col("form_type") == form)
    last = latest_version(own, key, version).withColumnsRenamed({key: "_k", version: "_v"})
    rows = own.join(last, (F.col(key) == F.col("_k")) & F.col(version).eqNullSafe(F.col("_v")))
    return rows.groupBy(key, version).agg(*[F.max(F.when(F.col("line_item") == line, F.col("amount_a"))).alias(name) for name, line in lines.items()])


def itemized(detail: DataFrame, code: str, prefix: str, key: str = "filing_id", schedule: str = "schedule_code", amount: str = "amount", owner: str | None = "committee_id") -> DataFrame:
    """For each key: sum of the schedule's amounts (null if none), rows with a code, all rows, least owner."""
    aggs = [F.sum(F.when(F.col(schedule) == code, F.col(amount))).alias(f"{prefix}_amt"), F.count(schedule).alias(f"{prefix}_coded"), F.count(F.lit(1)).alias(f"{prefix}_total")]
    if owner:
        aggs.append(F.min(owner).alias(f"{prefix}_owner"))
    return detail.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def status(reported_: Column, amt: Column, coded: Column, total: Column) -> Column:
    """The first that holds of STATUSES; rows without any code are not judged by sums."""
    got, near = F.coalesce(amt, F.lit(0)), F.lit(TOLERANCE).cast("decimal(3,2)")
    return (
        F.when(reported_.isNull(), "NO_SUMMARY")
        .when((F.coalesce(total, F.lit(0)) > 0) & (F.coalesce(coded, F.lit(0)) == 0), "UNKNOWN_SCHEDULE")
        .when(amt.isNull() & (reported_ != 0), "NO_DETAIL")
        .when(got > reported_ + near, "OVER_ITEMIZED")
        .when(got < reported_ - near, "UNITEMIZED")
        .otherwise("MATCH")
    )


def reconcile(reported_: DataFrame, details: dict[str, DataFrame], key: str = "filing_id") -> DataFrame:
    """Reported figures beside itemised ones: for each name in details (a frame of itemized()) adds name_itemized, name_unitemized, name_status."""
    out = reduce(lambda a, b: a.join(b, key, "left"), details.values(), reported_)
    for name in details:
        col = lambda x, name=name: F.col(f"{name}_{x}")
        judged = ~((F.coalesce(col("total"), F.lit(0)) > 0) & (F.coalesce(col("coded"), F.lit(0)) == 0))
        sums = F.coalesce(col("amt"), F.lit(0))
        gap = F.col(name) - sums
        out = out.withColumn(f"{name}_itemized", F.when(judged, sums)).withColumn(f"{name}_unitemized", F.when(judged & (gap > F.lit(TOLERANCE).cast("decimal(3,2)")), gap)).withColumn(f"{name}_status", status(F.col(name), col("amt"), col("coded"), col("total")))
    return out


def reconciliation_summary(rows: DataFrame, status_col: str) -> DataFrame:
    """Counts of each status in one pass."""
    return rows.agg(F.count(F.lit(1)).alias("filings"), *[F.count_if(F.col(status_col) == s).alias(s.lower()) for s in STATUSES])


def supersede(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows not below their key's greatest version. Rows of no version stay. One shuffle for the maximum, joined back, so that a large key is not sorted in one task."""
    last = rows.where(F.col(version).isNotNull()).groupBy(key).agg(F.max(version).alias("_last"))
    out = rows.join(last, key, "left")
    return out.where(F.col(version).isNull() | F.col("_last").isNull() | (F.col(version) >= F.col("_last"))).drop("_last")


def restated(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Keys that have more than one version, with how many rows would go."""
    per = rows.groupBy(key, version).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(key).agg(F.countDistinct(version).alias("versions"), F.max(F.struct(version, "n"))["n"].alias("kept"), F.sum(F.when(F.col(version).isNotNull(), F.col("n")).otherwise(0)).alias("all"))
    return out.where("versions > 1").select(key, "versions", (F.col("all") - F.col("kept")).alias("superseded"))


def attribute(detail: DataFrame, covers: DataFrame, committees: DataFrame, via: str = "filing_id", filer: str = "filer_id", owner: str = "committee_id", external: str = "external_id", seq: str = "seq") -> DataFrame:
    """Fills a missing owner from the detail's first cover page and the committee it names; adds how, or why not.

    Columns: those of detail with the owner filled, and link: kept, linked, no_filing, no_cover, unknown_filer. Deleted
    committees take part as others do; the caller filters them.
    """
    first = covers.groupBy(via).agg(F.min_by(filer, seq).alias("_filer"))
    named = committees.groupBy(F.col(external).alias("_filer")).agg(F.min("id").alias("_id"))
    rows = left_join(detail, left_join(first, named, "_filer"), via)
    link = F.when(F.col(owner).isNotNull(), "kept").when(F.col(via).isNull(), "no_filing").when(F.col("_filer").isNull(), "no_cover").when(F.col("_id").isNull(), "unknown_filer").otherwise("linked")
    return rows.withColumn("link", link).withColumn(owner, F.coalesce(owner, "_id")).drop("_filer", "_id")


def top_donors(rows: DataFrame, name: str, amount: str, n: int, by: list[str] | None = None, canonical: bool = True) -> DataFrame:
    """The largest donors, overall or of each group: total, contributions, and the spelling that gave most (of equals the least)."""
    by = by or []
    raw = rows.groupBy(*by, name).agg(F.sum(amount).alias("_raw"), F.count(F.lit(1)).alias("_n"))
    raw = raw.withColumn("donor_key", canonical_donor(F.col(name)) if canonical else F.col(name))
    best = F.min_by(name, F.struct(-F.col("_raw"), F.col(name)))
    out = raw.groupBy(*by, "donor_key").agg(best.alias("donor"), F.sum("_raw").alias("total"), F.sum("_n").alias("contributions"))
    order = [F.desc("total"), F.asc("donor_key")]
    if not by:
        return out.orderBy(*order).limit(n)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


#: What money of a measure may be.
GIFT, PAYMENT, INDEPENDENT = "contribution", "expenditure", "independent"


def funding_of(money: DataFrame, side: str, kind: Column, amount: str = "amount") -> DataFrame:
    """Raised, spent and donors by side, of one table of money of all kinds, in one pass. Independent spending counts as raised and as spent."""
    of = lambda *kinds: F.coalesce(F.sum(F.when(kind.isin(*kinds), F.col(amount))), F.lit(0))
    rows = money.where(kind.isin(GIFT, PAYMENT, INDEPENDENT))
    return rows.groupBy(side).agg(of(GIFT, INDEPENDENT).alias("raised"), of(PAYMENT, INDEPENDENT).alias("spent"), F.countDistinct(F.when(kind == GIFT, F.col("donor_name"))).alias("donors"))


def funding(contributions: DataFrame, expenditures: DataFrame, independent: DataFrame, side: str, amount: str = "amount") -> DataFrame:
    """As funding_of(), of three tables."""
    kind, parts = free("kind", contributions, expenditures, independent), None
    for name, rows in ((GIFT, contributions), (PAYMENT, expenditures), (INDEPENDENT, independent)):
        donor = F.col("donor_name") if name == GIFT else F.lit(None).cast("string").alias("donor_name")
        one = rows.select(side, amount, donor, F.lit(name).alias(kind))
        parts = one if parts is None else parts.unionByName(one)
    return funding_of(parts, side, F.col(kind), amount)


def attribute_independent(rows: DataFrame, covers: DataFrame, committees: DataFrame) -> DataFrame:
    """Independent spending without a committee gets its filing's first cover page's: id and name; the cover's candidate, measure and side where it says so.

    rows: id, filing_id, committee_id, committee_name, candidate_name, proposition_title, side. Adds link: kept, no_filing,
    no_cover, no_committee or linked. A filing has one cover (the least seq); an unresolved row keeps what it has.
    """
    cover = covers.groupBy("filing_id").agg(F.min_by(F.struct("filer_id", "candidate_name", "proposition_title", "side"), "seq").alias("cover"))
    named = committees.groupBy(F.col("external_id").alias("cover_filer")).agg(F.min(F.struct("id", "name")).alias("committee"))
    out = left_join(rows, left_join(cover.withColumn("cover_filer", F.col("cover.filer_id")), named, "cover_filer"), "filing_id")
    link = F.when(F.col("committee_id").isNotNull(), "kept").when(F.col("filing_id").isNull(), "no_filing").when(F.col("cover").isNull(), "no_cover").when(F.col("committee").isNull(), "no_committee").otherwise("linked")
    pick = lambda own, new: F.when(F.col("link") == "linked", F.coalesce(new, own)).otherwise(F.col(own)).alias(own)
    return out.withColumn("link", link).select(
        "id", "filing_id", pick("committee_id", "committee.id"), pick("committee_name", "committee.name"), pick("candidate_name", "cover.candidate_name"),
        pick("proposition_title", "cover.proposition_title"), pick("side", "cover.side"), "link",
    )


def representative_funding(committees: DataFrame, contributions: DataFrame, expenditures: DataFrame, donors: int = 10) -> DataFrame:
    """By representative: raised, spent, different donors by canonical name, committees, and the largest donors.

    committees: id, representative_id, deleted_at. Sums of a committee are made before its representative is looked up. All
    names take part, however small their sums, so no spelling of a large donor is lost.
    """
    own = committees.where(F.col("deleted_at").isNull() & F.col("representative_id").isNotNull()).select(F.col("id").alias("committee_id"), "representative_id")
    spent = expenditures.groupBy("committee_id").agg(F.sum("amount").alias("spent"))
    raised = contributions.groupBy("committee_id").agg(F.sum("amount").alias("raised"))
    sums = own.join(raised, "committee_id", "left").join(spent, "committee_id", "left").groupBy("representative_id").agg(F.coalesce(F.sum("raised"), F.lit(0)).alias("raised"), F.coalesce(F.sum("spent"), F.lit(0)).alias("spent"), F.count(F.lit(1)).alias("committees"))
    per = contributions.groupBy("committee_id", "donor_name").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")).join(own, "committee_id")
    spelt = per.groupBy("representative_id", "donor_name").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n")).withColumn("donor_key", canonical_donor(F.col("donor_name")))
    bucket = spelt.groupBy("representative_id", "donor_key").agg(F.min_by("donor_name", F.struct(-F.col("amount"), F.col("donor_name"))).alias("donor"), F.sum("amount").alias("total"), F.sum("n").alias("contributions"))
    order = Window.partitionBy("representative_id").orderBy(F.desc("total"), F.asc("donor_key"))
    top = bucket.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= donors).groupBy("representative_id").agg(F.sort_array(F.collect_list(F.struct("rank", "donor", "total", "contributions"))).alias("top_donors"))
    count = bucket.groupBy("representative_id").agg(F.count(F.lit(1)).alias("donors"))
    return sums.join(count, "representative_id", "left").join(top, "representative_id", "left").withColumn("donors", F.coalesce("donors", F.lit(0)))


def measure_positions(filings: DataFrame, spending: list[DataFrame]) -> DataFrame:
    """(committee_id, proposition_id, position, is_primary) of committees on measures: what a filing declares, else what their spending implies.

    filings and each frame of spending: committee_id, proposition_id, side; rows lacking one say nothing. A declared
    position stands before an inferred one; of contradicting ones the least by name.
    """
    complete = lambda df: df.where(F.col("committee_id").isNotNull() & F.col("proposition_id").isNotNull() & F.col("side").isin("support", "oppose")).select("committee_id", "proposition_id", F.col("side").alias("position"))
    rows = complete(filings).withColumn("is_primary", F.lit(True))
    for frame in spending:
        rows = rows.unionByName(complete(frame).withColumn("is_primary", F.lit(False)))
    best = rows.groupBy("committee_id", "proposition_id").agg(F.min(F.struct((~F.col("is_primary")).alias("inferred"), "position")).alias("best"))
    return best.select("committee_id", "proposition_id", "best.position", (~F.col("best.inferred")).alias("is_primary"))
