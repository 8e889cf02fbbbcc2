"""Feeds, activity summaries and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TAKE = 100


def threshold_feed(rows: DataFrame, group: str, person: str, ts: str, as_of: Column, hours: int = 24, least: int = 3) -> DataFrame:
    """Groups seen in the last hours, of at least `least` rows, so that no single person shows: rows, people, first and last time. Rows without a group are in none."""
    recent = rows.where(F.col(group).isNotNull() & (F.col(ts) > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col(ts) <= as_of))
    out = recent.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(person).alias("people"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.where(F.col("n") >= least)


def hourly(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(rows: DataFrame, entity: str, kind: str, kinds: list[str]) -> DataFrame:
    """A column of counts for each kind, in one pass."""
    return rows.groupBy(entity).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.count(F.lit(1)).alias("n_all"))


def latest(rows: DataFrame, entity: str, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where(F.col("rank") <= n)


def hide(rows: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which not all conditions hold; where that is unknown (a null) they go, as in SQL."""
    return rows.where(~reduce(lambda a, b: a & b, conditions))


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the filters that are given: a value, a list, or a (low, high) tuple with None for an open end."""
    for name, value in wanted.items():
        if value is None:
            continue
        if isinstance(value, tuple):
            low, high = value
            rows = rows.where(F.col(name) >= low) if low is not None else rows
            rows = rows.where(F.col(name) <= high) if high is not None else rows
        else:
            rows = rows.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return rows


def excluded(rows: DataFrame, **unwanted) -> DataFrame:
    """Rows whose columns have none of the listed values; a null is no answer, so such rows go, as in SQL."""
    for name, values in unwanted.items():
        rows = rows.where(~F.col(name).isin(list(values)))
    return rows


def with_json(rows: DataFrame, column: str, path: str = "$") -> DataFrame:
    """Rows whose JSON column has something at the path: neither a null column, nor a JSON null, nor text that is no JSON."""
    return rows.where(F.get_json_object(column, path).isNotNull())


def with_some(parents: DataFrame, children: DataFrame, key: str, condition: Column) -> DataFrame:
    """Parents with a child that meets the condition, once each."""
    return parents.join(children.where(condition).select(key), key, "left_semi")


def page(rows: DataFrame, skip: int, take: int, *order: Column) -> DataFrame:
    """One page and one row more, which tells that there are more; the order should leave no ties."""
    if skip < 0 or not 1 <= take <= MAX_TAKE:
        raise ValueError(f"skip must not be negative, take from 1 to {MAX_TAKE}")
    return rows.orderBy(*order).offset(skip).limit(take + 1)


def after(rows: DataFrame, key: str, cursor, take: int) -> DataFrame:
    """The page after a key."""
    rows = rows if cursor is None else rows.where(F.col(key) > cursor)
    return rows.orderBy(key).limit(take)


def nest(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Children as an ordered array of structs on each parent; an empty one where there are none."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    out = parents.join(grouped, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def share(rows: DataFrame, by: str) -> DataFrame:
    """Each group's count and its share of all."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


#: Kinds of actions that are counted for a member beside the days of presence and absence.
COUNTED = ("amendment", "committee_hearing", "committee_report", "resolution", "vote", "speech")


def member_activity(actions: DataFrame, reps: DataFrame, since: Column) -> DataFrame:
    """For each of reps (rep_id, chamber): days present and absent, days of a roll call in the chamber, and a count of each of COUNTED, of actions since a day.

    actions: representative_id, body, date, kind, position. One pass over the actions for the members and one for the chambers; members without any have zeros.
    """
    recent = actions.where(F.col("date") >= since)
    roll = F.col("kind") == "presence"
    days = lambda position: F.countDistinct(F.when(roll & (F.col("position") == position), F.col("date")))
    own = recent.where(F.col("representative_id").isNotNull()).groupBy(F.col("representative_id").alias("rep_id")).agg(days("yes").alias("present_days"), days("absent").alias("absent_days"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in COUNTED))
    body = recent.where(roll).groupBy(F.col("body").alias("chamber")).agg(F.countDistinct("date").alias("session_days"))
    out = reps.select("rep_id", "chamber").join(own, "rep_id", "left").join(body, "chamber", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("rep_id", "chamber", *map(zero, ("present_days", "absent_days", "session_days", *(f"n_{k}" for k in COUNTED))))


def bills_page(bills: DataFrame, votes: DataFrame, co_authors: DataFrame, referrals: DataFrame, skip: int, take: int, lifecycle: str = "active", measure: str | None = None, session: str | None = None, author=None, committee=None, co_author=None) -> DataFrame:
    """A page of bills, the last moved first, with votes (latest first) and co-authors as arrays, the number of all and whether more follow.

    lifecycle: active, inactive or all. The filters are applied to the bills, by semi-joins where they are about rows beside them, and only the page's bills get their arrays.
    """
    rows = bills if lifecycle == "all" else bills.where(F.col("is_active") if lifecycle == "active" else ~F.col("is_active"))
    rows = filtered(rows, measure_type=measure, session=session, author_id=author)
    for children, column, value in ((referrals, "committee_id", committee), (co_authors, "representative_id", co_author)):
        rows = with_some(rows, children, "bill_id", F.col(column) == value) if value is not None else rows
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page_ = rows.orderBy(F.desc_nulls_first("last_action_date"), F.asc("number"), F.asc("bill_id")).offset(skip).limit(take)
    held = page_.select("bill_id")
    voted = votes.join(held, "bill_id", "left_semi").groupBy("bill_id").agg(F.sort_array(F.collect_list(F.struct("vote_date", "name", "position")), asc=False).alias("votes"))
    wrote = co_authors.join(held, "bill_id", "left_semi").groupBy("bill_id").agg(F.sort_array(F.collect_list(F.struct("representative_id", "name"))).alias("co_authors"))
    out = page_.join(voted, "bill_id", "left").join(wrote, "bill_id", "left").join(F.broadcast(total), F.lit(True))  # one row
    for c, grouped in (("votes", voted), ("co_authors", wrote)):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(grouped.schema[c].dataType)))
    return out.withColumn("has_more", F.lit(skip + take) < F.col("total"))


def committee_activity(actions: DataFrame, committees: DataFrame, since: Column) -> DataFrame:
    """For each of committees (committee_id): hearings, reports, amendments and different measures of actions (committee_id, date, kind, proposition_id) since a day; zeros where there are none."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    own = actions.where((F.col("date") >= since) & F.col("committee_id").isNotNull()).groupBy("committee_id").agg(of("committee_hearing").alias("hearings"), of("committee_report").alias("reports"), of("amendment").alias("amendments"), F.countDistinct("proposition_id").alias("measures"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return committees.select("committee_id").join(own, "committee_id", "left").select("committee_id", *map(zero, ("hearings", "reports", "amendments", "measures")))


def action_page(actions: DataFrame, skip: int, take: int, kinds: list[str] | None = None, with_presence: bool = False, **about) -> DataFrame:
    """A page of the actions about a member, a committee or a bill (a column and its value), the latest first, with the number of all and whether more follow.

    Where no kinds are asked for, or presence is not among them, that a member was there is not shown unless with_presence is set.
    """
    rows = filtered(actions, **about, kind=kinds)
    if not with_presence and "presence" not in (kinds or ()):
        there = F.coalesce((F.col("kind") == "presence") & (F.col("position") == "yes"), F.lit(False))
        rows = rows.where(~there)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.orderBy(F.desc_nulls_first("date"), F.asc("action_id")).offset(skip).limit(take)
    return shown.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.lit(skip + take) < F.col("total"))  # one row
