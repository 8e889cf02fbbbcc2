"""Lists and work lists of the civic library: pages with totals, districts, rosters, hearings, revisions, budgets and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import committee_id, committee_key, role, role_rank
from .merge import first_by, pairs_of

#: Months back in which a hearing is looked for, and how many of a committee are shown.
HEARING_MONTHS, HEARINGS = 12, 5
#: Tokens that one more call is expected to take.
CALL_TOKENS = 2000
# What employment, residence, insurance and income of a profile imply.
WORKERS = ("w2", "1099", "self_employed", "business_owner")
RESIDENCE = ("permanent_resident", "daca", "visa_holder", "undocumented", "asylum_seeking")
PUBLIC_INSURANCE = ("medicare", "medicaid", "va", "tricare")
LOW_INCOME = ("under_25k", "25k_50k", "low", "lower_middle")


def page_with_total(rows: DataFrame, skip: int, take: int, *order: Column) -> DataFrame:
    """A page's rows with the total of all and whether more follow. The total is counted beside the page: its rows are few, so it is laid onto them."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).offset(skip).limit(take)
    return page.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.lit(skip + take) < F.col("total"))


def contributions(rows: DataFrame, skip: int, take: int, committee: str | None = None, source: str | None = None) -> DataFrame:
    """Attributed contributions, newest and largest first; a row without a committee is not shown yet."""
    rows = rows.where(F.col("committee_id").isNotNull())
    rows = rows.where(F.col("committee_id") == committee) if committee else rows
    rows = rows.where(F.col("source_system") == source) if source else rows
    return page_with_total(rows, skip, take, F.desc("date"), F.desc("amount"), F.asc("id"))


def attributed(rows: DataFrame, skip: int, take: int, side: str | None = None, committee: str | None = None, source: str | None = None) -> DataFrame:
    """Expenditures or independent spending that have a committee, newest and largest first, maybe of one side, committee or source."""
    for column, value in (("support_or_oppose", side), ("committee_id", committee), ("source_system", source)):
        rows = rows.where(F.col(column) == value) if value else rows
    return page_with_total(rows.where(F.col("committee_id").isNotNull()), skip, take, F.desc_nulls_first("date"), F.desc_nulls_first("amount"), F.asc("id"))


def committees(rows: DataFrame, skip: int, take: int, source: str | None = None) -> DataFrame:
    """Committees by name."""
    return page_with_total(rows.where(F.col("source_system") == source) if source else rows, skip, take, F.asc("name"), F.asc("id"))


def propositions(rows: DataFrame, skip: int, take: int) -> DataFrame:
    """Propositions, those without a day of election first, then the latest; of one day the newest row first."""
    return page_with_total(rows, skip, take, F.desc_nulls_first("election_date"), F.desc_nulls_first("created_at"), F.asc("id"))


def meetings(rows: DataFrame, skip: int, take: int) -> DataFrame:
    return page_with_total(rows, skip, take, F.desc_nulls_first("scheduled_at"), F.asc("id"))


def minutes(rows: DataFrame, skip: int, take: int, body: str | None = None) -> DataFrame:
    """Active minutes, maybe of one body, newest first."""
    rows = rows.where("is_active")
    return page_with_total(rows.where(F.col("body") == body) if body else rows, skip, take, F.desc_nulls_first("date"), F.asc("id"))


def representatives(rows: DataFrame, skip: int, take: int, chamber: str | None = None) -> DataFrame:
    """Representatives, maybe of one chamber, by chamber and last name."""
    return page_with_total(rows.where(F.col("chamber") == chamber) if chamber else rows, skip, take, F.asc("chamber"), F.asc("last_name"), F.asc("id"))


#: The chamber of those who govern a county.
SUPERVISORS = "Board of Supervisors"


def county_supervisors(homes: DataFrame, jurisdictions: DataFrame, plugins: DataFrame, reps: DataFrame) -> DataFrame:
    """(user_id, the representative's columns) of the county of each user's primary address, if its region is in use.

    homes: user_id, jurisdiction_id, is_primary; jurisdictions: jurisdiction_id, type, fips_code; plugins: fips_code, region, enabled; reps: region, chamber,
    deleted_at and more. Of several primary counties of a user the least id counts. There are few regions and many users in each: the supervisors are sent to the users' tasks,
    so that no region's pairs are one task's.
    """
    county = homes.where("is_primary").join(jurisdictions.where("type = 'COUNTY' AND fips_code IS NOT NULL"), "jurisdiction_id")
    one = county.groupBy("user_id").agg(F.min_by("fips_code", "jurisdiction_id").alias("fips_code"))
    regions = one.join(plugins.where("enabled"), "fips_code").select("user_id", "region")
    return pairs_of(regions, reps.where((F.col("chamber") == SUPERVISORS) & F.col("deleted_at").isNull()), "region", "user_id")


def committee_details(committees: DataFrame, assignments: DataFrame, reps: DataFrame, meetings: DataFrame, as_of: Column) -> DataFrame:
    """Committees that are not deleted with members (by role, then last name), their number, and hearings (latest first), as arrays of structs.

    committees: committee_id, name, chamber, deleted_at; assignments: committee_id, rep_id, role; reps: rep_id, name, last_name, party; meetings as hearings() takes them.
    """
    alive = committees.where(F.col("deleted_at").isNull()).drop("deleted_at")
    people = assignments.join(reps, "rep_id").withColumn("rank", role_rank(F.col("role")))
    person = F.struct("rank", "last_name", "rep_id", "name", "role", "party")
    members = people.groupBy("committee_id").agg(F.sort_array(F.collect_list(person)).alias("members"))
    members = members.withColumn("members", F.transform("members", lambda m: F.struct(*(m[c].alias(c) for c in ("rep_id", "name", "role", "party")))))
    heard = hearings(alive, meetings, as_of).groupBy("committee_id").agg(F.sort_array(F.collect_list(F.struct("rank", "meeting_id", "title", "scheduled_at", "url"))).alias("hearings"))
    out = alive.join(members, "committee_id", "left").join(heard, "committee_id", "left")
    for c, grouped in (("members", members), ("hearings", heard)):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(grouped.schema[c].dataType)))
    return out.withColumn("member_count", F.size("members").cast("long"))


def sessions(rows: DataFrame, token: Column, revoked: bool = False) -> DataFrame:
    """A user's sessions, the latest in use first, with their number for the user, their place, and whether one is the present one; ended ones only if asked for.

    rows: user_id, session_id, token, is_active, last_activity_at, created_at.
    """
    rows = rows if revoked else rows.where("is_active")
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_first("last_activity_at"), F.desc_nulls_first("created_at"), F.asc("session_id"))
    total = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return rows.withColumn("is_current", F.coalesce(F.col("token") == token, F.lit(False))).withColumn("place", F.row_number().over(order)).join(total, "user_id").drop("token")


def by_districts(reps: DataFrame, assembly: Column, senate: Column) -> DataFrame:
    """Representatives of the districts named in two texts; district numbers are stored with or without a leading zero."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int")
    own = F.col("district").cast("int")
    here = ((F.col("chamber") == "Assembly") & (own == number(assembly))) | ((F.col("chamber") == "Senate") & (own == number(senate)))
    return reps.where(F.coalesce(here & F.col("district").rlike(r"^\d+$"), F.lit(False)))


def roster(stored: DataFrame, found: DataFrame, references: DataFrame) -> DataFrame:
    """Committees after a sync: those found put in place or added, of a repeated one the last by seq; ids that money refers to and nobody names become stubs.

    stored: external_id, name, source_system. found: those and seq. references: external_id, source_system, seq. Adds action.
    """
    latest = first_by(found.where(F.coalesce("external_id", F.lit("")) != ""), ["external_id"], F.desc("seq")).select("external_id", F.col("name").alias("new_name"), F.col("source_system").alias("new_system"))
    named = stored.join(latest, "external_id", "full")
    action = F.when(F.col("new_name").isNull(), "kept").when(F.col("name").isNull(), "created").otherwise("updated")
    named = named.select("external_id", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_system", "source_system").alias("source_system"), action.alias("action"))
    wanted = references.where(F.col("external_id").isNotNull()).groupBy("external_id").agg(F.min_by("source_system", "seq").alias("source_system"))
    stubs = wanted.join(named, "external_id", "left_anti").select("external_id", F.col("external_id").alias("name"), "source_system", F.lit("stub").alias("action"))
    return named.unionByName(stubs)


def committees_of(reps: DataFrame, rep_id: str, chamber: str, assignments: str) -> tuple[DataFrame, DataFrame]:
    """Committees and memberships from the assignments (array of struct<name, role>) of representatives.

    (external_id, chamber, name): of the spellings of a committee the longest, of those of one length the least. And
    (rep, external_id, role), once for each.
    """
    rows = reps.select(F.col(rep_id).alias("rep"), F.col(chamber).alias("chamber"), F.explode(assignments).alias("a"))
    rows = rows.withColumn("name", F.trim("a.name")).withColumn("external_id", committee_id(F.col("chamber"), F.col("name"))).where(F.col("external_id").isNotNull() & (committee_key(F.col("name")) != ""))
    best = F.min_by("name", F.struct(-F.length("name"), F.col("name")))
    return rows.groupBy("external_id").agg(F.min("chamber").alias("chamber"), best.alias("name")), rows.select("rep", "external_id", role(F.col("a.role")).alias("role")).distinct()


#: Letters of a name by which titles are looked through for it.
GRAM = 3


def hearings(committees: DataFrame, meetings: DataFrame, as_of: Column, months: int = HEARING_MONTHS, most: int = HEARINGS) -> DataFrame:
    """The latest meetings whose title holds a committee's name, in its chamber, wherever in a word it begins; of meetings of one title and time the one with a full address.

    A title holds a name only if it holds every stretch of GRAM letters of it. So a name is joined by chamber and one of its stretches, the one
    that the fewest titles of the chamber hold, to titles exploded to their stretches, and then compared; names shorter than a stretch are stretches themselves.
    """
    low = lambda c: F.lower(F.col(c))
    grams = lambda text, n: F.array_distinct(F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda k: F.substr(text, k, F.lit(n)))).otherwise(F.array().cast("array<string>")))
    recent = meetings.where(F.col("scheduled_at") >= F.add_months(as_of, -months)).withColumn("url", F.when(F.col("agenda_url").rlike("(?i)^https?://"), F.col("agenda_url")))
    titles = recent.select("body", low("title").alias("low")).distinct()
    pieces = titles.select("body", "low", F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col("low"), n) for n in range(1, GRAM + 1)))))).alias("gram"))
    common = pieces.groupBy("body", "gram").agg(F.count(F.lit(1)).alias("held"))
    own = committees.where(F.col("name") != "").select("committee_id", low("name").alias("name"), F.col("chamber").alias("body"))
    asked = own.select("committee_id", "name", "body", F.explode(F.when(F.length("name") < GRAM, F.array("name")).otherwise(grams(F.col("name"), GRAM))).alias("gram"))
    rarest = asked.join(common, ["body", "gram"], "left").groupBy("committee_id", "name", "body").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("g"))
    wanted = rarest.where("g.held > 0").select("committee_id", F.col("name").alias("committee_name"), "body", F.col("g.gram").alias("gram"))
    found = pieces.join(wanted, ["body", "gram"]).where(F.contains("low", F.col("committee_name"))).select("committee_id", "body", "low").distinct()
    per = recent.groupBy("body", "title", "scheduled_at").agg(F.min(F.struct(F.col("url").isNull().alias("bare"), "meeting_id", "url")).alias("m"))  # before committees: the choice is theirs all
    one = per.withColumn("low", low("title")).join(found, ["body", "low"]).select("committee_id", "title", "scheduled_at", "m.meeting_id", "m.url")
    order = Window.partitionBy("committee_id").orderBy(F.desc("scheduled_at"), F.asc("title"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("committee_id", "meeting_id", "title", "scheduled_at", "url", "rank")


def active_revision(rows: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """Adds is_active: whether a row is its key's greatest revision. The greatest is a partial aggregate, joined back."""
    last = rows.groupBy(*keys).agg(F.max(revision).alias("last_revision"))
    return rows.join(last, keys, "left").withColumn("is_active", F.col(revision) == F.col("last_revision")).drop("last_revision")


def activity_summary(log: DataFrame, user: str, action: str, ts: str, success: str) -> DataFrame:
    """By user: actions of each kind, failures, and the latest sign-in and action, in one pass."""
    kind = F.col(action)
    return log.groupBy(user).agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "purchase").alias("purchases"), F.count_if(~F.col(success)).alias("failures"),
        F.max(F.when(kind == "signup", F.col(ts))).alias("last_signup"), F.max(ts).alias("last_action"),
    )


def search(rows: DataFrame, text: str, needle: str | None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows that are not deleted, hold a text in any case (its wildcards are plain characters), and are of a time."""
    rows = rows.where(F.col("deleted_at").isNull())
    rows = rows.where(F.contains(F.lower(text), F.lit(needle.lower()))) if needle else rows
    rows = rows.where(F.col("created_at") >= since) if since is not None else rows
    return rows.where(F.col("created_at") <= until) if until is not None else rows


def missing_summaries(minutes: DataFrame, most: int) -> DataFrame:
    """The work list: active minutes that have a text and no summary, newest first."""
    rows = minutes.where(F.col("is_active") & F.col("raw_text").isNotNull() & F.col("summary").isNull())
    return rows.orderBy(F.desc_nulls_last("date"), F.asc("id")).limit(most)


def token_budgets(calls: DataFrame, user: str, ts: str, as_of: Column, cap: int, call: int = CALL_TOKENS) -> DataFrame:
    """By user the tokens since the day began (UTC), and whether one more call stays within the cap."""
    today = calls.where(F.col(ts) >= F.date_trunc("day", as_of))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return today.groupBy(user).agg(F.sum(zero("tokens_in") + zero("tokens_out")).alias("used")).withColumn("within", F.col("used") + call <= cap)


def completion(parts: dict[str, Column]) -> tuple[Column, Column]:
    """Per cent of a profile's parts that are there, rounded half up, and the names of those that are not."""
    done = sum((F.coalesce(c, F.lit(False)).cast("int") for c in parts.values()), F.lit(0))
    left = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in parts.items()]), lambda x: x.isNotNull())
    return F.floor(done * 100 / len(parts) + 0.5).cast("int"), left


def ranking_flags(signal: str, private: str, masked: Column) -> dict[str, Column]:
    """Twenty flags, each false unless a field of the profile says so; those from the private part only if it is not masked.

    signal, private: names of struct columns. A missing struct gives false.
    """
    s, p = (lambda f: F.col(f"{signal}.{f}")), (lambda f: F.col(f"{private}.{f}"))
    some = lambda c: F.size(c) > 0
    flags = {
        "is_renter": s("tenure") == "renter", "is_homeowner": s("tenure") == "owner", "is_parent": some(s("children")) | some(s("parent_of")), "is_caregiver": s("eldercare"),
        "is_student": s("student_level").isNotNull(), "is_educator": s("educator"), "is_worker": s("employment").isin(*WORKERS), "is_business_owner": s("employment") == "business_owner",
        "is_union_member": s("union_member"), "is_gig_worker": s("gig_worker"), "is_transit_rider": s("transit_mode") == "transit",
        "is_driver": some(s("vehicles")) & F.exists(s("vehicles"), lambda v: v != "none"), "has_special_license": some(s("licenses")),
    }
    private_flags = {
        "has_immigration_concern": p("citizenship").isin(*RESIDENCE), "has_health_condition": some(p("conditions")), "has_public_health_insurance": p("insurance").isin(*PUBLIC_INSURANCE),
        "is_veteran": p("veteran") != "", "has_justice_involvement": some(p("justice")), "is_low_income": p("income").isin(*LOW_INCOME), "receives_public_benefits": some(p("benefits")),
    }
    flags |= {name: c & ~F.coalesce(masked, F.lit(False)) for name, c in private_flags.items()}
    return {name: F.coalesce(c, F.lit(False)).alias(name) for name, c in flags.items()}


def export(users: DataFrame, parts: dict[str, DataFrame], user: str) -> DataFrame:
    """(user, data): a JSON object for each user with its own row and an array of its rows of each table, ordered by all columns.

    A user's rows stand in one value, so this is for data of people, whose rows are few.
    """
    out = users.select(user, F.struct(*[c for c in users.columns if c != user]).alias("profile"))
    for name, rows in parts.items():
        grouped = rows.groupBy(user).agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != user]))).alias(name))
        out = out.join(grouped, user, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out.select(user, F.to_json(F.struct("profile", *parts)).alias("data"))


def rejects(rows: DataFrame, rules: dict[str, Column], most: int = 10) -> DataFrame:
    """One row: items, rejected ones, their share, and the first `most` different issues by name. An item may break several rules."""
    issues = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    out = rows.select(issues.alias("issues")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size("issues") > 0).alias("rejected"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("issues")))).alias("issues"))
    return out.select("items", "rejected", F.coalesce(F.col("rejected") / F.col("items"), F.lit(0.0)).alias("ratio"), F.slice("issues", 1, most).alias("issues"))
