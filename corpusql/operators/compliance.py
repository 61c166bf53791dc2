"""Privacy duties and retention as state: reports, access requests, predicates, transitions, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusql.functions import lexicon
from corpusql.operators import governance as g

PENDING = ("Submitted", "UnderReview")
EXPIRING_PURPOSES = ("Analytics", "Marketing")
SERVING_PURPOSES = ("ServiceProvision", "AccountManagement")
#: What an action makes of a record's status.
ACTIONS = ("hold", "release", "request", "approve", "delete")


def submitted(requests: DataFrame, days: int = 30) -> DataFrame:
    """``requests`` with the ``deadline`` that the law gives them."""
    return requests.withColumn("deadline", F.col("submitted_at") + F.make_dt_interval(F.lit(days)))


def with_expiry(consents: DataFrame, days: int = 365) -> DataFrame:
    """Consents to analytics and marketing end ``days`` after they were given; others don't."""
    return consents.withColumn("expires_at", F.when(F.col("purpose").isin(list(EXPIRING_PURPOSES)), F.col("ts") + F.make_dt_interval(F.lit(days))))


def consent_state(log: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """``user_id, purpose, valid, ts``: what a log of given and withdrawn consents leads to, by its last entry."""
    last = g.latest(log, "user_id", "purpose", order="o")
    last = with_expiry(last, days)
    return last.select("user_id", "purpose", g.consent_valid(as_of).alias("valid"), "ts")


def compliance_report(processing: DataFrame, consents: DataFrame, requests: DataFrame, breaches: DataFrame, as_of: Column) -> DataFrame:
    """One row: activities, valid consents, pending and overdue requests, breaches, and the status.

    Issues: requests past their deadline, breaches that the authority should know of and
    doesn't, activities without a lawful basis.  One table is read once; four rows meet.
    """
    p = processing.agg(F.count("*").alias("activities"), F.count_if(F.coalesce(F.col("lawful_basis"), F.lit("")) == "").alias("no_basis"))
    c = consents.agg(F.count_if(g.consent_valid(as_of)).alias("active_consents"))
    late = ~F.col("fulfilled") & (F.col("deadline") < as_of)
    r = requests.agg(F.count_if(F.col("status").isin(list(PENDING))).alias("pending_requests"), F.count_if(late).alias("overdue_requests"))
    notice = g.breach_notices(F.col("severity"))["authority"]
    b = breaches.agg(F.count("*").alias("breaches"), F.count_if(g.severity_rank(F.col("severity")) >= 3).alias("high_risk_breaches"), F.count_if(notice & ~F.col("authority_notified")).alias("unnotified"))
    out = p.crossJoin(c).crossJoin(r).crossJoin(b)  # one row each
    issues = sum((F.when(F.col(x) > 0, 1).otherwise(0) for x in ("overdue_requests", "unnotified", "no_basis")), F.lit(0))
    return out.withColumn("status", g.compliance_status(issues))


def access_request(subjects: DataFrame, consents: DataFrame, processing: DataFrame, as_of: Column, purposes: tuple[str, ...] = SERVING_PURPOSES) -> DataFrame:
    """What is held of each subject: ``user_id, kind, name, n, first, last, valid``, a row for each purpose of consent and each activity.

    Long form, so no subject's records have to fit in one row.
    """
    who = subjects.select("user_id").distinct()
    c = consents.join(who, "user_id", "left_semi").groupBy("user_id", F.col("purpose").alias("name"))
    c = c.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.coalesce(F.bool_or(g.consent_valid(as_of)), F.lit(False)).alias("valid")).withColumn("kind", F.lit("consent"))
    p = processing.where(F.col("purpose").isin(list(purposes))).join(who, "user_id", "left_semi").groupBy("user_id", F.col("activity").alias("name"))
    p = p.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).withColumns({"kind": F.lit("processing"), "valid": F.lit(None).cast("boolean")})
    return c.unionByName(p).select("user_id", "kind", "name", "n", "first", "last", "valid")


def retention_filter(as_of: Column, data_type: str | None = None, status: str | None = None, user: str | None = None, expired_only: bool = False, held_only: bool = False, created: tuple | None = None, expires: tuple | None = None) -> Column:
    """A predicate over retention records; ranges are (from, until), either of them None for open."""
    f = F.lit(True)
    for name, value in (("data_type", data_type), ("status", status), ("user_id", user)):
        if value is not None:
            f = f & (F.col(name) == value)
    if expired_only:
        f = f & g.expired(as_of)
    if held_only:
        f = f & g.held(as_of)
    for name, between in (("created_at", created), ("expires_at", expires)):
        since, until = between or (None, None)
        if since is not None:
            f = f & (F.col(name) >= F.lit(since))
        if until is not None:
            f = f & (F.col(name) <= F.lit(until))
    return f


def after_action(status: Column, is_held: Column, is_expired: Column, action: Column, soft: bool = True) -> Column:
    """The status that an action leads to; null where the action isn't allowed.

    A hold may come at any time and, once the last is released, the status is that of the
    time; deletion is requested only without a hold, approved only if requested, and done
    once approved.
    """
    deleted = F.lit("SoftDeleted" if soft else "Deleted")
    return (
        F.when(action == "hold", "LegalHold")
        .when((action == "release") & ~is_held, F.when(is_expired, "Expired").otherwise("Active"))
        .when((action == "release") & is_held, status)
        .when((action == "request") & ~is_held, "DeletionRequested")
        .when((action == "approve") & (status == "DeletionRequested"), "DeletionApproved")
        .when((action == "delete") & ~is_held & status.isin("DeletionApproved", "Expired"), deleted)
    )


def apply_actions(records: DataFrame, actions: DataFrame, as_of: Column, soft: bool = True) -> DataFrame:
    """``records`` with the ``status`` after one action each (``data_id, action``) and whether it was ``rejected``; records without one stay."""
    r = records.join(actions.select("data_id", "action"), "data_id", "left")
    to = after_action(F.col("status"), g.held(as_of), g.expired(as_of), F.col("action"), soft)
    r = r.withColumn("rejected", F.col("action").isNotNull() & to.isNull())
    return r.withColumn("status", F.coalesce(to, "status")).drop("action")


def with_hold(records: DataFrame, holds: DataFrame) -> DataFrame:
    """``records`` with one more hold each for ``holds`` (data_id, expires_at or null) and the status that goes with it."""
    new = holds.select("data_id", F.struct(F.lit(True).alias("active"), F.col("expires_at").cast("timestamp").alias("expires_at")).alias("__h"))
    r = records.join(new, "data_id", "left")
    more = F.col("__h").isNotNull()
    old = F.coalesce("holds", F.array().cast("array<struct<active:boolean,expires_at:timestamp>>"))
    return r.withColumn("holds", F.when(more, F.concat(old, F.array("__h"))).otherwise(old)).withColumn("status", F.when(more, "LegalHold").otherwise(F.col("status"))).drop("__h")


def without_holds(records: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """``records`` with the holds of ``ids`` (data_id) lifted: such a record is expired or active again."""
    r = records.join(ids.select("data_id", F.lit(True).alias("__l")).distinct(), "data_id", "left")
    lifted = F.coalesce("__l", F.lit(False))
    r = r.withColumn("holds", F.when(lifted, F.transform("holds", lambda h: F.struct(F.lit(False).alias("active"), h["expires_at"].alias("expires_at")))).otherwise(F.col("holds")))
    to = F.when(F.col("expires_at") < as_of, "Expired").otherwise("Active")
    return r.withColumn("status", F.when(lifted & (F.col("status") == "LegalHold"), to).otherwise(F.col("status"))).drop("__l")


def revoked(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """``keys`` with those of ``ids`` (key_id) made inactive."""
    r = keys.join(ids.select("key_id", F.lit(True).alias("__r")).distinct(), "key_id", "left")
    return r.withColumn("active", F.col("active") & F.col("__r").isNull()).drop("__r")


def issued(keys: DataFrame, new: DataFrame) -> DataFrame:
    """``keys`` and the ``new`` ones, which are active; a key_id that is there already is an error."""
    clash = new.join(keys.select("key_id", F.lit(True).alias("__c")), "key_id", "left")
    checked = clash.withColumn("active", F.when(F.col("__c").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("key exists: "), F.col("key_id").cast("string"))).cast("boolean"))).drop("__c")
    return keys.unionByName(checked, allowMissingColumns=True)


def purged(events: DataFrame, before: Column, ts: str = "ts") -> DataFrame:
    """The events that stay when older ones go."""
    return events.where(F.col(ts) >= before)


# API keys: ``key_id, owner, permissions, active, expires_at``.


def key_valid(as_of: Column) -> Column:
    return F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def authorised(keys: DataFrame, uses: DataFrame, as_of: Column, permission: str) -> DataFrame:
    """Each key with its ``usage_count`` (uses while it was valid) and whether it is ``valid`` and ``permitted``."""
    n = uses.groupBy("key_id").agg(F.count("*").alias("uses"))
    r = keys.join(n, "key_id", "left")
    valid = key_valid(as_of)
    return r.select("key_id", "owner", valid.alias("valid"), g.permitted(F.col("permissions"), permission).alias("permitted"), F.when(valid, F.coalesce("uses", F.lit(0))).otherwise(0).cast("long").alias("usage_count"))


def client_limit(kind: Column) -> Column:
    """Requests an hour by kind of client: address, key, administrator's key."""
    limits = F.create_map(*[F.lit(x) for kv in lexicon.CLIENT_LIMITS.items() for x in kv])
    return F.coalesce(F.try_element_at(limits, kind), F.lit(lexicon.CLIENT_LIMITS["ip"]))


def client_kind(api_key: Column, admin: Column) -> Column:
    return F.when(api_key.isNull(), "ip").when(F.coalesce(admin, F.lit(False)), "admin").otherwise("key")


def audit_sorted(events: DataFrame, by: str = "timestamp", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """Events by timestamp, type, user, severity or duration, from ``offset``; ties by id."""
    key = {"timestamp": F.col("ts"), "type": F.col("event_type"), "user": F.col("user_id"), "severity": g.severity_rank(F.col("severity")), "duration": F.col("duration_ms")}[by]
    return events.orderBy(key.desc() if descending else key.asc(), "event_id").offset(offset).limit(limit)


def should_log(severity: Column, level: str = "Info") -> Column:
    return g.severity_rank(severity) >= lexicon.SEVERITIES[level]
