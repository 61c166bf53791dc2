"""Audit, retention, consent, keys, rate limits, metrics and caches over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from corpusql.functions import lexicon

SECURITY_EVENTS = ["UserLoginFailed", "UnauthorizedAccess", "SecurityViolation", "SuspiciousActivity"]


# Audit.


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in lexicon.SEVERITIES.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def audit_filter(types: list[str] | None = None, user: str | None = None, resource: str | None = None, success: bool | None = None, since=None, until=None, severity: str | None = None, contains: str | None = None) -> Column:
    f = F.lit(True)
    if types:
        f = f & F.col("event_type").isin(types)
    for name, value in (("user_id", user), ("resource_id", resource), ("success", success)):
        if value is not None:
            f = f & (F.col(name) == value)
    if since is not None:
        f = f & (F.col("ts") >= F.lit(since))
    if until is not None:
        f = f & (F.col("ts") <= F.lit(until))
    if severity:
        f = f & (severity_rank(F.col("severity")) >= lexicon.SEVERITIES[severity])
    if contains:
        f = f & F.col("action").contains(contains)
    return f


def audit_report(events: DataFrame) -> DataFrame:
    """Totals in all, by type, by user and by severity, in one pass over grouping sets.

    ``kind`` names the set (all, event_type, user_id, severity) and ``name`` the member.
    """
    cube = events.select(F.col("event_type").cast("string").alias("event_type"), F.col("user_id").cast("string").alias("user_id"), "severity", "success", "duration_ms", "data_size")
    cube.createOrReplaceTempView("__audit")
    return events.sparkSession.sql(
        """
        SELECT CASE grouping_id(event_type, user_id, severity) WHEN 7 THEN 'all' WHEN 3 THEN 'event_type' WHEN 5 THEN 'user_id' ELSE 'severity' END AS kind,
               coalesce(event_type, user_id, severity, '') AS name, count(*) AS n, count_if(NOT success) AS failed,
               round(avg(duration_ms), 6) AS avg_duration, coalesce(sum(data_size), 0) AS bytes
        FROM __audit GROUP BY GROUPING SETS ((), (event_type), (user_id), (severity))
        """
    )


def batches(requests: DataFrame, size: int = 50, wait_us: int = 100_000, key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """``key, id, batch, place``: requests in batches that close with ``size`` of them, or when one comes ``wait_us`` or more after the first.

    Sequential by nature: a key's requests are read in order of time in Arrow batches with
    constant state, never as a whole.
    """
    rows = requests.select(F.col(key).cast("long").alias("k"), F.col(id_col).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("k is not null")
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "k").sortWithinPartitions("k", "t", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, place, first = None, 0, 0, 0
        for pdf in frames:
            out = []
            for k, i, t in zip(pdf["k"].tolist(), pdf["id"].tolist(), pdf["t"].tolist()):
                if k != now:
                    now, batch, place, first = k, 0, 0, t
                elif place == size or t - first >= wait_us:
                    batch, place, first = batch + 1, 0, t
                out.append((k, i, batch, place))
                place += 1
            yield pd.DataFrame(out, columns=["k", "id", "batch", "place"])

    return rows.mapInPandas(run, "k long, id long, batch long, place long").withColumnRenamed("k", key).withColumnRenamed("id", id_col)


def top_users(events: DataFrame, n: int = 10) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(n)


def audit_event(event_type: Column, action: Column, user: Column, error: Column | None = None, severity: Column | None = None) -> list[Column]:
    """Columns of a new event; an error makes it failed and High."""
    error = F.lit(None).cast("string") if error is None else error
    severity = F.lit("Info") if severity is None else severity
    bad = error.isNotNull()
    return [event_type.alias("event_type"), action.alias("action"), user.alias("user_id"), (~bad).alias("success"), F.when(bad, "High").otherwise(severity).alias("severity"), error.alias("error")]


# Retention.


def expired(as_of: Column) -> Column:
    """Past its time and without any hold, active or not."""
    return (F.col("expires_at") < as_of) & (F.size(F.coalesce("holds", F.array().cast("array<struct<active:boolean,expires_at:timestamp>>"))) == 0)


def held(as_of: Column) -> Column:
    """Under a hold that is active and not over."""
    return F.coalesce(F.exists("holds", lambda h: h["active"] & (h["expires_at"].isNull() | (h["expires_at"] > as_of))), F.lit(False))


def with_policy(records: DataFrame, days: dict[str, int] | None = None) -> DataFrame:
    """``expires_at`` from the policy of the data type, that of Other where it has none."""
    days = days or lexicon.RETENTION_DAYS
    table = F.create_map(*[F.lit(x) for kv in days.items() for x in kv])
    return records.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.coalesce(F.try_element_at(table, F.col("data_type")), F.lit(days["Other"]))))


def retention_report(records: DataFrame, as_of: Column, soon_days: int = 30) -> DataFrame:
    """By status and data type: records, bytes, those expired, expiring soon and held, bytes that deletion would free."""
    soon = F.col("expires_at").between(as_of, as_of + F.make_dt_interval(F.lit(soon_days)))
    return records.groupBy("status", "data_type").agg(
        F.count("*").alias("records"),
        F.sum("data_size").alias("bytes"),
        F.count_if(expired(as_of)).alias("expired"),
        F.count_if(soon).alias("expiring"),
        F.count_if(held(as_of)).alias("held"),
        F.coalesce(F.sum(F.when(expired(as_of), F.col("data_size"))), F.lit(0)).alias("savings"),
    )


def retention_decisions(records: DataFrame, as_of: Column, needs_approval: tuple[str, ...] = ("Audit", "Account")) -> DataFrame:
    """What processing would do with each record: keep, held, request or delete."""
    d = F.when(held(as_of), "held").when(~expired(as_of), "keep").when(F.col("data_type").isin(list(needs_approval)) & (F.col("status") != "Approved"), "request").otherwise("delete")
    return records.withColumn("decision", d)


def latest(log: DataFrame, *key: str, order: str = "ts") -> DataFrame:
    """The last entry of each key: the state that an append-only log leads to."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__l")).select(*key, *[F.col(f"__l.{c}").alias(c) for c in rest])


# Consent and requests.


def consent_valid(as_of: Column) -> Column:
    return F.col("consent_given") & ~F.col("withdrawn") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def valid_consents(consents: DataFrame, as_of: Column) -> DataFrame:
    """``user_id, purpose, valid``: whether any consent holds."""
    return consents.groupBy("user_id", "purpose").agg(F.coalesce(F.bool_or(consent_valid(as_of)), F.lit(False)).alias("valid"))


def overdue(requests: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return requests.where(~F.col("fulfilled") & (F.col("submitted_at") + F.make_dt_interval(F.lit(days)) < as_of))


def erase(table: DataFrame, subjects: DataFrame, key: str = "user_id") -> DataFrame:
    return table.join(subjects.select(key).distinct(), key, "left_anti")


def compliance_status(issues: Column) -> Column:
    return F.when(issues == 0, "Compliant").when(issues <= 2, "MinorIssues").otherwise("MajorIssues")


def breach_notices(severity: Column) -> Column:
    """Struct: whether the authority and the persons concerned are told."""
    return F.struct((severity_rank(severity) >= 2).alias("authority"), (severity_rank(severity) >= 3).alias("subjects"))


# Keys and permissions.


def permitted(permissions: Column, wanted: str) -> Column:
    return F.array_contains(permissions, "All") | F.array_contains(permissions, wanted)


def key_stats(keys: DataFrame, as_of: Column) -> DataFrame:
    over = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    return keys.agg(F.count("*").alias("total"), F.count_if(F.col("active") & ~over).alias("active"), F.count_if(over).alias("expired"))


# Rate limits.


def client(api_key: Column, forwarded: Column, real_ip: Column) -> Column:
    return F.coalesce(F.concat(F.lit("api_key:"), api_key), F.trim(F.substring_index(forwarded, ",", 1)), real_ip, F.lit("unknown"))


def fixed_window(events: DataFrame, limit: int, seconds: int, key: str = "user_id", ts: str = "ts", strict: bool = False) -> DataFrame:
    """``key, n, allowed, rejected, windows``: windows start at a client's first request.

    A rejected request doesn't count; a window ends when ``seconds`` have passed (``strict``:
    more than that).  Sequential by nature: a client's events are read in order of time in
    Arrow batches with constant state, never as a whole.
    """
    rows = events.select(F.col(key).cast("long").alias("k"), (F.unix_micros(F.col(ts).cast("timestamp"))).alias("t"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "k").sortWithinPartitions("k", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, [0, 0, 0, 0]  # allowed, rejected, windows, in this window
        start = 0
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                if k != now:
                    if now is not None:
                        out.append((now, state[0] + state[1], *state[:3]))
                    now, state, start = k, [0, 0, 0, 0], None
                past = None if start is None else t - start
                if past is None or past > seconds * 1_000_000 or past == seconds * 1_000_000 and not strict:
                    start, state[3] = t, 0
                    state[2] += 1
                if state[3] < limit:
                    state[3] += 1
                    state[0] += 1
                else:
                    state[1] += 1
            yield pd.DataFrame(out, columns=["k", "n", "allowed", "rejected", "windows"])
        if now is not None:
            yield pd.DataFrame([(now, state[0] + state[1], *state[:3])], columns=["k", "n", "allowed", "rejected", "windows"])

    return rows.where("k is not null").mapInPandas(run, "k long, n long, allowed long, rejected long, windows long").withColumnRenamed("k", key)


# Metrics.


def histogram(values: DataFrame, column: str, bounds: list[float] | None = None, *by: str) -> DataFrame:
    """Cumulative buckets ``le_<i>`` with ``sum`` and ``count``, in one aggregation."""
    bounds = lexicon.HISTOGRAM_BOUNDS if bounds is None else bounds
    return values.groupBy(*by).agg(*[F.count_if(F.col(column) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)], F.round(F.sum(column), 6).alias("sum"), F.count(column).alias("count"))


def counters(points: DataFrame) -> DataFrame:
    """``name, labels, total, last``: sums for counters, last values for gauges."""
    return points.groupBy("name", "labels").agg(F.round(F.sum("value"), 6).alias("total"), F.max_by("value", F.struct("ts", "id")).alias("last"))


def _running(df: DataFrame, value: str, by: list[str], order: list[str], parts: int = 64) -> DataFrame:
    """``df`` with ``__n`` and ``__s``: number and sum of the rows up to each, within ``by`` in ``order``.

    The first column of ``order`` is cut into ranges by its quantiles; a key's rows are only
    ordered within a range, and what comes before the range is added from sums, so few and
    hot keys are dealt over many tasks.
    """
    at = F.col(order[0])
    at = F.unix_micros(at.cast("timestamp")) if df.schema[order[0]].dataType.typeName().startswith("timestamp") else at
    cuts = sorted(set(df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 1000)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c < at))
    cut = df.withColumn("__p", F.when(at.isNull(), -1).otherwise(part)).withColumn("__v", F.col(value).cast("decimal(38,9)"))
    sums = cut.groupBy(*by, "__p").agg(F.count("__v").alias("__c"), F.sum("__v").alias("__t"))
    w = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = sums.select(*by, "__p", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__bn"), F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__bs"))
    before = before.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__p").alias("__q"), "__bn", "__bs")
    match = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    joined = cut.join(before, match).select(*cut.columns, "__bn", "__bs")
    w = Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumn("__n", F.col("__bn") + F.count("__v").over(w)).withColumn("__s", F.col("__bs") + F.coalesce(F.sum("__v").over(w), F.lit(0)))
    return out.drop("__p", "__v", "__bn", "__bs")


def running_average(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``running_avg`` over each key's rows so far."""
    r = _running(df, value, by, order)
    return r.withColumn("running_avg", F.when(F.col("__n") > 0, (F.col("__s") / F.col("__n")).cast("double"))).drop("__n", "__s")


def moving_average(df: DataFrame, value: str, by: list[str], order: list[str], size: int = 1000) -> DataFrame:
    """``df`` with ``moving_avg`` over each key's last ``size`` values: the difference of two running sums."""
    r = _running(df, value, by, order)
    earlier = r.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], (F.col("__n") + size).alias("__m"), F.col("__s").alias("__e"))
    match = F.col("__n") == F.col("__m")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__{i}"))
    out = r.join(earlier, match, "left")
    n = F.least(F.col("__n"), F.lit(size))
    mean = F.when(n > 0, ((F.col("__s") - F.coalesce("__e", F.lit(0))) / n).cast("double"))
    return out.withColumn("moving_avg", mean).select(*df.columns, "moving_avg")


def prometheus(points: DataFrame, help_text: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``line``: ``name{labels} value timestamp`` of each point (``name, labels, value, ts``), and for each of ``help_text`` (name -> kind, text) its two leading lines."""
    labels = F.when(F.size("labels") == 0, "").otherwise(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ","), F.lit("}")))
    lines = points.select(F.concat_ws(" ", F.concat("name", labels), F.col("value").cast("string"), F.unix_seconds("ts").cast("string")).alias("line"))
    if not help_text:
        return lines
    head = [(x,) for name, (kind, text) in help_text.items() for x in (f"# HELP {name} {text}", f"# TYPE {name} {kind}")]
    return points.sparkSession.createDataFrame(head, "line string").unionByName(lines)


def counted(df: DataFrame, name: str, **points: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what an action on it counts on the way: an aggregate for each of ``points``, without a scan of its own."""
    seen = Observation(name)
    return df.observe(seen, *[v.alias(k) for k, v in points.items()]), seen


def counted_points(spark: SparkSession, seen: Observation, labels: dict[str, str], ts: Column) -> DataFrame:
    """What was counted as metric points: ``name, labels, value, ts``; to be called after the action."""
    rows = [(k, labels, float(v) if v is not None else None) for k, v in seen.get.items()]
    return spark.createDataFrame(rows, "name string, labels map<string,string>, value double").withColumn("ts", ts)


def metrics_summary(points: DataFrame) -> DataFrame:
    """One row: points, names, and the span of time."""
    return points.agg(F.count("*").alias("total_metrics"), F.countDistinct("name").alias("names"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def metrics_json(points: DataFrame) -> DataFrame:
    """``json``: each point as one object."""
    return points.select(F.to_json(F.struct("name", "labels", "value", F.unix_seconds("ts").alias("timestamp"))).alias("json"))


def metrics_html(points: DataFrame) -> DataFrame:
    """``row``: each point as a row of an HTML table."""
    return points.select(F.format_string("<tr><td>%s</td><td>%s</td><td>%s</td></tr>", F.col("name"), F.to_json("labels"), F.col("value").cast("string")).alias("row"))


def batch_efficiency(requests: DataFrame) -> DataFrame:
    """One row from ``batch`` (null: alone): requests, batches, mean size of a batch, percent of requests in batches."""
    n = F.count("batch")
    return requests.agg(
        F.count("*").alias("requests"),
        F.countDistinct("batch").alias("batches"),
        F.round(F.when(F.countDistinct("batch") > 0, n / F.countDistinct("batch")).otherwise(0.0), 6).alias("mean_size"),
        F.round(F.when(F.count("*") > 0, 100 * n / F.count("*")).otherwise(0.0), 6).alias("efficiency"),
    )


def pool_efficiency(events: DataFrame) -> DataFrame:
    """One row from ``connection, reused, open``: connections, idle ones, percent of requests that reused one."""
    return events.agg(
        F.countDistinct("connection").alias("connections"),
        F.count_if(~F.col("open")).alias("idle"),
        F.round(F.when(F.count("*") > 0, 100 * F.count_if("reused") / F.count("*")).otherwise(0.0), 6).alias("efficiency"),
    )


def query_stats(log: DataFrame, slow: float) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_if("cached").alias("cached"), F.count_if("failed").alias("failed"), F.max("duration").alias("slowest"), F.count_if(F.col("duration") > slow).alias("slow"), F.round(F.avg("duration"), 6).alias("average"))


# Caches.


def hit_rate(accesses: DataFrame) -> DataFrame:
    n = F.count("*")
    return accesses.agg(n.alias("n"), F.count_if("hit").alias("hits"), F.when(n == 0, 0.0).otherwise(F.count_if("hit") / n).alias("hit_rate"))


def evict(entries: DataFrame, policy: str, keep: int) -> DataFrame:
    """The ``keep`` entries that stay: LRU by last access, LFU by accesses, TTL by expiry, FIFO by age."""
    order = {"lru": F.desc("last_accessed"), "lfu": F.desc("access_count"), "ttl": F.desc("expires_at"), "fifo": F.desc("created_at")}[policy]
    return entries.orderBy(order, "key").limit(keep)


def evict_bytes(entries: DataFrame, most_bytes: int, buckets: int = 64) -> DataFrame:
    """The most recently used entries whose sizes sum to ``most_bytes`` at most.

    Sums are first taken over ranges of the last access, cut by its quantiles, so only the
    range in which the limit falls is ordered as a whole.
    """
    at = F.unix_micros("last_accessed")
    cuts = sorted(set(entries.agg(F.percentile_approx(at, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []))
    if not cuts:
        return entries
    # Numbered from the latest range on.
    sized = entries.withColumn("__b", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= at)))
    sums = sized.groupBy("__b").agg(F.sum("size_bytes").alias("__s"))
    before = sums.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__before"))
    w = Window.partitionBy("__b").orderBy(F.desc("last_accessed"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.join(F.broadcast(before), "__b").where(F.col("__before") <= most_bytes)
    return out.withColumn("__run", F.col("__before") + F.sum("size_bytes").over(w)).where(F.col("__run") <= most_bytes).drop("__b", "__before", "__run")


def unexpired(entries: DataFrame, as_of: Column) -> DataFrame:
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def cache_split(wanted: DataFrame, cache: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``wanted`` that the cache has, and those that it lacks."""
    return wanted.join(cache, list(key), "inner"), wanted.join(cache, list(key), "left_anti")
