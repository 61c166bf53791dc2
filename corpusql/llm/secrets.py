"""Secret scan with linking of credential parts, in DataFrame functions only.

Strong findings (assignments of secrets, access key ids, long hexadecimal runs) are always
reported.  Parts that alone mean little (an account name, an opaque token, an endpoint) are
joined by interval with the parts that complete them: within one document and ``scope``
characters of each other.  A weak part is reported only where such a part is found; each
finding names the nearest part that completes it.

Text is read once, for the lengths of matches and of the gaps between them; all else works
on those numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusql.llm.common import materialise

# The base kinds as listed, then the weak ones.  Each has its pattern, the
# group that is measured and the least length of that group.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
N_BASE = 3
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "identifier": (r"""(?<![A-Za-z0-9_])((?i:user(?:_?(?:name|id))?|login|account|client_?id|tenant_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)""", 2, 3),
    "opaque": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 0, 20),
    "endpoint": (r"""(?<![A-Za-z0-9])(?i:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\s"'<>]+""", 0, 8),
}
#: Which parts complete which: an account and a secret, a secret and the place it opens.
SECRET, IDENTIFIER, PLACE = ("assign", "hex", "opaque"), ("access", "identifier"), ("endpoint",)
COMPLETE = {"assign": IDENTIFIER + PLACE, "access": SECRET, "hex": IDENTIFIER + PLACE, "identifier": SECRET, "opaque": IDENTIFIER + PLACE, "endpoint": SECRET}


def matches(text: Column, kind: str) -> Column:
    """Array of (gap before the match, its length, whether it counts), in code points; null if none."""
    pattern, group, least = PATTERNS[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    opaque = kind == "opaque"

    def one(z: Column) -> Column:
        good = F.length(z["v"]) >= least
        if opaque:  # letters and digits, so neither a word nor a rule of dashes
            good = good & z["v"].rlike("[0-9]") & z["v"].rlike("[A-Za-z]")
        return F.struct(F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("len"), good.alias("ok"))

    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    zipped = F.arrays_zip(gaps.alias("g"), whole.alias("m"), part.alias("v"))
    return F.when(text.rlike(pattern), F.transform(zipped, one))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row a document with its findings.

    Returns ``doc_id``; ``n_assign, n_access, n_hex``; ``found``: array of (start, kind
    number, end, kind, partner), all findings by start, then kind as listed, positions in
    code points with the end exclusive.  ``partner`` (kind, start, end) is the nearest part
    within ``scope`` that completes the finding, on a tie the one before it, and null where
    there is none.  A weak part that overlaps a base finding is not reported and completes
    nothing.  Null and empty texts have none; equal rows and rows with a null id each have
    their own row; other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    # The number is written with the rows, so it stays what it is.
    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), *[matches(F.col("t"), k).alias(k) for k in KINDS])
    numbered = materialise(numbered, "secret-matches")

    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("m")) for i, k in enumerate(KINDS)])
    some = F.greatest(*[F.size(F.coalesce(F.col(k), F.array().cast(numbered.schema[k].dataType))) for k in KINDS]) > 0
    spans = numbered.where(some).select("rid", F.explode(each).alias("e")).select("rid", "e.kind", F.posexplode("e.m").alias("i", "m"))
    run = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(run)
    spans = spans.select("rid", "kind", "m.ok", (end - F.col("m.len")).cast("long").alias("start"), end.cast("long").alias("end")).where("ok")

    # Interval join by sorted order: what ends last before a span, and, read from the other
    # end, what starts first after it.  Both frames grow row by row, so the cost is linear.
    before = Window.partitionBy("rid").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    number = {k: i for i, k in enumerate(KINDS)}
    base = F.col("kind") < N_BASE
    left, right = F.max(F.when(base, F.col("end"))).over(before), F.min(F.when(base, F.col("start"))).over(after)
    covered = ~base & (F.coalesce(left > F.col("start"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False)))
    spans = spans.withColumn("covered", covered).where("not covered").drop("covered")

    groups = sorted(set(COMPLETE.values()))
    for g, kinds in enumerate(groups):
        of = F.col("kind").isin([number[k] for k in kinds])
        spans = spans.withColumn(f"left{g}", F.max(F.when(of, F.struct("end", "start", "kind"))).over(before))
        spans = spans.withColumn(f"right{g}", F.min(F.when(of, F.struct("start", "end", "kind"))).over(after))

    def nearest(g: int) -> Column:
        gap_left, gap_right = F.col("start") - F.col(f"left{g}.end"), F.col(f"right{g}.start") - F.col("end")
        is_left = F.coalesce(gap_left < scope, F.lit(False)) & F.coalesce(gap_left <= gap_right, F.lit(True))
        part = lambda c: F.struct(name_of(c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        return F.when(is_left, part(F.col(f"left{g}"))).when(gap_right < scope, part(F.col(f"right{g}")))

    partner = F.coalesce(*[F.when(F.col("kind") == number[k], nearest(groups.index(needs))) for k, needs in COMPLETE.items()])
    spans = spans.select("rid", "kind", "start", "end", partner.alias("partner")).where(base | F.col("partner").isNotNull())

    found = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", name_of(F.col("kind")).alias("name"), "partner"))).alias("found"))
    out = numbered.select("rid", "doc_id").join(found, "rid", "left")
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == number[k]))
    none = F.array().cast(found.schema["found"].dataType)
    out = out.select("doc_id", F.coalesce("found", none).alias("found"))
    return out.select("doc_id", *[of(k).cast("long").alias(f"n_{k}") for k in KINDS[:N_BASE]], "found")


def name_of(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def links(found: Column) -> Column:
    """``kind:start:end>kind:start:end`` of each finding with a partner, joined by commas."""
    spelled = lambda x, k: F.concat_ws(":", x[k], x["start"], x["end"])
    return F.array_join(F.transform(F.filter(found, lambda x: x["partner"].isNotNull()), lambda x: F.concat(spelled(x, "name"), F.lit(">"), spelled(x["partner"], "kind"))), ",")


def joined(found: Column) -> Column:
    """``kind:start:end`` of each finding, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")


def base_of(found: Column) -> Column:
    return F.filter(found, lambda x: x["kind"] < N_BASE)
