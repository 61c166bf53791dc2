"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of ``window`` consecutive lines is hashed (a text with fewer lines is one run by
itself); runs that occur more than once anywhere are found by one aggregation on the hash,
the first occurrence stays, and the lines covered by any later one are removed.  Only hashes
and positions are dealt out by window; texts move once, to meet the positions found for
them.  Runs are compared by 128 bits, so a false match isn't to be expected at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusql.llm.common import materialise


def line_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``df`` with repeated lines taken out of ``text_col``, and three figures of each row.

    Lines are cut at ``\\n`` and compared without spaces at either end; a window of blank
    lines only is no window.  The first occurrence is that with the smallest id (null before
    all), then the smallest hash of the text, then the earliest line.  Of equal rows all but
    one lose every line that lies in a window.  A text of fewer than ``window`` lines is
    compared as a whole with other such texts of as many lines; null stays null.  Added, in place of columns of these names: ``n_lines`` (0
    for null), ``n_removed``, ``removed`` (numbers of the removed lines, from 0).
    """
    added = ("n_lines", "n_removed", "removed")
    carried = [c for c in df.columns if c not in added and c != text_col]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carried], F.lit(0).alias("_")).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    rows = rows.select("row", "t", key.alias("k"), F.xxhash64("t").alias("h"))

    # Two hashes of each line: what is compared has 128 bits.
    hashed = rows.select("k", "h", F.transform(F.split("t", "\n"), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.lit(1), F.trim(x)).alias("b"))).alias("l"))
    blank = F.xxhash64(F.lit(""))

    def run_of(each):
        return F.when(F.exists(each, lambda x: x["a"] != blank), F.struct(F.xxhash64(F.transform(each, lambda x: x["a"])).alias("a"), F.xxhash64(F.transform(each, lambda x: x["b"])).alias("b")))

    windows = F.when(F.size("l") >= window, F.transform(F.sequence(F.lit(0), F.size("l") - window), lambda i: run_of(F.slice("l", i + 1, window)))).otherwise(F.array(run_of(F.col("l"))))
    found = hashed.where("l is not null").select("k", "h", F.posexplode(windows).alias("p", "w"), F.least(F.size("l"), F.lit(window)).alias("z")).where("w is not null")
    found = materialise(found.select("k", "h", "p", "z", "w.a", "w.b"), "line-windows")

    firsts = found.groupBy("a", "b", "z").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "p")).alias("f")).where("n > 1").select("a", "b", "z", "f")
    later = found.join(firsts, ["a", "b", "z"]).where(F.struct("k", "h", "p") != F.col("f"))
    covered = later.select("k", "h", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("z") - 1)).alias("p"))
    covered = covered.groupBy("k", "h").agg(F.collect_set("p").alias("gone"))

    met = rows.select("row", "t", "k", "h", F.split("t", "\n").alias("lines")).join(covered, ["k", "h"], "left")
    # Rows without text, however many are equal, need no numbers and are dealt by their place.
    place = F.when(F.length(F.trim(F.coalesce("t", F.lit("")))) == 0, F.monotonically_increasing_id() % 4096)
    copy = F.row_number().over(Window.partitionBy("k", "h", "place").orderBy("k"))
    met = met.withColumn("place", place).select("row", "t", "lines", "gone", copy.alias("copy"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    # Of equal rows the later ones hold nothing but later occurrences.
    blank_run = lambda i: F.forall(F.slice("lines", i + 1, window), lambda x: F.trim(x) == "")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - window, F.lit(0))), lambda i: ~blank_run(i))
    short = F.when(F.exists("lines", lambda x: F.trim(x) != ""), every)
    all_gone = F.when(F.size("lines") >= window, F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[i + j for j in range(window)]))))).otherwise(short)
    gone = F.when(F.col("copy") > 1, all_gone).otherwise(F.col("gone"))
    met = met.select("row", "t", "lines", F.sort_array(F.coalesce(gone, F.array().cast("array<int>"))).alias("gone"))
    met = met.select("row", "t", "lines", "gone", F.when(F.size("gone") > 0, F.array_except(every, "gone")).alias("kept"))
    text = F.when(F.col("kept").isNull(), F.col("t")).otherwise(F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n"))
    out = {c: F.col("row").getField(c) for c in carried} | {text_col: text}
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return met.select(*[out[c].alias(c) for c in df.columns if c not in added], n.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.col("gone").alias("removed"))


#: The same for documents with unique ids, in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(1, greatest(len(ls) - 2, 1) + 1)) AS i FROM d WHERE ls IS NOT NULL),
k AS (SELECT doc_id, i, least(len(ls), 3) AS z, list_transform(list_slice(ls, i, i + 2), lambda x: trim(x)) AS run FROM w),
o AS (SELECT doc_id, i, z, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS r FROM k WHERE array_to_string(run, '') <> ''),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + z)) AS i FROM o WHERE r > 1),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
