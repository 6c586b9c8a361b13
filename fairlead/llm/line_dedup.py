"""Repeated runs of lines, by winnowing over line hashes.

A text is cut at line feeds (a null or empty text has no lines). Of each window of RUN consecutive lines the least line
hash is selected, the rightmost of equal ones: its position is the window's fingerprint. Equal windows select the same
line, so a run of RUN lines that occurs twice is guaranteed to be seen at a fingerprint of both places.

1. Each document lists its fingerprints, one row for each selected position (about half as many as there are windows), with
   the windows that selected it. 2. Fingerprints are counted, combined before the shuffle, and those whose hash occurs once are
   dropped with all their windows. 3. The positions that are left are extended to both sides, by the lines left and right of
   them in each window that selected them, and joined to the first position (in order of doc_id, null last, and line) that agrees
   in the fingerprint and in both sides, told by the SHA-256 of the lines. 4. Extended matches that follow one another make a
   run, which goes as far as it agrees; its first occurrence stays.
Positions are joined to the first one only, never listed in pairs.

Repeats shorter than RUN lines stay, and a text under RUN lines loses nothing even as an exact copy; the README has
figures. line_dedup takes a lower run (at 1, each line is its own fingerprint).

Defined results: rows that share doc_id and text stand at one position and are treated alike; a null doc_id counts as larger
than any; rows of one doc_id with different texts are ordered by a hash of the text; very long texts are listed whole, in one
row; an empty table gives no rows; other columns, whatever their names, are ignored. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import Scratch, load

RUN = 3
LAST = "9223372036854775807L"


def fingerprints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, row_key, p, f, windows): the selected positions, their line's hash, and start and digest of the windows that selected them."""
    lines = docs.selectExpr("cast(doc_id AS long) AS doc_id", "xxhash64(text, 1) AS row_key", r"split(text, '\n', -1) AS lines").where(f"size(lines) >= {run}")
    hashed = lines.withColumn("h", F.expr("transform(lines, (x, i) -> struct(xxhash64(x) AS f, -i AS p))"))  # of equal ones the rightmost is the least
    window = f"struct(i AS at, -array_min(slice(h, i + 1, {run})).p AS p, substr(unhex(sha2(array_join(slice(lines, i + 1, {run}), '\n'), 256)), 1, 16) AS digest)"
    windows = hashed.selectExpr("doc_id", "row_key", "h", f"transform(sequence(0, size(lines) - {run}), i -> {window}) AS w")
    own = f"transform(filter(slice(w, greatest(p - {run - 1}, 0) + 1, {run}), x -> x.p = p), x -> struct(x.at, x.digest))"
    return windows.selectExpr("doc_id", "row_key", f"inline(transform(array_distinct(w.p), p -> struct(p, h[p].f AS f, {own} AS windows)))")


def matched(table: DataFrame) -> DataFrame:
    """The fingerprints of the table whose hash occurs more than once."""
    return table.join(table.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "f")


def repeated_runs(spark: SparkSession, docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, row_key, starts): the windows of each document whose lines occur earlier."""
    scratch = Scratch(spark)
    table = scratch.keep(fingerprints(docs, run), "fingerprints")
    extended = scratch.keep(matched(table).selectExpr("doc_id", "row_key", "f", "inline(windows)"), "extended")
    place = f"struct(coalesce(doc_id, {LAST}) AS doc_id, row_key, at)"
    first = extended.groupBy("f", "digest").agg(F.expr(f"min({place})").alias("first"), F.count("*").alias("n")).where("n > 1").select("f", "digest", "first")
    found = extended.join(first, ["f", "digest"]).where(f"{place} > first")
    return found.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def line_dedup(spark: SparkSession, docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is kept) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length("text") > 0, F.col("text")).alias("text"))
    starts = repeated_runs(spark, docs.where("text IS NOT NULL"), run).select(F.coalesce("doc_id", F.expr(LAST)).alias("k"), "row_key", "starts")
    keyed = docs.select("*", F.coalesce("doc_id", F.expr(LAST)).alias("k"), F.xxhash64("text", F.lit(1)).alias("row_key"))
    both = keyed.join(starts, ["k", "row_key"], "left")
    both = both.select("doc_id", "text", "starts", F.expr(r"split(text, '\n', -1)").alias("lines"))
    both = both.withColumns({"begins": F.expr(f"filter(starts, (x, i) -> i = 0 OR starts[i - 1] < x - {run})"), "ends": F.expr(f"transform(filter(starts, (x, i) -> i = size(starts) - 1 OR starts[i + 1] > x + {run}), x -> x + {run})")})
    kept = "flatten(transform(sequence(0, size(begins)), j -> slice(lines, IF(j = 0, 0, ends[j - 1]) + 1, IF(j = size(begins), size(lines), begins[j]) - IF(j = 0, 0, ends[j - 1]))))"
    both = both.withColumn("kept", F.expr(f"CASE WHEN starts IS NULL THEN lines WHEN size(lines) >= 0 THEN {kept} END"))
    return both.selectExpr("doc_id", "coalesce(size(lines), 0) AS n_lines", "coalesce(size(lines) - size(kept), 0) AS n_removed", r"coalesce(array_join(kept, '\n'), '') AS text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark, load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS l FROM documents),
w AS (SELECT doc_id, pos, md5(array_to_string(list_slice(l, pos + 1, pos + {RUN}), chr(10))) AS h FROM (SELECT doc_id, l, unnest(range(len(l) - {RUN - 1})) AS pos FROM d WHERE len(l) >= {RUN})),
f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id, pos) AS d0, first_value(pos) OVER (PARTITION BY h ORDER BY doc_id, pos) AS p0 FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {RUN})) AS i FROM f WHERE doc_id <> d0 OR pos <> p0),
e AS (SELECT doc_id, l, unnest(range(len(l))) AS i FROM d),
k AS (SELECT e.doc_id, string_agg(l[e.i + 1], chr(10) ORDER BY e.i) AS kept, count(*) AS n FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY 1)
SELECT doc_id, len(l)::bigint AS n_lines, (len(l) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
