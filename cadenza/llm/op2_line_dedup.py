"""Line dedup: a deletion-neighbourhood join that drops later copies of a line.

A line repeats an earlier one (by doc_id, then line number) if they are within one edit.
Where short lines ("}" and "]", "1." and "2.") shall be told apart, `fuzzy_from` sets the
characters from which lines may differ; the default is all lines. Every line but the
earliest such goes, by the input alone: what an earlier line is compared with doesn't
depend on what stays.

Two lines within one edit share a half, and all but one block of about sqrt(n) characters:

1. Lines are grouped to distinct lines by 128 bits of hash, each with its first place;
   no text moves.
2. Distinct lines whose halves (prefix or suffix, by length class) occur once have no
   near partner. Only the others' texts are fetched.
3. Deletion variants, coarse: each line less one block, hashed. Fine, where two lines
   share a coarse variant: the block less each one character, and the block itself.
   Equal variants join: lines of one length that lack the same character differ by a
   substitution; a line that lacks a character equals a shorter one after a deletion.
   A variant's group is a minimum of first places, so no pairs are made. What is counted or
   reduced by key is written before it is joined by that key: a key of a third of all lines
   (a common first half, a log line's frame) is no aggregate's then and is split between tasks.
4. The edit distance to the earliest partner is verified.

Only DataFrame functions run. Blank lines (white space) and null or empty texts are
left as they are. Rows of equal doc_id and text are one document; null doc_ids come
first. Input columns named like a computed one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_since, hidden, others, quoted, shown, written, written_so_far

#: Characters from which a line may differ by one edit, unless told otherwise: all lines.
FUZZY_FROM = 1
LEAST_BLOCK = 16
#: Lines whose places (three numbers each, so some 12 MB) are sent to all tasks to fetch their texts; more are joined by a shuffle.
SMALL = 200_000


def half_keys(fuzzy_from: int) -> Column:
    """Hashes of the line's halves as the shorter (or equal) and as the longer line of a pair."""
    def halves(n: str) -> str:
        q = f"4 * ({n} div 8)"
        return f"array(xxhash64('p', {n} div 8, left(line, {q})), xxhash64('s', {n} div 8, right(line, {q})))"

    return F.expr(f"""
        CASE WHEN n % 8 = 0 AND n > {fuzzy_from} THEN concat({halves("n")}, {halves("(n - 1)")})
             ELSE {halves("n")} END""")


def with_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, line_no, line, n (characters) of lines that aren't blank. docs: doc_id, th, text."""
    lines = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.btrim("line", F.lit(" \t\r\f\v")) != "").withColumn("n", F.length("line"))


def hashed_lines(docs: DataFrame, fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """doc_id, th, line_no, f1, f2 (a line's 128 bits) and its half keys, null under fuzzy_from characters."""
    lines = with_lines(docs).withColumn("halves", F.when(F.col("n") >= fuzzy_from, half_keys(fuzzy_from)))
    return lines.select("doc_id", "th", "line_no", F.xxhash64("line").alias("f1"), F.xxhash64(F.lit(1), "line").alias("f2"), *(F.get("halves", F.lit(k)).alias(f"h{k}") for k in range(4)))


def shared(keys: DataFrame) -> DataFrame:
    """key: those that occur twice or more, written."""
    return written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "op2-shared")


def distinct_lines(docs: DataFrame, fuzzy_from: int) -> DataFrame:
    """f1, f2, half keys, first (place) and c (copies) of each distinct line."""
    halves = [F.min(f"h{k}").alias(f"h{k}") for k in range(4)]
    return hashed_lines(docs, fuzzy_from).groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "th", "line_no")).alias("first"), F.count(F.lit(1)).alias("c"), *halves)


def alike_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """first, line, n of distinct lines that share a half with another one."""
    keys = distinct.select("first", F.explode(F.array_compact(F.array(*(f"h{k}" for k in range(4))))).alias("key"))
    found = written(keys.join(shared(keys), "key", "left_semi").select("first").distinct(), "op2-alike")
    home = found.groupBy(F.col("first.doc_id").alias("d"), F.col("first.th").alias("t")).agg(F.collect_list("first").alias("firsts"))
    if found.count() <= SMALL:
        home = F.broadcast(home)
    lines = docs.join(home, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select(F.split("text", "\n").alias("lines"), F.explode("firsts").alias("first"))
    # a row that docs holds twice gives its lines twice
    return lines.select("first", F.expr("lines[first.line_no]").alias("line")).dropDuplicates(["first"]).withColumn("n", F.length("line"))


def coarse(lines: DataFrame, fuzzy_from: int) -> DataFrame:
    """first, short (or long), key, block: each line less one block, as the shorter and as the longer of a pair."""
    both = lines.select("line", "first", "n", F.explode(F.expr(f"IF(n > {fuzzy_from}, array(n, n - 1), array(n))")).alias("m"))
    both = both.withColumn("b", F.expr(f"greatest({LEAST_BLOCK}, cast(ceil(sqrt(m)) as int))"))
    cut = both.select("line", "first", "n", "m", "b", F.explode(F.expr("sequence(0, (m - 1) div b)")).alias("j"))
    tail = "greatest(m - (j + 1) * b, 0)"
    return cut.select(
        "first",
        F.expr("n = m").alias("short"),
        F.expr(f"xxhash64(m, j, left(line, j * b), right(line, {tail}))").alias("key"),
        F.expr(f"substr(line, j * b + 1, n - j * b - {tail})").alias("block"),
    )


def variants(blocks: DataFrame) -> DataFrame:
    """first, kind, key: fine deletion variants of blocks that share a coarse variant."""
    less = "concat(left(block, p - 1), substr(block, p + 1))"
    each = blocks.select("first", "short", "key", "block", F.explode(F.expr("sequence(1, length(block))")).alias("p"))
    swapped = each.where("short").select("first", F.lit("swap").alias("kind"), F.expr(f"xxhash64(key, p, {less})").alias("v"))
    dropped = each.where("NOT short").select("first", F.lit("less").alias("kind"), F.expr(f"xxhash64(key, {less})").alias("v"))
    whole = blocks.where("short").select("first", F.lit("whole").alias("kind"), F.expr("xxhash64(key, block)").alias("v"))
    return swapped.unionByName(dropped).unionByName(whole)


def near_firsts(lines: DataFrame, fuzzy_from: int) -> DataFrame:
    """first, near: place of the earliest other line within one edit, where it is before the line's own."""
    blocks = coarse(lines, fuzzy_from)
    blocks = written(blocks.join(shared(blocks), "key", "left_semi"), "op2-blocks")
    v = variants(blocks)
    least = v.groupBy("v").agg(*(F.min(F.when(F.col("kind") == k, F.col("first"))).alias(k) for k in ("swap", "less", "whole")), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    least = written(least, "op2-least")
    met = v.join(least, "v").select("first", F.when(F.col("kind") == "swap", F.col("swap")).when(F.col("kind") == "less", F.col("whole")).otherwise(F.col("less")).alias("near"))
    best = met.where("near < first").groupBy("first").agg(F.min("near").alias("near"))
    other = lines.select(F.col("first").alias("near"), F.col("line").alias("near_line"))
    return best.join(lines.select("first", "line"), "first").join(other, "near").where("levenshtein(line, near_line, 1) BETWEEN 0 AND 1").select("first", "near")


def repeated_lines(docs: DataFrame, fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """doc_id, th, line_no, kept (the earliest line's place) of each line that repeats an earlier one. docs: doc_id, th, text."""
    before = written_so_far()
    distinct = written(distinct_lines(docs, fuzzy_from), "op2-distinct")
    near = near_firsts(written(alike_lines(docs, distinct), "op2-lines"), fuzzy_from)
    told = distinct.join(near, "first", "left").where("c > 1 OR near IS NOT NULL").select("f1", "f2", F.least("first", "near").alias("kept"))
    told = written(told, "op2-told")
    drop_since(docs.sparkSession, before | {told.written_path})
    place = F.struct("doc_id", "th", "line_no")
    return hashed_lines(docs).drop(*(f"h{k}" for k in range(4))).join(told, ["f1", "f2"]).where(place > F.col("kept")).select("doc_id", "th", "line_no", "kept")


def dedup_lines(docs: DataFrame, text: str = "text", fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """docs with text less its repeated lines, n_lines and n_dropped; one row per row of docs."""
    rest = [c for c in others(docs, ["n_lines", "n_dropped"]) if c != text]
    keyed = docs.select(quoted("doc_id"), quoted(text).cast("string").alias("text")).withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)))
    gone = repeated_lines(keyed, fuzzy_from).groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_set("line_no").alias("__gone"))
    rows = docs.select(*[quoted(c) for c in rest], quoted(text).cast("string").alias("__text")).withColumn("__th", F.coalesce(F.xxhash64("__text"), F.lit(0)))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    lines = F.split("__text", "\n")
    stay = F.expr("array_except(sequence(0, size(__lines) - 1), __gone)")
    kept = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    out = rows.withColumn("__lines", lines).withColumns({"__kept": kept, "n_lines": F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint")})
    out = out.withColumn("n_lines", F.when(F.col("__text").isNull(), 0).otherwise(F.col("n_lines"))).withColumn("n_dropped", F.when(F.col("__gone").isNull(), 0).otherwise(F.col("n_dropped")))
    return out.select(*[F.col("__kept").alias(text) if c == text else quoted(c) for c in docs.columns if c == text or c in rest], "n_lines", "n_dropped")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts less lines that repeat an earlier line of the corpus; n_chars is counted again where a text changed."""
    out = shown(dedup_lines(hidden(docs)).withColumn("__changed", F.col("n_dropped") > 0), docs, more=("__changed",))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__changed")


# DuckDB's levenshtein counts bytes, of which a character has four at most; characters are compared after it.
SQL = r"""
WITH l AS (SELECT doc_id, k, lines[k] AS line, len(lines) AS n_lines FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, k, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT doc_id, k, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS r FROM w),
d AS (SELECT doc_id, k, line FROM f WHERE r = 1),
b AS (SELECT * FROM d),
s AS (SELECT * FROM d WHERE length(line) <= 20),
p AS (SELECT x.line, y.line AS other, y.doc_id, y.k, x.doc_id AS xd, x.k AS xk FROM s x JOIN s y ON abs(length(x.line) - length(y.line)) <= 1
  UNION SELECT x.line, y.line, y.doc_id, y.k, x.doc_id, x.k FROM b x JOIN b y ON left(x.line, 10) = left(y.line, 10) WHERE abs(length(x.line) - length(y.line)) <= 1
  UNION SELECT x.line, y.line, y.doc_id, y.k, x.doc_id, x.k FROM b x JOIN b y ON right(x.line, 10) = right(y.line, 10) WHERE abs(length(x.line) - length(y.line)) <= 1),
q AS (SELECT line, other, CASE WHEN length(line) < length(other) THEN line ELSE other END AS short, CASE WHEN length(line) < length(other) THEN other ELSE line END AS long FROM p WHERE (doc_id, k) < (xd, xk) AND levenshtein(line, other) <= 4),
n AS (SELECT DISTINCT line FROM q WHERE CASE WHEN length(short) = length(long) THEN len(list_filter(range(1, length(long) + 1), lambda i: short[i] <> long[i])) <= 1
  ELSE len(list_filter(range(length(long)), lambda i: left(long, i) || substr(long, i + 2) = short)) > 0 END),
g AS (SELECT doc_id, k FROM f WHERE r > 1 UNION SELECT d.doc_id, d.k FROM d JOIN n ON d.line = n.line)
SELECT o.doc_id, coalesce(count(l.k), 0) AS n_lines, count(g.k) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM documents o LEFT JOIN l ON o.doc_id = l.doc_id LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY o.doc_id
"""
