"""Benchmark decontamination: exact containment of item windows by a prefix-filtered join.

A window (13 words of an item, or the whole of a shorter one) is contained where all
its words stand in order, so one word of it is a sufficient prefix: its rarest by
counts over all documents. Documents' words are joined to those prefix words only;
each match fixes where the window would start, start and end must lie in the
document (positional and length bounds), and the words are then compared.

The benchmark is dealt into blocks of about `BLOCK_WORDS` words; a block is sent to
all tasks, and documents are scanned once for each block, so nothing sent grows with it.
Of all blocks but the last only what was hit is written, by a 128-bit hash of the text;
no text is, and only texts with hits are shuffled.

Null and empty texts have no words: no hit, not contaminated. Items without words
count nowhere. Items with a null id mark words but are not listed. Equal rows get equal results;
input columns named like a computed one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Filter, ddl, drop_since, hidden, others, passing, quoted, shown, written, written_so_far
from .words import ALNUM, LOWER, steps, word_hashes, word_spans

WINDOW = 13
BLOCK_WORDS = 100_000
#: Matches of prefix words that one numpy step looks at.
MATCHES = 1 << 20


def words_of(texts: pa.Array):
    """(first row, end row, words' hashes, rows, bytes in lower case, first bytes, end bytes) by runs of rows."""
    for a, b, buf, off in steps(texts):
        s, e, row = word_spans(buf, off, ALNUM)
        yield a, b, word_hashes(buf, s, e, lower=True), row, buf, s, e


def block_windows(rows: list[tuple[str | None, str]], size: int = WINDOW) -> tuple[np.ndarray, list[bytes], dict]:
    """(hashes of the words, the words, items of each window by its words' numbers)."""
    texts, hashes, spelled = pa.array([t for _, t in rows], pa.string()), {}, []
    found: dict[tuple[int, ...], set] = {}
    for a, _, h, row, buf, s, e in words_of(texts):
        low = LOWER[buf].tobytes()
        ids = []
        for x, p, q in zip(h.tolist(), s.tolist(), e.tolist(), strict=True):
            if x not in hashes:
                hashes[x] = len(spelled)
                spelled.append(low[p:q])
            ids.append(hashes[x])
        for r in np.unique(row).tolist():
            mine = ids[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
            for k in range(max(1, len(mine) - size + 1)):
                found.setdefault(tuple(mine[k : k + size]), set()).add(rows[a + r][0])
    return np.array(list(hashes), np.uint64), spelled, found


def corpus_counts(docs: DataFrame, text: str, vocabulary) -> dict[int, int]:
    """How often the vocabulary's words occur in all documents, by number; bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = vocabulary.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for _, _, h, *_ in words_of(b.column(0)):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(total)], names=["word", "n"])

    found = docs.select(quoted(text).cast("string")).mapInArrow(run, "word int, n bigint").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def join_tables(windows: dict, counts: dict[int, int]) -> dict:
    """Arrays of the join: windows in order of their prefix word, its place, and the windows' items."""
    prefix = [min(range(len(w)), key=lambda k: (counts.get(w[k], 0), w[k], k)) for w in windows]
    rows = sorted(zip((w[k] for w, k in zip(windows, prefix, strict=True)), prefix, windows, strict=True))
    words = np.full((len(rows), max(map(len, windows))), -1, np.int32)
    for i, (_, _, w) in enumerate(rows):
        words[i, : len(w)] = w
    return {"prefix": np.array([r[0] for r in rows], np.int32), "place": np.array([r[1] for r in rows]), "size": np.array([len(r[2]) for r in rows]), "words": words, "items": [sorted(x for x in windows[r[2]] if x is not None) for r in rows]}


def occurrences(num: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence; num: the words' numbers, -1 for words of no item.

    Matches of prefix words are looked at in parts of about MATCHES, however common the words are.
    """
    lo = np.searchsorted(t["prefix"], num, "left")
    n = np.where(num >= 0, np.searchsorted(t["prefix"], num, "right") - lo, 0)
    hit = np.flatnonzero(n)
    parts = [occurring(hit[p], lo[hit[p]], n[hit[p]], num, row, t) for p in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(n[hit]) // MATCHES)) + 1)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def occurring(places: np.ndarray, lo: np.ndarray, n: np.ndarray, num: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """occurrences() for the prefix words at the given places, whose windows are the n from lo."""
    at = np.repeat(places, n)
    win = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = at - t["place"][win]
    end = start + t["size"][win] - 1
    ok = (start >= 0) & (end < len(num))
    ok[ok] = (row[start[ok]] == row[at[ok]]) & (row[end[ok]] == row[at[ok]])
    start, win = start[ok], win[ok]
    for k in range(t["words"].shape[1]):
        want = t["words"][win, k]
        ok = (want < 0) | (num[np.minimum(start + k, len(num) - 1)] == want)
        start, win = start[ok], win[ok]
    return start, win


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of ranges."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [x[0] for x in out], [x[1] for x in out]


RANGES = "array<struct<first:int,end:int>>"


def scan(docs: DataFrame, keep: list[str], text: str, vocabulary, tables, carried: bool) -> DataFrame:
    """keep, n_words, hits (word ranges) and item_ids; with `carried`, added to what docs' hits and item_ids hold."""
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *ddl(f"n_words bigint, hits {RANGES}, item_ids array<string>").fields])
    kind = [pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order, spelled = vocabulary.value
        t = tables.value
        for b in batches:
            n_words, hits, items = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for a, e, h, row, buf, s, q in words_of(b.column(at)):
                n_words[a:e] = np.bincount(row, minlength=e - a)
                if not len(known) or not len(h):
                    continue
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                num = np.where(known[k] == h, order[k], -1).astype(np.int32)
                start, win = occurrences(num, row, t)
                # hashes agree; the spelling decides
                low = LOWER[buf].tobytes() if len(start) else b""
                good = [all(low[s[p + j] : q[p + j]] == spelled[num[p + j]] for j in range(t["size"][w])) for p, w in zip(start.tolist(), win.tolist(), strict=True)]
                start, win = start[good], win[good]
                first = np.searchsorted(row, row[start])
                by = row[start]
                for r in np.unique(by).tolist():
                    mine = by == r
                    lo = start[mine] - first[mine]
                    hits[a + r] = list(zip(*merged(lo, lo + t["size"][win[mine]]), strict=True))
                    items[a + r] = sorted({i for w in set(win[mine].tolist()) for i in t["items"][w]})
            if carried:
                for r, (old, was) in enumerate(zip(b.column(at + 1).to_pylist(), b.column(at + 2).to_pylist(), strict=True)):
                    if old:
                        both = [*hits[r], *((x["first"], x["end"]) for x in old)]
                        hits[r] = list(zip(*merged(np.array([x[0] for x in both]), np.array([x[1] for x in both])), strict=True))
                        items[r] = sorted({*items[r], *was})
            told = pa.array([[{"first": x, "end": y} for x, y in r] for r in hits], kind[0])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array(n_words), told, pa.array(items, kind[1])], names=schema.names)

    cols = [*[quoted(c) for c in keep], quoted(text).cast("string").alias("__text")]
    return docs.select(*cols, *(["hits", "item_ids"] if carried else [])).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """keep (all columns, unless named) and n_words, hits (ranges of words), item_ids, n_hit, contaminated.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    kept = [c for c in others(docs, ["n_words", "hits", "item_ids", "n_hit", "contaminated"]) if keep is None or c in keep]
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = b.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    blocks = max(1, -(-int(words) // (block_words * 3)))

    def sent(k: int):
        """The k-th block's words and join tables, in all tasks."""
        mine = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else b
        known, spelled, windows = block_windows([(r[0], r[1]) for r in mine.collect()])
        order = np.argsort(known).astype(np.int32)
        counts = corpus_counts(docs, text, spark.sparkContext.broadcast((known[order], order))) if windows else {}
        return spark.sparkContext.broadcast((known[order], order, spelled)), spark.sparkContext.broadcast(join_tables(windows, counts) if windows else None)

    if blocks == 1:
        out = scan(docs, kept, text, *sent(0), False)
    else:  # what a text holds depends on the text alone: hits of earlier blocks are kept by its hash
        key, before = ["__h1", "__h2"], written_so_far()
        t = quoted(text).cast("string")
        keyed = docs.select(*[quoted(c) for c in kept], t.alias("__text"), F.xxhash64(t).alias("__h1"), F.xxhash64(F.lit(1), t).alias("__h2"))
        found = [written(scan(keyed, key, "__text", *sent(k), False).where("size(hits) > 0").drop("n_words").dropDuplicates(key), "op5-found") for k in range(blocks - 1)]
        held = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))
        held = written(held, "op5-held")
        drop_since(spark, before | {held.written_path})
        some = Filter(held, "__h1", spark)
        met = passing(keyed, F.col("__h1"), some).join(held, key, "left")
        rest = passing(keyed, F.col("__h1"), some, missing=True).withColumns({c: F.lit(None).cast(held.schema[c].dataType) for c in ("hits", "item_ids")})
        out = scan(met.unionByName(rest), kept, "__text", *sent(blocks - 1), True)
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["first"])
    return out.withColumn("n_hit", hit).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), "contaminated")


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    out = contamination(hidden(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return shown(out.where("NOT contaminated"), docs)


SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dg AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS gram FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, k, dg.size, item_id FROM dg JOIN win ON dg.size = win.size AND dg.gram = win.gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
