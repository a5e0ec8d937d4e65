"""Importance resampling towards a target distribution, with bit-sliced weights.

Features are hashed runs of words. A bucket's gain is the floored log ratio of the target's
and the corpus's smoothed shares of it. A document's counts by bucket become bit planes, one
bit a bucket; gains become bit planes of their magnitudes, those above and below zero apart.
The document's sum of gains is then exact: for each pair of planes, the population count of
their AND, times the product of their powers of two. Gumbel noise from a hash of the id turns
the ranking of weights into a draw without replacement.

Buckets are all that reaches the driver (BUCKETS counts of each side). Ranks come from a
range-partitioned sort of those that can be drawn, in which each task numbers its own rows.

Null and empty texts have no features, weight 0, and aren't drawn. A null id is hashed as an
empty one and comes last among ties. Repeated rows are rows. Input columns named like a
computed one are replaced. A text is taken whole; memory grows with the longest.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ddl, drop_since, others, quoted, written, written_so_far
from .words import ALNUM, LOWER, row_counts, steps, word_spans

BUCKETS = 10_000
#: Rows whose planes are held at once.
ROWS = 512
#: Longer spans are hashed one by one.
LONG = 64


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = crc_table()


def crc32_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, a byte of all spans at a time."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    at, size = starts[order], (ends - starts)[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(size[0]), LONG) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, "left"))
        now = crc[:live]
        crc[:live] = CRC[(now ^ raw[at[:live] + k]) & 255] ^ (now >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -LONG, "left"))):
        crc[i] = zlib.crc32(raw[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(buf: np.ndarray, off: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to `longest` words, and the row of each word."""
    low = LOWER[buf]
    s, e, row = word_spans(buf, off, ALNUM)
    if longest > 1:  # words one space apart, so that a run is a span
        size = e - s
        at = np.cumsum(size + 1) - size - 1
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(at, size) + k] = low[np.repeat(s, size) + k]
        low, s, e = joined, at, at + size
    rows, found = [], []
    for n in range(1, longest + 1):
        if len(s) < n:
            break
        inside = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
        rows.append(row[inside])
        found.append(crc32_spans(low, s[inside], e[inside + n - 1]).astype(np.int64) % buckets)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *found]), row


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks send their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, buf, off in steps(b.column(0)):
                total += np.bincount(features(buf, off, longest, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    parts = docs.select(quoted(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target's share / corpus's share)) of each bucket, shares smoothed by one."""
    n = len(corpus)
    above, below = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log((t + 1) * above / ((s + 1) * below))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def bits_by_word(word: np.ndarray, bit: np.ndarray, size: int) -> np.ndarray:
    """64-bit words of a plane; `word` ascends."""
    out = np.zeros(size, np.uint64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(bit, first)
    return out


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) of the gains' magnitudes."""
    words = (len(gains) + 63) >> 6
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gains, 0)
        for k in range(int(size.max(initial=0)).bit_length()):
            b = np.flatnonzero((size >> k) & 1)
            out.append((sign << k, bits_by_word(b >> 6, np.uint64(1) << (b & 63).astype(np.uint64), words)))
    return out


def sums_of_gains(rows: np.ndarray, buckets: np.ndarray, n: int, planes: list[tuple[int, np.ndarray]], width: int) -> np.ndarray:
    """The exact sum of gains over the features of each of n rows, from ANDs of planes."""
    words = (width + 63) >> 6
    out = np.zeros(n, np.int64)
    key, count = np.unique(rows * np.int64(width) + buckets, return_counts=True)
    row, bucket = key // width, key % width
    bit = np.uint64(1) << (bucket & 63).astype(np.uint64)
    power = 0
    while len(count):
        on = (count & 1) == 1
        held, place = np.unique(row[on], return_inverse=True)  # rows with a bit in this plane
        plane = bits_by_word(place * words + (bucket[on] >> 6), bit[on], len(held) * words).reshape(len(held), words)
        total = np.zeros(len(held), np.int64)
        for weight, gain in planes:
            total += weight * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
        out[held] += total << power
        power += 1
        more = count > 1
        row, bucket, bit, count = row[more], bucket[more], bit[more], count[more] >> 1
    return out


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", keep: list[str] | None = None, longest: int = 1) -> DataFrame:
    """The kept columns (all, unless named), n_words, n_features and weight: the floored mean of the features' gains."""
    added = ddl("n_words bigint, n_features bigint, weight bigint")
    kept = others(docs.select(*[quoted(c) for c in keep]) if keep is not None else docs, added.names)
    schema = T.StructType([*(docs.schema[c] for c in kept), *added.fields])
    names, width, buckets, planes = [*kept, *added.names], len(kept), len(gains), gain_planes(gains)

    def measured(texts: pa.Array) -> Iterator[list[np.ndarray]]:
        for a, b, buf, off in steps(texts):
            for first in range(0, b - a, ROWS):
                end = min(first + ROWS, b - a)
                part, places = buf[off[first] : off[end]], off[first : end + 1] - off[first]
                rows, found, words = features(part, places, longest, buckets)
                n = row_counts(rows, end - first)
                yield [row_counts(words, end - first), n, sums_of_gains(rows, found, end - first, planes, buckets) // np.maximum(n, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                new = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*measured(b.column(width)), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(width)), *new], names=names)

    return docs.select(*[quoted(c) for c in kept], quoted(text).cast("string").alias("__text")).mapInArrow(run, schema)


def with_score(weighed: DataFrame, doc_id: str = "doc_id", seed: int = 2024) -> DataFrame:
    """score: weight and Gumbel noise in thousandths, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(scored: DataFrame, doc_id: str = "doc_id", percent: int = 10, least_words: int = 20) -> DataFrame:
    """scored with rank: 1, 2, ... of the floored percent of rows of enough words, by score downwards, ties by id; null for all others.

    Distinct scores are whole numbers between sums of two logarithms (some 100,000), so that their counts are few.
    """
    spark = scored.sparkSession
    before = written_so_far()
    rows = others(scored, ["rank"])
    held = written(scored.select(*[quoted(c) for c in rows]), "op11-scored")
    fit = F.col("n_words") >= least_words
    by = held.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.col("score").desc())
    most = held.where(fit).count() * percent // 100
    bound = by.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") >= most).agg(F.max("score")).first()[0] if most else None
    if bound is None:
        return held.withColumn("rank", F.lit(None).cast("bigint"))
    drawn = fit & (F.col("score") >= bound)
    place = F.monotonically_increasing_id()
    ordered = held.where(drawn).orderBy(F.col("score").desc(), quoted(doc_id).asc_nulls_last())
    ordered = written(ordered.withColumns({"__part": F.shiftright(place, 33), "__place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "op11-drawn")
    parts = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row a task
    starts = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    rank = F.col("__start") + F.col("__place") + 1
    top = ordered.join(F.broadcast(starts), "__part").withColumn("rank", F.when(rank <= most, rank)).select(*[quoted(c) for c in rows], "rank")
    drop_since(spark, before | {held.written_path, ordered.written_path})
    return top.unionByName(held.where(~F.coalesce(drawn, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, longest: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """The kept columns, n_words, n_features, weight, score and rank. Rows with a rank are the sample that is distributed like the target (column `text`)."""
    gains = gains_of(bucket_counts(docs, text, longest), bucket_counts(target, "text", longest))
    kept = others(docs.select(*[quoted(c) for c in keep]) if keep is not None else docs, ["n_words", "n_features", "weight", "score", "rank"])
    return ranked(with_score(weigh(docs, gains, text, kept, longest), doc_id, seed), doc_id, percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
dn AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM dw) GROUP BY 1),
bn AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM bw) GROUP BY 1),
crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
hex AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dn UNION SELECT word FROM bn)),
bucket AS (SELECT word, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS b FROM hex, crc),
s AS (SELECT b, sum(n) AS s FROM dn JOIN bucket USING (word) GROUP BY 1), t AS (SELECT b, sum(n) AS t FROM bn JOIN bucket USING (word) GROUP BY 1),
g AS (SELECT r.b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM dn) + 10000)::DOUBLE / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM bn) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS b) r LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b),
dk AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM dw),
f AS (SELECT k, sum(gain) AS total FROM (SELECT k, unnest(w) AS word FROM dk) JOIN bucket USING (word) JOIN g USING (b) GROUP BY 1),
x AS (SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(floor(CAST(total AS DOUBLE) / len(w)) AS BIGINT) END AS weight, CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM dk d LEFT JOIN f ON f.k = d.k),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_features >= 20 AS fit FROM x),
z AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) END AS place, 10 * count(*) FILTER (fit) OVER () // 100 AS most FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM z
"""
