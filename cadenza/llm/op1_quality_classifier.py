"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features of a text are its hashed words, pairs and triples of neighbouring words,
over words and over words' shapes (letter cases, digits, marks, equality with the
word before), weighted by 1 + log(count), the vector scaled to length 1. A score is
the sparse dot product with the weights, through the logistic function.

The learner makes a few passes over at most `LABELLED_ROWS` labelled rows (those of
least hash outside the held-out third), which tasks turn to features; that sample is
the only bounded part. Every text is scored whole.

Null and empty texts have no features and get the score of the intercept. Equal rows
get equal results; input columns named like a computed one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, drop_since, least_hashes, others, quoted, written, written_so_far
from .words import SPACED, byte_values, gram_hashes, mix, powers, steps, word_hashes, word_spans

#: Bounds of the labelled rows that the learner reads, and of the bytes of their features.
LABELLED_ROWS, LABELLED_BYTES = 4_000, 256 << 20
BITS = 18
#: Passes over the sample, and FTRL-proximal's settings.
PASSES, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.002, 0.0005

U = np.uint64

#: Classes of bytes that shapes keep apart.
KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!", b"?", b"#*$%&", b"|", b"<>", b"'\"()-", b":;/\\=_@"), 1):
    KIND[np.frombuffer(_chars, np.uint8)] = _k
KIND[128:] = 1


def shape_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's kinds of bytes, runs of one kind counted as one."""
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    kinds = KIND[buf[np.repeat(starts, size) + place]]
    turn = np.ones(len(kinds), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[first] = True
    runs = np.cumsum(turn)
    at = runs - runs[np.repeat(first, size)]
    values = byte_values(7)[kinds]
    values *= powers(int(at.max()) + 1)[at]
    values[~turn] = 0
    return mix(np.add.reduceat(values, first))


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, place of each row, buckets, weights)."""
    for a, b, buf, off in steps(texts):
        s, e, row = word_spans(buf, off, SPACED)
        keys, rows = [], []
        if len(s):
            word, shape = word_hashes(buf, s, e, lower=True), shape_hashes(buf, s, e)
            again = np.zeros(len(word), np.uint64)
            again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
            for k, h in enumerate((word, shape + again)):
                for n in (1, 2, 3):
                    g = gram_hashes(h, n)
                    inside = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
                    keys.append(mix(g[inside] + U(10 * k + n)) >> U(64 - BITS))
                    rows.append(row[inside])
        if keys:
            both = (np.concatenate(rows).astype(np.uint64) << U(BITS)) | np.concatenate(keys)
            both.sort()
            new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            count = np.diff(np.append(new, len(both)))
            both = both[new]
            row, bucket = (both >> U(BITS)).astype(np.int64), (both & U((1 << BITS) - 1)).astype(np.int64)
            value = 1 + np.log(count)
            value /= np.sqrt(np.bincount(row, value * value, minlength=b - a))[row]
        else:
            row, bucket, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        yield a, b, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]), bucket, value


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights, the intercept last: FTRL-proximal over the rows, PASSES times, in the given order."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(PASSES):
        for bucket, value, y in rows:
            i, x = np.append(bucket, size - 1), np.append(value, 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (logistic(wi @ x) - y) * x
            grown = np.sqrt(ni + g * g)
            z[i] = zi + g - (grown - np.sqrt(ni)) / ALPHA * wi
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w


def held_out():
    return F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)")


def feature_columns(texts: pa.Array) -> list[pa.Array]:
    buckets, values = [], []
    for a, b, at, bucket, value in features(texts):
        for r in range(b - a):
            buckets.append(bucket[at[r] : at[r + 1]].astype(np.int32))
            values.append(value[at[r] : at[r + 1]].astype(np.float32))
    return [pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]


def fitted(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, most_bytes: int = LABELLED_BYTES) -> np.ndarray:
    """Weights learnt from at most `most` labelled rows outside the held-out third, and as many of those, in order of their hash, as have features of `most_bytes`; zeros (score 0.5) without any."""
    told = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    told = least_hashes(told, "doc_id", most)
    rows = arrow_map(docs.join(F.broadcast(told), "doc_id").select("doc_id", "quality", "text"), ["doc_id", "quality"], "text", [("buckets", "array<int>"), ("weights", "array<float>")], feature_columns)
    before = written_so_far()
    ordered = written(rows, "op1-features").orderBy(F.xxhash64("doc_id"), "doc_id", F.hash("buckets"))
    sizes = ordered.limit(most).select(F.size("buckets")).toArrow()[0].to_numpy()  # `most` numbers
    fits = int(np.searchsorted(np.cumsum(8 * sizes.astype(np.int64)), most_bytes, "right"))
    sample = ordered.limit(fits).toArrow()
    drop_since(docs.sparkSession, before)
    columns = [[x.values.to_numpy(zero_copy_only=False) for x in sample[c]] for c in ("buckets", "weights")]
    return train(list(zip(*columns, sample["quality"].to_pylist(), strict=True)))


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The kept columns and score."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # a fixed 2 MB

    def score(texts: pa.Array) -> list[pa.Array]:
        w, parts = sent.value, []
        for a, b, at, bucket, value in features(texts):
            of = np.repeat(np.arange(b - a), np.diff(at))
            parts.append(logistic(np.bincount(of, w[bucket] * value, minlength=b - a) + w[-1]))
        return [pa.array(np.concatenate(parts))]

    return arrow_map(docs, [c for c in others(docs, ["score"]) if c in keep], "text", [("score", "double")], score)


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns, unless named) with held_out, score and predicted."""
    weights = fitted(docs.select("doc_id", "text"), labels)
    out = scored(docs, weights, keep or docs.columns)
    return out.withColumns({"held_out": held_out(), "predicted": F.expr("cast(score >= 0.5 as int)")})


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return out.select(quoted("doc_id"), "held_out", "score", "predicted")
