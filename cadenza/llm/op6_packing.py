"""Packing: order-preserving dynamic programming over window cuts.

The tokens of a partition's documents, in doc_id order, are one stream. A sequence
is a run of at most LENGTH tokens between two cuts. Cuts cost nothing at document
ends, a little at sentence ends and more elsewhere (places every GRID tokens, so
that any text can be cut); a sequence costs its padding and a constant. With f(j) the
least cost up to cut place b[j],

    f(j) = cut(j) + SEQUENCE + LENGTH - b[j] + min over b[j] - b[i] <= LENGTH of f(i) + b[i],

a sliding-window minimum that a monotone queue gives in constant time each. A run
whose length is a power of two takes no padding: those few places are tried as well.

A stream is packed in blocks of BLOCK tokens; what follows a block's last cut but
one is carried over, so memory is bounded by a block and the longest text. Only a
partition's end leaves a sequence short. No row leaves its partition: there is no
shuffle.

Null and empty texts are their end token. Each row, equal or with a null id, is a
document of its own.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ddl, quoted

LENGTH, END = 2048, 1
SENTENCE_CUT, OTHER_CUT, SEQUENCE = 4, 12, 8
GRID, BLOCK = 32, 1 << 19
POWERS = [1 << k for k in range(4, 11)]

#: Id of the sequence: the partition's number above this bit, the place in it below.
PLACES = 33


class Tokens:
    """Ids of texts by a byte-level BPE file of the `tokenizers` library.

    The file's vocabulary is also run by tiktoken, which is four times as fast; a text
    that holds a special token, or any text if the two don't agree on a sample, goes to
    `tokenizers` itself.
    """

    SAMPLE = "It's 12 o'clock,\n\n  Größe 3.14 — naïve “quotes” \t tab; 日本語 end.  "

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.ends = np.zeros(0, bool)
        try:
            import tiktoken

            # byte-level BPE spells bytes as characters: printable ones as themselves, the rest from 256 up
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
            ranks = {bytes(spelled[c] for c in w): i for w, i in told["model"]["vocab"].items() if w not in self.special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.fast = fast if fast.encode_ordinary(self.SAMPLE) == self.slow.encode(self.SAMPLE, add_special_tokens=False).ids else None
        except (ImportError, KeyError, ValueError):
            self.fast = None
        #: Which ids end a sentence: their bytes close with one of . ! ? or a line feed.
        size = max(told["model"]["vocab"].values()) + 1
        self.ends = np.zeros(size, bool)
        for w, i in told["model"]["vocab"].items():
            self.ends[i] = w[-1:] in (".", "!", "?", "Ċ")

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def cut_places(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in one document where a cut may be, and what it costs there; the last is the document's end."""
    cost = np.full(len(ids) + 1, -1, np.int16)
    cost[GRID::GRID] = OTHER_CUT
    known = ids[:-1]
    cost[1:-1][ends[known] if len(known) else []] = SENTENCE_CUT
    cost[0], cost[-1] = -1, 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Indexes into `at` of the chosen cuts; the first place is 0 and the last one is chosen."""
    place, price = at.tolist(), cost.tolist()
    n = len(place)
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    tail = [np.searchsorted(at, at - p) for p in POWERS if p < length]
    exact = [np.where(at[t] == at - p, t, -1).tolist() for t, p in zip(tail, (p for p in POWERS if p < length), strict=True)]
    for j in range(1, n):
        b = place[j]
        while place[queue[0][1]] < b - length:
            queue.popleft()
        least, best = queue[0]
        least += length - b
        for x in exact:
            i = x[j]
            if i >= 0 and f[i] < least:
                least, best = f[i], i
        f[j] = now = least + price[j] + SEQUENCE
        back[j] = best
        key = now + b
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Stream:
    """Packs documents in the order given; yields (document, start, ids of the piece, tokens of the document, sequence, offset)."""

    def __init__(self, ends: np.ndarray, length: int = LENGTH, block: int = BLOCK):
        self.ends, self.length, self.block, self.sequence = ends, length, block, 0
        self.docs: deque[tuple[object, np.ndarray, int]] = deque()  # key, ids, tokens already packed
        self.at: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.size = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        at, cost = cut_places(ids, self.ends)
        self.docs.append((key, ids, 0))
        self.at.append(at + self.size)
        self.cost.append(cost)
        self.size += len(ids)
        if self.size >= self.block:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        if not self.size:
            return
        at, cost = np.concatenate([[0], *self.at]), np.concatenate([[0], *self.cost])
        cuts = at[best_cuts(at, cost, self.length)].tolist()
        if not last and len(cuts) > 2:  # the end of a block is no place to cut
            cuts = cuts[:-1]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            offset = 0
            while offset < hi - lo:
                key, ids, done = self.docs[0]
                n = min(len(ids) - done, hi - lo - offset)
                yield key, done, ids[done : done + n], len(ids), self.sequence, offset
                offset += n
                if done + n == len(ids):
                    self.docs.popleft()
                else:
                    self.docs[0] = (key, ids, done + n)
            self.sequence += 1
        left = at > cuts[-1]
        self.at, self.cost, self.size = [at[left] - cuts[-1]], [cost[left]], self.size - cuts[-1]


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(docs: DataFrame, tokenizer: str, text: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id and PIECES for each piece (with ids, the tokens, if asked): a document's pieces follow each other."""
    schema = T.StructType([docs.schema["doc_id"], *ddl(PIECES + ", ids array<int>" * with_ids).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        stream, out = Stream(tokens.ends, length), []
        base = TaskContext.get().partitionId() << PLACES
        types = None

        def batch(rows):
            keys, start, ids, total, seq, offset = zip(*rows, strict=True)
            columns = [pa.array([k.as_py() for k in keys], types), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array([base + s for s in seq], pa.int64()), pa.array(offset, pa.int64())]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for b in batches:
            types = b.schema.field(0).type
            for key, value in zip(b.column(0), b.column(1), strict=True):
                ids = tokens.ids(value.as_py() or "")
                out.extend(stream.add(key, np.append(ids, np.uint32(END))))
                if len(out) >= 4000:
                    yield batch(out)
                    out = []
        out.extend(stream.flush())
        if out:
            yield batch(out)

    rows = docs.select("doc_id", quoted(text).cast("string").alias("__text"))
    return rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("__text")).mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return packed(docs, tokenizer_path())
