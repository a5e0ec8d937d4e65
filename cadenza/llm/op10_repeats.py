"""Repeated passages: longest-previous-factor arrays over the passages that may repeat.

Texts are UTF-8 bytes. A window is MIN bytes; it repeats if equal bytes start anywhere
else. One suffix array of a corpus fits no machine, so windows are dealt first:

1. A window's anchor is its K-byte string of least hash (winnowing), a function of the
   window's bytes: equal windows have equal anchors at equal places. Neighbouring windows
   with one anchor are a run, and the run's bytes a region. Only (anchor, document, place,
   126 bits of region hash) is shuffled, counted by anchor before the shuffle.
2. An anchor that occurs once has no repeats. Where all regions of an anchor are equal,
   all their windows repeat, however many there are.
3. Other anchors' distinct regions come together with their bytes, in blocks of one suffix
   order: prefix doubling to depth MIN, ties by place. The previous and next smaller places
   of a suffix in that order give its longest previous factor, cut off at MIN, and where it
   stands; a window repeats iff its factor reaches MIN or it is such a factor itself.
4. Before that, an anchor of more than GROUP places has its runs cut by the anchor's place
   in the window, and keyed by all bytes that such windows share (WIDTHS: ever narrower
   cuts, so ever longer keys, at last the whole window). Pieces of equal bytes become one,
   and only keys of different pieces go on, so no group is more than a task can hold.
5. Each document's repeated windows are merged to spans.

A Bloom filter of bounded size keeps what no join can match from being shuffled.

keep='none' removes all copies, keep='first' all but the first by (doc_id, place).

Null and empty texts have no windows, nor have texts under MIN bytes. Equal rows repeat
each other; for keep='first' rows of equal doc_id and text are one document. Null doc_ids
come first. Input columns named like a computed one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Filter, ddl, drop_since, passing, quoted, written, written_so_far
from .words import byte_values, mix, powers, steps

MIN, K = 200, 40
#: Places of a key that are compared by one task.
GROUP = 1_000
#: Cuts of a larger key's windows, by how many places of the anchor in the window share a key.
WIDTHS = (40, 8, 1)
#: Window starts that one numpy step looks at, and bytes of one suffix order.
SLICE, BLOCK = 1 << 16, 1 << 18

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(ODD), -1, 1 << 64))
#: Bits of a packed hash that hold the place in a slice.
PLACE = 20
#: A prime and two bases: hashes modulo a prime have no structure in common with those modulo 2**64.
PRIME, BASES = (1 << 31) - 1, (1_298_345_417, 762_939_467)
#: Distinct values under 2**12 for bytes, so that sums of a slice stay under 2**64.
SMALL = (np.argsort(mix(np.arange(4096, dtype=np.uint64) + U(11)))[:256] + 1).astype(np.uint64)


def prime_powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(pow(base, done, PRIME)) % U(PRIME)
        done += more
    return out


def tables(most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers and inverse powers modulo 2**64 and, for each of BASES, modulo PRIME."""
    return [(powers(most, ODD), powers(most, INVERSE)), *((prime_powers(most, b), prime_powers(most, pow(b, -1, PRIME))) for b in BASES)]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    n, reach = len(x) - w + 1, 1
    while 2 * reach <= w:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:n], x[w - reach : w - reach + n])


def runs(buf: np.ndarray, off: np.ndarray, known: list) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window start in the row, anchor's place from there, number of windows, anchor, two region hashes) of each run."""
    values, w = byte_values(3), MIN - K + 1
    (up, down), *primes = known
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for lo in range(0, len(buf) - MIN + 1, SLICE):
        part = buf[lo : lo + SLICE + MIN - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        gram = mix((sums[K:] - sums[:-K]) * down[: len(part) - K + 1])
        n = len(part) - MIN + 1
        packed = (gram & ~U((1 << PLACE) - 1)) | np.arange(len(gram), dtype=np.uint64)
        at = (sliding_min(packed, w)[:n] & U((1 << PLACE) - 1)).astype(np.int64)
        row = owner[lo : lo + n]
        ok = row == owner[lo + MIN - 1 : lo + MIN - 1 + n]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        if not len(first):
            continue
        # a run ends before the next one, or before windows that leave the row
        stop = np.flatnonzero(np.concatenate([new[1:] | ~ok[1:], [True]]) & ok) + 1
        size, place = stop - first, at[first] - first
        end = stop + MIN - 1
        shape = (size << 8 | place).astype(np.uint64)
        region = mix((sums[end] - sums[first]) * down[first] + shape * ODD)
        small, other = SMALL[part], np.zeros(len(first), np.uint64)
        for to, back in primes:
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(small * to[: len(part)], out=total[1:])
            other = (other << U(31)) | (total[end] - total[first]) % U(PRIME) * back[first] % U(PRIME)
        yield row[first], first + lo - off[row[first]], place, size, gram[at[first]], region, mix(other) ^ shape


def places(docs: DataFrame, only: Filter | None = None) -> DataFrame:
    """doc_id, th, anchor, rh, rp, at (first window start, anchor's place, number of windows) of each run. docs: doc_id, th, text."""
    schema = T.StructType([docs.schema["doc_id"], *ddl("th bigint, anchor bigint, rh bigint, rp bigint, at bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables(SLICE + MIN + 1)
        for b in batches:
            for a, _, buf, off in steps(b.column(2)):
                for row, start, place, size, anchor, *region in runs(buf, off, known):
                    columns = [anchor.view(np.int64), *(x.view(np.int64) for x in region), (start << 16) + (place << 8) + size]
                    if only is not None:
                        keep = only.may_hold(columns[0])
                        row, columns = row[keep], [c[keep] for c in columns]
                    take = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *map(pa.array, columns)], names=schema.names)

    return docs.select("doc_id", "th", "text").mapInArrow(run, schema)


# --- suffix order of a block ------------------------------------------------------


def suffix_ranks(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The first 8 bytes of each suffix, and (depth, ranks by the first depth bytes), depth from 8 to MIN by doubling.

    Suffixes that reach beyond the end have some rank.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << U(8)) | padded[k : k + n]
    key, depth, out = first, 8, []
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        out.append((depth, rank))
        if depth == MIN:
            return first, out
        step = min(depth, MIN - depth)
        key = rank.astype(np.uint64) << U(32)
        key[: max(n - step, 0)] |= rank[step:]
        depth += step


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each value, -1 for none, by a tree of minima: up, then down."""
    n = len(x)
    levels = [x]
    while len(levels[-1]) > 1:
        y = levels[-1]
        if len(y) % 2:
            y = np.append(y, np.iinfo(x.dtype).max)
            levels[-1] = y
        levels.append(y.reshape(-1, 2).min(1))
    node, height = np.full(n, -1), np.zeros(n, np.int8)
    left, at = np.arange(n), np.arange(n)
    for k, y in enumerate(levels):
        beside = np.maximum(at - 1, 0)
        hit = (at & 1 == 1) & (y[beside] < x[left])
        node[left[hit]], height[left[hit]] = beside[hit], k
        left, at = left[~hit], at[~hit] >> 1
    for k in range(len(levels) - 1, 0, -1):
        i = np.flatnonzero(height == k)
        right = 2 * node[i] + 1
        node[i] = np.where(levels[k - 1][right] < x[i], right, right - 1)
        height[i] -= 1
    return node


def common_prefix(i: np.ndarray, j: np.ndarray, first: np.ndarray, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Bytes that the suffixes at i and j have in common, at most MIN; j of -1 has none in common. Both hold MIN bytes."""
    some = np.flatnonzero(j >= 0)
    out = np.zeros(len(i), np.int64)
    p, q = i[some], j[some]
    whole = ranks[-1][1][p] == ranks[-1][1][q]
    out[some[whole]] = MIN
    some, p, q = some[~whole], p[~whole], q[~whole]
    n, end = np.zeros(len(p), np.int64), len(first) - 1
    for depth, rank in reversed(ranks[:-1]):
        n += depth * (rank[np.minimum(p + n, end)] == rank[np.minimum(q + n, end)])
    differ = first[np.minimum(p + n, end)] ^ first[np.minimum(q + n, end)]
    for k in range(1, 8):
        n += differ >> U(64 - 8 * k) == 0
    out[some] = np.minimum(n, MIN - 1)
    return out


def factors(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor, cut off at MIN, of each window start (ascending) among the starts, and which start it is at (-1 for none)."""
    first, ranks = suffix_ranks(text)
    order = np.lexsort((starts, ranks[-1][1][starts]))
    n = len(order)
    before = previous_smaller(order)
    after = n - 1 - previous_smaller(order[::-1])[::-1]
    after[after == n] = -1
    longest, source = np.zeros(n, np.int64), np.full(n, -1)
    for near in (before, after):
        other = np.where(near >= 0, order[near], -1)
        size = common_prefix(starts[order], np.where(near >= 0, starts[other], -1), first, ranks)
        more = size > longest
        longest[more], source[more] = size[more], other[more]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return longest[back], source[back]


RUNS = "array<struct<lo:int,hi:int>>"
RUNS_ARROW = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def true_runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def compared(regions: DataFrame) -> DataFrame:
    """key, x, y, again, earlier: runs of windows that occur in another region of the key, and in an earlier one.

    regions: key, x, y, first, bytes, windows. Whole keys are gathered into blocks of about BLOCK bytes.
    """
    schema = ddl(f"key bigint, x bigint, y bigint, again {RUNS}, earlier {RUNS}")

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        base = np.cumsum([0, *(len(r[3]) for r in rows)])
        windows = np.array([r[4] for r in rows])
        starts = np.repeat(base[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        longest, source = factors(text, starts)
        later = longest >= MIN
        twice = later.copy()
        twice[source[later]] = True  # what a later one copies is a copy, too
        cut = np.cumsum(windows)[:-1]
        again, earlier = ([true_runs(f) for f in np.split(flags, cut)] for flags in (twice, later))
        keys = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(again, RUNS_ARROW), pa.array(earlier, RUNS_ARROW)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= BLOCK and r[0] != held[-1][0]:
                    yield solved(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield solved(held)

    dealt = regions.repartition("key").sortWithinPartitions("key", "first")
    return dealt.select("key", "x", "y", "bytes", "windows").mapInArrow(run, schema)


def pieces(regions: DataFrame, width: int) -> DataFrame:
    """key, x, y of each region, and its pieces: shift (windows before it), place, windows, bytes, key2, x2, y2.

    A window's group is the anchor's place in it, over width; key2 hashes all bytes that a group's windows share.
    """
    cut = regions.withColumn("g", F.explode(F.expr(f"sequence((place - windows + 1) div {width}, place div {width})")))
    cut = cut.withColumns({"high": F.expr(f"least(place, g * {width} + {width - 1})"), "low": F.expr(f"greatest(place - windows + 1, g * {width})")})
    cut = cut.withColumns({"shift": F.expr("place - high"), "n2": F.expr("high - low + 1"), "core": F.expr(f"substring(bytes, place - g * {width} + 1, {MIN + 1 - width})")})
    cut = cut.select("key", "x", "y", "first", "shift", F.col("high").alias("place"), F.col("n2").alias("windows"), F.expr(f"substring(bytes, shift + 1, n2 + {MIN - 1})").alias("bytes"), F.xxhash64("key", "g", "core").alias("key2"))
    shape = F.struct("place", "windows", "bytes")
    return cut.withColumns({"x2": F.xxhash64(shape), "y2": F.xxhash64(F.lit(1), shape)})


def resolved(regions: DataFrame, crowded: bool, level: int = 0) -> DataFrame:
    """key, x, y, again, earlier of the regions (distinct by key, x, y, of keys with different ones): by compared(),
    keys of more than GROUP places in pieces first. regions: key, x, y, n (places), first, place, windows, bytes."""
    if not crowded or level == len(WIDTHS):
        return compared(regions)
    few, many = regions.where(f"n <= {GROUP}"), regions.where(f"n > {GROUP}")
    cut = written(pieces(many, WIDTHS[level]), "op10-pieces")
    tally = cut.groupBy("key2").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(k) for f, c, k in ((F.min, "x2", "x0"), (F.max, "x2", "x1"), (F.min, "y2", "y0"), (F.max, "y2", "y1")))).where("n > 1")
    tally = written(tally.select("key2", "n", F.expr("x0 <> x1 OR y0 <> y1").alias("mixed")), "op10-keys")
    equal = cut.join(tally.select("key2"), "key2", "left_semi").groupBy("key2", "x2", "y2").agg(F.count(F.lit(1)).alias("copies"), F.min("first").alias("origin"))
    equal = written(equal, "op10-equal")
    next_ = cut.join(tally.where("mixed").select("key2", "n"), "key2").groupBy("key2", "x2", "y2").agg(F.max("n").alias("n"), F.min(F.struct("first", "place", "windows", "bytes")).alias("r"))
    next_ = next_.select(F.col("key2").alias("key"), F.col("x2").alias("x"), F.col("y2").alias("y"), "n", "r.*")
    below = resolved(next_, not tally.where(f"mixed AND n > {GROUP}").isEmpty(), level + 1).withColumnsRenamed({"key": "key2", "x": "x2", "y": "y2"})
    told = written(equal.join(below, ["key2", "x2", "y2"], "left"), "op10-below")
    met = cut.select("key", "x", "y", "first", "shift", "windows", "key2", "x2", "y2").join(told, ["key2", "x2", "y2"])
    moved = lambda c: F.transform(c, lambda r: F.struct((r["lo"] + F.col("shift")).cast("int").alias("lo"), (r["hi"] + F.col("shift")).cast("int").alias("hi")))
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("windows") - 1).cast("int").alias("hi")))
    none = F.expr(f"cast(array() as {RUNS})")
    again = F.coalesce(moved(F.when(F.col("copies") > 1, whole).otherwise(F.col("again"))), none)
    earlier = F.coalesce(moved(F.when(F.col("first") != F.col("origin"), whole).otherwise(F.col("earlier"))), none)
    out = met.groupBy("key", "x", "y").agg(F.flatten(F.collect_list(again)).alias("again"), F.flatten(F.collect_list(earlier)).alias("earlier"))
    return compared(few).unionByName(out)


def document_key() -> Column:
    return F.xxhash64("doc_id", "th")


def repeated_spans(docs: DataFrame, keep: str = "none") -> DataFrame:
    """d, t (doc_id and th) and spans (array of lo, hi byte ranges, in any order, may overlap) of documents with any. docs: doc_id, th, text."""
    spark, before = docs.sparkSession, written_so_far()
    mine = F.struct(F.col("doc_id"), F.col("th"), F.col("at"))
    bounds = [f(c).alias(k) for f, c, k in ((F.min, "rh", "r0"), (F.max, "rh", "r1"), (F.min, "rp", "p0"), (F.max, "rp", "p1"))]
    tally = places(docs).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *bounds, *([F.min(mine).alias("origin")] if keep == "first" else [])).where("n > 1")
    # written, so that a common anchor's places are no aggregate's and can be split between tasks
    tally = written(tally.withColumn("mixed", F.expr("r0 <> r1 OR p0 <> p1")).drop("r0", "r1", "p0", "p1"), "op10-tally")
    live = places(docs, Filter(tally, "anchor", spark)).join(tally, "anchor")
    if keep == "first":
        live = live.withColumn("lone", mine == F.col("origin")).drop("origin")
    live = written(live, "op10-live")
    whole = F.expr("array(named_struct('lo', 0, 'hi', cast((at & 255) - 1 as int)))")
    plain = live.where("NOT mixed").select("doc_id", "th", "at", (F.when(~F.col("lone"), whole) if keep == "first" else whole).alias("runs"))

    regions = written(live.where("mixed").groupBy("anchor", "rh", "rp").agg(F.count(F.lit(1)).alias("copies"), F.min(mine).alias("first"), F.max("n").alias("n")), "op10-regions")
    asked = regions.groupBy(F.col("first.doc_id").alias("d"), F.col("first.th").alias("t")).agg(F.collect_list(F.struct("anchor", "rh", "rp", "first", "n")).alias("asked"))
    homes = Filter(regions.select(F.xxhash64("first.doc_id", "first.th").alias("k")).distinct(), "k", spark)
    at_home = passing(docs, document_key(), homes).join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    at_home = at_home.dropDuplicates(["doc_id", "th"]).select(F.encode("text", "UTF-8").alias("raw"), F.explode("asked").alias("r")).select("r.*", "raw")
    at_home = at_home.withColumns({"windows": F.expr("cast(first.at & 255 as int)"), "place": F.expr("cast(shiftright(first.at, 8) & 255 as int)")})
    sent = at_home.select(F.col("anchor").alias("key"), F.col("rh").alias("x"), F.col("rp").alias("y"), "n", "first", "place", "windows", F.expr(f"substring(raw, cast(shiftright(first.at, 16) as int) + 1, windows + {MIN - 1})").alias("bytes"))
    told = resolved(sent, not tally.where(f"mixed AND n > {GROUP}").isEmpty()).withColumnsRenamed({"key": "anchor", "x": "rh", "y": "rp"})
    # what repeats only, written so that a common region's places can be split between tasks, as for the tally
    runs = "earlier" if keep == "first" else "again"
    told = regions.select("anchor", "rh", "rp", "copies", *(["first"] if keep == "first" else [])).join(told.select("anchor", "rh", "rp", runs), ["anchor", "rh", "rp"], "left")
    told = written(told.where(F.expr(f"copies > 1 OR size({runs}) > 0")), "op10-told")
    met = live.where("mixed").select("doc_id", "th", "at", "anchor", "rh", "rp").join(told, ["anchor", "rh", "rp"])
    if keep == "first":
        ours = F.when(mine == F.col("first"), F.col("earlier")).otherwise(whole)
    else:
        ours = F.when(F.col("copies") > 1, whole).otherwise(F.col("again"))
    spans = plain.unionByName(met.select("doc_id", "th", "at", ours.alias("runs"))).select("doc_id", "th", F.explode("runs").alias("r"), F.shiftright("at", 16).alias("base"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.struct((F.col("base") + F.col("r.lo")).alias("lo"), (F.col("base") + F.col("r.hi") + MIN).alias("hi")).alias("s"))
    out = written(spans.groupBy("d", "t").agg(F.collect_list("s").alias("spans")), "op10-spans")
    drop_since(spark, before | {out.written_path})
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and how many runs are removed."""
    keep, at, n = [], 0, 0
    reach = -1
    for lo, hi in sorted(spans):
        if lo > reach:
            keep.append(raw[at:lo])
            n += 1
        reach = max(reach, hi)
        at = max(at, hi)
    keep.append(raw[at:])
    return b"".join(keep), n


def remove_repeats(docs: DataFrame, keep: str = "none", text: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for each row of docs."""
    rows = docs.select("doc_id", quoted(text).cast("string").alias("text")).withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)))
    schema = T.StructType([docs.schema["doc_id"], *ddl("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept).fields])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def told(ids: pa.Array, texts: pa.Array, spans: pa.Array | None) -> Iterator[pa.RecordBatch]:
        out = []
        for k, value in enumerate(texts):
            raw = (value.as_py() or "").encode()
            mine = (spans[k].as_py() if spans is not None else None) or ()
            kept, n = without(raw, [(x["lo"], x["hi"]) for x in mine]) if mine else (raw, 0)
            out.append((len(raw), len(raw) - len(kept), n, sha256(kept).hexdigest(), kept))
        if out:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns[: 4 + with_kept]], names=schema.names)

    spans = repeated_spans(rows, keep)
    some = Filter(spans.select(F.xxhash64("d", "t").alias("k")), "k", docs.sparkSession)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~some.may_hold(b.column(2).to_numpy())))
            yield from told(b.column(0), b.column(1), None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from told(b.column(0), b.column(1), b.column(2))

    whole = rows.select("doc_id", "text", document_key().alias("k")).mapInArrow(untouched, schema)
    joined = passing(rows, document_key(), some).join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return whole.unionByName(joined.select("doc_id", "text", "spans").mapInArrow(cut, schema))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: All windows by their bytes: for tables of a few million bytes.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, md5(substr(h, 2 * k + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM d WHERE length(h) >= 400)),
twice AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, k FROM w SEMI JOIN twice USING (g)),
s AS (SELECT doc_id, k, k > coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 200, -1) AS fresh FROM hit),
r AS (SELECT doc_id, k, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM s),
spans AS (SELECT doc_id, run, min(k) AS lo, max(k) + 200 AS hi FROM r GROUP BY 1, 2),
p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS last FROM spans),
k AS (SELECT d.doc_id, any_value(h) AS h, coalesce(sum(hi - lo), 0) AS n_removed, count(lo) AS n_spans, coalesce(string_agg(substr(h, 2 * last + 1, 2 * (lo - last)), '' ORDER BY lo), '') AS head, coalesce(max(hi), 0) AS tail FROM d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(head || substr(h, 2 * tail + 1))) AS kept_sha256 FROM k
"""
