"""Near duplicates by SetSketch: banded registers, joint likelihood, full verification.

A text's set is its distinct 5-word shingles. Register i is the least of exponential
hashes of the set, kept as its place on a scale of powers of BASE (exponentially
spaced, truncated to 16 bits): registers merge by maximum, and two sets agree in a
register with a probability close to their Jaccard similarity J.

1. Texts of one set are one class (128-bit hash of the set); all else works on classes.
2. Bands of registers are keys. In each key's bucket one class is paired with the others,
   a star, no pairs within groups: at first the class that meets most others in all its
   buckets, in later rounds one by hash of (component, key), another in each bucket.
3. J of a pair is estimated from its registers and set sizes by maximum likelihood;
   pairs that can't reach the threshold go. The best pair of each class is verified on
   the full sets; then all pairs between what is not yet connected, in rounds, with new
   stars between the components that share a bucket.
4. Components that still share a bucket meet in a prefix-filtered join of how the full sets
   of their classes differ from the bucket's head, by blocks of differences that the same
   classes have: what a star's heads missed is found, and nothing is tried within a component.
5. Components of the verified links give each document its group.

With BANDS bands of ROWS registers a pair at J = 0.85 misses all bands with a
probability of (1 - 0.85**4)**24 < 1e-7, one at the pipeline's J = 0.8 of less than 1e-5.

Null, empty and wordless texts have an empty set and link to nothing; with fewer
than five words the whole sequence is the one shingle. Equal texts are one class.
A document's rows with one doc_id and equal sets get equal results; null ids take
part in links, and a group of nothing but null ids has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Filter, arrow_map, drop_since, hidden, passing, quoted, shown, written, written_so_far
from .components import components
from .words import FACTORS as PLACES
from .words import SPACED, gram_hashes, mix, steps, word_hashes, word_spans

SHINGLE = 5
REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The same for the pipeline's stage.
STAGE_PERCENT = 80
#: Standard deviations of the estimate (about 0.037 at J = 0.85) that a linked pair may lie low.
SLACK = 6
#: Rounds of stars, each with other heads in each bucket, before the last pass.
ROUNDS = 1
#: A class of more than one in HOT rows is joined by broadcast: there are fewer than HOT of them.
HOT = 1024

U = np.uint64
FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * U(0xA0761D6478BD642F)) | U(1)


def shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingles' hashes in order, first place of each row and the end, a second hash of each shingle)."""
    for a, b, buf, off in steps(texts):
        s, e, row = word_spans(buf, off, SPACED)
        h = word_hashes(buf, s, e, lower=True)
        n = np.bincount(row, minlength=b - a)
        g, g2, owner = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(h) >= SHINGLE:
            inside = np.flatnonzero(row[SHINGLE - 1 :] == row[: 1 - SHINGLE])
            g, g2, owner = gram_hashes(h, SHINGLE)[inside], gram_hashes(h, SHINGLE, SHINGLE)[inside], row[inside]
        few = np.flatnonzero((n > 0) & (n < SHINGLE))
        if len(few):
            at, whole = np.concatenate([[0], np.cumsum(n)])[few], np.zeros(len(few), np.uint64)
            for k in range(SHINGLE - 1):
                on = n[few] > k
                whole[on] += h[at[on] + k] * PLACES[k]
            whole = mix(whole + n[few].astype(np.uint64))
            g, g2, owner = np.concatenate([g, whole]), np.concatenate([g2, whole]), np.concatenate([owner, few])
        order = np.lexsort((g, owner))
        g, g2, owner = g[order], g2[order], owner[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, g2, owner = g[new], g2[new], owner[new]
        yield a, b, g, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))]), g2


def class_ids(g: np.ndarray, at: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """For each row with shingles, 64-bit sums of two hashes of its shingles: equal for equal sets."""
    on = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if len(on):
        out[on, 0] = np.add.reduceat(mix(g ^ U(0x1D8E4E27C47D124F)), at[on])
        out[on, 1] = np.add.reduceat(mix(g2 + U(0xEB44ACCAB455D165)), at[on])
    return out


def registers(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers of each row with shingles."""
    on = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, REGISTERS), np.uint16)
    if len(on):
        least = np.empty((len(on), REGISTERS))
        for i, f in enumerate(FACTORS):
            least[:, i] = np.minimum.reduceat(g * f, at[on])
        exponential = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
        out[on] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP)
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as one binary value each."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(raw)])


def sketch_columns(texts: pa.Array) -> list[pa.Array]:
    parts = [(np.diff(at), class_ids(g, at, g2), registers(g, at)) for _, _, g, at, g2 in shingles(texts)]
    n, ids, regs = (np.concatenate(x) for x in zip(*parts, strict=True))
    return [pa.array(n, pa.int64()), binary(ids), binary(regs)]


def sketches(docs: DataFrame, text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, more, n_shingles, node (the set's class), regs."""
    return arrow_map(docs, ["doc_id", *more], text, [("n_shingles", "bigint"), ("node", "binary"), ("regs", "binary")], sketch_columns)


def likelihood_jaccard(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """J of greatest joint likelihood of rows of registers u, v of sets of nu, nv elements.

    With x, y the shares of the sets in nu + nv, a register of the first is the greater one
    with probability p(x - y J), the smaller with p(y - x J), p(z) = -log_b(1 - z (b - 1) / b).
    """
    more, less = (u > v).sum(1), (u < v).sum(1)
    same = u.shape[1] - more - less
    x, y = nu / (nu + nv), nv / (nu + nv)
    p = lambda z: -np.log1p(-np.clip(z, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        a, b = p(x - y * j), p(y - x * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))

    lo, hi = np.zeros(len(x)), np.minimum(x / y, y / x)
    for _ in range(40):  # the likelihood is concave in J
        m1, m2 = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = score(m1) < score(m2)
        lo, hi = np.where(up, m1, lo), np.where(up, hi, m2)
    return (lo + hi) / 2


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, j of the pairs whose estimate doesn't rule the threshold out."""
    t = percent / 100
    floor = t - SLACK * (t * (1 - t) / REGISTERS) ** 0.5
    side = lambda k: classes.select(F.col("node").alias(k), F.col("regs").alias(f"r{k}"), F.col("n_shingles").alias(f"n{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, v = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
                j = likelihood_jaccard(u, v, *(b.column(c).to_numpy().astype(float) for c in (4, 5)))
                ok = pa.array(j >= floor)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(j[j >= floor])], names=["a", "b", "j"])

    both = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a binary, b binary, j double")


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """node, items (all hashes of the set, ascending) of the given nodes, from one document of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, g, at, g2 in shingles(b.column(0)):
                ids = class_ids(g, at, g2)
                items = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(g))])
                yield pa.RecordBatch.from_arrays([binary(ids), items], names=["node", "items"])

    wanted = classes.join(nodes, "node", "left_semi").select("rep").distinct()
    only = Filter(wanted.select(F.xxhash64("rep").alias("k")), "k", docs.sparkSession)
    texts = passing(docs.select(F.col("doc_id").alias("rep"), quoted(text).cast("string").alias("__text")), F.xxhash64("rep"), only)
    texts = texts.join(wanted, texts["rep"].eqNullSafe(wanted["rep"]), "left_semi")
    sets = texts.select("__text").mapInArrow(run, "node binary, items binary")
    return sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                k = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[k] == p).sum())
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    side = lambda k: sets.select(F.col("node").alias(k), F.col("items").alias(f"i{k}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "ia", "ib").mapInArrow(run, "a binary, b binary")


def stars(bands: DataFrame, round_: int) -> DataFrame:
    """a < b: in each bucket with more than one component (group), a class of one and all classes of the others."""
    order = -F.col("mates") if round_ == 0 else F.xxhash64("group", "key", F.lit(round_))
    heads = bands.groupBy("key").agg(F.min_by(F.struct("node", "group", "n"), F.struct(order, "node")).alias("head"), F.min("group").alias("g0"), F.max("group").alias("g1"))
    heads = written(heads.where("g0 <> g1").select("key", "head"), "heads")  # so that a common key's classes can be split between tasks
    met = bands.join(heads, "key").where("group <> head.group").select("node", "n", "head")
    return met.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"), F.least("n", "head.n").alias("lo"), F.greatest("n", "head.n").alias("hi"))


def nearest(links: DataFrame) -> DataFrame:
    """node, label: the least of a node and its neighbours, a first guess at its component."""
    both = links.select(F.col("a").alias("node"), "b").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("b")))
    return both.groupBy("node").agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))


def with_groups(bands: DataFrame, label: DataFrame | None) -> DataFrame:
    """bands with group: the component of each class so far."""
    if label is None:
        return bands.withColumn("group", F.col("node"))
    return bands.join(label, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")


def deltas(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """h, node, n, group (64 bits of the component), nh, i, items: how each class differs from the heads of its buckets.

    Of each bucket with more than one component the class that meets most others is the head, h, itself included
    in the rows; nh is its size, i the members that both hold, items those that one of the two holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, parts = [], []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                parts.append(np.setxor1d(p, q, assume_unique=True))
                shared.append((len(p) + len(q) - len(parts[-1])) // 2)
            items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate(parts or [np.zeros(0, np.int64)])))
            sizes = [pa.array([len(x) // 8 for x in b.column(k).to_pylist()], pa.int64()) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], sizes[0], b.column(2), sizes[1], pa.array(shared, pa.int64()), items], names=["h", "node", "n", "group", "nh", "i", "items"])

    heads = grouped.groupBy("key").agg(F.min_by("node", F.struct(-F.col("mates"), "node")).alias("h"), F.min("group").alias("g0"), F.max("group").alias("g1"))
    heads = written(heads.where("g0 <> g1").select("key", "h"), "heads")
    near = grouped.join(heads, "key").select("h", "node", F.xxhash64("group").alias("group")).distinct()
    rows = near.join(sets.select("node", "items"), "node").join(sets.select(F.col("node").alias("h"), F.col("items").alias("head")), "h")
    return rows.select("h", "node", "group", F.lit(0), "items", "head").mapInArrow(run, "h binary, node binary, n bigint, group bigint, nh bigint, i bigint, items array<bigint>")


def missed_pairs(grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of classes that may be linked, of components that share a bucket and that no star has tried.

    Classes of one bucket are told by how they differ from its head h, not by what they have
    in common with it. Let x share i members with h and differ from it in d; x and y share
    o = nh - ix - iy + |x & y| of their differences, so they are linked if o is at least
    need = nh - ix - iy + ceil(t / (1 + t) (nx + ny)) (t: the threshold). With
    q = t / (1 + t) n - i this is nh + qx + qy, rounded up.

    - need <= 0: linked, whatever they share. Let c be the class of least q: then need(x, c) and
      need(y, c) are 0 or less too. So those with need(x, c) <= 0, the core, are paired with c only.
    - Else they share a difference, and one of them, y, is not of the core: need > qx - qc. The
      differences are in order of how many classes of the head have them, rarest first, after
      those that one component alone has; what begins at place p may be the first shared one of a
      pair with d - p >= need. That bounds what a class of the core and what others offer.

    Copies of one text with changes of their own, however many there are, offer such changes, which
    few share. What meets is asked for the weight that prefixes of twice that length share: beyond
    them two classes share no more than the greater rest. Differences that the same classes have
    are one block, told by their count and the XOR of their hashes, that begins at its first place.
    """
    whole = 100 + percent
    rows = written(deltas(grouped, sets).withColumn("q", F.expr(f"{percent} * n - {whole} * i")), "deltas")
    core = written(rows.groupBy("h").agg(F.min_by(F.struct("node", "group", "q"), F.struct("q", "node")).alias("c")), "core")
    rows = rows.join(core, "h").withColumn("core", F.expr(f"node = c.node OR {whole} * nh + q + c.q <= 0"))
    stars = rows.where("core AND group <> c.group").select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
    least = F.expr(f"nh - 2 * i + ceil({2 * percent - 100} * n / {percent})")  # as y differs from x in no more than the threshold allows
    first = F.greatest(F.expr(f"floor((q - c.q) / {whole}) + 1"), least)
    offer = F.when(F.col("core"), first).otherwise(F.greatest(F.expr(f"ceil(({whole} * nh + q + c.q) / {whole})"), least))
    rows = rows.select("h", "node", "n", "group", "nh", "i", "core", F.expr("n + nh - 2 * i").alias("d"), first.alias("first"), offer.alias("offer"), "items").where("d >= offer")
    items = written(rows.select("*", F.explode("items").alias("of")).drop("items").withColumn("item", F.xxhash64("h", "of")).drop("of"), "items")
    held = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("group").alias("g0"), F.max("group").alias("g1"), F.bit_xor(F.xxhash64("node")).alias("holders"))
    held = written(held.where("g0 <> g1").select("item", "c", "holders"), "held")  # what one component alone has makes no pair
    whose = ["h", "node", "n", "group", "nh", "i", "core", "d", "first", "offer"]
    blocks = items.join(held, "item").repartition("h", "node").groupBy(*whose, "c", "holders").agg(F.count(F.lit(1)).alias("w"), F.min("item").alias("block"))
    of = Window.partitionBy("h", "node")
    left = F.sum("w").over(of.orderBy(F.desc("c"), F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prefix = blocks.withColumn("left", left).where("left >= 2 * offer - d").withColumn("beyond", F.min(F.expr("left - w")).over(of))  # left: d - p
    prefix = written(prefix.drop("c", "holders", "d"), "prefix")
    side = lambda k, *names: [F.col(c).alias(f"{c}{k}") for c in names]
    met = prefix.where("left >= first").select("block", "h", "nh", *side("x", "node", "n", "group", "i", "core", "left"))
    met = met.join(prefix.where("NOT core AND left >= offer").select("block", *side("y", "node", "n", "group", "i", "left", "first")), "block")
    met = met.where(f"groupx <> groupy AND (corex OR (lefty >= firsty AND nodex < nodey)) AND 100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    met = met.where(f"{whole} * (least(leftx, lefty) + ix + iy - nh) >= {percent} * (nx + ny)")
    met = written(met.select("h", "nodex", "nodey").distinct(), "met")
    both = met.join(prefix.select("h", "nh", "block", "w", *side("x", "node", "n", "i", "beyond")), ["h", "nodex"]).join(prefix.select("h", "block", *side("y", "node", "n", "i", "beyond")), ["h", "nodey", "block"])
    most = F.any_value(F.expr("greatest(beyondx, beyondy) + ix + iy - nh"))  # without what both prefixes hold
    both = both.groupBy("h", "nodex", "nodey").agg((F.sum("w") + most).alias("most"), F.any_value(F.expr("nx + ny")).alias("n")).where(f"{whole} * most >= {percent} * n")
    return both.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).unionByName(stars).distinct()


def groups(docs: DataFrame, text: str = "text", percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    return grouped(docs, text, percent, rounds).drop("node", "lead")


def grouped(docs: DataFrame, text: str = "text", percent: int = PERCENT, rounds: int = ROUNDS, more: tuple[str, ...] = ()) -> DataFrame:
    """groups with the columns more of docs, node (the set's class) and lead (the least class of the group)."""
    before = written_so_far()
    sketch = written(sketches(docs, text, more), "sketches")
    full = sketch.where("n_shingles > 0")
    classes = written(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("regs").alias("regs"), F.any_value("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies")), "classes")
    keys = F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {2 * ROWS} + 1, {2 * ROWS})))"))
    bands = classes.select("node", F.col("n_shingles").alias("n"), keys.alias("key"))
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    bands = written(bands.join(shared, "key"), "bands")
    mates = bands.groupBy("node").agg(F.sum("c").alias("mates"))
    sets = written(full_sets(docs, classes, mates.select("node"), text), "sets")
    bands = written(bands.drop("c").join(mates, "node"), "bands")
    links, label, tried = None, None, None
    for k in range(rounds):
        pairs = stars(with_groups(bands, label), k).where(f"100 * lo >= {percent} * hi").select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(estimated(pairs, classes, percent), "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        # one pair of each class first: they connect most, and what is connected needs no other pair
        best = pairs.groupBy("a").agg(F.max_by("b", F.struct("j", "b")).alias("b")).unionByName(pairs.groupBy("b").agg(F.max_by("a", F.struct("j", "a")).alias("a")).select("a", "b")).distinct()
        found = written(verified(best, sets, percent), "found")
        near = nearest(found)
        rest = pairs.join(near.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(near.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        rest = rest.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")
        found = found.unionByName(written(verified(rest, sets, percent), "found"))
        if found.isEmpty():
            break
        links = found if links is None else label.withColumnsRenamed({"node": "a", "label": "b"}).unionByName(found)
        label = components(links)
    if label is not None or not bands.isEmpty():
        pairs = estimated(missed_pairs(written(with_groups(bands, label), "grouped"), sets, percent), classes, percent)
        last = written(verified(pairs, sets, percent), "missed")
        if not last.isEmpty():
            label = components(last if label is None else label.withColumnsRenamed({"node": "a", "label": "b"}).unionByName(last))
    ends = classes.select("node", "rep", "copies", F.col("node").alias("lead"))
    if label is not None:
        of = label.join(ends, "node")
        ids = of.groupBy("label").agg(F.min("rep").alias("component"))
        ends = ends.join(of.select("node", "label").join(ids, "label"), "node", "left").select("node", F.coalesce("component", "rep").alias("rep"), "copies", F.coalesce("label", "lead").alias("lead"))
    ends = written(ends, "ends")
    drop_since(docs.sparkSession, before | {sketch.written_path, ends.written_path})
    rows = full.select("doc_id", *more, "n_shingles", "node")
    hot = ends.where(F.col("copies") * HOT > rows.count()).select("node", "rep", "lead")
    out = rows.join(F.broadcast(hot), "node").unionByName(rows.join(F.broadcast(hot.select("node")), "node", "left_anti").join(ends.select("node", "rep", "lead"), "node"))
    out = out.unionByName(sketch.where("n_shingles = 0").select("node", "doc_id", *more, "n_shingles", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("rep"), F.col("node").alias("lead")))
    out = out.select("doc_id", *more, "n_shingles", "node", "lead", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, with its own columns; rows of one doc_id and group are one document.

    Rows are told apart by doc_id and text. A row without an id is a document of its own: in a
    group of nothing but such rows one stays, of the least text hash in the least class.
    """
    rows = hidden(docs).withColumn("__text_hash", F.unhex(F.md5(F.col("text").cast("string"))))
    of = grouped(rows, percent=STAGE_PERCENT, more=("__text_hash",))
    gone = of.where("doc_id IS NOT NULL AND NOT kept").select("doc_id", "__text_hash").distinct()
    out = rows.where("doc_id IS NOT NULL").join(gone, ["doc_id", "__text_hash"], "left_anti")
    bare = rows.where("doc_id IS NULL")
    filled = of.where("doc_id IS NULL AND n_shingles > 0")
    alone = filled.where("component_id IS NULL").groupBy("lead").agg(F.min(F.struct("node", "__text_hash")).alias("least"))
    one = bare.join(alone.select("least.__text_hash"), "__text_hash", "left_semi").dropDuplicates(["__text_hash"])
    blank = bare.join(filled.select("__text_hash").distinct(), "__text_hash", "left_anti")
    return shown(out, docs).unionByName(shown(one, docs)).unionByName(shown(blank, docs))


#: All pairs of texts that share a shingle, and all nodes that a node reaches: for tables of thousands of rows.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS node FROM s GROUP BY doc_id),
k AS (SELECT node, min(doc_id) AS rep, any_value(n) AS n FROM c GROUP BY node),
t AS (SELECT k.node, rep, n, g FROM k JOIN s ON s.doc_id = rep),
l AS (SELECT x.rep AS a, y.rep AS b FROM t x JOIN t y ON x.g = y.g AND x.rep <> y.rep AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT rep, rep AS root FROM k UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.rep),
m AS (SELECT rep, min(root) AS component FROM r GROUP BY rep)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN k ON c.node = k.node LEFT JOIN m ON m.rep = k.rep
"""
