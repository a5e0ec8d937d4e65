"""License scans: TF-IDF cosine of windows of lines to templates, then inheritance by directory.

Templates are notices, file headers, heads and texts of licences, and identifier lines. A
window is a run of a file's lines with words: each of SIZES lines long, anywhere in the file,
and all of them together, so wrapped headers and licence files are compared whole. It is a
sparse vector of its words, weighted by their count and by how rare they are in all files;
words of no template count 1 each in its length. A window matches a template at a cosine of
at least ALIKE (or the template's own bound); of a file's matches that of most evidence, the
fourth power of the cosine times the root of the template's words, is its own licence, then
the first template, then the shorter and earlier window.

Windows are found by a prefix filter: of a cosine of at least c, more than 1 - c**2 of the
template's squared length is in words of which the window must hold one, the heaviest ones
here, so files without such a word are only counted. Dot products come from sums over lines,
lengths are bounded by sums over lines, and what passes is compared in full.

A file named like a licence file gives its own licence to its directory. A file without
one takes that of the nearest ancestor directory that has one: directories, not files,
are joined to their ancestors by path.

Null and empty texts have no licence of their own; null paths inherit none. Of two
licence files in a directory the better score, then the first licence by name, counts.
Equal rows get equal results; input columns named like a computed one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, others, quoted, written
from .licence_texts import TEMPLATES
from .words import ALNUM, steps, word_hashes, word_spans

ALIKE = 0.8
#: Names of licence files, as a pattern over the last part of a path.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$"

#: Lines of a window.
SIZES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32)
#: Words whose lines are summed at once.
WORDS = 1 << 16


def tokens(texts: pa.Array):
    """(first row, end row, word hashes, rows, line of each word, row of each line) by runs of rows."""
    for a, b, buf, off in steps(texts):
        s, e, row = word_spans(buf, off, ALNUM)
        # a line is what lies between line feeds and row ends
        breaks = np.union1d(np.flatnonzero(buf == 10) + 1, off[:-1])
        line = np.searchsorted(breaks, s, "right") - 1
        yield a, b, word_hashes(buf, s, e, lower=True), row, line


def vocabulary(templates: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the templates' words in order, and the count of each word in each template."""
    words, rows = [], []
    for a, _, h, row, _ in tokens(pa.array([t[1] for t in templates])):
        words.append(h)
        rows.append(row + a)
    h, r = np.concatenate(words), np.concatenate(rows)
    known, at = np.unique(h, return_inverse=True)
    counts = np.zeros((len(templates), len(known)))
    np.add.at(counts, (r, at), 1)
    return known, counts


def document_counts(files: DataFrame, text: str, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of files and, for each word of the templates, of files that hold it: one row per word comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(known), np.int64)
        for b in batches:
            n += b.num_rows
            for _, _, h, row, _ in tokens(b.column(0)):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(h) else np.zeros(0, np.int64)
                hit = known[at] == h
                pairs = np.unique(row[hit] * len(known) + at[hit])
                df += np.bincount(pairs % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(known)), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], names=["word", "n"])

    rows = files.select(quoted(text).cast("string")).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    said = {r["word"]: r["n"] for r in rows}
    return said.get(-1, 0), np.array([said.get(k, 0) for k in range(len(known))])


class Scan:
    """Templates as vectors over known words, and what of a text matches one."""

    def __init__(self, templates: list[tuple], known: np.ndarray, counts: np.ndarray, rare: np.ndarray, alike: float):
        self.names, self.known, self.rare = [t[0] for t in templates], known, rare
        vectors = counts * rare
        self.vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
        self.least = np.array([max(alike, t[2] or 0) for t in templates])
        self.size = np.sqrt(counts.sum(1))
        self.telling = np.zeros(len(known), bool)  # a window that matches holds one of these
        for k, least in enumerate(self.least):
            heavy = np.argsort(-self.vectors[:, k], kind="stable")
            enough = np.searchsorted(np.cumsum(self.vectors[heavy, k] ** 2), 1 - least**2 + 1e-9) + 1
            self.telling[heavy[:enough]] = True

    def words(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, -1)

    def best(self, word: np.ndarray, line: np.ndarray) -> tuple[int, float]:
        """(template, cosine) of a text's match of most evidence, (-1, 0) for none. line: from 0 without gaps."""
        first = np.flatnonzero(np.diff(line, prepend=-1))
        n = len(first)
        dots, length = np.zeros((n, len(self.names))), np.zeros(n)
        weighted = self.rare[:, None] * self.vectors
        for lo in range(0, len(word), WORDS):
            w, at = word[lo : lo + WORDS], line[lo : lo + WORDS]
            hit = np.flatnonzero(w >= 0)
            if len(hit):
                turn = np.flatnonzero(np.diff(at[hit], prepend=-1))
                np.add.at(dots, at[hit][turn], np.add.reduceat(weighted[w[hit]], turn))
        pairs, count = np.unique(line[word >= 0] * len(self.known) + word[word >= 0], return_counts=True)
        np.add.at(length, pairs // len(self.known), (count * self.rare[pairs % len(self.known)]) ** 2)
        np.add.at(length, line[word < 0], 1)
        telling = np.bincount(line[(word >= 0) & self.telling[word]], minlength=n)
        dots, length, told = (np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)]) for x in (dots, length, telling))
        end = np.append(first, len(word))
        found, evidence = (-1, 0.0), 0.0
        for size in sorted({*(s for s in SIZES if s < n), n}):
            lo = np.arange(n - size + 1)
            lo = lo[told[lo + size] > told[lo]]
            # a window's squared length is at least that of its lines together
            close = ((dots[lo + size] - dots[lo]) >= (self.least - 1e-9) * np.sqrt(length[lo + size] - length[lo])[:, None]).any(1)
            for a in lo[close].tolist():
                w = word[end[a] : end[a + size]]
                v = np.bincount(w[w >= 0], minlength=len(self.known)) * self.rare
                cos = np.round(v @ self.vectors / np.sqrt(v @ v + (w < 0).sum()), 9)
                value = np.where(cos >= self.least, cos**4 * self.size, 0)
                k = int(value.argmax())
                if value[k] > evidence + 1e-9:
                    found, evidence = (k, float(cos[k])), value[k]
        return found


def own_licences(files: DataFrame, keep: list[str], text: str = "text", templates: list[tuple] = TEMPLATES, alike: float = ALIKE) -> DataFrame:
    """keep, own_licence and own_score (the cosine of its window, null for none)."""
    known, counts = vocabulary(templates)
    n, df = document_counts(files, text, known)
    scan = Scan(templates, known, counts, np.log((1 + n) / (1 + df)) + 1, alike)

    def run(texts: pa.Array) -> list[pa.Array]:
        name, score = [None] * len(texts), [None] * len(texts)
        for a, _, h, row, line in tokens(texts):
            word = scan.words(h) if len(h) else np.zeros(0, np.int64)
            for r in np.unique(row[(word >= 0) & scan.telling[word]]).tolist():
                lo, hi = np.searchsorted(row, (r, r + 1))
                k, cos = scan.best(word[lo:hi], np.cumsum(np.diff(line[lo:hi], prepend=line[lo]) > 0))
                if k >= 0:
                    name[a + r], score[a + r] = scan.names[k], cos
        return [pa.array(name, pa.string()), pa.array(score, pa.float64())]

    return arrow_map(files, keep, text, [("own_licence", "string"), ("own_score", "double")], run)


def with_inherited(own: DataFrame) -> DataFrame:
    """own (with path, own_licence, own_score) and licence, licence_from (a directory, null if its own or none)."""
    placed = own.withColumns({"__dir": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "__name": F.regexp_extract("path", r"[^/]*$", 0)})
    giving = placed.where(F.col("__name").rlike(LICENCE_FILE) & F.col("own_licence").isNotNull() & F.col("path").isNotNull())
    giving = giving.groupBy(F.col("__dir").alias("at")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("l")))["l"].alias("given"))
    deep = giving.agg(F.max(F.size(F.split("at", "/")))).first()[0] or 1  # deeper ancestors give nothing
    dirs = placed.where("path IS NOT NULL AND own_licence IS NULL").select(F.col("__dir").alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(deep))), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))).alias("depth", "at"))
    near = up.join(giving, "at").groupBy("dir").agg(F.max_by(F.struct("given", "at"), "depth").alias("got"))
    near = written(near, "op3-near")  # so that a directory of very many files is split between tasks
    out = placed.join(near, F.when(F.col("own_licence").isNull(), F.col("__dir")) == F.col("dir"), "left")
    return out.withColumns({"licence": F.coalesce("own_licence", "got.given"), "licence_from": F.col("got.at")}).drop("__dir", "__name", "dir", "got")


def scan_licences(files: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list[tuple] = TEMPLATES) -> DataFrame:
    """keep (all columns but the text, unless named; with path) and own_licence, own_score, licence, licence_from."""
    kept = [c for c in others(files, ["own_licence", "own_score", "licence", "licence_from", "__dir", "__name", "dir", "got"]) if (c in keep if keep is not None else c != text)]
    return with_inherited(written(own_licences(files, kept, text, templates), "op3-own"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths: source, language and doc_id make one. Each 16th document is a licence file, in turn of its own directory and of those one, two and three levels up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.expr("IF(doc_id % 16 = 0, 'LICENSE', concat(doc_id, '.txt'))")
    up = F.expr("IF(doc_id % 16 = 0, cast(doc_id div 16 % 4 as int), 0)")
    parts = F.array("source", "lang", F.expr("cast(doc_id div 4096 as string)"), F.expr("cast(doc_id div 64 as string)"))
    path = F.concat_ws("/", F.slice(parts, F.lit(1), F.lit(4) - up), name)
    return scan_licences(docs.select("doc_id", path.alias("path"), "text"), keep=["doc_id", "path"])
