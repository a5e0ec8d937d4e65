"""Quality rules: a learned decision list over statistics of whole texts.

Sequential covering (grow on two thirds, prune on one) finds conjunctions of
thresholds that mark texts labelled 0. A rule is taken while it is right for at
least `precision` of the pruning rows that it covers. The list becomes one ordered
Spark CASE expression; nothing but that expression runs on the corpus.

The learner sees at most `LABELLED_ROWS` labelled rows (those of least hash), a few
numbers each. Null and empty texts have all counts 0 and fail the base rule.
Equal rows get equal results; input columns named like a computed one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, hidden, least_hashes, others, quoted, shown, written
from .words import SPACED, gram_hashes, mix, row_counts, steps, word_hashes, word_spans

#: Bound of the labelled rows that the learner reads.
LABELLED_ROWS = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_same_next", "n_bytes"]

#: What rules may test, as SQL over the counts.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "same_next_share": "n_same_next / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "digits_per_word": "n_digits / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}


def table_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


SYMBOLS, MARKS = table_of("#*$%&|<>"), table_of("!?;:")
UPPER, LOWER, DIGITS = table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), table_of("abcdefghijklmnopqrstuvwxyz"), table_of("0123456789")
NOT_LF = np.ones(256, bool)
NOT_LF[10] = False
CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_counts(texts: pa.Array) -> list[pa.Array]:
    """COUNTS of each text."""
    parts = []
    for a, b, buf, off in steps(texts):
        n = b - a
        per_row = lambda mask, off=off: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
        s, e, row = word_spans(buf, off, SPACED)
        h = word_hashes(buf, s, e, lower=False)
        of_row = mix(row.astype(np.uint64) + np.uint64(1))
        hit = np.zeros(len(h) + 1, np.int64)
        if len(h) >= 5:
            inside = np.flatnonzero(row[4:] == row[:-4])
            twice = inside[repeated(gram_hashes(h, 5)[inside] ^ of_row[inside])]
            np.add.at(hit, twice, 1)
            np.add.at(hit, twice + 5, -1)
        again = np.cumsum(hit)[:-1] > 0
        ls, le, lrow = word_spans(buf, off, NOT_LF)
        worded = np.unique(np.searchsorted(ls, s, "right") - 1)
        ls, le, lrow = ls[worded], le[worded], lrow[worded]
        keys = word_hashes(buf, ls, le, lower=False) ^ mix(lrow.astype(np.uint64) + np.uint64(1))
        first = np.zeros(len(keys), bool)
        first[np.unique(keys, return_index=True)[1]] = True
        next_same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
        parts.append([
            row_counts(row, n), per_row(SPACED[buf] & CODE_POINT[buf]), per_row(SYMBOLS[buf]), row_counts(lrow[~first], n),
            row_counts(row[again], n), row_counts(lrow, n), per_row(UPPER[buf]), per_row(LOWER[buf]), per_row(DIGITS[buf]),
            per_row(MARKS[buf]), row_counts(row[next_same], n), np.diff(off),
        ])
    return [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)]


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, unless named) and COUNTS."""
    kept = others(docs.select(*[quoted(c) for c in keep]) if keep is not None else docs, COUNTS)
    return arrow_map(docs, kept, text, [(c, "bigint") for c in COUNTS], text_counts)


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


# --- learning -----------------------------------------------------------------

Condition = tuple[str, str, float]


def holds(x: dict[str, np.ndarray], c: Condition) -> np.ndarray:
    return x[c[0]] <= c[2] if c[1] == "<=" else x[c[0]] > c[2]


def covers(x: dict[str, np.ndarray], rule: list[Condition], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= holds(x, c)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Adds the condition of most FOIL gain until only bad rows are covered."""
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (~bad[live]).any():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        best, chosen = 1e-9, None
        for f in sorted(x):
            for t in np.unique(np.quantile(x[f][live & bad], np.linspace(0, 1, 33), method="lower")) if p0 else ():
                for op in ("<=", ">"):
                    now = live & holds(x, (f, op, float(t)))
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, chosen = gain, (f, op, float(t))
        if chosen is None:
            break
        f, op, t = chosen  # halfway to the nearest row on the other side of the threshold
        beyond = x[f][live & (bad if op == ">" else ~bad) & (x[f] > t)]
        chosen = (f, op, float((t + beyond.min()) / 2) if len(beyond) else t)
        rule.append(chosen)
        live &= holds(x, chosen)
    return rule


def prune(x: dict[str, np.ndarray], bad: np.ndarray, rule: list[Condition]) -> tuple[list[Condition], float]:
    """The start of the rule that is best on rows not grown on, and its precision there."""
    def worth(r):
        c = covers(x, r, len(bad))
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / max(p + n, 1), p, p / max(p + n, 1)

    cut = max(range(1, len(rule) + 1), key=lambda k: (*worth(rule[:k])[:2], -k))
    return rule[:cut], worth(rule[:cut])[2]


def learn(x: dict[str, np.ndarray], quality: np.ndarray, precision: float = 0.97, rules: int = 24, conditions: int = 5, least: int = 5) -> list[list[Condition]]:
    """The rules that reject, in order; none from no labelled rows."""
    bad = quality == 0
    side = np.random.default_rng(1).permutation(len(bad)) % 3 == 0
    left = np.ones(len(bad), bool)
    out: list[list[Condition]] = []
    while len(out) < rules and (left & bad & ~side).sum() >= least:
        g, q = left & ~side, left & side
        rule = grow({k: v[g] for k, v in x.items()}, bad[g], conditions)
        if not rule:
            break
        rule, sure = prune({k: v[q] for k, v in x.items()}, bad[q], rule)
        c = covers(x, rule, len(bad))
        if sure < precision or (c & q & bad).sum() < 3 or (c & left & bad).sum() < least:
            left &= ~(c & bad)  # what no sure rule finds is left alone
            if not (c & bad).any():
                break
            continue
        out.append(rule)
        left &= ~c
    return out


def rejects(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that fires (from 1), else null."""
    fired = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for f, op, t in rule:
            test &= (F.expr(FEATURES[f]) <= F.lit(t)) if op == "<=" else (F.expr(FEATURES[f]) > F.lit(t))
        fired = F.when(test, F.lit(k)).otherwise(fired)
    return fired


def learn_from(counts: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> list[list[Condition]]:
    """Rules from labelled rows outside the held-out third that the base rule passes, `most` at most."""
    told = labels.where("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counts.where(~base_failed()).join(told, "doc_id").select("doc_id", "quality", *[F.expr(v).alias(k) for k, v in FEATURES.items()])
    sample = least_hashes(rows, "doc_id", most).toPandas().sort_values(["doc_id", *FEATURES], ignore_index=True)
    return learn({f: sample[f].to_numpy(float) for f in FEATURES}, sample["quality"].to_numpy())


def judged(counts: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """counts with base_failed, rule and kept."""
    return counts.withColumns({"base_failed": base_failed(), "rule": rejects(rules)}).withColumn("kept", F.expr("NOT base_failed AND rule IS NULL"))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule and kept for each row of docs."""
    counts = written(with_counts(docs, keep=["doc_id"]), "op8-counts")
    return judged(counts, learn_from(counts, labels))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no learned rule rejects, with their own columns."""
    rules = learn_from(written(with_counts(docs, keep=["doc_id"]), "rules-counts"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return shown(judged(with_counts(hidden(docs)), rules).where("kept"), docs)
