"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

Three kinds of base matches come from patterns. In what they leave of a text, runs of
TOKEN characters that hold a letter are candidates. A first-order character model of random strings
and one of ordinary identifiers give each pair of neighbouring characters a log ratio; a
candidate whose ratios add up to more than `margin` is a secret of kind markov. Both models
are trained from labelled samples: random ones are the values that the base matches hold
and a base-64 string drawn by hash for each document (base matches alone would leave most
letters unseen), ordinary ones are the distinct other tokens of all texts. Ratios are whole
thousandths, so that sums don't depend on their order.

Everything is DataFrame functions. A text's matches get their places from the lengths of the
pieces between them, added up in blocks, so that many matches cost no square. Tokens are
read in pieces of 256 characters, each of which begins anew. Two pieces of text can't share
a match: no pattern matches \\n, and none is cut.

Null and empty texts have no spans. Repeated rows are rows. Input columns named like a
computed one are replaced. A candidate never overlaps a base match that was taken out; the
kinds are taken out in order, each from what the former left. Base matches of different
kinds may overlap. The driver gets one count per label and pair of characters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, quoted

#: Name, pattern, the group whose length counts and the least length. Only runs of 24 or more are hex, of 20 or more access:
#: shorter runs of the same characters don't hold longer ones. A short assigned value is matched, so that it is passed over, and dropped.
KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
MARKOV = "markov"
#: Characters of tokens; candidates are runs of SHORTEST and more, ordinary samples of SAMPLED and more.
TOKEN, LETTERS, SHORTEST, SAMPLED = "[A-Za-z0-9+/_-]", 66, 20, 6
#: Log odds in thousandths: about one candidate in 22,000 may be expected to be a secret.
MARGIN = 10_000
BLOCK, PIECE = 256, 256
SPAN = "array<struct<start:int,`end`:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def value_of(pattern: str, group: int) -> Callable[[Column], Column]:
    return lambda m: F.regexp_extract(m, pattern, group) if group else m


def passes(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    value = value_of(pattern, group)
    return lambda m: F.length(value(m)) >= least


def places(text: Column, pattern: str, whole: Column, ok: Callable[[Column], Column]) -> Column:
    """start and end (in code points) of the matches `whole` of a pattern in a text, those that are ok."""
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), ok(m).alias("ok")))
    none = F.array().cast(SPAN)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end")))
        return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    def block(a: Column, x: Column) -> Column:
        inner = F.aggregate(x, F.struct(a["at"].alias("at"), none.alias("out")), step)
        return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(a["out"], F.array(i["out"])).alias("out")))

    def added_up(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda k: F.slice(s, k * BLOCK + 1, BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.flatten(F.aggregate(blocks, start, block, lambda a: a["out"]))

    return F.when(F.size(whole) > 0, let(steps, added_up)).otherwise(none)


def less(text: Column, pattern: str, whole: Column, ok: Callable[[Column], Column]) -> Column:
    """text with spaces in place of its matches that are ok."""
    parts = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.concat(gap, F.when(m.isNull(), "").when(ok(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)))
    return F.when(F.size(whole) > 0, F.array_join(parts, "")).otherwise(text)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """docs with __text, __assign, __access and __hex (spans), __values (what the matches hold) and __rest (the text less its matches)."""
    out = docs.withColumn("__text", F.coalesce(quoted(text).cast("string"), F.lit(""))).withColumn("__rest", F.col("__text"))
    values = []
    for kind, pattern, group, least in KINDS:
        ok = passes(pattern, group, least)
        out = out.withColumn(f"__w_{kind}", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
        out = out.withColumn(f"__{kind}", places(F.col("__text"), pattern, F.col(f"__w_{kind}"), ok))
        # what was taken out before may have been part of a match of this kind
        out = out.withColumn("__left", F.when(F.size(f"__w_{kind}") > 0, F.regexp_extract_all("__rest", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        out = out.withColumn("__rest", less(F.col("__rest"), pattern, F.col("__left"), ok))
        values.append(F.transform(F.filter(f"__w_{kind}", ok), value_of(pattern, group)))
    return out.withColumn("__values", F.concat(*values))


def pieces(token: Column) -> Column:
    return F.regexp_extract_all(token, F.lit(f".{{1,{PIECE}}}"), F.lit(0))


# --- the models ------------------------------------------------------------------------


def samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """label (1 random, 0 ordinary) and token, each once."""
    base = with_base(docs.select(quoted(doc_id).cast("string").alias("__id"), quoted(text).cast("string").alias("__own")), "__own")
    drawn = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("random:"), F.coalesce("__id", F.lit(""))), 256))), "=", "")
    of = lambda label, tokens: F.transform(tokens, lambda t: F.struct(F.lit(label).alias("label"), t.alias("token")))
    both = F.concat(of(1, F.concat("__values", F.array(drawn))), of(0, F.regexp_extract_all("__rest", F.lit(f"{TOKEN}{{{SAMPLED},}}"), F.lit(0))))
    return base.select(F.explode(both).alias("s")).select("s.*").distinct()


def pair_counts(sample: DataFrame) -> DataFrame:
    """label, pair (128 times the character before, 0 at a start, and the character) and n."""
    each = sample.select("label", F.explode(pieces(F.col("token"))).alias("piece")).withColumn("c", F.split("piece", ""))
    before = F.concat(F.array(F.lit("")), F.slice("c", F.lit(1), F.size("c") - 1))
    pairs = F.zip_with(before, F.col("c"), lambda a, b: F.ascii(a) * 128 + F.ascii(b))
    return each.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


def train(sample: DataFrame) -> list[int]:
    """Log ratios of random to ordinary, in thousandths, by pair; shares are smoothed by one. Pairs of characters that no token has are 0."""
    n = {0: [0] * 16384, 1: [0] * 16384}
    for r in pair_counts(sample.where(F.col("token").rlike(f"^{TOKEN}+$"))).collect():  # 2 * 67 * 66 rows at most
        n[r["label"]][r["pair"]] = r["n"]
    known = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_-"]
    out = [0] * 16384
    for a in [0, *known]:
        of = {k: sum(n[k][a * 128 : a * 128 + 128]) for k in (0, 1)}
        for c in known:
            p = a * 128 + c
            out[p] = math.floor(1000 * math.log((n[1][p] + 1) * (of[0] + LETTERS) / ((n[0][p] + 1) * (of[1] + LETTERS))) + 0.5)
    return out


def log_odds(token: Column, model: list[int]) -> Column:
    """Sum of a token's log ratios, in thousandths."""
    ratio = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")

    def step(a: Column, c: Column) -> Column:
        return F.struct((a["total"] + F.coalesce(F.get(ratio, a["last"] * 128 + F.ascii(c)), F.lit(0))).alias("total"), F.ascii(c).alias("last"))

    def piece(total: Column, p: Column) -> Column:
        return F.aggregate(F.split(p, ""), F.struct(total.alias("total"), F.lit(0).alias("last")), step, lambda a: a["total"])

    return F.aggregate(pieces(token), F.lit(0).cast("bigint"), piece)


def scan_secrets(docs: DataFrame, model: list[int], text: str = "text", keep: list[str] | None = None, margin: int = MARGIN) -> DataFrame:
    """The kept columns (all, unless named) and secrets: kind, start and end of each, by start, then by kind."""
    kept = others(docs.select(*[quoted(c) for c in keep]) if keep is not None else docs, ["secrets"])
    base = with_base(docs.select(*[quoted(c).alias(f"__own_{i}") for i, c in enumerate(kept)], quoted(text).cast("string").alias("__in")), "__in")
    token = f"{TOKEN}{{{SHORTEST},}}"
    out = base.withColumn("__w", F.regexp_extract_all("__rest", F.lit(token), F.lit(0)))
    out = out.withColumn(f"__{MARKOV}", places(F.col("__rest"), token, F.col("__w"), lambda m: m.rlike("[A-Za-z]") & (log_odds(m, model) > margin)))
    names = [*(k for k, *_ in KINDS), MARKOV]
    ranked = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"))
    spans = [F.transform(f"__{k}", ranked(i)) for i, k in enumerate(names)]
    kind = lambda s: F.element_at(F.array(*map(F.lit, names)), s["rank"] + 1)
    secrets = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(kept)], secrets.alias("secrets"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_secrets(docs, train(samples(docs)), keep=["doc_id"])
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"] != MARKOV)
    return out.select("doc_id", *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k, *_ in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def oracle() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    parts, spans, last = [], [], "d"
    said = lambda m, p, g, n: f"length(regexp_extract({m}, {quote(p)}, {g})) >= {n}"
    of = lambda src, text, p: f"(SELECT k, string_split_regex({text}, {quote(p)}) AS p, regexp_extract_all({text}, {quote(p)}) AS w FROM {src})"
    size = "lambda x: length(x)"
    found = lambda src, text, p, ok: f"""SELECT k, m, start, start + length(m) AS stop FROM (SELECT k, w[i] AS m, CAST(list_sum(list_transform(p[1:i], {size})) + coalesce(list_sum(list_transform(w[1:i - 1], {size})), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM {of(src, text, p)})) WHERE {ok}"""  # noqa: E731
    for rank, (kind, p, g, n) in enumerate(KINDS):
        parts.append(f"{kind} AS ({found('d', 't', p, said('m', p, g, n))})")
        parts.append(f"less_{kind} AS (SELECT k, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(w) THEN '' WHEN {said('w[i]', p, g, n)} THEN repeat(' ', length(w[i])) ELSE w[i] END), '') AS rest FROM {of(last, 't' if last == 'd' else 'rest', p)})")
        spans.append(f"SELECT k, start, stop, {rank} AS rank, '{kind}' AS kind FROM {kind}")
        last = f"less_{kind}"
    values = " UNION ".join(f"SELECT regexp_extract(m, {quote(p)}, {g}) FROM {kind}" for kind, p, g, _ in KINDS)
    sql = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), {", ".join(parts)},
sample AS (SELECT DISTINCT 1 AS label, token FROM (SELECT rtrim(to_base64(unhex(sha256('random:' || coalesce(CAST(doc_id AS VARCHAR), '')))), '=') AS token FROM d UNION {values}) WHERE regexp_full_match(token, '{TOKEN}+')
  UNION ALL SELECT DISTINCT 0, token FROM (SELECT unnest(regexp_extract_all(rest, '{TOKEN}{{{SAMPLED},}}')) AS token FROM {last})),
pairs AS (SELECT label, CASE WHEN i % {PIECE} = 0 THEN '' ELSE token[i] END AS a, token[i + 1] AS c, count(*) AS n FROM (SELECT label, token, unnest(range(length(token))) AS i FROM sample) GROUP BY 1, 2, 3),
abc AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-', '')) AS c),
totals AS (SELECT label, a, sum(n) AS n FROM pairs GROUP BY 1, 2),
ratio AS (SELECT f.a, f.c, CAST(floor(1000 * ln(CAST((coalesce(r.n, 0) + 1) * (coalesce(ot.n, 0) + {LETTERS}) AS DOUBLE) / CAST((coalesce(o.n, 0) + 1) * (coalesce(rt.n, 0) + {LETTERS}) AS DOUBLE)) + 0.5) AS BIGINT) AS x
  FROM (SELECT a, c FROM (SELECT c AS a FROM abc UNION ALL SELECT '') CROSS JOIN abc) f LEFT JOIN pairs r ON r.label = 1 AND r.a = f.a AND r.c = f.c LEFT JOIN pairs o ON o.label = 0 AND o.a = f.a AND o.c = f.c
  LEFT JOIN totals rt ON rt.label = 1 AND rt.a = f.a LEFT JOIN totals ot ON ot.label = 0 AND ot.a = f.a),
candidates AS ({found(last, 'rest', f"{TOKEN}{{{SHORTEST},}}", "regexp_matches(m, '[A-Za-z]')")}),
judged AS (SELECT k, start, stop FROM (SELECT k, start, stop, CASE WHEN i % {PIECE} = 0 THEN '' ELSE m[i] END AS a, m[i + 1] AS c FROM (SELECT *, unnest(range(length(m))) AS i FROM candidates)) JOIN ratio USING (a, c) GROUP BY 1, 2, 3 HAVING sum(x) > {MARGIN}),
spans AS ({" UNION ALL ".join(spans)} UNION ALL SELECT k, start, stop, {len(KINDS)}, '{MARKOV}' FROM judged),
lists AS (SELECT k, {", ".join(f"count(*) FILTER (rank = {r}) AS n_{kind}" for r, (kind, *_) in enumerate(KINDS))}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(KINDS)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (k)"""
    return sql


SQL = oracle()
