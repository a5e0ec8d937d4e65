"""Fill-in-middle: each text is cut into prefix, middle and suffix at ends of lines and put in another order.

A unit is a line with its \\n. Two hashed cuts among the units' ends part a text into
three roles. Each batch is one pyarrow.compute pipeline: texts split into lists of lines,
lists flattened beside their parents' indices, ordinals from the lists' offsets, units
filtered by role, lists rebuilt by role, and the roles' texts joined with the markers.

Where a text is empty or null, holds a marker, or isn't chosen, its form is plain and its
output the text. Rows with equal ids and texts get equal outputs; a null id is hashed as
an empty one. Input columns named like a computed one are replaced. Batches are cut into
runs of rows of some megabytes; a longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, ddl, others, quoted

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def runs(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """First and end row of runs of whole rows of about `most` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        before = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + most, "right")))
        yield row, end
        row = end


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with their \\n, the row and ordinal of each, and how many each row has."""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    count = pc.list_value_length(lists).to_numpy()
    first = np.cumsum(count) - count
    ordinal = np.arange(len(flat)) - first[parent]
    last = pa.array(ordinal == count[parent] - 1)
    lines = pc.binary_join_element_wise(flat, pc.if_else(last, pa.scalar("", flat.type), pa.scalar("\n", flat.type)), pa.scalar("", flat.type))
    real = pc.not_equal(lines, "")  # what follows a text's last \n is no line
    is_real = real.to_numpy(zero_copy_only=False)
    return lines.filter(real), parent[is_real], ordinal[is_real], np.bincount(parent[is_real], minlength=len(texts))


def role_texts(lines: pa.Array, parent: np.ndarray, mask: np.ndarray, rows: int) -> pa.Array:
    """The lines of one role, joined by row."""
    places = np.concatenate([[0], np.cumsum(np.bincount(parent[mask], minlength=rows))])
    rebuilt = pa.ListArray.from_arrays(pa.array(places, pa.int32()), lines.filter(pa.array(mask)))
    return pc.binary_join(rebuilt, pa.scalar("", lines.type))


def transform(texts: pa.Array, h: list[np.ndarray], rate: int, spm: int) -> list[pa.Array]:
    """The columns of ADDED for a run of texts with four hashes each."""
    lines, parent, ordinal, n = units(texts)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(a, b)[parent], np.maximum(a, b)[parent]
    prefix, middle, suffix = (role_texts(lines, parent, m, len(texts)) for m in (ordinal < low, (ordinal >= low) & (ordinal < high), ordinal >= high))
    plain = pc.or_(pc.equal(texts, ""), pa.array(h[2] % 100 >= rate))
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, marker))
    turned = pa.array(h[3] % 100 < spm)
    mark = lambda x: pa.scalar(x, texts.type)
    moved = pc.binary_join_element_wise(
        pc.if_else(turned, mark(SUFFIX), mark(PREFIX)), pc.if_else(turned, suffix, prefix), pc.if_else(turned, mark(PREFIX), mark(SUFFIX)), pc.if_else(turned, prefix, suffix), mark(MIDDLE), middle, mark(""),
    )
    form = pc.if_else(plain, "plain", pc.if_else(turned, "spm", "psm"))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, pc.if_else(plain, texts, moved)]


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """The kept columns (all, unless named), n units, form, prefix_chars, middle_chars (null if plain) and output.

    rate: percent of texts that are transformed; spm: percent of those whose suffix comes first.
    """
    added = ddl(ADDED)
    kept = others(docs.select(*[quoted(c) for c in keep]) if keep is not None else docs, added.names)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(doc_id).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring("__digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"__h{k}") for k in range(4)]
    names, width = [*kept, *added.names], len(kept)
    schema = T.StructType([*(docs.schema[c] for c in kept), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in runs(batch.column(width + 4)):
                part = batch.slice(first, end - first)
                h = [part.column(width + k).to_numpy() for k in range(4)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(width)), *transform(part.column(width + 4), h, rate, spm)], names=names)

    one = docs.select(*[quoted(c) for c in kept], digest.alias("__digest"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("__text"))
    return one.select(*[quoted(c) for c in kept], *hashes, "__text").mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output came from."""
    part = lambda k: F.element_at(F.split(output, "<[PSM]>", -1), k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS turned,
  t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS middle, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN turned THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN turned THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
