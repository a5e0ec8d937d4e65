"""The ten operators against brute force on small fixtures with odd rows."""

import collections
import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import op1_quality_classifier as op1
from cadenza.llm import op2_line_dedup as op2
from cadenza.llm import op3_licenses as op3
from cadenza.llm import op4_warc as op4
from cadenza.llm import op5_decontamination as op5
from cadenza.llm import op6_packing as op6
from cadenza.llm import op7_near_dedup as op7
from cadenza.llm import op8_quality_rules as op8
from cadenza.llm import op9_url_filters as op9
from cadenza.llm import op10_repeats as op10
from cadenza.llm.components import components
from cadenza.llm.licence_texts import IDENTIFIERS, TEMPLATES

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SYLLABLES = ["the", "an", "er", "ó", "ción", "ß", "ing", "re", "日本", "ti", "of", "es"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """doc_id, text: copies, near copies, shared passages, repeats, blanks, nulls, repeated rows and ids."""
    rng = random.Random(3)
    passage = " ".join(words(rng, 70))
    out = []
    for k in range(60):
        lines = [" ".join(words(rng, rng.randint(3, 14))) for _ in range(rng.randint(1, 9))]
        if k % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        out.append("\n".join(lines))
    for k in range(12):
        w = out[k].split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [out[5], out[5], out[6] + "\n" + out[6], "again and " * 90, "\n\n \t\n", "", "one", "One", "two words", "x" * 1500, "Straße " * 40]
    rows = list(enumerate(out)) + [(5, out[5]), (7, "another text under id seven " * 12), (None, None), (None, out[8]), (500, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1.5) for i, t in texts]
    # columns that clash with computed ones, in another case
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, N_Words double").repartition(3)


def thue_morse(n):
    """A string that sums of powers modulo 2**64 can't tell from its complement, if it is long enough."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def rowset(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


# --- 1 -------------------------------------------------------------------------


def test_op1_learns_what_words_tell_and_scores_all_rows(spark):
    rng = random.Random(1)
    good = [(k, " ".join(words(rng, 30)) + ".") for k in range(0, 300)]
    bad = [(k, " ".join(w.upper() + "!!" for w in words(rng, 30))) for k in range(300, 420)]
    odd = [(900, None), (901, ""), (None, "some text")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(420)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in op1.quality_scores(docs, labels).collect()}
    assert len(got) == 423
    assert all(r["held_out"] == (k is not None and crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    held = [(k, r) for k, r in got.items() if k is not None and k < 420 and r["held_out"]]
    assert sum(r["predicted"] == int(k < 300) for k, r in held) >= 0.97 * len(held)
    assert got[900]["score"] == got[901]["score"]
    assert op1.quality_scores(empty(spark), labels.limit(0)).count() == 0


def test_op1_scores_are_the_dot_products(spark):
    import pyarrow as pa

    weights = np.random.default_rng(0).normal(size=(1 << op1.BITS) + 1)
    docs = spark.createDataFrame([(1, "A b a B c."), (2, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in op1.scored(docs, weights, ["doc_id"]).collect()}
    for a, _, at, bucket, value in op1.features(pa.array(["A b a B c.", ""])):
        for r in range(2):
            x = sum(weights[i] * v for i, v in zip(bucket[at[r] : at[r + 1]], value[at[r] : at[r + 1]], strict=True)) + weights[-1]
            assert got[a + r + 1] == pytest.approx(1 / (1 + np.exp(-x)))


def test_op1_features_equal_brute_force():
    """Counts of runs of one to three words and shapes, from strings alone: equal strings share a bucket, weights are 1 + log(count) over the length."""
    import pyarrow as pa

    rng = random.Random(30)
    kinds = {}
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,", "!", "?", "#*$%&", "|", "<>", "'\"()-", ":;/\\=_@"), 1):
        kinds |= dict.fromkeys(chars, k)
    texts = [" ".join(rng.choice(["the", "The", "THE", "x1", "end.", "wow!!", "né", "a-b", "a-b"]) for _ in range(rng.randint(0, 25))) for _ in range(40)] + ["", None]

    def grams(text):
        w = SPACED.findall(text or "")
        low = [x.translate(LOWER) for x in w]
        shape = []
        for k, x in enumerate(w):
            codes = [kinds.get(chr(b), 1 if b >= 128 else 0) for b in x.encode()]
            runs = tuple(c for i, c in enumerate(codes) if i == 0 or c != codes[i - 1])
            shape.append((runs, k > 0 and low[k] == low[k - 1]))
        return collections.Counter((kind, tuple(seq[k : k + n])) for kind, seq in (("word", low), ("shape", shape)) for n in (1, 2, 3) for k in range(len(seq) - n + 1))

    named = {}
    for a, b, at, bucket, value in op1.features(pa.array(texts)):
        for r in range(b - a):
            want = grams(texts[a + r])
            got = dict(zip(bucket[at[r] : at[r + 1]].tolist(), value[at[r] : at[r + 1]].tolist(), strict=True))
            length = sum((1 + np.log(n)) ** 2 for n in want.values()) ** 0.5
            assert len(got) == len(want) and sorted(got.values()) == pytest.approx(sorted((1 + np.log(n)) / length for n in want.values()))
            for bucket_ in got:
                named.setdefault(bucket_, []).append(set(want))
    # all texts that share a bucket share a gram
    assert all(set.intersection(*sets) for sets in named.values())


def test_op1_learner_equals_ftrl_by_the_book():
    """Per coordinate, with dicts: w from z and n, then n and z from the gradient."""
    rng = np.random.default_rng(31)
    size = 1 << op1.BITS
    rows = []
    for _ in range(25):
        bucket = np.sort(rng.choice(np.append(np.arange(40), size - 1), rng.integers(0, 9), replace=False))
        rows.append((bucket, rng.random(len(bucket)), int(rng.integers(0, 2))))
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= op1.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * op1.L1) / ((op1.BETA + n[i] ** 0.5) / op1.ALPHA + op1.L2)

    for _ in range(op1.PASSES):
        for bucket, value, y in rows:
            x = [*zip(bucket.tolist(), value.tolist(), strict=True), (size, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / op1.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = op1.train(rows)
    assert len(got) == size + 1
    assert {i: got[i] for i in z} == pytest.approx({i: weight(i) for i in z})
    assert np.count_nonzero(got) == sum(weight(i) != 0 for i in z)


# --- 2 -------------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_lines(rows):
    """{(doc_id, text): kept text}: rows of equal doc_id and text are one document."""
    order, out = [], {}
    for key in dict.fromkeys(r for r in rows if r[1] is not None):
        order += [((key[0] is not None, key[0] or 0), key, k, line) for k, line in enumerate(key[1].split("\n")) if line.strip(" \t\n\v\f\r")]
    return order, out


@pytest.mark.parametrize("fuzzy_from", [20, 1])
def test_op2_equals_brute_force(spark, fuzzy_from):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh äß日", k=rng.choice([1, 2, 5, 7, 8, 9, 19, 20, 21, 40, 47, 48, 100, 300]))) for _ in range(40)]
    lines = []
    for s in base:
        lines.append(s)
        for _ in range(rng.randint(0, 4)):
            t = s
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                k = rng.randrange(len(t) + 1)
                t = rng.choice([t[:k] + "z" + t[k:], t[:k] + "z" + t[k + 1 :], t[:k] + t[k + 1 :]])
            lines.append(t)
    rng.shuffle(lines)
    lines += ["", "   ", "fff", "fff", "", "   "]
    rows = [(k, "\n".join(lines[k * 5 : k * 5 + 5])) for k in range(len(lines) // 5 + 1)] + [(900, None), (901, ""), (None, "null id line"), (902, "null id line")]
    rows.append(rows[3])
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, n_Lines int")
    got = rowset(op2.dedup_lines(df, fuzzy_from=fuzzy_from), "doc_id", "text")
    order, _ = brute_lines(rows)
    order.sort(key=lambda x: (x[0], x[2]))
    gone = set()
    for i, (_, key, k, line) in enumerate(order):
        for _, _, _, other in order[:i]:
            if line == other or (min(len(line), len(other)) >= fuzzy_from and within_one(line, other)):
                gone.add((key, k))
                break
    want = collections.Counter((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if ((i, t), k) not in gone)) for i, t in rows)
    assert got == want
    assert op2.dedup_lines(empty(spark)).count() == 0


def test_op2_runs_no_python(spark, docs):
    plan = op2.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_op2_long_line(spark):
    long = "".join(random.Random(1).choices("abc ", k=40_000))
    rows = [(1, long), (2, long[:25_000] + long[25_001:]), (3, long[:9] + "Z" + long[10:]), (4, long + "é"), (5, "x" + long + "yy")]
    got = {r["doc_id"]: r["n_dropped"] for r in op2.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


# --- 3 -------------------------------------------------------------------------


def test_op3_own_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.txt", "nothing here"),
        (3, "a/b/LICENSE.md", "some words\nLicensed under the Apache License, Version 2.0.\nmore"),
        (4, "a/b/c/y.txt", "Licensed under CC BY-NC 4.0."),
        (5, "z/x.txt", "nothing"),
        (6, "a/x.txt", None),
        (7, None, "Released under the MIT License."),
        (8, None, ""),
        (9, "top.txt", "word " * 5000),
        (10, "a/b/COPYING", "plain text with no notice"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, path string, text string, Licence string")
    got = {r["doc_id"]: (r["own_licence"], r["licence"], r["licence_from"]) for r in op3.scan_licences(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        5: (None, None, None), 6: (None, "MIT", "a"), 7: ("MIT", "MIT", None), 8: (None, None, None), 9: (None, None, None), 10: (None, "Apache-2.0", "a/b"),
    }
    assert op3.scan_licences(df.limit(0)).count() == 0


def test_op3_scores_equal_brute_force(spark, docs, texts):
    """All windows of all lines against all templates, word by word."""
    split = lambda s: ALNUM.findall((s or "").translate(LOWER))
    rng = random.Random(21)
    rows = [t for _, t in texts]
    for k, (_, t, _) in enumerate(TEMPLATES):
        w = t.split()
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = rng.choice(["other", "words", "the", "of"])
        wrap = rng.randint(3, 12)
        rows.append("\n".join(["first some text", *(" ".join(w[i : i + wrap]) for i in range(0, len(w), wrap)), "* ", "then more of it"]))
    n, df = len(rows), collections.Counter(w for t in rows for w in set(split(t)))
    known = {w for _, t, _ in TEMPLATES for w in split(t)}
    rare = {w: np.log((1 + n) / (1 + df[w])) + 1 for w in known}
    vectors = []
    for name, t, least in TEMPLATES:
        v = {w: x * rare[w] for w, x in collections.Counter(split(t)).items()}
        vectors.append((name, max(least or 0, op3.ALIKE), {w: x / sum(y * y for y in v.values()) ** 0.5 for w, x in v.items()}, len(split(t)) ** 0.5))

    def best(text):
        lines = [w for w in map(split, (text or "").split("\n")) if w]
        top, found = 0.0, (None, None)
        for size in sorted({*(s for s in op3.SIZES if s < len(lines)), len(lines)}):
            for a in range(len(lines) - size + 1) if lines else ():
                c = collections.Counter(w for x in lines[a : a + size] for w in x)
                norm = sum((x * rare[w]) ** 2 if w in known else x for w, x in c.items()) ** 0.5
                for name, least, v, root in vectors:
                    cos = round(sum(v[w] * x * rare[w] for w, x in c.items() if w in v) / norm, 9)
                    if cos >= least and cos**4 * root > top + 1e-9:
                        top, found = cos**4 * root, (name, round(cos, 6))
        return found

    files = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: (r["own_licence"], r["own_score"] and round(r["own_score"], 6)) for r in op3.own_licences(files, ["doc_id"]).collect()}
    assert got == {k: best(t) for k, t in enumerate(rows)}
    assert len({x for x, _ in got.values()}) > 0.8 * len(IDENTIFIERS)


HEADS = {
    "Apache-2.0": """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.""",
    "GPL-2.0": """/* This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
int main(void) { return 0; }""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.""",
    "LGPL-3.0": """                   GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.""",
    "BSD-3-Clause": """# Copyright (c) 2011, Some Body
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
# 1. Redistributions of source code must retain the above copyright
#    notice, this list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright
#    notice, this list of conditions and the following disclaimer in the
#    documentation and/or other materials provided with the distribution.
# 3. Neither the name of the University nor the names of its contributors
#    may be used to endorse or promote products derived from this software
#    without specific prior written permission.""",
    "BSD-2-Clause": """Copyright 2020 Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
    "MIT": """MIT License

Copyright (c) 2022 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "ISC": """// Permission to use, copy, modify, and/or distribute this software for
// any purpose with or without fee is hereby granted, provided that the
// above copyright notice and this permission notice appear in all copies.""",
    "CC-BY-SA-4.0": "# SPDX-License-Identifier: CC-BY-SA-4.0\nx = 1",
    None: "# SPDX-License-Identifier: Unheard-Of\nthe rest of a text about the license of this software and its version",
}


def test_op3_knows_usual_heads_and_headers(spark):
    rng = random.Random(22)
    filler = [(f"f{k}", " ".join(words(rng, 60)) + " the of and to a is in this it for free use with may not") for k in range(40)]
    files = spark.createDataFrame([*((str(k), v) for k, v in HEADS.items()), *filler], "name string, text string")
    got = {r["name"]: r["own_licence"] for r in op3.own_licences(files, ["name"]).collect()}
    assert {k: v for k, v in got.items() if v} == {k: k for k in HEADS if k}


def test_op3_two_licence_files_in_a_directory(spark):
    mit, isc = "Released under the MIT License.", "Released under the ISC License."
    rows = [("a/LICENSE", mit + " And more."), ("a/COPYING", isc), ("a/x", "text"), ("b/LICENSE", mit), ("b/LICENSE.txt", isc), ("b/x", "text"), ("b/c/x", "text"), ("b/x", "text")]
    got = collections.Counter((r["path"], r["licence"], r["licence_from"]) for r in op3.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect() if r["path"].endswith("x"))
    # the better score, then the first name; repeated rows stay
    assert got == {("a/x", "ISC", "a"): 1, ("b/x", "ISC", "b"): 2, ("b/c/x", "ISC", "b"): 1}


# --- 4 -------------------------------------------------------------------------


def test_op4_round_trip(spark, tmp_path):
    rng = random.Random(2)
    big = ["\r\n\r\nWARC/1.1\r\n" + "ü" * n for n in (492, 493, 900)]
    rows = [(k, f"http://{rng.choice('abc')}.example.org/{rng.randint(0, 3)}", big[k % 3] if k % 2 else f"small {k % 4}") for k in range(60)]
    rows += [(100, None, None), (101, "x\r\ny", ""), (None, "http://a.example.org/", big[2]), (7, rows[7][1], rows[7][2]), (59, "http://d/", "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, Digest int")
    at = F.timestamp_seconds(F.lit(0) + F.coalesce("page_id", F.lit(0)) % 5)
    op4.write_archives(df.select("page_id", "url", "html"), str(tmp_path / "w"), at, [(1500, 7), (None, 3)])
    out = op4.merged(op4.read_runs(spark, str(tmp_path / "w"))).collect()
    assert len(out) == len(rows)
    keys = [op4.order(tuple(r)) for r in out]
    assert keys == sorted(keys)
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= op4.LEAST:
            last[h] = max(last.get(h, -1), i)
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = last.get(h) if i is not None and len(raw) >= op4.LEAST and i < last[h] else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    assert any(r["record_type"] == "revisit" for r in out)
    assert op4.capture_histories(df.limit(0), at).count() == 0


def test_op4_url_keys():
    assert {u: op4.url_key(u) for u in ("http://A.com?x=1", "https://u:p@b.a.com:80/x/y?q#f", "http://a.com", "http://a.com/#top", "x://[::1]:8/z", "plain", "")} == {
        "http://A.com?x=1": "com,a)/?x=1", "https://u:p@b.a.com:80/x/y?q#f": "com,a,b)/x/y?q", "http://a.com": "com,a)/", "http://a.com/#top": "com,a)/", "x://[::1]:8/z": "[::1])/z", "plain": "plain", "": "",
    }


def test_op4_long_pages_that_stand_together_make_no_long_file(spark, tmp_path):
    """A run of long pages in a table of short ones (sizes scaled down): files are bounded by bytes, not by the mean."""
    rows = [(k, f"http://h/{k}", "s" * 50) for k in range(3000)]
    rows[1000:1200] = [(k, f"http://h/{k}", f"{k:06d}" + "L" * 20_000) for k in range(1000, 1200)]
    rows[2000] = (2000, "http://h/2000", "H" * 300_000)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    classes = [(100, 500), (30_000, 5), (None, 1)]
    op4.write_archives(pages, str(tmp_path / "w"), F.timestamp_seconds("page_id"), classes, "none")
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*") if f.stat().st_size)
    assert sizes[-1] < 302_000 and sizes[-2] < 600 * 700 and len([x for x in sizes if 90_000 < x < 110_000]) == 40
    out = op4.merged(op4.read_runs(spark, str(tmp_path / "w")))
    assert sorted((r["page_id"], r["payload_bytes"]) for r in out.collect()) == [(i, len(h)) for i, _, h in rows]


def test_op1_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(50 + k))) for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    seen = []
    train = op1.train
    try:
        op1.train = lambda rows: seen.append(rows) or train(rows)
        for most in (1 << 30, 20_000, 0):
            op1.fitted(docs, labels, most_bytes=most)
    finally:
        op1.train = train
    whole, some, none = seen
    assert len(whole) > len(some) > 5 and none == []
    assert sum(8 * len(b) for b, _, _ in some) <= 20_000 < sum(8 * len(b) for b, _, _ in whole[: len(some) + 1])
    assert all((a[0] == b[0]).all() for a, b in zip(some, whole))


def test_op4_unpacked_archives_seek_by_offset_and_hot_urls_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op4, "RANGE_ROWS", 40)
    rows = [(k, "http://hot.org/", "long " * (k % 50) + "ü" * 3_000_000 * (k == 7)) for k in range(300)] + [(None, "http://a/", "same"), (None, "http://b/", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    op4.write_archives(pages, str(tmp_path / "w"), F.timestamp_seconds(F.coalesce("page_id", F.lit(0))), compression="none")
    index = op4.merged(op4.read_runs(spark, str(tmp_path / "w")))
    sizes = [r["n"] for r in index.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    out = index.collect()
    assert len(out) == 302 and max(sizes) < 150
    ids = set()
    for r in out:
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            head, block, _ = next(op4.parse(f.read(13_000_000)))
        assert head.get("X-Page-ID") == (None if r["page_id"] is None else str(r["page_id"]))
        ids.add(head["WARC-Record-ID"])
    assert len(ids) == 302


def test_op4_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(((str(rng.randint(0, 9)), "t", rng.choice([None, 1, 2]), 0, "", "", None, f"f{i}", j, "") for j in range(rng.randint(0, 20))), key=op4.order) for i in range(k)]
        assert list(op4.LoserTree([iter(r) for r in runs])) == sorted((x for r in runs for x in r), key=op4.order)


# --- 5 -------------------------------------------------------------------------


@pytest.mark.parametrize("block_words", [100_000, 20])
def test_op5_equals_brute_force(spark, docs, texts, block_words):
    rng = random.Random(8)
    split = lambda s: ALNUM.findall((s or "").translate(LOWER))
    some = [split(t) for _, t in texts if t]
    items = [(k, " ".join(w[2:40]).upper()) for k, w in enumerate(some[:20])] + [(50, "One"), (51, "again and"), (52, ""), (53, None), (54, " ".join(words(rng, 30))), (None, " ".join(some[21][:15]))]
    items.append(items[0])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = collections.Counter()
    for r in op5.contamination(docs, bench, block_words=block_words).collect():
        got[r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]] += 1
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = collections.Counter()
    for i, t in texts:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[g]
        want[i, len(w), len(hit), tuple(sorted(str(x) for x in ids if x is not None)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    assert got == want
    assert op5.contamination(empty(spark), bench).count() == 0
    assert op5.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_op5_tells_apart_structured_words(spark):
    t = thue_morse(1024)
    bench = spark.createDataFrame([(1, f"{t} a b")], "item_id bigint, text string")
    rows = [(1, f"x {t} a b"), (2, f"x {t.translate(str.maketrans('ab', 'ba'))} a b")]
    got = rowset(op5.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), bench), "doc_id", "n_hit")
    assert got == {(1, 3): 1, (2, 0): 1}


def test_op5_windows_of_common_words_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(op5, "MATCHES", 7)
    rng = random.Random(20)
    some = lambda n: " ".join(rng.choices("ab", k=n))
    items = [(k, some(30)) for k in range(40)]
    docs = [(k, some(200)) for k in range(9)] + [(9, items[3][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r["n_hit"] for r in op5.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    windows = {tuple(t.split()[k : k + 13]) for _, t in items for k in range(18)}
    for i, t in docs:
        w = t.split()
        assert got[i] == len({x for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for x in range(k, k + 13)})


# --- 6 -------------------------------------------------------------------------


def test_op6_is_an_exact_cover_with_little_padding(spark, docs, texts):
    length = 64
    rows = op6.packed(docs, op6.tokenizer_path(), length=length, with_ids=True).collect()
    tokens = op6.Tokens(op6.tokenizer_path())
    seqs = collections.defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == crc32(np.array(r["ids"], "<u4").tobytes())
        seqs[r["sequence_id"]].append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    joined = collections.Counter()
    open_, order = [], sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    for r in order:
        assert r["start"] == len(open_)
        open_ += r["ids"]
        if len(open_) == r["doc_tokens"]:
            joined[r["doc_id"], tuple(open_)] += 1
            open_ = []
    want = collections.Counter((i, (*tokens.slow.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in texts)
    assert joined == want
    assert op6.packed(empty(spark), op6.tokenizer_path()).count() == 0


def test_op6_dynamic_program_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 40, rng.integers(1, 25)))])
        cost = rng.choice([0, 4, 12], len(at))

        def price(cuts, at=at, cost=cost):
            total = 0
            for i, j in zip(cuts, cuts[1:], strict=False):
                n = int(at[j] - at[i])
                assert n <= 64
                total += cost[j] + op6.SEQUENCE + (0 if n in op6.POWERS else 64 - n)
            return total

        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                if at[j] - at[i] <= 64:
                    n = int(at[j] - at[i])
                    best[j] = min(best[j], best[i] + cost[j] + op6.SEQUENCE + (0 if n in op6.POWERS else 64 - n))
        assert price(op6.best_cuts(at, cost, 64)) == best[-1]


# --- 7 -------------------------------------------------------------------------


def shingle_set(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_op7_equals_brute_force(spark, docs, texts):
    sets = [(i, shingle_set(t)) for i, t in texts]
    group = list(range(len(sets)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                group[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    want = collections.Counter()
    for x, (i, s) in enumerate(sets):
        c = least.get(root(x)) if s else i
        want[i, len(s), c, i == c] += 1
    assert rowset(op7.groups(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert op7.groups(empty(spark)).count() == 0


@pytest.mark.parametrize("n, common, own", [(2000, 45, 55), (400, 70, 10)])
def test_op7_makes_few_pairs_of_texts_with_a_common_part(spark, n, common, own, monkeypatch):
    """J of about 0.27, and of 0.77: no two texts are linked, but buckets hold many."""
    rng = random.Random(17)
    part = [f"c{k}" for k in range(common)]
    rows = [(k, " ".join(part + [f"o{rng.randint(0, 10**9)}" for _ in range(own)])) for k in range(n)]
    rows += [(n + k, rows[k][1].replace("c7 ", "changed ")) for k in range(5)]  # these five pairs are linked
    counts = []

    def counted(pairs, sets, percent, real=op7.verified):
        counts.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(op7, "verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in op7.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    linked = [k for k in range(5) if 100 * len(sets[k] & sets[n + k]) >= 85 * len(sets[k] | sets[n + k])]
    assert got == {k: k - n if k - n in linked else k for k in sets}
    assert sum(counts) <= 30 * n


def assembled(kind, n, seed):
    """Texts put together from shared parts: 12 sections of three variants, or forms of 20 sections of which four vary."""
    rng = random.Random(seed)
    part = lambda *name: [f"p{'-'.join(map(str, name))}-{k}" for k in range(25)]
    if kind == "sections":
        return [sum((part(s, rng.randrange(3)) for s in range(12)), []) for _ in range(n)]
    return [sum((part(s, rng.randrange(20) if s % 5 == 2 else 0) for s in range(20)), []) for _ in range(n)]


@pytest.mark.parametrize("kind, share", [("sections", 0.01), ("forms", 0.03)])
def test_op7_tries_few_pairs_of_texts_put_together_from_shared_parts(spark, kind, share, monkeypatch):
    n, rng = 400, random.Random(29)
    rows = list(enumerate(" ".join(w) for w in assembled(kind, n, 23)))
    rows += [(n + k, rows[k][1].replace("-12 ", f"-12x{rng.randint(0, 99)} ", 2)) for k in range(20)]
    counts = []

    def counted(*args, real=op7.missed_pairs):
        out = op7.written(real(*args), "counted")
        counts.append(out.count())
        return out

    monkeypatch.setattr(op7, "missed_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in op7.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    sets, least = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    links = [(x, y) for x in range(len(rows)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])]
    for _ in rows:
        for x, y in links:
            least[x] = least[y] = min(least[x], least[y])
    assert got == dict(enumerate(least)) and len(links) >= 20
    assert sum(counts) <= share * n * n / 2


def joined_rows(store, first, on):
    """Rows that each join over keys like on made, of the executions from the first."""
    out = []
    seq = lambda s: [s.apply(k) for k in range(s.size())]
    for e in seq(store.executionsList())[first:]:
        values = store.executionMetrics(e.executionId())
        for node in seq(store.planGraph(e.executionId()).allNodes()):
            if "Join" in node.name() and re.search(on, node.desc()):
                for m in seq(node.metrics()):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_op7_compares_few_of_many_near_copies(spark):
    """Copies of one text with one to six words of their own: those past the threshold share nearly all with hundreds of linked ones."""
    n, rng = 500, random.Random(41)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            words[at : at + rng.choice((0, 1, 1, 1))] = [f"o{rng.randint(0, 10**9)}"] * rng.choice((0, 1, 1, 1))
        rows.append((k, " ".join(words)))
    store = spark._jsparkSession.sharedState().statusStore()
    ran = store.executionsCount()
    got = {r["doc_id"]: r["component_id"] for r in op7.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    sets, least = [shingle_set(t) for _, t in rows], list(range(n))
    links = [(x, y) for x in range(n) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])]
    for _ in range(20):
        for x, y in links:
            least[x] = least[y] = min(least[x], least[y])
    assert got == dict(enumerate(least)) and len(set(least)) > 50
    made = joined_rows(store, ran, r"\[block")
    assert made and max(made) <= 20 * n


def test_op7_tells_apart_structured_words(spark):
    t = thue_morse(1024)
    u = t.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{t} w x y z"), (2, f"{u} w x y z"), (3, f"{t} w x y z")]
    got = rowset(op7.groups(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "component_id")
    assert got == {(1, 1): 1, (2, 2): 1, (3, 1): 1}


def test_op7_likelihood_finds_j():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.85, 0.95):
        n = 2000
        both = rng.integers(0, 1 << 63, int(2 * n * j / (1 + j)), dtype=np.uint64)
        each = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)])) for _ in range(2)]
        regs = op7.registers(np.concatenate(each), np.array([0, len(each[0]), len(each[0]) + len(each[1])]))
        got = op7.likelihood_jaccard(regs[:1], regs[1:], np.array([float(len(each[0]))]), np.array([float(len(each[1]))]))
        assert abs(got[0] - j) < 5 * (j * (1 - j) / op7.REGISTERS) ** 0.5 + 0.01


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    label = {}
    for a, b in links:
        if a != b:
            x, y = label.get(a, a), label.get(b, b)
            label |= {a: x, b: y}
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert got == label
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


# --- 8 -------------------------------------------------------------------------


def test_op8_counts_equal_brute_force(spark, docs, texts):
    got = rowset(op8.with_counts(docs, keep=["doc_id"]), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = collections.Counter()
    for i, t in texts:
        t = t or ""
        w = SPACED.findall(t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {x for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)] += 1
    assert got == want
    assert op8.with_counts(empty(spark)).count() == 0


def test_op8_tells_apart_structured_lines(spark):
    t = thue_morse(1024)
    u = t.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{t}\n{u}"), (2, f"{t}\n{u}\n{t}"), (3, " ".join([t, "b", "c", "d", "e", u, "b", "c", "d", "e"]))]
    got = rowset(op8.with_counts(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "n_dup_lines", "n_repeat_words")
    assert got == {(1, 0, 0): 1, (2, 1, 0): 1, (3, 0, 0): 1}


def test_op8_learns_rules_and_keeps_clean_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = words(rng, rng.randint(20, 60))
        rows.append((k, " ".join(x + rng.choice(["###", "&&&"]) for x in w) if bad else " ".join(w) + " & co"))
        labels.append((k, int(not bad)))
    rows += [(1000, None), (1001, ""), (1002, "too short"), (None, " ".join(words(rng, 40)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in op8.quality_verdicts(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert all(got[k]["base_failed"] and not got[k]["kept"] for k in (1000, 1001, 1002))
    judged = [(k, r) for k, r in got.items() if k is not None and k < 600 and not r["base_failed"]]
    assert all(r["kept"] for k, r in judged if k % 4) and sum(not r["kept"] for k, r in judged if k % 4 == 0) > 140
    none = op8.quality_verdicts(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert none.where("kept = base_failed").count() == 0


def test_op8_rules_equal_brute_force():
    """Each condition of a grown rule has the greatest gain of all thresholds offered; pruning keeps the best start; covered rows leave."""
    rng = np.random.default_rng(32)
    n = 400
    x = {"a": rng.integers(0, 30, n).astype(float), "b": rng.random(n), "c": rng.integers(0, 3, n).astype(float)}
    bad = ((x["a"] > 20) & (x["b"] < 0.5)) | (rng.random(n) < 0.03)

    def gain(live, op, f, t):
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        now = [i for i in range(n) if live[i] and (x[f][i] <= t if op == "<=" else x[f][i] > t)]
        p = sum(bool(bad[i]) for i in now)
        return p * (np.log2(p / len(now)) - np.log2(p0 / (p0 + n0))) if p else -1.0

    rule = op8.grow(x, bad, 5)
    live = np.ones(n, bool)
    for f, op, t in rule:
        offered = [gain(live, o, g, float(u)) for g in x for u in np.unique(np.quantile(x[g][live & bad], np.linspace(0, 1, 33), method="lower")) for o in ("<=", ">")]
        # moving a threshold halfway to the next row on the wrong side never loses gain
        assert gain(live, op, f, t) >= max(offered) - 1e-9
        live &= x[f] <= t if op == "<=" else x[f] > t
    assert rule and (live & bad).any()
    cut, sure = op8.prune(x, bad, rule)
    worth = []
    for k in range(1, len(rule) + 1):
        c = np.ones(n, bool)
        for f, op, t in rule[:k]:
            c &= x[f] <= t if op == "<=" else x[f] > t
        p, m = int((c & bad).sum()), int((c & ~bad).sum())
        worth.append(((p - m) / max(p + m, 1), p, -k, p / max(p + m, 1)))
    assert cut == rule[: -max(worth)[2]] and sure == pytest.approx(max(worth)[3])
    rules = op8.learn(x, 1 - bad.astype(int), precision=0.9)
    fired = np.zeros(n, bool)
    for r in rules:
        now = np.ones(n, bool)
        for f, op, t in r:
            now &= x[f] <= t if op == "<=" else x[f] > t
        assert (now & ~fired & bad).sum() >= 5
        fired |= now
    assert (fired & bad).sum() >= 0.7 * bad.sum() and (fired & ~bad).sum() <= 0.1 * fired.sum()
    assert op8.learn(x, np.ones(n, int)) == []


def test_op8_rule_expression_is_ordered(spark):
    rules = [[("words", ">", 10.0), ("symbols_per_word", "<=", 0.5)], [("words", ">", 5.0)]]
    zero = {c: 0 for c in op8.COUNTS}
    rows = [zero | {"n_words": w, "n_symbols": k} for w, k in ((20, 1), (20, 19), (7, 0), (3, 0))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in op8.COUNTS))
    assert sorted(((r["n_words"], r["n_symbols"]), r["rule"]) for r in df.withColumn("rule", op8.rejects(rules)).collect()) == [((3, 0), None), ((7, 0), 2), ((20, 1), 1), ((20, 19), 2)]


# --- 9 -------------------------------------------------------------------------


def test_op9_equals_brute_force(spark):
    rng = random.Random(9)
    hosts = ["com", "example.com", "a.example.com", "EXAMPLE.com", "notexample.com", "net", "b.example.net", "x.org", "a..com", "com.", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/77?x=/de/8", "/de/8#y", "/es/1", "/en/\u00ff\U0010ffff", "?/en/", "#/es/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths] + ["example.com/en/7", "", None, "a://b://c/en/", "http://com/en/" + "z" * 9000]
    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(3, urls[3], "clash"), (None, urls[5], "clash"), (None, None, "clash")]
    rules = [*op9.RULES, ("com", "", "block"), ("a.example.com", "/en/7", "block"), ("example.com", "/en/77", "block"), ("org", "", "allow")]
    rng.shuffle(rules)
    got = rowset(op9.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, RULE string"), op9.rule_table(spark, rules)), "page_id", "host", "path", "rule", "verdict")
    want = collections.Counter()
    for i, u, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)] if m else []
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want[i, host, path, rule, verdict] += 1
    assert got == want
    frame = spark.createDataFrame(rows[:5], "page_id bigint, url string, x string")
    assert op9.filter_urls(frame, op9.rule_table(spark, []), "block").where("verdict = 'block'").count() == 5
    assert op9.filter_urls(frame.limit(0), op9.rule_table(spark, rules)).count() == 0
    plan = op9.filter_urls(frame, op9.rule_table(spark, rules))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|Pandas", plan)


# --- 10 ------------------------------------------------------------------------


def removed_by_brute_force(rows):
    """The rows of remove_repeats: each 200 bytes that start anywhere else go."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k : k + 200] for _, b in raws for k in range(len(b) - 199))
    want = collections.Counter()
    for i, b in raws:
        gone = set()
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone |= set(range(k, k + 200))
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        want[i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()] += 1
    return want


OP10 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("group, slice_", [(1000, 1 << 19), (1, 1 << 19), (2, 97), (1000, 700)])
def test_op10_equals_brute_force(spark, docs, texts, group, slice_, monkeypatch):
    """Also with every key cut into pieces, and with runs and texts across the borders of slices and blocks."""
    monkeypatch.setattr(op10, "GROUP", group)
    monkeypatch.setattr(op10, "SLICE", slice_)
    monkeypatch.setattr(op10, "BLOCK", 4 * slice_)
    got = rowset(op10.remove_repeats(docs), *OP10)
    assert got == removed_by_brute_force(texts)
    assert any(k[2] for k in got)


def test_op10_templates_that_differ_in_few_bytes(spark, monkeypatch):
    """One common passage before, after and around what differs: one anchor has many different regions."""
    monkeypatch.setattr(op10, "GROUP", 8)
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh ", k=330))
    rows = []
    for k in range(90):
        cut = rng.choice([130, 165, 180, 200, 215, 260])
        rows.append((k, passage[:cut] + f"#{rng.randint(0, 30)}#" + passage[cut:] + "".join(rng.choices("xyz", k=rng.randint(0, 60)))))
    got = rowset(op10.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")), *OP10)
    assert got == removed_by_brute_force(rows)


def test_op10_empty_and_long_and_thue_morse(spark):
    assert op10.remove_repeats(empty(spark)).count() == 0
    t = thue_morse(1024)
    rng = random.Random(13)
    long = "".join(rng.choices("abcdefghijklmnop", k=3_000_000))  # over more than one numpy step
    rows = [(1, t), (2, t.translate(str.maketrans("ab", "ba"))), (3, long), (4, long[1_999_000:2_000_000] + "é"), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in op10.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    short = removed_by_brute_force(rows[:2])
    assert all(tuple(got[i][c] for c in OP10) in short for i in (1, 2))
    assert [got[i]["n_removed"] for i in (3, 4, 5, 6)] == [1000, 1000, 0, 0]


def test_op10_factors_are_longest_previous():
    rng = random.Random(14)
    for letters, n in (("ab", 700), ("abcd", 900), ("a", 450)):
        text = "".join(rng.choices(letters, k=n))
        text = text[:300] + text[:260] + text[300:]
        raw = text.encode()
        starts = np.array(sorted(rng.sample(range(len(raw) - 199), 150)))
        longest, source = op10.factors(np.frombuffer(raw, np.uint8), starts)

        def common(i, j, raw=raw):
            n = 0
            while n < 200 and raw[i + n] == raw[j + n]:
                n += 1
            return n

        assert longest.tolist() == [max((common(i, j) for j in starts if j < i), default=0) for i in starts]
        assert all(j < 0 if n == 0 else j < k and common(starts[k], starts[j]) == n for k, (n, j) in enumerate(zip(longest, source, strict=True)))


@pytest.mark.parametrize("group", [1000, 1])
def test_op10_keeps_the_first_copy(spark, texts, group, monkeypatch):
    monkeypatch.setattr(op10, "GROUP", group)
    rows = sorted({(i, t or "") for i, t in texts if i is not None and i != 7})
    seen, want = set(), {}
    for i, t in rows:
        b, gone = t.encode(), set()
        for k in range(len(b) - 199):
            if b[k : k + 200] in seen:
                gone |= set(range(k, k + 200))
            seen.add(b[k : k + 200])
        want[i] = bytes(c for k, c in enumerate(b) if k not in gone)
    got = {r["doc_id"]: bytes(r["kept"]) for r in op10.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), keep="first", with_kept=True).collect()}
    assert got == want


# --- all -----------------------------------------------------------------------


def test_very_long_texts(spark):
    """Texts of over one numpy step, beside short ones, in each operator that reads words."""
    rng = random.Random(40)
    vocabulary = words(rng, 4000)
    long = [" ".join(rng.choices(vocabulary, k=420_000)) for _ in range(2)]
    long[1] += "\n" + long[1][:5000]
    near = long[0].replace(" ", "  ", 50)
    rows = [(1, long[0]), (2, "short one here"), (3, long[1]), (4, near), (5, None), (6, "")]
    assert min(map(len, long)) > 2 << 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    split = {i: SPACED.findall(t or "") for i, t in rows}
    counts = {r["doc_id"]: r for r in op8.with_counts(docs, keep=["doc_id"]).collect()}
    assert {i: (r["n_words"], r["word_chars"]) for i, r in counts.items()} == {i: (len(w), sum(map(len, w))) for i, w in split.items()}
    grams = collections.Counter(tuple(split[3][k : k + 5]) for k in range(len(split[3]) - 4))
    assert counts[3]["n_repeat_words"] == len({x for k in range(len(split[3]) - 4) if grams[tuple(split[3][k : k + 5])] > 1 for x in range(k, k + 5)})
    group = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7.groups(docs).collect()}
    assert group == {1: (len(shingle_set(long[0])), 1), 2: (1, 2), 3: (len(shingle_set(long[1])), 3), 4: (len(shingle_set(near)), 1), 5: (0, 5), 6: (0, 6)}
    part = ALNUM.findall(long[0].translate(LOWER))[300_000:300_030]
    hit = {r["doc_id"]: r["n_hit"] for r in op5.contamination(docs, spark.createDataFrame([(1, " ".join(part))], "item_id int, text string")).collect()}
    assert hit == {1: 30, 2: 0, 3: 0, 4: 30, 5: 0, 6: 0}
    scores = {r["doc_id"]: r["score"] for r in op1.scored(docs, np.random.default_rng(1).normal(size=(1 << op1.BITS) + 1), ["doc_id"]).collect()}
    assert scores[1] == pytest.approx(scores[4]) and scores[5] == scores[6] and all(0 <= x <= 1 for x in scores.values())
    pieces = collections.Counter()
    for r in op6.packed(docs.where("doc_id <> 4"), op6.tokenizer_path()).collect():
        pieces[r["doc_id"]] += r["length"]
    tokens = op6.Tokens(op6.tokenizer_path())
    assert pieces == {i: len(tokens.ids(t or "")) + 1 for i, t in rows if i != 4}


def test_op1_and_op8_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(41)
    texts = [(k, " ".join(words(rng, 30)) if k % 2 else " ".join(x + "###" for x in words(rng, 30))) for k in range(120)]
    rows = [(k, t, 5, "mine") for k, t in [*texts, *texts[:20], (None, texts[3][1]), (7, texts[4][1])]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Score int, KEPT string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(3, 1), (3, 1)], "doc_id bigint, quality int")
    for out, columns in ((op1.quality_scores(docs, labels), ("score", "predicted")), (op8.quality_verdicts(docs, labels), ("kept", "base_failed", "n_words"))):
        got = out.collect()
        assert len(got) == len(rows) and [c.lower() for c in out.columns].count(columns[0]) == 1
        seen = collections.defaultdict(set)
        for r in got:
            seen[r["doc_id"]].add(tuple(r[c] for c in columns))
        assert all(len(v) == 1 for k, v in seen.items() if k != 7) and seen[None] == seen[3]
