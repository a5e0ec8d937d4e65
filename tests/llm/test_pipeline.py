"""The pipeline's stages on the smallest tables, each against what it was given."""

import collections
import re

import pytest

import corpus_pipeline
from cadenza.llm import common
from cadenza.llm import op2_line_dedup as op2
from cadenza.llm import op5_decontamination as op5
from cadenza.llm import op6_packing as op6
from cadenza.llm import op7_near_dedup as op7
from cadenza.llm import op8_quality_rules as op8

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows before and after each stage."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def test_columns_stay_until_the_last_stage(kept):
    assert all(x.columns == kept[0].columns for x in kept[:-1])
    assert set(kept[-1].columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_quality_rules(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r["doc_id"]: r["kept"] for r in op8.quality_verdicts(kept[0], labels).collect()}
    assert {r["doc_id"] for r in kept[1].select("doc_id").collect()} == {k for k, v in judged.items() if v}
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    base = {r["doc_id"] for r in op8.with_counts(kept[0]).where(op8.base_failed()).collect()}
    assert len([k for k in clean - base if not judged.get(k, True)]) <= 0.02 * len(clean)


def test_line_dedup(kept):
    rows = sorted((r["doc_id"], r["text"]) for r in kept[1].collect())
    seen, long, want = set(), [], {}
    for i, text in rows:
        stay = []
        for line in text.split("\n"):
            if not re.search(r"\S", line):
                stay.append(line)
                continue
            near = line in seen or (len(line) >= op2.FUZZY_FROM and any(abs(len(x) - len(line)) <= 1 and (len(line) < 21 or x[:10] == line[:10] or x[-10:] == line[-10:]) and one_edit(x, line) for x in long))
            seen.add(line)
            if len(line) >= op2.FUZZY_FROM:
                long.append(line)
            if not near:
                stay.append(line)
        want[i] = "\n".join(stay)
    assert {r["doc_id"]: r["text"] for r in kept[2].collect()} == want


def one_edit(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_near_dedup_leaves_one_of_each_group(kept):
    group = {r["doc_id"]: r["component_id"] for r in op7.groups(kept[2]).collect()}
    assert sorted(r["doc_id"] for r in kept[3].collect()) == sorted(set(group.values()))


def test_near_dedup_takes_a_similarity_of_four_fifths(spark):
    """One changed word of 55: J = 46 / 56; one of 45 has J = 36 / 46 and stays."""
    text = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    rows = [(1, text(1, 55)), (2, text(1, 55)), (3, text(2, 45)), (4, text(2, 45))]
    for _, w in rows[1::2]:
        w[20] = "changed"
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in op7.stage_near_dedup(spark, docs, SF).collect()) == [1, 3, 4]
    assert op7.groups(docs).where("kept").count() == 4


def test_near_dedup_with_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(90))
    near = lambda k: text(k).replace(f"w{k}x40", "changed")
    rows = [(1, text(1)), (5, near(1)), (5, text(5)), (None, text(1)), (None, text(6)), (7, text(7)), (7, text(7))]
    rows += [(None, text(8)), (None, text(8)), (None, near(8)), (None, text(8).upper()), (None, None), (None, ""), (None, ""), (9, None)]
    docs = spark.createDataFrame([(t, i, "en") for i, t in rows], "text string, doc_id bigint, lang string").repartition(3)
    out = op7.stage_near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    eighth = [x for x in got if x[1] in (text(8), near(8), text(8).upper())]
    assert len(eighth) == 1 and eighth[0][0] is None
    want = [(1, text(1)), (5, text(5)), (None, text(6)), (7, text(7)), (7, text(7)), (None, None), (None, ""), (None, ""), (9, None)]
    assert collections.Counter(got) - collections.Counter(eighth) == collections.Counter(want)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_that_clash_with_computed_ones(spark, kept, stage):
    names = ["n_words", "Rule", "kept", "n_lines", "n_dropped", "hits", "item_ids", "n_hit", "contaminated", "node", "lead", "n_shingles", "a.b", "base_failed", "component_id"]
    docs = kept[stage].selectExpr("*", *(f"doc_id * 100 + {k} AS `{c}`" for k, c in enumerate(names)))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == r["doc_id"] * 100 + k for r in rows for k, c in enumerate(names))
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in kept[stage + 1].collect())


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "_jsc": spark.sparkContext._jsc})()

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            common.shared_dir(Session())


def test_decontamination(spark, kept):
    left = {r["doc_id"] for r in kept[4].collect()}
    told = {r["doc_id"]: r["contaminated"] for r in op5.contamination(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert left == {k for k, v in told.items() if not v}


def test_packing_covers_all_kept_documents(kept):
    tokens = op6.Tokens(op6.tokenizer_path())
    pieces = collections.defaultdict(list)
    for r in kept[5].collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    docs = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        at = 0
        for start, n, total in sorted(pieces[i]):
            assert start == at and total == len(tokens.ids(text)) + 1
            at += n
        assert at == total


def test_run(spark, kept):
    assert corpus_pipeline.run(spark, SF).count() == kept[-1].count()


def test_an_empty_table_gives_no_pieces(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
