"""Rollups from deltas and bucketed upserts: equal to a full recount, and only touched buckets are read and written."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import incremental as I
from cadenza.operators.rollups import COUNTS, task_counts

SCHEMA = "project_id bigint, task_id bigint, status string, due_date date, percent_complete int"
STATUS = ["Not Started", "In Progress", "Blocked", "Complete", "Pending Review"]
DAY = dt.date(2026, 1, 10)


def task(rng, k):
    return (rng.choice([*range(1, 40), None]), k, rng.choice(STATUS), rng.choice([None, DAY + dt.timedelta(days=rng.randint(-9, 9))]), rng.randint(0, 100))


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("project_id", *COUNTS).collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_give_a_full_recount(spark, tmp_path, seed):
    rng = random.Random(seed)
    now = {k: task(rng, k) for k in range(300)}
    df = lambda r: spark.createDataFrame(list(r), SCHEMA)
    state, by, day = I.rollup_state(spark, str(tmp_path / "s"), [("project_id", "bigint")], 16), ["project_id"], F.lit(DAY)
    I.apply_delta(state, I.delta(None, df(now.values()), by, day), 0)
    for epoch in (1, 2):
        some = rng.sample(sorted(now), 25)
        before = [now[k] for k in some]
        for k in some[:10]:
            del now[k]
        for k in some[10:]:
            now[k] = task(rng, k)
        new = [1000 * epoch + k for k in range(8)]
        now |= {k: task(rng, k) for k in new}
        I.apply_delta(state, I.delta(df(before), df([now[k] for k in (*some[10:], *new)]), by, day), epoch)
        assert rows(state.read()) == rows(task_counts(df(now.values()), by, day))
    later = F.lit(DAY + dt.timedelta(days=5))
    I.apply_delta(state, I.grown_older(df(now.values()), by, day, later), 3)
    assert rows(state.read()) == rows(task_counts(df(now.values()), by, later))
    gone = list(now.values())
    I.apply_delta(state, I.delta(df(gone), None, by, later), 4)
    assert state.read().count() == 0 and state.manifest()["folders"] == {}


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    table = I.Buckets(spark, str(tmp_path / "t"), ["id"], spark.range(1).withColumn("x", F.lit("a")).schema, 32)
    table.upsert(spark.range(5000).withColumn("x", F.lit("a")))
    before = table.manifest()["folders"]
    assert len(before) == 32
    new = spark.range(2).withColumn("x", F.lit("b"))
    seen = []
    touched = table.merge(new, lambda old, d: (seen.extend(old.inputFiles()), I.upsert(old, d, ["id"]))[1])
    after = table.manifest()["folders"]
    assert len(touched) == 2 and {int(b) for b in after if after[b] != before[b]} == set(touched)
    assert {f.split(f"{I.BUCKET}=")[1].split("/")[0] for f in seen} == {str(b) for b in touched}
    assert table.read().where("x = 'b'").count() == 2 and table.read().count() == 5000


def test_an_epoch_is_merged_once_and_a_broken_merge_is_never_seen(spark, tmp_path):
    state = I.rollup_state(spark, str(tmp_path / "s"), [("project_id", "bigint")], 4)
    one = spark.createDataFrame([(1, 1, "Blocked", None, 50)], SCHEMA)
    d = I.delta(None, one, ["project_id"], F.lit(DAY))
    assert I.apply_delta(state, d, 5) and I.apply_delta(state, d, 5) == [] == I.apply_delta(state, d, 4)
    with pytest.raises(Exception, match="stop"):
        state.merge(d, lambda old, new: old.withColumn("task_count", F.raise_error(F.lit("stop")).cast("bigint")), 6)
    assert rows(state.read()) == rows(task_counts(one, ["project_id"], F.lit(DAY)))
    assert I.apply_delta(state, d, 6) and state.read().first()["task_count"] == 2


def test_a_stream_of_changes_keeps_the_rollup(spark, tmp_path):
    rng = random.Random(3)
    tasks = [task(rng, k) for k in range(90)]
    for k in range(3):
        spark.createDataFrame(tasks[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    state = I.rollup_state(spark, str(tmp_path / "s"), [("project_id", "bigint")], 4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    write = lambda batch, epoch: I.apply_delta(state, I.delta(None, batch, ["project_id"], F.lit(DAY)), epoch) and None
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(state.read()) == rows(task_counts(spark.createDataFrame(tasks, SCHEMA), ["project_id"], F.lit(DAY)))
    assert state.manifest()["epoch"] == 2
