"""Keyed rules as batches and streams: against a queue, in any number of micro-batches, and over a restart."""

import collections
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.plans import services
from cadenza.streaming import edits as D
from cadenza.streaming import keyed as K

SF = "/root/testdata/sf0.01"


def queue(rows, most, window):
    """The rule by the book: only hits that were let through are remembered."""
    held, out = collections.defaultdict(list), {}
    for key, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        held[key] = [t for t in held[key] if at - t < window]
        out[i] = len(held[key]) < most
        if out[i]:
            held[key].append(at)
    return out


@pytest.mark.parametrize("most, window, span", [(5, 100, 3000), (1, 7, 400), (3, 100000, 500), (2, 1, 50)])
def test_rate_limit_is_that_of_a_queue(spark, most, window, span):
    rng = random.Random(most)
    rows = [(rng.choice([1, 2, 2, 2, 2, 3, None]), rng.randint(0, span), i) for i in range(600)]
    df = spark.createDataFrame(rows, "client bigint, at bigint, event_id bigint").withColumn("ADMITTED", F.lit("own")).repartition(7)
    got = {r["event_id"]: r["admitted"] for r in K.rate_limit(df, "client", "at", "event_id", most, window).collect()}
    assert got == queue(rows, most, window)
    assert K.rate_limit(df.limit(0), "client", "at", "event_id").count() == 0


def test_a_client_that_keeps_knocking_gets_five_an_hour(spark):
    rows = [(1, 60 * k, k) for k in range(240)]
    df = spark.createDataFrame(rows, "client bigint, at bigint, event_id bigint")
    got = K.rate_limit(df, "client", "at", "event_id", 5, 3600).where("admitted").select("at").orderBy("at").collect()
    assert [r[0] // 60 for r in got] == [h * 60 + k for h in range(4) for k in range(5)]


def test_state_of_a_key_is_bounded():
    _, held = K.let_through(np.arange(100_000), [], 5, 90_000)
    assert len(held) <= 5


def files(spark, df, folder, n, first=0, of=None):
    """df in order of time as n files."""
    rows = df.orderBy("ts").toPandas()
    times = {c: "Int64" if t == "bigint" else "datetime64[us]" for c, t in df.dtypes if t == "bigint" or t.startswith("timestamp")}
    edges = np.linspace(0, len(rows), (of or n) + 1).astype(int)
    for k in range(n):
        part = rows.iloc[edges[first + k] : edges[first + k + 1]].astype(times)
        part.to_parquet(f"{folder}/{first + k:03d}.parquet", index=False)


def play(spark, folder, of, flow, schema, out, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    flow(of(stream)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def events(spark):
    K.with_state_store(spark)
    return spark.read.parquet(f"{SF}/events.parquet").where("event_id < 2500").cache()


@pytest.mark.parametrize("n", [1, 3, 10])
def test_streams_give_the_batch_in_any_number_of_micro_batches(spark, events, tmp_path, n):
    folder = tmp_path / "in"
    folder.mkdir()
    files(spark, events, folder, n)
    want = K.rate_limit(services.hits(events).drop("ts"), "client", "at", "event_id")
    got = play(spark, folder, services.hits, K.rate_limit_stream, events.schema, str(tmp_path / "a"), str(tmp_path / "ac"))
    assert counted(got.select("event_id", "client", "admitted")) == counted(want.select("event_id", "client", "admitted"))
    assert want.where("NOT admitted").count() > 5
    ttl = 86_400_000_000 // 2
    newest = services.touches(events).agg(F.max("at")).first()[0]
    ended = K.sessions(services.touches(events), "sid", "at", ttl).where(F.col("expired_at") < newest)
    got = play(spark, folder, services.touches, lambda t: K.session_stream(t, ttl=ttl), events.schema, str(tmp_path / "b"), str(tmp_path / "bc"))
    assert counted(got.select("sid", "started_at", "expired_at", "touches")) == counted(ended.select("sid", "started_at", "expired_at", "touches"))
    assert ended.count() > 100


def test_a_restarted_stream_knows_its_state(spark, events, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for first in (0, 3):
        files(spark, events, folder, 3, first, of=6)
        a = play(spark, folder, services.hits, K.rate_limit_stream, events.schema, str(tmp_path / "a"), str(tmp_path / "ac"))
    want = K.rate_limit(services.hits(events).drop("ts"), "client", "at", "event_id")
    assert counted(a.select("event_id", "admitted")) == counted(want.select("event_id", "admitted"))


def test_sessions_touch_their_end(spark):
    rows = [("a", 0), ("a", 100), ("a", 201), ("a", 301), ("b", 5), ("b", 5)]
    got = K.sessions(spark.createDataFrame(rows, "sid string, at bigint"), "sid", "at", 100)
    assert counted(got) == {("a", 0, 200, 2): 1, ("a", 201, 401, 2): 1, ("b", 5, 105, 2): 1}


@pytest.mark.parametrize("n", [1, 4])
def test_no_edit_is_lost(spark, events, tmp_path, n):
    edited = services.edited(events).withColumn("ts", F.col("at"))
    folder = tmp_path / "in"
    folder.mkdir()
    files(spark, edited, folder, n)
    schema = spark.read.parquet(str(folder)).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    over = services.overrides(spark)
    run = lambda: D.edits_into(stream().withColumn("at", F.col("at").cast("timestamp")).withColumn("period_start", F.col("period_start").cast("date")), over, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run()
    # after a restart: a retry of a known edit, and one that is older than the horizon
    newest = edited.orderBy(F.col("at").desc()).first()
    more = spark.createDataFrame([(newest["edit_id"], newest["period_start"], newest["at"], newest["at"]), (-1, newest["period_start"], dt.datetime(2023, 12, 1), dt.datetime(2023, 12, 1)), (None, newest["period_start"], newest["at"], newest["at"])], "edit_id bigint, period_start date, at timestamp, ts timestamp")
    files(spark, more, folder, 1, 0)
    (folder / "000.parquet").rename(folder / "last.parquet")
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    by = dict(got.groupBy(F.coalesce("reason", F.lit("accepted"))).count().collect())
    assert got.count() == edited.count() + 3
    want = dict(D.first_of_each(D.judged(edited, over)).groupBy(F.coalesce("reason", F.lit("accepted"))).count().collect())
    assert by == {**want, "duplicate": want["duplicate"] + 1, "late": 1, "accepted": want["accepted"] + 1}


def test_sessions_of_a_stream_call_no_python_by_key(spark, tmp_path):
    K.with_state_store(spark)
    at = F.col("at")
    rows = spark.createDataFrame([("a", 0), ("a", 100), ("a", 201), ("b", 5), ("b", 5), ("c", 300_000), ("d", 299_900), ("e", 298_000)], "sid string, at bigint")
    rows.withColumn("ts", F.timestamp_micros(at)).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "sid string, at bigint, ts timestamp"
    flow = lambda t: K.session_stream(t, ttl=100)
    plan = flow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    assert "InPandas" not in plan and "session_window" in plan
    got = play(spark, str(tmp_path / "in"), lambda t: t, flow, schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    # a touch at the end moves it; what ends at the newest touch or later is open
    assert counted(got.select("sid", "started_at", "expired_at", "touches")) == {("a", 0, 200, 2): 1, ("a", 201, 301, 1): 1, ("b", 5, 105, 2): 1, ("e", 298_000, 298_100, 1): 1}
