"""Batches of identity merges against one merge after another; chains, faults, versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import merges as G

INHERITED = [("password", "set_at"), ("email",), ("image",)]
CLEARED = ["email", "password", "set_at"]


def forest(rng, n):
    """Merges, each account's own before it goes on, in a random order otherwise."""
    parent = {k: rng.randrange(k) for k in range(1, n) if rng.random() < 0.6}
    left, order = dict(parent), []
    while left:
        k = rng.choice([k for k in left if k not in left.values()])
        order.append((k, left.pop(k)))
    return order


def one_by_one(users, rows, refs, order):
    """The rule by the book: drop the source's rows of keys that the target has, move the rest, pass on what the target lacks."""
    own = {u["user_id"]: u["image"] for u in users}
    users, refs = {u["user_id"]: dict(u) for u in users}, [list(r) for r in refs]
    for source, target in order:
        has = {r[1] for r in rows if r[0] == target and r[1] is not None}
        rows = [r for r in rows if r[0] != source or r[1] not in has]
        rows = [(target, *r[1:]) if r[0] == source else r for r in rows]
        refs = [[i, *(target if c == source else c for c in cs)] for i, *cs in refs]
        s, t = users[source], users[target]
        for group in INHERITED:
            if not t[group[0]] and s[group[0]]:
                t.update({c: s[c] for c in group})
        s.update({c: None for c in CLEARED}, is_active=False)
        t["is_active"] = True
    for source, _ in order:  # a batch leaves a merged account's picture its own, where a merge on the way gives it another's
        users[source]["image"] = own[source]
    return users, rows, refs


@pytest.mark.parametrize("seed", range(4))
def test_a_batch_is_its_merges_one_after_another(spark, seed):
    rng = random.Random(seed)
    n = 14
    users = [{"user_id": k, "is_active": rng.random() < 0.5, "email": rng.choice(["", None, f"e{k}"]), "password": (p := rng.choice([None, f"p{k}"])), "set_at": p and f"at{k}", "image": rng.choice([None, f"i{k}"])} for k in range(n)]
    rows = [(rng.choice([*range(n), None]), rng.choice([1, 2, 3, None]), k) for k in range(60)]
    refs = [(k, rng.choice([*range(n), None]), rng.randrange(n)) for k in range(40)]
    order = forest(rng, n)
    want_users, want_rows, want_refs = one_by_one(users, rows, refs, order)
    df = lambda x, t: spark.createDataFrame(x, t)
    people = df([tuple(u.values()) for u in users], "user_id bigint, is_active boolean, email string, password string, set_at string, image string")
    merges = df([(a, b, k) for k, (a, b) in enumerate(order)], "source bigint, target bigint, position int")
    out = G.merge_batch(people, merges, {"refs": (df(refs, "id int, a bigint, b bigint"), ["a", "b"])}, {"keyed": (df(rows, "user_id bigint, key int, id int"), "user_id", ["key"])}, INHERITED, CLEARED)
    assert {r["user_id"]: r.asDict() for r in out.users.collect()} == want_users
    assert sorted(map(str, (tuple(r) for r in out.tables["keyed"].drop(G.MOVED).collect()))) == sorted(map(str, want_rows))
    assert sorted(map(str, (tuple(r) for r in out.tables["refs"].drop(G.MOVED).collect()))) == sorted(str(tuple(r)) for r in want_refs)
    sources = {a for a, _ in order}
    counts = collections.Counter({"refs.a": sum(r[1] in sources for r in refs), "refs.b": sum(r[2] in sources for r in refs)})
    kept = {r[2] for r in want_rows}
    counts["keyed.user_id"] = sum(r[0] in sources and r[2] in kept for r in rows)
    assert dict(tuple(r) for r in out.moved().collect()) == {k: v for k, v in counts.items() if v}


def test_long_chains_resolve_in_few_rounds(spark):
    n = 200
    merges = spark.createDataFrame([(k, k + 1, k) for k in range(n)], "source bigint, target bigint, position int")
    got = {r["user_id"]: (r["root"], r["path"]) for r in G.resolve(merges, spark.range(n + 1).withColumnRenamed("id", "user_id")).collect()}
    assert got == {k: (n, list(range(n - 1, k - 1, -1))) for k in range(n)}


@pytest.mark.parametrize("merges, said", [([(1, 1)], "itself"), ([(1, 2), (2, 3), (3, 1)], "cycle"), ([(1, 9)], "exist"), ([(9, 1)], "exist"), ([(1, 2), (1, 3)], "twice"), ([(None, 2)], "exist")])
def test_faults_raise(spark, merges, said):
    users = spark.createDataFrame([(k,) for k in range(1, 5)], "user_id bigint")
    with pytest.raises(ValueError, match=said):
        G.resolve(spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(merges)], "source bigint, target bigint, position int"), users)


def test_no_merges_change_nothing(spark):
    none = spark.createDataFrame([], "source bigint, target bigint, position int")
    users = spark.createDataFrame([(1, True)], "user_id bigint, is_active boolean")
    out = G.merge_batch(users, none, {"t": (users, ["user_id"])}, {}, [], [])
    assert out.users.collect() == users.collect() and out.moved().count() == 0


def test_a_version_shows_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "v")
    one = lambda k: spark.range(k).toDF("x")
    G.publish(spark, root, {"a": one(3), "b": one(4)})
    broken = one(5).select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        G.publish(spark, root, {"a": one(9), "b": broken})
    assert (G.current(spark, root, "a").count(), G.current(spark, root, "b").count()) == (3, 4)
    G.publish(spark, root, {"a": one(9), "b": one(1)})
    assert (G.current(spark, root, "a").count(), G.current(spark, root, "b").count()) == (9, 1)
