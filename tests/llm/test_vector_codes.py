"""Member-resident Lloyd against plain loops; ties, repeats, odd vectors; what moves."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import vector_codes as C

SCHEMA = "vec_id long, embedding array<double>, label int"


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, parts=16, entries=64, rounds=2):
    """{(vec_id, vector): (code, error)} and the codebooks, in Python's integers."""
    kept = sorted((r for r in rows if usable(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) if kept else 0
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in kept if len(v) == width]
    cut = C.edges(width, parts)
    cuts = list(zip(cut, cut[1:]))
    books = [[v[a:b] for _, v in kept[:entries]] for a, b in cuts]

    def choose(p, x):
        return min((sum((s - t) ** 2 for s, t in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p, (a, b) in enumerate(cuts):
            of = {}
            for _, v in kept:
                of.setdefault(choose(p, v[a:b])[1], []).append(v[a:b])
            new.append([[sum(c) // len(of[e]) for c in zip(*of[e])] if e in of else old for e, old in enumerate(books[p])])
        books = new
    out = []
    for i, v in kept:
        found = [choose(p, v[a:b]) for p, (a, b) in enumerate(cuts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    books = C.fit(df, **more)
    coded = C.encode(df, books)
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"]) for r in coded.collect()), books, coded


def same(spark, rows, **more):
    got, books, coded = run(spark, rows, **more)
    want, plain = brute(rows, **more)
    assert sorted(got, key=str) == sorted(((i is None, i or 0, c, e if e < 2**63 else None) for i, c, e in want), key=str)
    assert [e.tolist() for e in books.entries] == plain or not want
    return books, coded


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(9, 32)) / 3
    out = [(int(i), [float(np.float32(x)) for x in centre[i % 9] + 0.15 * rng.normal(size=32)], int(i % 4) if i % 5 else None) for i in rng.permutation(600)]
    return out + [(900 + i, out[3][1], 7) for i in range(200)]  # a third of all rows is one vector


def test_codes_equal_plain_loops(spark, rows):
    books, coded = same(spark, rows)
    assert books.sha256() == hashlib.sha256(",".join(str(x) for e in books.entries for r in e.tolist() for x in r).encode()).hexdigest()
    total = C.with_group_total(coded, F.col("label"))
    want = {}
    for r in coded.collect():
        want[r["label"]] = want.get(r["label"], 0) + r["error"]
    assert {r["label"]: r["label_error"] for r in total.collect()} == want and total.count() == coded.count()


def test_other_sizes_and_rounds(spark, rows):
    for more in ({"parts": 5, "entries": 3, "rounds": 4}, {"parts": 40, "entries": 10, "rounds": 1}, {"parts": 2, "entries": 7, "rounds": 3}, {"parts": 4, "entries": 4, "rounds": 0}):
        same(spark, rows[:150], **more)


def test_odd_vectors_ties_and_repeats(spark):
    bad = [(1, None, 1), (2, [], 1), (3, [0.1, None, 0.2, 0.3], 1), (4, [float("nan")] * 4, 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1)]
    good = [(10, [0.5, -0.001, 0.0, 1.0], None), (10, [0.25, 0.0, 0.0, 1.0], None), (11, [0.5, -0.001, 0.0, 1.0], 3), (None, [0.5, 0.5, 0.5, 0.5], 3), (12, [1.0, 2.0], 3), (13, [-1e-9, 0.25, 0.0, 0.0], 2)]
    for entries in (2, 64):
        books, coded = same(spark, bad + good, parts=2, entries=entries, rounds=2)
        assert {r["vec_id"] for r in coded.collect()} == {10, 11, 13, None}
    none = spark.createDataFrame(bad, SCHEMA)
    books = C.fit(none)
    assert C.encode(none, books).count() == 0 and C.encode(none.where("false"), books).count() == 0
    assert C.with_group_total(C.encode(none, books), F.col("label")).count() == 0


def test_numbers_beyond_double_precision(spark):
    rows = [(i, [float(2**30 + i), -float(2**28) * i, 1.0 / 256, 0.0], 0) for i in range(8)]
    same(spark, rows, parts=2, entries=3, rounds=2)


def test_columns_with_clashing_names(spark, rows):
    df = spark.createDataFrame(rows[:80], SCHEMA).withColumns({"code": F.lit("clash"), "Error": F.lit("clash"), "entry": F.lit(1), "a.b": F.lit(2)})
    out = C.encode(df, C.fit(df))
    assert out.columns == ["vec_id", "label", "entry", "a.b", "code", "error"] and out.count() == 80


def test_members_live_with_one_owner_and_only_those_that_change_entry_move(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    books = C.initial(df, "vec_id", "embedding", 64, 16, 256)
    residents = C.members(df, "embedding", books, 256, 8).cache()
    assert residents.agg(F.sum("n")).first()[0] == 16 * len(rows)
    # a member is there once, and all members of an owner lie in one task
    assert residents.groupBy("position", "part").count().where("count > 1").count() == 0
    owner = residents.withColumn("task", F.spark_partition_id()).groupBy("position", "entry", "salt").agg(F.countDistinct("task").alias("n"))
    assert owner.where("n > 1").count() == 0
    books = C.updated(books, residents)
    chosen = C.reassigned(residents, books).cache()
    moved = chosen.where("to <> entry").count()
    assert 0 < moved < chosen.count() / 2
    plan = C.migrated(chosen)._jdf.queryExecution().optimizedPlan().toString()
    union = plan.index("Union")
    assert plan.count("RepartitionByExpression") == 1 and plan.index("RepartitionByExpression") > union
    assert C.migrated(chosen).agg(F.sum("n")).first()[0] == 16 * len(rows)
    residents.unpersist(), chosen.unpersist()


def test_a_hot_entry_has_many_owners(spark):
    """All vectors near one entry: its members are dealt to all salts."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (5.0 if i < 63 else 0.0) * np.eye(8)[i % 8] + 0.05 * rng.normal(size=8)], 0) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    residents = C.members(df, "embedding", C.initial(df, "vec_id", "embedding", 64, 4, 256), 256, 16)
    hot = residents.groupBy("position", "entry").agg(F.countDistinct("salt").alias("salts"), F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc()).first()
    assert hot["n"] > 60 and hot["salts"] == 16
