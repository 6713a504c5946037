"""Operators held against plain loops, and cases of hot copies, repeated ids and hubs."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import langid, mixing, neardup, quality, queries, toxicity
from tapewright.llm.components import connected_components
from tapewright.llm.queries import QUERIES
from tests.oracle import database, difference

DATA = "/root/testdata"


def test_bradley_terry_weights_are_those_of_gradient_descent():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=80) > 0).astype(int)
    model = quality.fit_pairs(x, y, partners=3, ridge=0.05, seed=7)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    good, bad, draw = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(7)
    b_of = draw  # the operator draws better documents' partners last
    better = list(np.repeat(good, 3))
    more = b_of.choice(good, len(bad) * 3)
    worse = list(b_of.choice(bad, len(good) * 3)) + list(np.repeat(bad, 3))
    pairs = list(zip(better + list(more), worse))
    w = np.zeros(4)
    for _ in range(4000):
        g = 0.05 * w
        for a, b in pairs:
            d = z[a] - z[b]
            g = g - d * (1 - 1 / (1 + math.exp(-float(d @ w)))) / len(pairs)
        if np.abs(g).max() < 1e-7:
            break
        w = w - 2.0 * g
    assert np.allclose(w, model.weights, atol=1e-4)
    # the cut is the quantile of the share of label 0
    assert (model.score(x) >= 0.5).sum() == (y == 1).sum()


def grams(text: str) -> list[list[int]]:
    """n-gram buckets of each word, with marks at its ends, by the definition."""
    words, out = [], []
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        if not words or words[-1] != w:
            words.append(w)
    for w in words:
        chars, own = [0, *map(ord, w), 0], []
        for n in toxicity.SIZES:
            for i in range(len(chars) - n + 1):
                h = 0
                for k in range(n):
                    h = ((h ^ chars[i + k]) * 16777619 + k + 1) % 2**32
                h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
                own.append((h ^ (h >> 13)) & (toxicity.BUCKETS - 1))
        out.append(own)
    return out


def test_toxicity_logits_are_those_of_a_loop():
    margins = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    model = toxicity.SubwordSoftmax(margins, 0.3, 1.0, 0.0)
    texts = ["one bad bad word among many others that are said here and there in a text of some length", "Übel, x!", "", "12 34 ab"]
    want = []
    for t in texts:
        words = grams(t)
        bags = [words[i : i + model.bag_words] for i in range(0, len(words), model.hop)] or [[]]
        values = [sum(float(margins[g]) for w in bag for g in w) / (sum(map(len, bag)) + toxicity.PRIOR) for bag in bags]
        want.append(max(values) + 0.3)
    assert np.allclose(model.logits(pa.array(texts)), want, atol=1e-5)


def test_mixture_proportions_are_those_of_a_loop():
    rng = np.random.default_rng(2)
    model = langid.LanguageModel(("a", "b"), np.log(rng.dirichlet(np.ones(langid.BUCKETS), 2).T).astype(np.float32), penalty=0.0, rounds=200)
    # a text of two languages: of many words those that speak most for either, and some that speak for neither
    many = sorted({"".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)})
    g, first, _ = langid.word_grams(pa.array([" ".join(many)]))
    for_a = [float((model.log_p[g[s:e], 0] - model.log_p[g[s:e], 1]).sum()) for s, e in zip(first, [*first[1:], len(g)])]
    order = np.argsort(for_a)
    some = [*order[:18], *order[-32:], *order[240:250]]
    text = " ".join(many[i] for i in some)
    g, first, _ = langid.word_grams(pa.array([text]))
    ends = [*first[1:], len(g)]
    lik = [[math.exp(sum(float(model.log_p[k, j]) for k in g[s:e]) + 40) for j in (0, 1)] for s, e in zip(first, ends)]
    pi = [0.5, 0.5]
    for _ in range(2000):
        new = [0.0, 0.0]
        for one in lik:
            total = pi[0] * one[0] + pi[1] * one[1]
            for j in (0, 1):
                new[j] += pi[j] * one[j] / total / len(lik)
        pi = new
    got = model.proportions(pa.array([text]))[0]
    assert min(pi) > 0.2 and np.allclose(got, pi, atol=0.02)
    assert got.argmax() == int(pi[1] > pi[0])


def test_a_language_of_copies_is_not_missed(spark):
    texts = [(f"palabra {i} de un texto", "es") for i in range(50)] + [("ein und derselbe Satz", "de")] * 4000
    for n in range(3):
        df = spark.createDataFrame([(f"{t} {n}", x) for t, x in texts], "text string, lang string")
        model = langid.fit(df, "text", "lang", per_language=20)
        assert model.languages == ("de", "es") and np.ptp(model.log_p[:, 0]) > 0.5


def test_repeated_ids_give_the_same_model_on_every_run(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} {'bad!! ###' if i % 40 < 20 else 'A plain sentence, with words.'}") for i in range(160)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "doc_id long, quality int")
    a, b = (quality.fit(d, labels, "doc_id", "text", "quality") for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.weights, b.weights)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_source_of_a_mix_meets_its_target(spark, sf):
    """Within half of its largest document, at most twice its size; size, source_size and target as SQL has them."""
    out = QUERIES["op10_source_mix"](spark, f"{DATA}/{sf}").select("doc_id", "size", "source_size", "target", "taken").toPandas()
    sql = duckdb.sql(f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM '{DATA}/{sf}/documents.parquet')
        SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d""").df()
    both = out.merge(sql, on="doc_id", suffixes=("", "_sql"))
    assert len(both) == len(out) and (both["size"] == both["size_sql"]).all() and (both["source_size"] == both["source_size_sql"]).all()
    assert (both["taken"] <= 2 * both["size"]).all()
    for _, g in both.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max() / 2 + 1


def test_leaf_is_filled_towards_its_target():
    sizes = np.array([1000.0, 900.0, 450.0, 400.0, 30.0])
    for left in (0.0, 29.0, 431.0, 880.0, 1299.0, 1500.0, 2780.0):
        got = sizes[mixing.fill(sizes, left)].sum()
        best = min(abs(left - sum(s for k, s in enumerate(sizes) if m >> k & 1)) for m in range(32))
        assert abs(got - left) <= best + 30


def test_components_of_a_hub_a_chain_and_loops(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000), (None, 7), (5001, 5002), (5002, 5001)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1041)} | {5001: 5001, 5002: 5001}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_of_a_hub_are_verified_on_many_keys(spark):
    texts = [(i, "a b c d e f g h i j " + ("x " * (i % 3))) for i in range(60)]
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 60)] + [(3, 4), (4, 5)], "a long, b long")
    df = spark.createDataFrame(texts, "id long, t string")
    one, many = (sorted((r["a"], r["b"], r["j"]) for r in neardup.verify(pairs, df, per_key=n).collect()) for n in (1000, 4))
    assert one == many and len(one) == 61
    dealt = neardup.with_text(pairs, df, "b", 4)
    assert dealt.count() == 61 and dealt.where("tb is null").count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd.select("doc_id", "text", "lang", "source", "n_chars")), ("empty", empty)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (7, 0, 0)] if name == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).toPandas()
        if name == "empty":
            assert len(out) == 0
        else:
            # what has no letter goes; the row that repeats stays once
            assert set(out["doc_id"].dropna()) <= {1, 6, 7, 8} and {6} <= set(out["doc_id"].dropna())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_their_sql(spark, name):
    con = database("sf0.01")
    assert difference(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), con.execute(queries.ORACLES[name]).fetch_df()) == ""
