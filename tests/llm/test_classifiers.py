"""Language, quality and toxicity: held-out accuracy on the driver's tables, and odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tapewright.llm import langid, quality, toxicity
from tapewright.llm.common import table
from tapewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def held_out(spark, name, label):
    out = QUERIES[name](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    return auc(out["score"].to_numpy(), out[label].to_numpy()), out


def test_quality_ranks_held_out_documents(spark):
    got, out = held_out(spark, "op2_quality_ranker", "quality")
    assert got > 0.97
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()


def test_toxicity_finds_held_out_documents(spark):
    got, out = held_out(spark, "op5_toxicity", "toxic")
    assert got > 0.9
    assert ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()


def test_language_of_held_out_documents(spark):
    out = QUERIES["op7_language_mixture"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95


def test_mixture_finds_both_languages(spark):
    en, de = "the cat and the dog are here with that house and this ", "der hund und die katze sind nicht mit dem haus auf das "
    docs = spark.createDataFrame([(en * 3, "en"), (de * 3, "de")], "text string, lang string")
    model = langid.fit(docs, "text", "lang")
    p = model.proportions(pa.array([en * 10 + de * 10, en * 10, None, "123 !"]))
    assert (p[0] > 0.3).all() and abs(p[0].sum() - 1) < 1e-6
    assert p[1].max() > 0.99 and not p[2:].any()


def test_unseen_misspelling_shares_n_grams():
    rng = np.random.default_rng(0)
    plain = ["green", "table", "river", "cloud", "stone", "music", "paper", "light"]
    say = lambda bad: " ".join(rng.permutation([*rng.choice(plain, 20), *bad]))
    texts = [say(["stupidity"]) if i % 3 == 0 else say(["stupendo"]) if i % 3 == 1 else say([]) for i in range(120)]
    y = np.array([1 if i % 3 == 0 else 0 for i in range(120)])
    model = toxicity.fit_texts(pa.array(texts), y)
    s = model.score(pa.array([say(["stupiditty"]), say(["stupendo"]), say([]), "", None]))
    assert s[0] > 0.5 > s[1:].max()


@pytest.mark.parametrize("fitted", [True, False])
def test_odd_rows_are_kept_one_for_one(spark, odd, empty, fitted):
    docs = odd if fitted else empty
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (6, 1, 1), (3, None, None), (None, 1, 1)] if fitted else [], "doc_id long, quality int, toxic int")
    models = [(quality, quality.fit(docs, labels, "doc_id", "text", "quality")), (toxicity, toxicity.fit(docs, labels, "doc_id", "text", "toxic")), (langid, langid.fit(docs, "text", "lang"))]
    for module, model in models:
        out = module.predict(odd, model).toPandas()
        assert len(out) == odd.count() and out["score"].between(0, 1).all()
        assert "Score" not in out.columns and "source" in out.columns
        assert module.predict(empty, model).count() == 0
    langs = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, models[2][1]).collect()}
    assert [langs[i] for i in (2, 3, 4, 5)] == ["und"] * 4
    if not fitted:
        assert set(langs.values()) == {"und"}
