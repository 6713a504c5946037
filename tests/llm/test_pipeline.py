"""The pipeline on the smallest tables, stage by stage against what each must hold to."""

from __future__ import annotations

import random

import corpus_pipeline as C
from pyspark.sql import functions as F

from tests.llm.test_neardup import components

SF = "/root/testdata/sf0.001"


def test_stages_and_their_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != C.STAGES[-1][0]:
            assert docs.columns == before.columns
    language, clean, dedup = (kept[n].toPandas() for n in ("language_id", "toxicity", "near_dedup"))
    assert len(language) == 200
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").toPandas()["doc_id"]
    assert len(set(clean["doc_id"]) & set(labels)) <= 0.1 * len(labels) and len(clean) >= 0.75 * len(language)
    clean = clean.sort_values("doc_id").reset_index(drop=True)
    firsts = set(clean["doc_id"][sorted(set(components(clean["text"].tolist(), 0.8)))])
    assert set(dedup["doc_id"]) == firsts and len(dedup) == len(firsts)
    mixed = kept["mix_sources"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed <= 2
    packed = kept["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == kept["mix_sources"].select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).where("n > 2048 or n <> e").count() == 0


def test_language_stage_keeps_all_where_no_language_is_named(spark):
    docs = spark.sql("select * from values (1L, 'some plain words', cast(null as string), 'a'), (2L, null, null, 'b') t(doc_id, text, lang, source)")
    assert C.language(spark, docs, SF).count() == 2
    named = spark.sql("select * from values (1L, 'some plain words', 'en', 'a'), (2L, null, 'en', 'b'), (3L, '123 456', null, null) t(doc_id, text, lang, source)")
    assert [r["doc_id"] for r in C.language(spark, named, SF).collect()] == [1]


def test_language_stage_rejects_what_is_in_no_learnt_language(spark):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(40)) for _ in range(5)]
    noise += ["to jest zupełnie inny język i model nie zna żadnego z tych słów", "здесь нет ни одного знакомого слова"]
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    kept = C.language(spark, docs.unionByName(odd, allowMissingColumns=True), SF)
    assert kept.where("doc_id < 0").count() == 0 and kept.count() == docs.count()
