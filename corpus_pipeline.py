"""A training corpus from `documents` in five stages; each stage's rows are written and read again by the next.

language ID -> toxicity -> MinHash near-dedup -> mixing sources to target weights -> best-fit packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import langid, mixing, neardup, packing, toxicity
from tapewright.llm.common import stash, table
from tapewright.llm.queries import tokenizer_path


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*like.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, those of which no language has a third, and those that fit every language worse than
    chance (random letters, languages that no row names); where no row names a language, nothing can be learnt and all
    rows stay."""
    model = langid.fit(docs, "text", "lang")
    if not model.languages:
        return docs
    found = langid.predict(docs, model)
    return _as_documents(found.where((F.col("lang_pred") != "und") & (F.col("score") >= 1 / 3) & (F.col("fit") >= 0)), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; null and empty texts are not toxic, and without labels nothing goes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return _as_documents(toxicity.predict(docs, model).where("predicted = 0"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of least doc_id, once however often its row is repeated; texts without a
    word are one class."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it: not at all, once or twice; each file holds rows of one shard of the
    mix, shuffled. A null source is a source, a null text has no words; rows alike are taken one by one."""
    plan = mixing.make_plan(docs)
    return _as_documents(mixing.in_order(mixing.mix(docs, plan), plan), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces and their places, with the number of the mix's file that a document came
    from: no sequence crosses files, so the mix's shards and their make-up last. A null text is its end token alone; a
    document that the mix takes twice is packed twice; no documents make no sequences."""
    number = F.expr(r"coalesce(try_cast(regexp_extract(input_file_name(), 'part-(\\d+)', 1) as int), 0)")
    rows = docs.select("doc_id", "text", number.alias("mix_file"))
    return packing.pack_documents(rows, tokenizer_path(), 2048, within="mix_file")


STAGES = [("language_id", language), ("toxicity", clean), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between them the rows lie as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express none of the trained or randomised stages; tests hold run() against the stages' own brute force.
ORACLE_SQL = None
