"""From raw documents to packed training sequences; each stage calls one training-data operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last keep the columns of ``documents``:

1. toxicity: rows that the classifier chain marks as toxic go.
2. language_id: rows whose language is rejected (no letter, or below the calibrated bound) go.
3. ngram_join: of each group of near-duplicate documents one stays, the one with the smallest id.
4. source_mixing: rows are repeated or cut so that sources meet their target weights.
5. best_fit_packing: rows become pieces placed in sequences of at most 2048 tokens.

Rows with null columns, empty or very long texts and repeated rows go through by the rules of each
stage's operator; an empty table gives an empty one. Columns besides those of ``documents`` are kept up
to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborspark.llm import best_fit_packing, language_id, ngram_join, source_mixing, toxicity
from arborspark.llm.common import given, materialize, set_aside


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table, names = set_aside(docs, "doc_id", "text")
    model = toxicity.fit(table.select("doc_id", "text"), toxicity.label_table(spark, sf_dir))
    return given(toxicity.score(table, model).where("not is_toxic"), names, docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table, names = set_aside(docs, "doc_id", "text", "lang")
    return given(language_id.predict(table, language_id.fit(table)).where("not rejected"), names, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", keep_clean),
    ("language_id", keep_known_languages),
    ("ngram_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and hashed candidate search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
