"""A training corpus from `documents`: language, quality, near duplicates, contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the
columns of `docs`; the last returns token digests. `run` writes every stage's
result as Parquet to the shared folder, reads it again for the next, and then
deletes the one before.

Decisions: texts without a recognisable language go; texts that the ordinal
model doesn't give the highest grade go; of each group of near duplicates
(five-word shingles, similarity 0.8) the smallest id stays; documents with at
least a twentieth of their words inside benchmark windows go. Models are fitted
on the documents that a stage gets. Stages that judge by text (language,
quality, tokens) judge each row by itself; those that decide by id drop all
rows of an id. Rows without an id are judged by their text and are kept by
stages that decide by id. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.llm import bpe, decontaminate, jaccard_join, language_id, quality
from shutterloom.llm.common import Tables, table

#: Share of the best language below which a text counts as none.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language with a score of LEAST_LANGUAGE_SCORE or more; null, empty and letterless texts go. Without any labelled text no language is known, and all rows go."""
    judged = docs.withColumn("_p", language_id.predict(spark, language_id.learned(docs), F.col("text")))
    return judged.filter((F.col("_p.lang") != "und") & (F.col("_p.score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality_grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model of `labels` gives the highest grade with a probability of a half or more; null and empty texts are rated by their form. Without labels that is a half for each, and all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.grade_of_labels())
    judged = docs.withColumn("_r", quality.rate(spark, model, F.col("text")))
    return judged.filter(F.col("_r.tail") >= quality.SELECT_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the smallest id of their group; texts without words are in no group. Where an id has several rows it goes if one of them is another's duplicate."""
    classes = jaccard_join.near_duplicates(docs, rule=jaccard_join.NEAR)
    dropped = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words stands in `benchmark`; an id goes if one of its rows is contaminated. Texts without words, and all where `benchmark` is empty, stay."""
    judged = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    dropped = judged.filter("contaminated").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row its id, the number of tokens, and digests of the ids and of the text decoded from them; null and empty texts have none."""
    done = bpe.round_trip(docs)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("quality", quality_grade),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can't express the trained models and the tokenizer; tests/llm/test_cases.py holds all stages and `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over `documents`."""
    tables = Tables(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
        if before:
            tables.drop(before)
        before = name
    return docs
