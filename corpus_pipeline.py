"""The corpus pipeline: each stage works on all that the one before it kept.

run() writes each stage's rows as Parquet in the shared folder and reads them
again, so a lost executor costs no more than the stage at work; what a stage was
given is deleted once the next is written.

Defined results: null and empty texts are scored like any other, are near copies of
each other (one stays, that with the smallest doc_id), hold no benchmark item, and have
no words, so the mix does not take them; very long texts go through whole; of repeated
rows one stays; ties between near copies go to the smallest doc_id, a null one last;
an empty table gives no rows; further columns are carried through all stages but the last,
whatever their names. The mix decides how often a document is taken; the token files are
in ascending doc_id order, so its order takes no effect there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontamination, mixing, simhash, tokens, toxicity
from brindle.llm.queries import tokenizer_path
from brindle.llm.shared import removed, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the model, trained on the labelled rows of documents, does not reject."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The stages hash shingles and fit a model; SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, given = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if given is not None:
            removed(given)
        given = docs
    return docs
