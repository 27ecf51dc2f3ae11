"""A training corpus from the documents table: filter, thin out, decontaminate, mix, write token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns the columns of documents, but for the last one, which returns
what it reads back from the token files.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zealmark.llm.common import packed, prepare, table
from zealmark.llm.decontaminate import drop_contaminated
from zealmark.llm.jaccard_join import keep_one_of_each
from zealmark.llm.mixture import mix_sources
from zealmark.llm.queries import TOKENIZER
from zealmark.llm.token_files import tokenize_corpus
from zealmark.llm.toxicity import drop_toxic, learn_toxicity
from zealmark.session import job_scratch, stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose score reaches the threshold go; the examples are the labelled rows among ``docs``."""
    return drop_toxic(prepare(spark) and docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays: that of the least id."""
    prepare(spark)
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that the mix takes: none, one or two rows each."""
    prepare(spark)
    mixed = mix_sources(packed(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source")))
    copies = F.explode(F.expr("sequence(1, cast(copies as int))"))
    return mixed.where("copies > 0").select("row", copies.alias("copy")).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of what is left, read back."""
    return tokenize_corpus(spark, docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token files", token_files),
]
ORACLE_SQL = None  # the toxicity model and the tokenizer have no SQL; tests/llm holds each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the last stage has written its files when it returns, so what the others staged can go
    with job_scratch(spark):
        for name, apply in STAGES[:-1]:
            docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
