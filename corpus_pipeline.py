"""A corpus from raw documents to packed sequences, stage by stage.

Each stage is written to the shared folder and read again as the next one's input. All
but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.llm import language_id
from surveyloom.llm.common import keep_rows, shared_table
from surveyloom.llm.exact_dedup import exact_dedup
from surveyloom.llm.near_join import near_join
from surveyloom.llm.packing import pack
from surveyloom.llm.substring_dedup import substring_dedup

#: A document goes if more than this share of its letters is in scripts that no learned language uses.
UNLEARNED_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those mostly in scripts of which no language was learned.

    How languages mix in a document is no ground: of learned ones all may stay.
    """
    model = language_id.fit(language_id.training_rows(docs))
    judged = language_id.identify(docs, model, keep_row=True)
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("unlearned") <= UNLEARNED_SHARE)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest original stays."""
    return keep_rows(docs, shared_table(exact_dedup(docs).select("doc_id", "text_key", "kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more connect, the one with the least id stays.

    Documents without an id stay if their whole group has none.
    """
    linked = near_join(docs).select("doc_id", "text_key", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
    return keep_rows(docs, shared_table(linked))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out; a text that loses words is its other words joined by one space."""
    cut = substring_dedup(docs, keep_row=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs what is left."""
    return pack(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: The stages learn and tokenise, which SQL can't say; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
