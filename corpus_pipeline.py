"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

toxicity           documents that the classifier rejects go
ngram_jaccard_join one document of each group of near duplicates stays, the one with the smallest id; near is
                   what it is for op5: 85 % of the distinct runs of 4 words in common, not 80 % of runs of 5
substring_dedup    words of passages that repeat are cut out of the texts
decontamination    documents with too large a share of benchmark words go
packing            what is left is packed into sequences of at most 1024 tokens

Stages keep the columns of documents; ``n_chars`` follows the text. A null text passes through all of
them and is packed as an end mark. Each stage reads what it needs besides the documents from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm import decontaminate, ngram_join, packing, substring_dedup, toxicity
from corpusfold.llm.columns import row_key, table
from corpusfold.session import stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    scored = toxicity.score(docs, toxicity.train(docs, labels), name=name)
    return scored.where(F.col(name) < 0.5).drop(name)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(docs).where("n_removed > 0").select("key", "kept_text").dropDuplicates(["key"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key("doc_id", "text").alias("key"))
    new = {
        "text": F.coalesce(F.col("kept_text"), F.col("row.text")),
        "n_chars": F.coalesce(F.length("kept_text").cast("long"), F.col("row.n_chars")),
    }
    return rows.join(cut, "key", "left").select(*[new.get(c, F.col(f"row.`{c}`")).cast(kind).alias(c) for c, kind in docs.dtypes])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.PackOptions(public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# a classifier and a linear program have no SQL; tests compare each stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
