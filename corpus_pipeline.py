"""The corpus pipeline: documents through five of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, so each works on what the stage before it kept:

1. quality: rows that the quality classifier (9) rejects go;
2. near_duplicates: of each group of the n-gram Jaccard join (5) the row with the smallest id stays;
3. repeated_passages: substring dedup (7) cuts repeated passages out of the texts;
4. decontamination: rows that hold a benchmark passage (10) go;
5. encoding: BPE ids (8), as digests.

``run`` writes each stage's rows as Parquet in a folder of its own in the shared checkpoint folder
and reads them again, so a lost executor never reaches back beyond one stage; a stage's folder goes
when the next one is written, its operators' checkpoints with it, and the last one's is the result. Rows without an id go by
their text in stages 2 and 4 and are left whole by stage 3; of rows that repeat an id and text one
passes stage 2. Empty documents give an empty result; more columns, whatever their names, pass to the
last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.llm import bpe, common, decontaminate, ngram_join, quality_knn, substring_dedup
from revcast.session import delete_folder, ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_knn.train(docs, common.table(spark, sf_dir, "labels"))
    score = common.free_name(docs, "quality_score")
    return quality_knn.scored(docs, model, score).filter(F.col(score) >= quality_knn.KEEP_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The classifier's vectors and the encoder's merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with common.consumed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
