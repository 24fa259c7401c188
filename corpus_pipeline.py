"""A training corpus from raw documents, stage by stage.

``STAGES`` lists (name, function).  Each function takes (spark, docs, sf_dir),
works on all documents that the stage before it kept and returns a DataFrame
with the columns of ``docs``, except the last, which returns packed token ids.
Columns other than doc_id, text and source are carried along unread, whatever
their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from symgrove.llm import decontam, mixing, oddsketch, packing, quality
from symgrove.llm.runtime import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    A null or empty text has no n-grams and is judged by importance 0; rows that
    repeat an id are judged together, by the worst of them; rows with a null id
    stay.  Without labels of both kinds, and of an empty table, nothing goes.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each near-duplicate group.

    Rows with a null id, a null text or a text without words stay.  Rows that
    repeat an id are one document, which stays or goes with all its rows.
    """
    return oddsketch.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Rows with a null id or text stay.  An id goes with all its rows if one of
    them holds an item.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents, some of them more than once, so that all sources weigh alike.

    Rows with a null id are left out, since nothing tells them apart.  A null
    source is a source, a null or empty text has size 1.  Rows that repeat an id
    and a text are taken alike.
    """
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, words, block_offsets) of each row; a null or empty text has no ids."""
    return packing.token_blocks(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: No SQL: hashed generative models, odd sketches and byte-pair encoding have no counterpart in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    Between stages the documents are written as Parquet in the checkpoint
    folder, which all executors share, and read again; a table goes as soon as
    the next one is written, and the last one when the JVM ends.
    """
    ensure_checkpoint_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}")
    fs = base.getFileSystem(conf)
    fs.deleteOnExit(base)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = jvm.org.apache.hadoop.fs.Path(base, name)
        stage(spark, docs, sf_dir).write.parquet(path.toString())
        docs = spark.read.parquet(path.toString())
        if before is not None:
            fs.delete(before, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
