"""The corpus pipeline: documents in, encoded training rows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import graph, langid, lines, mixing, pieces, simhash
from quillspark.llm.queries import WEIGHTS, piece_model

#: Rows that go to a Python worker at once: it holds a batch whole, and texts may be long.
BATCH_ROWS = 250
#: Rows that a task reads at once: their texts are one array.
READ_ROWS = 512
#: Words that a Python worker remembers while it encodes; workers live on beside the stages that follow.
WORDS = 60_000
#: Share of the tokens that reach the mixing stage which it hands on.
TOKEN_SHARE = 0.9


def _in_small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session's readers and Python workers, unless they are smaller already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; null texts and texts without a letter go."""
    _in_small_batches(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their copied lines; those of which nothing stays go."""
    _in_small_batches(spark)
    return lines.dedup_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    _in_small_batches(spark)
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected so that domains, languages and sources meet their weights; none twice."""
    _in_small_batches(spark)
    return mixing.mix_documents(docs, WEIGHTS, TOKEN_SHARE, max_epochs=1, seed=42)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number."""
    _in_small_batches(spark)
    coded = pieces.encode_documents(docs, piece_model(), words=WORDS)
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").cast("bigint").alias("n_tokens"), "piece_ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("mix_sources", mix_sources), ("encode", encode)]
#: The stages learn a model, link near copies and encode: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table.

    Each stage but the last runs once: its rows are written to the shared
    folder and read back, and what it had read or written besides is deleted
    then.  The rows of the last but one stay for the result, which reads them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = graph.written_so_far()
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        mine = graph.written_so_far() - before
        docs = graph.written(made, [])
        graph.drop_written(spark, mine)
    return STAGES[-1][1](spark, docs, sf_dir)
