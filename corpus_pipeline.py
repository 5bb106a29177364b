"""Training-data pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage takes all that its predecessor kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from etherloom.llm import bpe, decontaminate, langid, lines, simhash
from etherloom.llm.common import scratch, stash, table
from etherloom.llm.queries import vocabulary

CHUNKS = 100_000  #: results of the encoder that a worker remembers, fewer than its own: it is there beside those of other stages
BATCH = 1000  #: rows of whole texts in a batch that goes to Python, where the session has Spark's own number
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _batches(spark: SparkSession) -> None:
    """Smaller batches, which are held in Spark's native memory and in Python's at once; a number that the session has set stays."""
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    return langid.keep_identified(docs.select(*COLUMNS), langid.fit_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    return lines.drop_frequent_lines(docs.select(*COLUMNS))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    return bpe.digest_documents(docs, vocabulary(), chunks=CHUNKS)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_tokens),
]

#: Language models, fingerprints and tokens are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has read and written besides its rows is deleted once they are written.

    Null and empty texts and those without a letter have no language and go in the first stage; null and repeated ids
    stay, as rows are told apart by text and content. Rows that are equal in all columns go on once. No rows give none.
    """
    docs, own = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark) as paths:
            paths += own
            docs = stash(stage(spark, docs, sf_dir), f"stage{k}")
            own = [paths.pop()]
    return docs
