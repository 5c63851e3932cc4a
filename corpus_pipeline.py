"""The corpus pipeline: documents pass five stages, each one an operator of ``rankflow.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame that
``run`` writes as Parquet to the shared work folder and reads again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import bpe_codec, decontaminate, pii, simhash, toxicity
from rankflow.llm.arrowtext import fresh
from rankflow.llm.queries import BYTE_BPE
from rankflow.llm.queries import QUERIES as OPERATOR_QUERIES
from rankflow.session import ship_package, work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: whole texts go to Python workers in batches of so many rows; some MB, on top of an executor's heap
BATCH_ROWS = "1000"


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance, calibrated on the labelled ones, scores under 0.3."""
    _ready(spark)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return toxicity.scored(docs, model, score).where(F.col(score) < 0.3).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    _ready(spark)
    return simhash.keep_first(docs, shingle=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark share of a twentieth of their words."""
    _ready(spark)
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars follows the text."""
    _ready(spark)
    masked = pii.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", length)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    _ready(spark)
    done = bpe_codec.round_trip(docs, BYTE_BPE)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_contaminated),
          ("pii", mask_personal_data), ("bpe", encode)]

#: dictionaries, SimHash and byte-pair merges are beyond SQL: tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages."""
    folder = work_dir(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


QUERIES = {**OPERATOR_QUERIES, "pipeline": (run, ORACLE_SQL)}
