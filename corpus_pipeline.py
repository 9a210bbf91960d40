"""From documents to packed bins: each stage reads what the one before has written.

Edge cases, for every stage: an empty table gives an empty one; extra columns pass
through all stages but the last, whatever their names; null ids, sources and
languages are values like any other; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import minhash, packing, quality, secrets, toxicity
from driftmark.llm.common import scope, veiled, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Toxicity cannot be written in SQL; the tests hold the other stages against plain Python on what it keeps.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The machine learns from the labels of ``docs``.

    A null or empty text has the score of no words and stays unless the labels say
    that most texts are toxic.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    safe, back = veiled(docs, "doc_id", "text")
    return back(toxicity.score(safe, model).where("predicted = 0"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go, null and blank texts among them."""
    safe, back = veiled(docs, "text")
    return back(quality.quality(safe).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id (null after all others); texts without words stay."""
    return minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, found through the ledger, are cut out of the texts; ``n_chars`` follows where there is a text. No document goes."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in bins; empty texts are placed too, longer ones than a bin in parts."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):  # what a stage has written besides its result goes
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
