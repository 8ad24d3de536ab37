"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, secrets are masked, sources are
mixed to their weights, and what is left is packed into training sequences.

Each stage reads what the one before it has written; ORACLE_SQL is None, because SQL expresses none of the stages whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm import mixing, packing, secrets, simhash, toxicity
from relq.llm.common import free_names, new_folder, table

#: Documents at this chance or above are toxic.
TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents below TOXIC, learned from the labels of those there are. Null and empty texts are not toxic
    where most documents are not; an empty table gives none."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = free_names(docs, "__toxic")
    return toxicity.classify(docs, model, name).where(F.col(name) < TOXIC).drop(name)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as simhash.one_of_each says for repeats, nulls and blanks."""
    return simhash.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span found. n_chars follows where the table has it. Every row and column stays; null texts stay null."""
    (spans,) = free_names(docs, "secret_spans")
    found = secrets.findings(docs, rules=secrets.MASKED, name=spans)
    out = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as mixing.mixed says; documents without words go."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces, as packing.pack says."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
