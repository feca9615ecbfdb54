"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir). All but the last return
the columns of ``docs``. Each works on everything the one before it has kept, and its decisions
take effect. The other tables (labels, benchmark) are read from ``sf_dir``. Null and empty texts are
neither toxic nor contaminated; as near copies of each other (fingerprint zero) one of them stays,
and the mix takes no document without words. Repeated rows are near copies, whole texts of any
length count, and empty tables give no rows.
"""

from pyspark.sql import DataFrame, SparkSession

from pathledger.llm import decontaminate, mixing, pii, simhash, toxicity
from pathledger.session import materialise


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return pii.remove_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents by their repetitions, a partly taken one with the words taken.

    With them the number of the copy and the figures of the mix: size, source_size, target, taken.
    """
    mixed = mixing.repeated(mixing.mix(docs))
    return mixed.select("doc.*", "copy", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
]

# The classifier and the fingerprints have no SQL; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
