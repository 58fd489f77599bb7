"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared
folder and read again as the next one's docs. All stages but the last return the columns
of ``documents``. A mixed document that is taken several times is several documents of the
same id in the token files.

All stages but the last: an empty table stays empty, columns beyond those of ``documents``
are kept as they are whatever their names, and a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from encore.llm import decontaminate, mixing, neardup, quality, token_files
from encore.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Repeated rows and null ids are scored like any other."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of its smallest id; of repeated rows one. Rows of null id all stay."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Repeated rows go or stay alike; empty texts stay."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Equal ids are taken alike; a null source is a source; empty texts count 0 words."""
    return mixing.emitted(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: a row for each document, in the order of ids, repeated ones by text."""
    import public_tokenizers

    return token_files.token_table(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: The classifier, the near-duplicates and the token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
