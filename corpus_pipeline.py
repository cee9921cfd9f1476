"""A corpus pipeline of five stages over `documents`.

Quality rules, line deduplication, near-duplicate detection, benchmark decontamination,
BPE encoding. Each stage takes what the one before kept; all but the last return the
columns of `documents`. `run` writes each stage's rows as Parquet to the folder in
spark.checkpoint.dir and reads them again for the next one.

Odd rows in every stage: an empty table gives an empty one; extra columns pass through, whatever their names; repeated
rows are judged alike, so all of them stay or go; a text of any length is taken whole. What null ids, null and
empty texts, and ties mean is stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlens.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from barlens.llm.common import materialize, table


# Words whose encodings a task of the last stage keeps: the stages before have left executors large.
KEPT_WORDS = 120_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the line labeller.

    Null, empty and blank texts have under 50 words and go; a null id is never trained on and judged by its text. Labels
    that tie count as content, a share of exactly one half is kept.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without records that an earlier document has; emptied documents go.

    Earlier is the smaller id. A row without an id stays as it is and is nobody's source; null and empty texts have no
    records and stay. Confirmed copies of a whole document stay for the next stage.
    """
    return line_dedup.drop_recurring(docs, confirm=line_dedup.CONFIRM)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id.

    Rows without an id and texts without words are linked with nothing and stay.
    """
    return near_dedup.deduplicate(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items cover less than one word in twenty.

    Exactly one in twenty goes. Null and empty texts hold no item and stay; null and empty items have no window.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded text.

    A null or empty text has no tokens and decodes to the empty text; a null id stays null.
    """
    return bpe.encode(docs, keep=["lang", "source"], max_words=KEPT_WORDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", token_stage),
]

# SQL can express neither the trained line labeller nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
