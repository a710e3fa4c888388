"""Corpus preparation: quality rules, line dedup, near-dedup, decontamination, packing.

Defined results of the whole: null, empty and short texts fail the base rule of the first stage and go; rows with a null id
or with an id of others are documents of their own and are told apart by their texts throughout; of rows equal in id and
text, and of near-duplicates, one stays, that with the smallest id, of equal ids that with the smallest text hash; very
long texts are judged, compared and packed whole; an empty table gives no rows; all other columns come along unchanged up
to the last stage, whatever their names, but for n_chars where the line stage has changed a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from calibrium.llm.common import read, shared_table
from calibrium.llm.decontam import without_leaks
from calibrium.llm.linededup import without_repeated_lines
from calibrium.llm.neardup import keep_one_of_each
from calibrium.llm.packing import pack_documents
from calibrium.llm.quality import good_documents


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: a row per piece of each document, placed in a sequence."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", without_leaks),
    ("packing", packed),
]
#: Learnt rules, MinHash and tokens have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each stage's rows written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
