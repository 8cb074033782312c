"""A training corpus from raw documents: five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and any
further columns of docs, whatever their names. Rows are told apart by a number of their own: repeated rows and ids, null
ids, null, empty and very long texts and empty tables are taken as each stage's docstring or its operator's says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, decontam, line_dedup, similar, toxicity
from factloom.llm.common import BROADCAST_ROWS, broadcast_if_small, keyed, persisted, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages lose all but their first occurrence; n_chars follows. No document goes."""
    return line_dedup.trimmed(docs, lengths="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word similarity of 0.8 or more) the row with the smallest id stays: of equal
    ids one row, and one without an id only where no row of its group has one."""
    return similar.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark passage go, whatever their ids; others that share an id with one stay."""
    each, _ = keyed(docs)
    gone = decontam.contamination(each.select("row", "doc.doc_id", "doc.text"), table(spark, sf_dir, "benchmark"), row="row").where("contaminated").select("row")
    return each.join(broadcast_if_small(gone, gone.count(), BROADCAST_ROWS), "row", "left_anti").select("doc.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can't express the nearest-neighbour scores, MinHash bands or BPE; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
