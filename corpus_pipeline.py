"""A corpus cleaned and packed: the stages, each written and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), works on all
rows of ``docs``, the documents that the stage before kept, and returns a DataFrame: the
kept documents with the columns of ``documents``, and in the last stage the packing.
``run`` applies them to the table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontaminate, line_dedup, packing, simhash, toxicity
from spindrift.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the others stay as they are.

    The model is fitted on labelled rows of ``docs``.  Null and empty texts and rows without
    doc_id are judged like any other, so null and empty texts stay; repeated rows stay or go
    together.  Without documents, or without labels of both classes, nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has go, and documents that only had such.

    Null and empty texts and rows without doc_id stay as they are; repeated rows lose the
    same lines.
    """
    return line_dedup.cleaned(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays.

    Documents without words and rows without doc_id stay; rows that repeat a doc_id stay or
    go together.
    """
    copies = simhash.near_duplicates(docs).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go.

    Null and empty texts stay; rows without doc_id and repeated rows are judged each.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token of every document goes: (doc_id, piece, start, length, bin).

    Null and empty texts have no row; rows without doc_id and repeated rows are packed each;
    an empty table gives no row.
    """
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The toxicity model, SimHash and the packing can't be written in SQL; tests hold them
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
