"""Five stages that turn ``documents`` into token files.

Each stage works on all rows that the one before it kept; all but the last return
the columns of documents. Stages are written as Parquet and read again, so each
starts from files and not from the lineage of the ones before.
"""

from __future__ import annotations

from colsense.llm import decontaminate, mixing, near_dup, quality_rules, token_store
from colsense.llm.common import staged, table


def quality(spark, docs, sf_dir):
    """Documents that the weighted quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group with 5-word shingles that are similar to 0.80 or more stays: the one with the smallest doc_id."""
    return near_dup.keep_one(docs, shingle=5, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents with a 10-word window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Sources come to their target weights; a document that is taken twice is two rows."""
    return mixing.take(docs)


def tokens(spark, docs, sf_dir):
    """Token ids go to a content-addressed store; a row for each document, as read back from it."""
    return token_store.round_trip(docs)


STAGES = [("quality_rules", quality), ("near_dup", near_duplicates), ("decontaminate", decontamination), ("mixing", mix), ("token_store", tokens)]

#: The tokenizer's ids and the estimated rule accuracies are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
