"""Corpus pipeline: quality rules, language ID, near-duplicates, packing; each stage works on what the one before it kept."""

from __future__ import annotations

from latticework.llm import langid, near_dup, packing, repetition, shared

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", repetition.clean),
    ("language_id", langid.one_language),
    ("near_duplicates", near_dup.one_of_each),
    ("best_fit_packing", packing.packed),
]

#: The stages fit a model and search a packing, which SQL can't; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each written as Parquet in the shared folder and read again; what the last one made stays, the others' tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            shared.drop(before)
        before = docs
    return docs
