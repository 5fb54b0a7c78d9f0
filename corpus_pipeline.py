"""The corpus pipeline: quality, exact and near dedup, mixing, packing.

Every stage works on all that its predecessor kept; all but the last return the
columns of documents. STAGES is what a job writes and reads between the stages;
run() applies them one after another and does the same, so that no stage's work is
repeated by a later one; a stage's rows are deleted when the next one's are written. The stages decide by trained models and
hashed schedules that SQL can't express, so there is no oracle; the tests hold them
against plain versions.
"""

from tablewright.llm.common import forget, written
from tablewright.llm.exact_dedup import dedup_documents
from tablewright.llm.mixing import mix_documents
from tablewright.llm.packing import pack
from tablewright.llm.quality import good_documents
from tablewright.llm.simhash import near_dedup_documents

ORACLE_SQL = None


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark, docs, sf_dir):
    """Of equal texts one document stays."""
    return dedup_documents(docs)


def near_stage(spark, docs, sf_dir):
    """Of each group of near duplicates one document stays."""
    return near_dedup_documents(docs)


def mixing_stage(spark, docs, sf_dir):
    """Documents stay, go or repeat as the mix of sources takes them."""
    return mix_documents(docs)


def packing_stage(spark, docs, sf_dir):
    """The places of the documents' pieces in training sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark, sf_dir):
    """STAGES, one after another, over the documents; all but the last are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
