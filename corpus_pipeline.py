"""The corpus pipeline: STAGES, applied one after the other to documents."""

from loomgraph.llm import pipeline
from loomgraph.llm.common import table, written

STAGES = [
    ("language_id", pipeline.language_id),
    ("near_dedup", pipeline.near_dedup),
    ("secret_scan", pipeline.secret_scan),
    ("mix", pipeline.mix),
    ("tokenize", pipeline.tokenize),
]

#: Learned and hashed stages are beyond SQL; tests compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
