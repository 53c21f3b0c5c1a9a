"""A training corpus from documents, in stages; each stage calls one operator of treelake.llm.

A stage takes (spark, docs, sf_dir) and works on all its predecessor kept: its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents,
and those only by name and type: further columns, whatever their names, go through unread.

Defined cases: a null or empty text is clean, has no near copy and no secret, counts no tokens in
mixing (which takes nothing of a source without tokens) and encodes to no tokens. A null id is
never learned from and never a near copy; of repeated ids one row stays (the least text). A null
source is a source of its own. Equal documents get equal decisions, but for near copies, of which
the least id stays. Texts are read whole, and an empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm import bpe, jaccard, mixing, secrets, toxicity
from treelake.llm._spark import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject; learned from all labels."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: F.lit(True))
    return toxicity.keep_clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 of their five-word shingles, the one with the least id."""
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature-mixed weights of their sources take them, within the corpus's own budget of tokens."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document."""
    return bpe.encode(docs, carry=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage is a trained model, which SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
