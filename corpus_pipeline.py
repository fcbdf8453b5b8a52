"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

``STAGES`` lists the stages in order.  Each takes ``(spark, docs, sf_dir)`` and
returns the documents it keeps, with their columns; the last returns the packing.

Rows that share an id or have none are told apart and judged each by its own text.
An empty table stays empty in every stage; extra columns pass through and may have
any name.  Null, empty and blank texts have no letter and go in the first stage; the
others would keep them.  Very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulith.llm.decontaminate import remove_contaminated
from tabulith.llm.language import fit_field, keep_known
from tabulith.llm.near_dup import keep_one
from tabulith.llm.packing import pack
from tabulith.llm.rows import stored, table
from tabulith.llm.secrets import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the field knows; ties between languages go to the first by name."""
    return keep_known(docs, fit_field(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five words, 0.8); of repeated rows one stays."""
    return keep_one(docs, width=5, numer=80, denom=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark passages; items without an id are ignored."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets masked; a null source is one owner."""
    return redact_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of permitted lengths, one row per piece of a document; one without words has one piece in no bin."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the stages; tests/llm/test_stages.py compares each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
