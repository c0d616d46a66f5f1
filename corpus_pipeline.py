"""Corpus pipeline: documents in, packed training sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import keep, load
from assayer.llm.decontaminate import drop_contaminated
from assayer.llm.packing import pack
from assayer.llm.quality import select_documents
from assayer.llm.queries import tokenizer_path
from assayer.llm.simhash import one_of_each
from assayer.llm.suffix_dedup import removed_spans


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects.

    Null, empty and wordless texts are never selected; repeated rows share their fate; without labels of both kinds all other
    rows stay; rows without an id are selected by their text's weight like any other.
    """
    return select_documents(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints: the one with the smallest id.

    Groups go by text alone, so rows that share an id, or have none, are each judged by their own text; rows without an id
    stay only where a group has no other; of rows equal in id and text one stays.
    """
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too; n_chars, if there, is counted again.

    All rows stay, null texts as empty ones; rows that share an id never remove each other; rows without an id count as
    smaller than all others.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    private = {c: f"_passage_{k}" for k, c in enumerate(carried)}
    out = removed_spans(docs.withColumnsRenamed(private), with_text=True, carry=tuple(private.values()))
    text = F.col("kept")
    back = {"doc_id": F.col("doc_id"), "text": text, **{c: F.col(p) for c, p in private.items()}}
    if "n_chars" in private:
        back["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*(back[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Each row is judged by its own text, whatever its id; null and empty texts hold none; an empty benchmark drops nothing.
    """
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; null and empty texts are one piece of their end token."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No single SQL statement expresses these stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
