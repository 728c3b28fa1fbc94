"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before kept, as they were written, and decides on all of them, row by row:
rows that share a doc_id, or have none, get verdicts of their own. Null texts are empty. The last stage returns the
packing; the others return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattice.llm import near_copies, packing, quality_rules, suffix_dedup, toxicity
from lattice.llm.common import remainder, stored, table

#: Bytes of a string that the suffix-array stage removes wherever it repeats: less than a passage of 50 words has.
REPEAT = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the tagger calls toxic; it learns from the labels outside of the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model, carry=True).where("predicted = 0").select("row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judge(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group stays; groups by op9's fingerprints, and by five-word shingles beyond."""
    return near_copies.representatives(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned_texts(docs, REPEAT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
