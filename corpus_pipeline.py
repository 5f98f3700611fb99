"""From raw documents to packed training sequences in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and
read again as the next stage's docs, so a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resrisk.llm import bagminhash, exact, mixing, packing, quality
from resrisk.llm.registry import MIX_SEED, MIX_WEIGHTS, ids_crc32, table, tokenizer_path
from resrisk.session import drop_written, lean_actions, owning, scratch, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base nor fit a rule learned from `labels`.

    A null or empty text has no words and fails the base; very long texts are read whole; rows
    with equal statistics are decided alike, repeated rows too; an empty table gives an empty one.
    Extra columns pass, whatever their names.
    """
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: that with the largest doc_id.

    A null text counts as empty, a null doc_id is smaller than any other. Rows that repeat doc_id
    and text are one document. Texts of any length are compared whole. An empty table gives an
    empty one; extra columns pass, whatever their names.
    """
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near copies: that with the smallest doc_id.

    Texts without words, null included, are one class. A null doc_id is kept only if its class has
    no other; rows that repeat doc_id and bag of shingles are one document. Long texts are compared
    whole. An empty table gives an empty one; extra columns pass, whatever their names.
    """
    return bagminhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson count says, in a random order.

    A null source is a source of weight 1 as any unnamed one. The text plays no part, so null,
    empty and long ones are alike; repeated rows share their count. An empty table gives an empty
    one; extra columns pass, whatever their names.
    """
    return mixing.poisson_mix(docs, MIX_WEIGHTS, seed=MIX_SEED).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids, placed in sequences.

    A null or empty text is one piece with the end id; a longer one than 1024 ids is cut. Repeated
    rows, as the mixing makes them, are packed each. An empty table gives an empty one; extra
    columns are left out.
    """
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.withColumn("ids_crc32", ids_crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The rules are learned and the signatures hashed: SQL cannot express the stages.
ORACLE_SQL = None


@owning
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`.

    The tables that a stage writes on its way go as soon as its result is stored; what the last
    stage and its input need stays until `session.release`.
    """
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"pipeline-{i}")
        with scratch():
            result = stage(spark, docs, sf_dir)
            with lean_actions(spark):
                result.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before is not None:
            drop_written(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
