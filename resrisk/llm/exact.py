"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import shielded

#: Smallest and largest number of slots of the bitmaps: 2 MB and 32 MB in all.
_LEAST_SLOTS, _MOST_SLOTS = 1 << 24, 1 << 28
#: A group's rows meet its result in at most so many parts.
_PARTS = 64


def _survivors(groups: DataFrame, slot: Column) -> DataFrame:
    """Bitmaps of the slots of the groups that survive, at most 8,192 rows of 4 KB."""
    return groups.select(slot.alias("_slot")).groupBy(
        F.bitmap_bucket_number("_slot").alias("_bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))


def _slots(groups: DataFrame) -> Column:
    """About 16 slots a surviving group, a power of two between the two limits."""
    wanted = F.pow(F.lit(2.0), F.ceil(F.log2(F.count(F.lit(1)) * 16 + 1)))
    return groups.agg(F.least(F.greatest(wanted, F.lit(float(_LEAST_SLOTS))), F.lit(float(_MOST_SLOTS)))
                      .cast("long").alias("_slots")).scalar()


def _grouped(docs: DataFrame, text: str = "text", key: str = "doc_id",
             prefix_chars: int = 256, filter_bits: int | None = None) -> DataFrame:
    """`group_copies` with `_full` besides, the full hash of the text where its group may have two rows."""
    out = ["keep_id", "group_size", "kept"]
    rows = docs.drop(*out).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({
        "_length": F.octet_length("_text"),
        "_prefix": F.xxhash64(F.substring("_text", 1, prefix_chars)),
    })
    # Pass 1: lengths that occur twice, then prefixes that occur twice within such a length.
    by_prefix = rows.groupBy("_length", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    lengths = by_prefix.groupBy("_length").agg(F.sum("_n").alias("_of_length")).filter("_of_length > 1")
    surviving = by_prefix.filter("_n > 1").join(lengths, "_length", "left_semi")
    slots = F.lit(filter_bits).cast("long") if filter_bits else _slots(surviving)
    slot = F.pmod(F.xxhash64("_length", "_prefix"), slots) + 1
    bitmaps = _survivors(surviving, slot)
    # Pass 2: the full hash, of surviving groups only.
    bit = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    tagged = rows.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    tagged = tagged.join(F.broadcast(bitmaps), "_bucket", "left")
    hit = F.col("_bits").isNotNull() & (F.floor(byte.cast("long") / F.pow(F.lit(2), bit % 8)) % 2 == 1)
    tagged = tagged.withColumn("_full", F.when(hit, F.sha2("_text", 256)))
    # A group is counted in parts by its keys; each part that has rows gets the group's result, so
    # that a large group meets it in many tasks and a group of two in two rows at most.
    tagged = tagged.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(_PARTS)))
    parts = tagged.filter(F.col("_full").isNotNull()).groupBy("_full", "_part").agg(
        F.max(key).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = parts.groupBy("_full").agg(
        F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"), F.collect_set("_part").alias("_parts"))
    groups = groups.filter("_size > 1").select(
        F.col("_full").alias("_group"), "_keep", "_size", F.explode("_parts").alias("_part"))
    # Rows without a full hash get a join key of their own, so that they do not meet in one task.
    alone = F.concat(F.lit("row "), F.coalesce(F.col(key).cast("string"), F.col("_prefix").cast("string")))
    found = tagged.withColumn("_group", F.coalesce("_full", alone)).join(groups, ["_group", "_part"], "left")
    return found.withColumns({
        "keep_id": F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col(key)),
        "group_size": F.coalesce("_size", F.lit(1).cast("long")),
    }).withColumn("kept", F.col(key).eqNullSafe(F.col("keep_id"))).select(
        *[c for c in docs.columns if c not in out], *out, "_full")


@shielded
def group_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Every row of `docs` with `keep_id`, `group_size` and `kept`.

    Rows are grouped by length and prefix hash first. Only rows of groups with two rows or more
    have their whole text hashed (SHA-256): a bitmap of the surviving groups tells them apart
    where the text is read, so that no text is moved. It has 16 slots a surviving group, from 2 MB
    up to 32 MB; beyond 16 million groups more rows are hit falsely. A false hit costs one hash
    and changes nothing. Groups are counted with partial aggregates, so a group of a third of all
    rows is a few rows per task, and its rows meet its result in up to 64 parts.

    A null text counts as empty. Of equal texts the row with the largest key stays; a null key
    is smaller than any other. Rows that repeat both key and text are one document and are
    marked alike; `drop_copies` keeps one of them. Input columns called as the three results are
    replaced. An empty table gives an empty one. Options: `prefix_chars` and `filter_bits`.
    """
    return _grouped(docs, text, key, **options).drop("_full")


@shielded
def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row of each group of equal texts, with the columns of `docs`.

    Different texts stay apart where their groups keep the same key or none. Options as in
    `group_copies`.
    """
    marked = docs.withColumn("_clash_free", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    marked = marked.select(F.col(key).alias("_key"), F.col(text).alias("_of"), "_clash_free")
    kept = _grouped(marked, "_of", "_key", **options).filter("kept")
    # A repeated row is in a group of two or more; rows alone in their group need no second look.
    again = kept.filter("group_size > 1").dropDuplicates(["_key", "_full"])
    return kept.filter("group_size = 1").unionByName(again).select("_clash_free.*")
