"""Numbered turns of owners: history tables by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siltstone.runtime import settle


def numbered(rows: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_n``, their number within the key by ``order``, from 1.

    Rows are range-partitioned by key and order, so that a key with a third of all rows spans
    many tasks: each part is numbered by itself and begins after the parts before it. Null
    keys are a key; rows equal in all of ``order`` are numbered in any order.
    """
    spread = settle(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = spread.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(F.count("*").alias("_size"))
    before = W.partitionBy("_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))  # a row for each key and part
    own = F.row_number().over(W.partitionBy(key, "_part").orderBy(*order))
    met = spread.withColumn("_own", own).join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return met.withColumn("_n", F.col("_own") + F.col("_before")).drop("_part", "_own", "_key", "_at", "_size", "_before")


def numbered_turns(new: DataFrame, existing: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """``new`` with ``turn_number``, going on from the highest number that ``existing`` has for the key."""
    last = existing.groupBy(key).agg(F.max("turn_number").alias("_last"))
    return numbered(new, key=key, order=order).join(last, key, "left").withColumn("turn_number", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int")).drop("_last", "_n")


def last_turns(turns: DataFrame, *, key: str, order: list[str], texts: dict[str, int], limit: int = 3) -> DataFrame:
    """(key, turns): the last ``limit`` turns of each key, oldest first, as structs of the columns
    of ``texts``, each cut at its number of characters (900 of a question, 1,200 of an answer, say)."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    each = F.struct((-F.col("_r")).alias("_o"), F.struct(*[F.substring(c, 1, n).alias(c) for c, n in texts.items()]).alias("_t"))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["_t"]).alias("turns"))


def owned(rows: DataFrame, owner: str, *, owner_col: str = "owner_user_id") -> DataFrame:
    """Only the owner's active rows; every read of the history goes through it."""
    return rows.where((F.col(owner_col) == owner) & (F.col("status") == "active"))


def owned_turns(requests: DataFrame, turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(owner_user_id, the columns of ``turns``): for each request (owner_user_id, conversation_id),
    the turns of the conversation if it is active and the owner's own; else nothing."""
    own = conversations.where(F.col("status") == "active").select("owner_user_id", "conversation_id").distinct()
    granted = requests.select("owner_user_id", "conversation_id").distinct().join(own, ["owner_user_id", "conversation_id"], "left_semi")
    return granted.join(turns, "conversation_id")


def newest_conversations(conversations: DataFrame) -> DataFrame:
    """(owner_user_id, place, conversation_id, updated_at): each owner's active conversations,
    the last updated first; ties go to the smaller id."""
    w = W.partitionBy("owner_user_id").orderBy(F.desc("updated_at"), "conversation_id")
    active = conversations.where(F.col("status") == "active")
    return active.select("owner_user_id", F.row_number().over(w).alias("place"), "conversation_id", "updated_at")
