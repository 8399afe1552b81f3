"""Batches of changes as new snapshots: absolute quantities, accepted results, overrides, sets, headers, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.operators import collection


def set_quantity(target: DataFrame, wanted: DataFrame) -> DataFrame:
    """The quantity of each named key becomes the wanted one (the largest ``seq`` wins); 0 or less deletes the row. Keys that the target lacks change nothing."""
    last = collection.keyed(wanted).groupBy(*collection.KEY).agg(F.max_by("quantity", "seq").alias("wanted"))
    j = collection.keyed(target).alias("t").join(last.alias("d"), collection._same(), "left")
    n = F.coalesce(F.col("d.wanted"), F.col("t.quantity")).cast("long")
    return j.select(*[F.col(f"t.{k}") for k in collection.KEY], n.alias("quantity")).filter("quantity > 0")


def overrides(rows: DataFrame, key: list[str], value: str, *order: str) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def register_sets(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (set_code, set_name) with a status: blank, exists or created. Of several rows with one new code and a name, one with the smallest name is created and the others, equal ones too, exist."""
    a = asked.select(F.upper(F.trim("set_code")).alias("set_code"), F.trim("set_name").alias("set_name"))
    blank = (F.coalesce("set_code", F.lit("")) == "") | (F.coalesce("set_name", F.lit("")) == "")
    turn = F.row_number().over(W.partitionBy("set_code", blank).orderBy("set_name"))
    j = a.withColumns({"_b": blank, "_n": turn}).join(existing.select(F.col("set_code").alias("e_code")).distinct(), F.col("set_code") == F.col("e_code"), "left")
    status = F.when(F.col("_b"), "blank").when(F.col("e_code").isNotNull() | (F.col("_n") > 1), "exists").otherwise("created")
    return j.select("set_code", "set_name", status.alias("status"))


def reject(results: DataFrame, job: int | None = None) -> DataFrame:
    """Results that wait for a person (of one job, or of all) are rejected."""
    waits = F.col("decision").isin("pending", "manual", "unmatched")
    if job is not None:
        waits = waits & (F.col("job_id") == job)
    return results.withColumn("decision", F.when(waits, "rejected").otherwise(F.col("decision")))


def delete_jobs(results: DataFrame, gone: DataFrame) -> DataFrame:
    """Results without those of deleted jobs; the collection is not touched."""
    return results.join(gone.select("job_id").distinct(), "job_id", "left_anti")


def release(results: DataFrame, items_left: DataFrame, key: str) -> DataFrame:
    """References to collection rows that are gone become null."""
    kept = items_left.select(F.col(key).alias("_k")).distinct()
    j = results.join(kept, F.col(key) == F.col("_k"), "left")
    return j.withColumn(key, F.col("_k")).drop("_k")


def deck_headers(headers: DataFrame, changes: DataFrame, card: DataFrame) -> DataFrame:
    """``headers`` (deck_id, name, cover) after ``changes`` (deck_id, op, value, seq): create, rename, cover (a card id that exists, else the cover stays; null clears it) and delete. Of each kind the last change holds."""
    c = changes.withColumn("as_card", F.expr("try_cast(value AS bigint)")).join(card.select(F.col("card_id").alias("c_id")), F.col("as_card") == F.col("c_id"), "left")
    good = (F.col("op") != "cover") | F.col("value").isNull() | F.col("c_id").isNotNull()
    of = lambda op: F.max_by(F.struct("value", "c_id"), F.when(F.col("op") == op, F.col("seq"))).alias(op)
    named = c.filter(good).withColumn("op", F.when(F.col("op") == "create", "rename").otherwise(F.col("op")))
    ops = ("rename", "cover", "delete")
    g = named.groupBy("deck_id").agg(*[of(o) for o in ops], *[F.max(F.when(F.col("op") == o, F.col("seq"))).alias(f"{o}_at") for o in ops], F.lit(True).alias("changed"))
    j = headers.join(g, "deck_id", "full")
    name = F.when(F.col("rename_at").isNotNull(), F.col("rename.value")).otherwise(F.col("name"))
    cover = F.when(F.col("cover_at").isNotNull(), F.col("cover.c_id")).otherwise(F.col("cover_card"))
    later = F.coalesce(F.col("delete_at") > F.coalesce("rename_at", F.lit(-1)), F.lit(False))
    return j.filter(~later & name.isNotNull()).select("deck_id", name.alias("name"), cover.alias("cover_card"))
