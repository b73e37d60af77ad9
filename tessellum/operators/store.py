"""Idempotent stores on plain tables: every change is a new DataFrame, or new rows whose latest state is a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the highest version; ties by the whole row. A partial aggregation, safe for hot keys."""
    rest = [c for c in df.columns if c not in (key, version)]
    return df.groupBy(key).agg(F.max(F.struct(F.col(version), *[F.col(c) for c in rest])).alias("_r")).select(key, "_r.*").select(*df.columns)


def upsert(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The table with the batch's rows in place of those of the same key; keys of the batch must be unique."""
    return table.join(batch.select(key), key, "left_anti").unionByName(batch)


def insert_if_absent(table: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The table and the batch's rows of new keys; of several in the batch the first by ``order`` wins (a partial
    aggregation, safe for hot keys)."""
    rest = [c for c in batch.columns if c not in (key, order)]
    first = batch.groupBy(key).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_r")).select(key, "_r.*").select(*batch.columns)
    return table.unionByName(first.join(table.select(key), key, "left_anti"))


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The table without the given keys."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is gone: what a cascade would delete."""
    p = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.where(F.col(child_key).isNotNull()).join(p, child_key, "left_anti")


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The n oldest pending entries (a limit is what a claim is)."""
    return queue.where("status = 'pending'").orderBy("created_at", "id").limit(n)


def resolve(entries: DataFrame, events: DataFrame, key: str, event_key: str) -> tuple[DataFrame, DataFrame]:
    """(entries with their event, entries marked failed since there is none)."""
    e = events.select(F.col(event_key).alias(key), F.struct("*").alias("event"))
    j = entries.join(e, key, "left")
    missing = j.where("event is null").drop("event").withColumn("status", F.lit("failed")).withColumn("error", F.concat(F.lit("event "), F.col(key), F.lit(" not found")))
    return j.where("event is not null"), missing


def touch(parents: DataFrame, children: DataFrame, key: str, parent_key: str, at: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """The parents with their time of update moved to that of their latest child, never back."""
    last = children.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias(key)).agg(F.max(at).alias("_last"))
    return parents.join(last, key, "left").withColumn(updated, F.greatest(updated, "_last")).drop("_last").select(*parents.columns)


def two_vector_points(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(id, vector, terms): points with a dense and a sparse vector, either null where a point has none.

    ``dense`` is (id, vector), ``sparse`` postings (id, term, weight); the sparse vector is an array of (term, weight) by term.
    """
    t = sparse.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    return dense.select("id", "vector").join(t, "id", "full")


def newest(df: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows, ties by key (a limit is what such a list is)."""
    return df.orderBy(F.desc_nulls_last(at), key).limit(n)


def sample_of(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded digest of their keys; all where there are no more. One seed gives one sample."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
