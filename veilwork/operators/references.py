"""References to records that do not exist (problem 6).

Every foreign key of a child table is checked against the keys of its parent
table and the log of deletions.  Keys are compared in one spelling
(:func:`veilwork.runtime.clean_key`).

The plan is split by skew.  References are first aggregated per key and period
(number and earliest time, combined on the map side), and these groups, at most
one per key and month, are joined to the parents' keys; what is left are the
groups that hold an orphan.  The references are then looked at again, for those
groups only.  A key that holds more than one in ``heavy_share`` of all
references, and ``heavy_least`` at least, is *heavy*: there can be at most
``heavy_share`` such keys, so their groups are broadcast; those of all other
keys are broadcast too if they are few bytes, else joined by a shuffle on the
key.  Both parts are united.  The thresholds choose the plan only; no row is
dropped.

Defined results
---------------
* null, empty or blank reference: no reference, no row;
* repeated child rows: one row; repeated parent rows: the earliest created_at;
* parent without created_at, or child without time: never ``late``;
* key that has a row *and* stands in the log: present;
* empty tables: an empty parent makes every reference ``missing`` or ``deleted``;
* further columns of the inputs, whatever their names, are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.runtime import clean_key, join_sized, stage


@dataclass(frozen=True)
class Reference:
    """One foreign key: ``child_table.ref_column`` names rows of ``parent_table``."""

    child_table: str
    ref_column: str
    parent_table: str
    child_time: str
    child_id: str = "id"
    parent_id: str = "id"
    parent_time: str = "created_at"


def _references(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    out = None
    for r in refs:
        part = tables[r.child_table].select(
            F.lit(r.child_table).alias("child_table"),
            F.lit(r.ref_column).alias("ref_column"),
            F.col(r.child_id).alias("child_id"),
            F.lit(r.parent_table).alias("parent"),
            clean_key(F.col(r.ref_column)).alias("key"),
            F.col(r.child_time).alias("at"),
        ).where("key IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def _parents(tables: dict[str, DataFrame], deletions: DataFrame, refs: list[Reference]) -> DataFrame:
    """One row per known key: is there a row, since when, was it deleted."""
    out = deletions.select(
        F.lower(F.trim("table_name")).alias("parent"),
        clean_key(F.col("record_id")).alias("key"),
        F.lit(False).alias("there"),
        F.lit(None).cast("timestamp").alias("born"),
    )
    for r in {(r.parent_table, r.parent_id, r.parent_time): r for r in refs}.values():
        out = out.unionByName(
            tables[r.parent_table].select(
                F.lit(r.parent_table).alias("parent"),
                clean_key(F.col(r.parent_id)).alias("key"),
                F.lit(True).alias("there"),
                F.col(r.parent_time).cast("timestamp").alias("born"),
            )
        )
    return (
        out.where("key IS NOT NULL")
        .groupBy("parent", "key")
        .agg(F.max("there").alias("there"), F.min("born").alias("born"))
    )


def orphan_references(
    tables: dict[str, DataFrame],
    deletions: DataFrame,
    refs: list[Reference],
    heavy_share: int = 200,
    heavy_least: int = 1000,
) -> DataFrame:
    """Rows (child_table, ref_column, child_id, kind, period) of every orphan reference.

    kind: ``missing`` (no row, not in the log), ``deleted`` (no row, in the
    log), ``late`` (the row was created after the time of the child).
    period: month of the child's time, ``unknown`` without one.
    """
    group = ["parent", "key", "period"]
    children = _references(tables, refs).withColumn("period", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")))
    counted = stage(children.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # at most heavy_share keys can each hold more than this share
    heavy = counted.groupBy("parent", "key").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(max(heavy_least, total // heavy_share))).select("parent", "key", F.lit(True).alias("hot"))

    known = _parents(tables, deletions, refs)
    status = counted.join(known, ["parent", "key"], "left").withColumns({"logged": F.col("there").isNotNull(), "there": F.coalesce("there", F.lit(False))})
    held = status.where(~F.col("there") | (F.col("born") > F.col("first_at"))).join(F.broadcast(heavy), ["parent", "key"], "left")
    orphaned = stage(held.select(*group, "there", "logged", "born", F.col("hot").isNotNull().alias("hot")))
    hot = children.join(F.broadcast(orphaned.where("hot")), group)
    light = join_sized(children, stage(orphaned.where("NOT hot")), group)
    kind = (
        F.when(~F.col("there") & F.col("logged"), F.lit("deleted"))
        .when(~F.col("there"), F.lit("missing"))
        .when(F.col("born") > F.col("at"), F.lit("late"))
    )
    found = light.unionByName(hot).select("child_table", "ref_column", "child_id", kind.alias("kind"), "period")
    return found.where("kind IS NOT NULL").distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, reference column, kind and month."""
    return orphans.groupBy("child_table", "ref_column", "kind", "period").agg(F.count(F.lit(1)).alias("n_orphans"))


#: The three references of the review store.
REVIEW_STORE = [
    Reference("entities", "document_id", "scan_documents", "created_at"),
    Reference("corrections", "entity_id", "entities", "reviewed_at"),
    Reference("corrections", "document_id", "scan_documents", "reviewed_at"),
]
