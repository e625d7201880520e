"""A tamper-evident log: each event's hash covers its fields and the hash before it."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ["sequence", "event_type", "at", "user_id", "details"]
GENESIS = "0" * 64


def event_hash(prev: Column) -> Column:
    """SHA-256 over the previous hash and all fields, separated by a unit separator."""
    parts = [F.coalesce(F.date_format(F.col(f), "yyyy-MM-dd HH:mm:ss.SSSSSS") if f == "at" else F.col(f).cast("string"), F.lit("")) for f in FIELDS]
    return F.sha2(F.concat_ws("\x1f", prev, *parts), 256)


def chain(events: DataFrame, log: str = "log") -> DataFrame:
    """Adds prev_hash and hash per log, in order of ``sequence``.

    A chain is sequential by nature; logs are chained in parallel, and one log
    as a stream of its sorted rows with a single hash of state.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.date_format(F.col(f), "yyyy-MM-dd HH:mm:ss.SSSSSS") if f == "at" else F.col(f).cast("string"), F.lit("")) for f in FIELDS])
    rows = events.select(log, *FIELDS, text.alias("_t"))
    parted = rows.repartition(log).sortWithinPartitions(log, "sequence")

    def run(batches):
        last, prev = object(), GENESIS
        for b in batches:
            before, now = [], []
            for key, t in zip(b[log], b["_t"], strict=True):
                if key != last:
                    last, prev = key, GENESIS
                before.append(prev)
                prev = hashlib.sha256(f"{prev}\x1f{t}".encode()).hexdigest()
                now.append(prev)
            yield b.drop(columns="_t").assign(prev_hash=before, hash=now)

    kinds = dict(rows.dtypes)
    return parted.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [log, *FIELDS]) + ", prev_hash string, hash string")


def broken_links(chained: DataFrame, log: str = "log") -> DataFrame:
    """(log, sequence, problem) of gaps, wrong previous hashes and altered rows; checked in parallel by neighbours."""
    w = Window.partitionBy(log).orderBy("sequence")
    prev_seq, prev_hash = F.lag("sequence").over(w), F.lag("hash").over(w)
    problem = (
        F.when(prev_seq.isNotNull() & (F.col("sequence") != prev_seq + 1), "gap")
        .when(F.col("prev_hash") != F.coalesce(prev_hash, F.lit(GENESIS)), "previous hash")
        .when(F.col("hash") != event_hash(F.col("prev_hash")), "altered")
    )
    return chained.withColumn("problem", problem).where("problem IS NOT NULL").select(log, "sequence", "problem")


def verify(chained: DataFrame, log: str = "log") -> DataFrame:
    """Per log: number of events, whether it is whole, and the first bad sequence."""
    bad = broken_links(chained, log).groupBy(log).agg(F.min("sequence").alias("first_bad"))
    return chained.groupBy(log).agg(F.count(F.lit(1)).alias("n_events")).join(bad, log, "left").withColumn("valid", F.col("first_bad").isNull())


def query(events: DataFrame, since=None, until=None, event_type: str | None = None, user_id=None, limit: int | None = 1000, offset: int = 0) -> DataFrame:
    """Events by optional conditions, newest first, one page."""
    conditions = [
        (since, lambda v: F.col("at") >= F.lit(v)),
        (until, lambda v: F.col("at") <= F.lit(v)),
        (event_type, lambda v: F.col("event_type") == v),
        (user_id, lambda v: F.col("user_id") == v),
    ]
    for value, test in conditions:
        if value is not None:
            events = events.where(test(value))
    events = events.orderBy(F.desc("at"), F.desc("sequence")).offset(offset)
    return events.limit(limit) if limit else events


def stats(events: DataFrame, days: int = 30) -> DataFrame:
    """Per event type: count, first and last time, and the count in the last ``days`` of the log."""
    end = events.agg(F.max("at").alias("end"))
    return events.crossJoin(F.broadcast(end)).groupBy("event_type").agg(  # end: one row
        F.count(F.lit(1)).alias("n_events"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_if(F.col("at") >= F.col("end") - F.expr(f"INTERVAL {days} DAYS")).alias("n_recent")
    )


def append(spark: SparkSession, log: DataFrame, events: pd.DataFrame) -> DataFrame:
    """New events behind a log's last one (a single writer): their sequence and hashes go on from there."""
    last = log.orderBy(F.desc("sequence")).limit(1).collect()
    seq, prev = (last[0]["sequence"], last[0]["hash"]) if last else (0, GENESIS)
    rows = []
    for _, e in events.iterrows():
        seq += 1
        at = pd.Timestamp(e["at"])
        text = "\x1f".join([prev, str(seq), str(e["event_type"]), at.strftime("%Y-%m-%d %H:%M:%S.%f"), str(e["user_id"]), str(e["details"] or "")])
        now = hashlib.sha256(text.encode()).hexdigest()
        rows.append((e.get("log", "main"), seq, e["event_type"], at.to_pydatetime(), e["user_id"], e["details"], prev, now))
        prev = now
    return log.unionByName(spark.createDataFrame(rows, log.schema))
