"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilwork.runtime import shared_dir, table
from veilwork.streaming import detection as W


def _streamed(spark, sf_dir):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "messages").select("id", "content").distinct().write.parquet(f"{base}/in")
    W.detect_stream(W.read_texts(spark, f"{base}/in", "id string, content string"), "id", "content", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumnRenamed("id", "message_id")


def streamed_spans(spark, sf_dir):
    """The spans of every rule in messages, by a file stream."""
    return _streamed(spark, sf_dir)


def streamed_tokens(spark, sf_dir):
    """Tokens that a stream of findings is given, conversation by conversation; a text keeps its token over batches."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    m = table(spark, sf_dir, "messages").select(F.coalesce("conversation_id", F.lit("none")).alias("conversation_id"), F.col("role").alias("text"), F.lit("NAME_ROLE").alias("entity_type")).where("text IS NOT NULL").distinct()
    m.repartition(4, "conversation_id").write.parquet(f"{base}/in")
    read = W.read_texts(spark, f"{base}/in", "conversation_id string, text string, entity_type string", files_per_trigger=1)
    W.append_stream(W.token_stream(read), f"{base}/out", f"{base}/state").awaitTermination()
    t = spark.read.schema("conversation_id string, hash string, token string").parquet(f"{base}/out").distinct()
    return t.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_texts"), F.count_distinct("token").alias("n_tokens"))


def hourly_counts(spark, sf_dir):
    """Events per type and hour, as a stream counts them and writes each hour that is over."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("entity_type"))
    # an event far ahead closes all windows before it; it is no part of the result
    end = e.agg((F.max("at") + F.expr("INTERVAL 10 DAYS")).alias("at")).select("at", F.lit("end of stream").alias("entity_type"))
    e.write.parquet(f"{base}/in")
    end.write.mode("append").parquet(f"{base}/in")
    counted = W.counts_per_window(W.read_texts(spark, f"{base}/in", "at timestamp, entity_type string", files_per_trigger=1_000))
    W.append_stream(counted, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("window_start timestamp, entity_type string, n long").parquet(f"{base}/out").where("entity_type <> 'end of stream'")


def queries():
    return {f.__name__: f for f in (streamed_spans, streamed_tokens, hourly_counts)}


def oracle_sql():
    from veilwork.catalog.rules import RULES
    from veilwork.plans.detection import _all

    return {
        "streamed_spans": _all(RULES, "(SELECT DISTINCT id, content FROM messages)", "id", "content", 'id AS message_id, rule, entity_type, start, CAST(start + length(text) AS INT) AS "end", text, confidence, has_checksum'),
        "streamed_tokens": "SELECT coalesce(conversation_id, 'none') AS conversation_id, count(DISTINCT lower(trim(role))) AS n_texts, count(DISTINCT lower(trim(role))) AS n_tokens FROM messages WHERE role IS NOT NULL GROUP BY 1",
        "hourly_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type AS entity_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    }
