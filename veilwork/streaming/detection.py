"""Detection, token state and counts over streams (file source or any other)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.operators.deidentify import lookup_hash, short_type
from veilwork.operators.detect import Catalog, detect


def read_texts(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def detect_stream(texts: DataFrame, id_col: str, text_col: str, target: str, checkpoint: str, catalog: Catalog | None = None):
    """Spans of a stream of texts appended to ``target``; started, ends when the input is used up."""

    def batch(df: DataFrame, _: int) -> None:
        detect(df, id_col, text_col, catalog).write.mode("append").parquet(target)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(df: DataFrame, target: str, checkpoint: str):
    """A stream's rows appended to ``target``; started, ends when the input is used up."""
    return df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_per_window(spans: DataFrame, at: str = "at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Spans per type and window; rows later than the watermark are dropped by the engine."""
    return spans.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "entity_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "entity_type", "n")


TOKENS = "conversation_id string, hash string, token string"


def _assign(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State of a conversation: its hashes with their tokens, and a counter per kind."""
    known, numbers = state.get if state.exists else ([], [])
    tokens = dict(zip(known[::2], known[1::2], strict=True)) if known else {}
    count = {k: int(v) for k, v in zip(numbers[::2], numbers[1::2], strict=True)} if numbers else {}
    out = []
    for b in batches:
        for h, kind in zip(b["hash"], b["kind"], strict=True):
            if h not in tokens:
                count[kind] = count.get(kind, 0) + 1
                tokens[h] = f"[{kind}_{count[kind]}]"
            out.append((key[0], h, tokens[h]))
    state.update(([x for kv in tokens.items() for x in kv], [str(x) for kv in count.items() for x in kv]))
    yield pd.DataFrame(out, columns=["conversation_id", "hash", "token"]).drop_duplicates()


def token_stream(spans: DataFrame) -> DataFrame:
    """(conversation_id, hash, token) of a stream of (conversation_id, text, entity_type); a text keeps its token over batches."""
    keyed = spans.select("conversation_id", lookup_hash(F.col("text")).alias("hash"), short_type(F.col("entity_type")).alias("kind"))
    return keyed.groupBy("conversation_id").applyInPandasWithState(_assign, TOKENS, "known array<string>, numbers array<string>", "append", "NoTimeout")
