"""Conversations: context, compaction, retention and tokens over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.operators.deidentify import assign_tokens, decrypt, encrypt, generalise, restore, splice


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")


def context(messages: DataFrame, include_compacted: bool = False) -> DataFrame:
    """Per conversation: messages in order, their number, and an estimate of their tokens."""
    m = messages if include_compacted else messages.where("NOT coalesce(compacted, false)")
    per = m.groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "id", "role", F.coalesce("content_redacted", "content", F.lit("")).alias("content")))).alias("m"),
        F.sum(F.length(F.coalesce("content_redacted", "content", F.lit("")))).alias("chars"),
    )
    return per.select("conversation_id", F.size("m").cast("long").alias("n_messages"), token_estimate(F.col("chars")).alias("tokens"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def compaction(messages: DataFrame, limit: int = 8000, keep: int = 10) -> DataFrame:
    """(conversation_id, id, compact): conversations over ``limit`` tokens compact all but their last ``keep`` messages."""
    open_ = messages.where("NOT coalesce(compacted, false)")
    size = F.sum(F.length(F.coalesce("content_redacted", "content", F.lit("")))).over(Window.partitionBy("conversation_id"))
    rank = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id")))
    return open_.select("conversation_id", "id", ((token_estimate(size) > limit) & (rank > keep)).alias("compact"))


def append_summary(old: Column, new: Column) -> Column:
    return F.when(F.length(F.coalesce(old, F.lit(""))) > 0, F.concat(old, F.lit("\n\n---\n\n"), new)).otherwise(new)


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The most recent ``n`` messages of each conversation."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _conversation() -> Column:
    """A message without a conversation is one of its own."""
    return F.coalesce("conversation_id", F.concat(F.lit("message:"), "id"))


def tokenise_messages(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, redacted): tokens are shared by a conversation's messages; ``spans`` are keyed by ``message_id``."""
    order = messages.select(F.col("id").alias("message_id"), _conversation().alias("doc"), F.struct("created_at", "id").alias("seq"))
    tokens = assign_tokens(spans.join(order, "message_id"), "doc", "seq")
    per = tokens.groupBy("message_id").agg(F.collect_set(F.struct("start", "end", "token")).alias("s"))
    out = messages.join(per, messages["id"] == per["message_id"], "left")
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return out.select("id", F.when(F.col("s").isNull(), F.col("content")).otherwise(splice(F.col("content"), F.coalesce("s", none))).alias("redacted"))


def process_user_messages(messages: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, redacted) of messages, and the conversations' tokens (doc, token, original).

    Dates, ages and postcodes are generalised first, so their tokens lead back
    to the general value only; ``spans`` are keyed by ``message_id``.
    """
    order = messages.select(F.col("id").alias("message_id"), _conversation().alias("doc"), F.struct("created_at", "id").alias("seq"))
    tokens = assign_tokens(spans.join(order, "message_id"), "doc", "seq")
    per = tokens.groupBy("message_id").agg(F.collect_set(F.struct("start", "end", "token")).alias("s"))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    out = messages.join(per, messages["id"] == per["message_id"], "left").select("id", F.when(F.col("s").isNull(), F.col("content")).otherwise(splice(F.col("content"), F.coalesce("s", none))).alias("redacted"))
    kept = tokens.groupBy("doc", "token").agg(F.min(generalise(F.col("text"), F.col("entity_type"), F.col("doc"))).alias("original"))
    return out, kept


def process_assistant_messages(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, content): an answer's tokens replaced by what they stand for in its conversation."""
    maps = tokens.groupBy(F.col("doc").alias("conversation_id")).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("m"))
    out = messages.withColumn("conversation_id", _conversation()).join(maps, "conversation_id", "left")
    return out.select("id", F.when(F.col("m").isNull(), F.col("content")).otherwise(restore(F.col("content"), F.coalesce("m", F.create_map().cast("map<string,string>")))).alias("content"))


def lookup_tokens(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, token, original) of the wanted (doc, token); the original of an unknown one is null."""
    return wanted.select("doc", "token").distinct().join(tokens.select("doc", "token", "original"), ["doc", "token"], "left")


def count_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of each conversation, in all and by kind."""
    kind = F.regexp_extract("token", r"^\[(.*)_\d+\]$", 1)
    return tokens.groupBy("doc", kind.alias("kind")).agg(F.count_distinct("token").alias("n"))


def seal(tokens: DataFrame, key: bytes) -> DataFrame:
    """A token table whose originals only the holder of the key can read."""
    return encrypt(tokens, "original", key)


def unseal(tokens: DataFrame, key: bytes) -> DataFrame:
    return decrypt(tokens, "original", key)


def create_conversations(conversations: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``conversations`` (id, title, active_summary, token_count, created_at, updated_at) with new ones (id, title); known ids stay as they are."""
    fresh = new.join(conversations.select("id"), "id", "left_anti").select("id", "title", now.alias("created_at"), now.alias("updated_at"), F.lit(0).cast("long").alias("token_count"))
    return conversations.unionByName(fresh, allowMissingColumns=True)


def update_conversations(conversations: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Titles, summaries and token counts that ``changes`` (id, ...) gives; what was changed is updated ``now``."""
    cols = [c for c in changes.columns if c != "id"]
    c = changes.select("id", *(F.col(x).alias(f"_{x}") for x in cols), F.lit(True).alias("_hit"))
    out = conversations.join(c, "id", "left")
    new = {x: F.coalesce(F.col(f"_{x}"), F.col(x)) for x in cols} | {"updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}
    return out.withColumns(new).select(conversations.columns)


def delete_conversations(conversations: DataFrame, messages: DataFrame, tokens: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the conversations in ``gone`` (id)."""
    g = gone.select(F.col("id").alias("_g")).distinct()
    return tuple(df.join(g, df[col] == g["_g"], "left_anti") for df, col in ((conversations, "id"), (messages, "conversation_id"), (tokens, "doc")))


def session_stats(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per conversation: messages, of them the user's, and tokens."""
    m = messages.groupBy(_conversation().alias("doc")).agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.lower("role") == "user").alias("n_user"))
    t = tokens.groupBy("doc").agg(F.count_distinct("token").alias("n_tokens"))
    return m.join(t, "doc", "left").fillna(0, ["n_tokens"])


def recent_conversations(messages: DataFrame, limit: int = 20) -> DataFrame:
    """The conversations written to last (a top-k report)."""
    g = messages.groupBy("conversation_id").agg(F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n_messages"))
    return g.orderBy(F.desc_nulls_last("last_at"), "conversation_id").limit(limit)


def expired_conversations(messages: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Conversations without a message in the last ``days``; deleting them deletes their messages and tokens."""
    g = messages.groupBy("conversation_id").agg(F.max("created_at").alias("last_at"))
    return g.where(F.col("last_at") < now - F.expr(f"INTERVAL {days} DAYS")).select("conversation_id")
