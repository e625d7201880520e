"""Row store on Parquet: upserts, reviews, signal life cycle, model registry, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null values of ``changes`` (at most one row per key)."""
    cols = [c for c in changes.columns if c != key]
    c = changes.select(key, *(F.col(x).alias(f"_{x}") for x in cols))
    joined = old.join(c, key, "left")
    return joined.select(*(F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x in cols else F.col(x) for x in old.columns))


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def append(df: DataFrame, path: str) -> DataFrame:
    """Rows added to the Parquet table at ``path``, which is made where there is none; the table as it is then."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_cascade(gone: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without the rows whose column names a deleted ``key``."""
    g = gone.select(F.col(key).alias("_gone")).where("_gone IS NOT NULL").distinct()
    return {name: df.join(g, df[col] == g["_gone"], "left_anti") for name, (df, col) in tables.items()}


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order``."""
    w = Window.partitionBy(key).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def review_queue(entities: DataFrame, documents: DataFrame, corrections: DataFrame, threshold: float = 0.95, entity_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """Entities under the threshold without a correction, least certain first (a top-k report)."""
    e = entities.where(F.col("confidence") < threshold)
    if entity_type:
        e = e.where(F.col("entity_type") == entity_type)
    out = e.join(corrections.select(F.col("entity_key").alias("span_id")).distinct(), "span_id", "left_anti").join(documents, "doc")
    out = out.orderBy("confidence", "span_id")
    return out.limit(limit) if limit else out


def review_stats(entities: DataFrame, documents: DataFrame, corrections: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row of counts."""
    e = entities.agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("confidence") >= threshold).alias("n_auto"))
    c = corrections.agg(F.count(F.lit(1)).alias("n_reviewed"), *(F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("confirmed", "rejected", "changed")))
    d = documents.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("scanned_at").isNull()).alias("n_unscanned"))
    # three single rows
    return reduce(lambda a, b: a.crossJoin(b), [d, e, c])


def document_entities(entities: DataFrame) -> DataFrame:
    """Entities with ``place``: their number in the order of their document."""
    return entities.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("start", "end", "span_id")))


def newest_corrections(corrections: DataFrame, per: str = "detected_type", limit: int = 50) -> DataFrame:
    """The ``limit`` newest corrections of each kind (a top-k report)."""
    w = Window.partitionBy(per).orderBy(F.col("reviewed_at").desc_nulls_last(), "id")
    return corrections.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def patterns_of_type(corrections: DataFrame, least: int = 2) -> DataFrame:
    """Texts that reviewers decided alike ``least`` times or more, by type: (entity_type, text, decision, n)."""
    kind = F.coalesce(F.when(F.col("decision") == "changed", F.col("correct_type")), F.col("detected_type"))
    g = corrections.where("entity_text IS NOT NULL").groupBy(kind.alias("entity_type"), F.lower(F.trim("entity_text")).alias("text"), "decision").agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least)


def top_false_positives(corrections: DataFrame, limit: int = 10) -> DataFrame:
    """The rejected (text, type) seen most (a top-k report)."""
    g = corrections.where("decision = 'rejected'").groupBy("entity_text", "detected_type").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "entity_text", "detected_type").limit(limit)


def pending(signals: DataFrame, limit: int = 50, oldest_first: bool = True, threshold: float = 0.95) -> DataFrame:
    """Signals waiting for review, oldest or newest first (a top-k report)."""
    by = F.col("created_ts").asc_nulls_first() if oldest_first else F.col("created_ts").desc_nulls_last()
    return signals.where((F.col("status") == "pending") & (F.col("merged_conf") < threshold)).orderBy(by, "id").limit(limit)


def labelled_signals(signals: DataFrame) -> DataFrame:
    """Reviewed signals with a truth, which a training run may take; ``place`` 1 is the feedback that came last."""
    w = Window.orderBy(F.col("feedback_ts").desc_nulls_last(), "id")
    return signals.where("status = 'reviewed' AND ground_truth_type IS NOT NULL").withColumn("place", F.row_number().over(w))


def mark_used(signals: DataFrame, used: DataFrame, run_id: str) -> DataFrame:
    """``signals`` with those in ``used`` (id) taken by training run ``run_id``."""
    hit = used.select("id").distinct().withColumn("_hit", F.lit(True))
    out = signals.join(hit, "id", "left")
    return out.withColumns({"status": F.when(F.col("_hit"), "training").otherwise(F.col("status")), "run_id": F.when(F.col("_hit"), F.lit(run_id))}).drop("_hit")


def store_stats(signals: DataFrame, archived: DataFrame, missed: DataFrame, models: DataFrame) -> DataFrame:
    """One row: signals in all, pending, reviewed, labelled; missed reports pending; archived signals; the active model."""
    status = lambda s: F.count_if(F.col("status") == s)
    s = signals.agg(F.count(F.lit(1)).alias("n_active"), status("pending").alias("n_pending"), status("reviewed").alias("n_reviewed"), F.count_if((F.col("status") == "reviewed") & F.col("ground_truth_type").isNotNull()).alias("n_labelled"))
    active = models.where("status = 'active'").agg(F.max_by("version", F.struct("promoted_at", "version")).alias("active_model"))
    # four single rows
    return s.crossJoin(missed.agg(F.count_if(F.col("status") == "pending").alias("n_missed"))).crossJoin(archived.agg(F.count(F.lit(1)).alias("n_archived"))).crossJoin(active)


def feedback_truth(signals: DataFrame) -> DataFrame:
    """Ground truth from feedback: right type kept, wrong label corrected, false finding NONE, skipped null."""
    kind = F.lower(F.trim("feedback_type"))
    truth = F.when(kind == "tp", F.col("merged_type")).when(kind == "wl", F.col("feedback_correct_type")).when(kind == "fp", F.lit("NONE"))
    return signals.withColumn("truth", truth)


def parse_time(c: Column) -> Column:
    """ISO-like time texts in several layouts, as a timestamp; else null."""
    t = F.regexp_replace(F.trim(c), "Z$", "")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd")))


def archive_split(rows: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Adds ``place`` (active or archive) and the status after archiving: old pending rows expire, rows in training stay."""
    old = (F.col("created_ts") < now - F.expr(f"INTERVAL {days} DAYS")) & (F.coalesce("status", F.lit("")) != "training")
    return rows.withColumns({"place": F.when(old, "archive").otherwise("active"), "status": F.when(old & (F.col("status") == "pending"), "expired").otherwise(F.col("status"))})


def active_model(models: DataFrame) -> DataFrame:
    """The active version promoted last."""
    return models.where("status = 'active'").orderBy(F.desc("promoted_at"), F.desc("version")).limit(1)


def promote(models: DataFrame, version: str, now: Column) -> DataFrame:
    """``version`` becomes active, the active ones are rolled back."""
    hit = F.col("version") == version
    status = F.when(hit, "active").when(F.col("status") == "active", "rolled_back").otherwise(F.col("status"))
    return models.withColumns({"promoted_at": F.when(hit, now).otherwise(F.col("promoted_at")), "status": status})


def rollback_order(models: DataFrame) -> DataFrame:
    """The two versions a rollback swaps: the active one, then the last rolled back."""
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "rolled_back", 1).otherwise(2)
    return models.where("status IN ('active', 'rolled_back')").orderBy(rank, F.desc("promoted_at"), F.desc("version")).limit(2)


def rollback(models: DataFrame, now: Column) -> DataFrame:
    """The version rolled back last becomes active again, the active one is rolled back; nothing changes without both."""
    pair = rollback_order(models)
    roles = F.broadcast(pair.select("version", F.col("status").alias("_was"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("_n")).where("_n = 2").drop("_n"))
    out = models.join(roles, "version", "left")
    back = F.col("_was") == "rolled_back"
    status = F.when(back, "active").when(F.col("_was") == "active", "rolled_back").otherwise(F.col("status"))
    return out.withColumns({"promoted_at": F.when(back, now).otherwise(F.col("promoted_at")), "status": status}).drop("_was")


def retained_models(models: DataFrame, keep: int = 2) -> DataFrame:
    """All versions but the rolled-back ones beyond the newest ``keep``."""
    w = Window.partitionBy("status").orderBy(F.desc("promoted_at"), F.desc("version"))
    return models.withColumn("_rn", F.row_number().over(w)).where((F.col("status") != "rolled_back") | (F.col("_rn") <= keep)).drop("_rn")


def should_train(labelled: int, least: int = 1000, last_f1: float | None = None, new_f1: float | None = None, drop: float = 0.02) -> tuple[bool, str]:
    """Gate of a new model: enough labels, and no loss of F1."""
    if labelled < least:
        return False, f"{labelled} of {least} labels"
    if last_f1 is not None and new_f1 is not None and new_f1 < last_f1 - drop:
        return False, f"F1 falls from {last_f1:.3f} to {new_f1:.3f}"
    return True, "ready"


def stage_model(models: DataFrame, version: str, metrics: dict[str, float], now: Column) -> DataFrame:
    """``models`` with a new version that waits; ``metrics`` are columns of the registry."""
    spark = models.sparkSession
    row = spark.range(1).select(F.lit(version).alias("version"), F.lit("staged").alias("status"), now.alias("staged_at"), *(F.lit(float(v)).alias(k) for k, v in metrics.items()))
    return models.unionByName(row, allowMissingColumns=True)


def advance_models(models: DataFrame, now: Column, shadow_hours: int = 24, drop: float = 0.02) -> DataFrame:
    """One step of the life of staged and shadow versions.

    A staged version whose F1 falls by more than ``drop`` against the active
    one is refused, any other runs in the shadow; after ``shadow_hours`` there
    it becomes active and the active one is rolled back.
    """
    current = models.where("status = 'active'").agg(F.max("f1").alias("_f1"))  # a single row
    m = models.crossJoin(current)
    ready = (F.col("status") == "shadow") & (F.col("staged_at") <= now - F.expr(f"INTERVAL {shadow_hours} HOURS"))
    first = F.row_number().over(Window.partitionBy(ready).orderBy(F.desc("staged_at"), F.desc("version"))) == 1
    m = m.withColumn("_up", ready & first).withColumn("_any", F.max("_up").over(Window.partitionBy(F.lit(1))))
    status = (
        F.when(F.col("_up"), "active")
        .when((F.col("status") == "active") & F.col("_any"), "rolled_back")
        .when((F.col("status") == "staged") & (F.col("f1") < F.col("_f1") - drop), "refused")
        .when(F.col("status") == "staged", "shadow")
        .otherwise(F.col("status"))
    )
    return m.withColumns({"promoted_at": F.when(F.col("_up"), now).otherwise(F.col("promoted_at")), "status": status}).drop("_f1", "_up", "_any")


def learn_from(hits: DataFrame, signals: DataFrame, now: Column, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(hits, signals): the hits as they are, and ``signals`` with those under the threshold that it has not yet, as pending.

    ``hits``: doc, span_id, entity_type, confidence; a signal's id is the span's.
    """
    new = hits.where(F.col("confidence") < threshold).select(F.col("span_id").alias("id"), F.col("doc").alias("document_id"), F.col("entity_type").alias("merged_type"), F.col("confidence").alias("merged_conf"), F.lit("pending").alias("status"), now.alias("created_ts"))
    return hits, signals.unionByName(new.dropDuplicates(["id"]).join(signals.select("id"), "id", "left_anti"), allowMissingColumns=True)


def due_steps(hour: int, labelled: int, least: int = 1000, window: tuple[int, int] = (2, 6)) -> list[str]:
    """What an hourly scheduler has to do: promote always, train with enough labels inside the window of hours, archive at its end."""
    train, _ = should_train(labelled, least)
    return ["promote"] + (["train"] if train and window[0] <= hour < window[1] else []) + (["archive"] if hour == window[1] else [])


def scan_unscanned(documents: DataFrame, detect, now: Column, threshold: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, documents as scanned, tally) of the documents not scanned yet; ``detect(df)`` gives spans keyed by ``id``."""
    todo = documents.where("scanned_at IS NULL")
    found = detect(todo)
    done = documents.withColumn("scanned_at", F.coalesce("scanned_at", now))
    tally = found.agg(F.count_if(F.col("confidence") >= threshold).alias("n_auto"), F.count_if(F.col("confidence") < threshold).alias("n_review"))
    return found, done, tally


def apply_decisions(entities: DataFrame, decisions: DataFrame, texts: DataFrame, now: Column, window: int = 50) -> DataFrame:
    """Review decisions (span_id, decision, correct_type) as corrections, with the words around each entity."""
    e = entities.join(decisions, "span_id").join(texts, "doc", "left")
    s = F.greatest(F.col("start") - window, F.lit(0))
    return e.select(
        F.sha2(F.concat_ws("|", "span_id", "decision"), 256).alias("id"),
        F.col("span_id").alias("entity_id"),
        F.col("doc").alias("document_id"),
        F.col("text").alias("entity_text"),
        F.col("start").alias("entity_start"),
        F.col("end").alias("entity_end"),
        F.col("entity_type").alias("detected_type"),
        "decision",
        F.when(F.col("decision") == "changed", F.col("correct_type")).alias("correct_type"),
        F.substring(F.col("doc_text"), s + 1, F.col("start") - s).alias("context_before"),
        F.substring(F.col("doc_text"), F.col("end") + 1, F.lit(window)).alias("context_after"),
        F.col("confidence").alias("ner_confidence"),
        now.alias("reviewed_at"),
    )


def capture_uncertain(signals: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Signals worth asking about, as pending."""
    return signals.where(F.col("merged_conf") < threshold).withColumn("status", F.lit("pending"))


def missed_reports(reports: DataFrame, texts: DataFrame) -> DataFrame:
    """Reports of missed text (doc, missed_text, correct_type) with its first place, or null if it is not there."""
    at = F.call_function("instr", F.col("doc_text"), F.col("missed_text"))
    return reports.join(texts, "doc", "left").select("doc", "missed_text", "correct_type", F.when(at > 0, at - 1).alias("missed_start"), F.when(at > 0, at - 1 + F.length("missed_text")).alias("missed_end"))
