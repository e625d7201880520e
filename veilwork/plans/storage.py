"""Queries over the row store and the audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilwork.operators import audit as A
from veilwork.operators import store as K
from veilwork.plans import base as B
from veilwork.runtime import clean_key, shared_dir, table


def _corrections(spark, sf_dir):
    c = table(spark, sf_dir, "corrections")
    return c.select("id", clean_key(F.col("entity_id")).alias("entity_key"), "entity_text", "detected_type", "decision", "correct_type", "reviewed_at").distinct()


_CORR = "SELECT DISTINCT id, " + B.KEY.format("entity_id") + " AS entity_key, entity_text, detected_type, decision, correct_type, reviewed_at FROM corrections"


def review_queue(spark, sf_dir):
    q = K.review_queue(B.entity_spans(spark, sf_dir), B.texts(spark, sf_dir).select("doc"), _corrections(spark, sf_dir))
    return q.select("span_id", "doc", "entity_type", "confidence")


def review_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "scan_documents").select("id", "scanned_at").distinct()
    return K.review_stats(B.entity_spans(spark, sf_dir), docs, _corrections(spark, sf_dir))


def top_false_positives(spark, sf_dir):
    return K.top_false_positives(_corrections(spark, sf_dir))


def document_entities(spark, sf_dir):
    return K.document_entities(B.entity_spans(spark, sf_dir)).select("doc", "span_id", F.col("place").cast("long").alias("place"))


def newest_corrections(spark, sf_dir):
    return K.newest_corrections(_corrections(spark, sf_dir), limit=20).select("detected_type", "id", F.col("place").cast("long").alias("place"))


def patterns_of_type(spark, sf_dir):
    return K.patterns_of_type(_corrections(spark, sf_dir))


def entities_latest(spark, sf_dir):
    """A repeated row carries newer verdicts; the last one counts."""
    e = table(spark, sf_dir, "entities").select("id", "document_id", "text", "entity_type", "confidence", "llm_confidence")
    return K.latest(e, "id", [F.nanvl("llm_confidence", F.lit(None).cast("double")), F.struct("entity_type", "confidence")]).select("id", "entity_type", F.round(F.nanvl("llm_confidence", F.lit(None).cast("double")), 6).alias("llm_confidence"))


def entities_upserted(spark, sf_dir):
    """What reviewers changed, put in place of the rows it is about, and entities they speak of that are not there."""
    e = B.entity_spans(spark, sf_dir).select("span_id", "entity_type", "source").distinct()
    c = table(spark, sf_dir, "corrections").where("decision = 'changed'").select(clean_key(F.col("entity_id")).alias("span_id"), F.col("correct_type").alias("entity_type")).where("span_id IS NOT NULL")
    return K.upsert(e, c.groupBy("span_id").agg(F.max("entity_type").alias("entity_type")).withColumn("source", F.lit("review")), "span_id")


def entities_patched(spark, sf_dir):
    """Confidences that reviewers give (UPDATE by key): absent ones leave the old value."""
    e = B.entity_spans(spark, sf_dir).select("span_id", "confidence").distinct()
    c = table(spark, sf_dir, "corrections").select(clean_key(F.col("entity_id")).alias("span_id"), F.nanvl("ner_confidence", F.lit(None).cast("double")).alias("confidence")).where("span_id IS NOT NULL")
    return K.patch(e, c.groupBy("span_id").agg(F.max("confidence").alias("confidence")), "span_id")


def appended_rows(spark, sf_dir):
    """Messages added to a table in two writes."""
    path = f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    m = table(spark, sf_dir, "messages").select("id", "role", "conversation_id").distinct()
    K.append(m.where("role = 'user'"), path)
    return K.append(m.where("role <> 'user' OR role IS NULL"), path)


def deleted_cascade(spark, sf_dir):
    """Conversations of one user's turn only are deleted, with their messages."""
    m = table(spark, sf_dir, "messages").select("id", "conversation_id").distinct()
    gone = m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).where("n <= 3 AND conversation_id IS NOT NULL")
    return K.delete_cascade(gone, "conversation_id", {"messages": (m, "conversation_id")})["messages"]


def marked_scanned(spark, sf_dir):
    """Every document not scanned yet is, with a tally of what needs review."""
    now = F.expr("TIMESTAMP '2026-01-01 00:00:00'")
    docs = table(spark, sf_dir, "scan_documents").select("id", "scanned_at").distinct()
    spans = B.entity_spans(spark, sf_dir)
    _, done, tally = K.scan_unscanned(docs, lambda todo: spans.join(todo.select(F.col("id").alias("doc")).distinct(), "doc", "left_semi"), now)
    return done.agg(F.count_if(F.col("scanned_at") == now).alias("n_new"), F.count_if(F.col("scanned_at").isNull()).alias("n_open")).crossJoin(tally)  # single rows


def applied_decisions(spark, sf_dir):
    """Decisions on every entity by its confidence, as corrections."""
    e = B.entity_spans(spark, sf_dir)
    how = F.when(F.col("confidence") >= 0.9, "confirmed").when(F.col("confidence") >= 0.6, "changed").otherwise("rejected")
    d = e.select("span_id", how.alias("decision"), F.lit("OTHER").alias("correct_type")).distinct()
    out = K.apply_decisions(e, d, B.texts(spark, sf_dir), F.expr("TIMESTAMP '2026-01-01 00:00:00'"))
    return out.select("id", "entity_id", "decision", "correct_type", "context_before", "context_after")


def entities_without_deleted(spark, sf_dir):
    gone = table(spark, sf_dir, "deletions").where("table_name = 'entities'").select(F.col("record_id").alias("id")).distinct()
    return K.delete(table(spark, sf_dir, "entities").select("id").distinct(), gone, "id")


def unscanned_documents(spark, sf_dir):
    return table(spark, sf_dir, "scan_documents").where("scanned_at IS NULL").select("id", "source").distinct()


def span_signal_counts(spark, sf_dir):
    s = table(spark, sf_dir, "span_signals").select("id", "ground_truth_type").distinct()
    return s.agg(F.count(F.lit(1)).alias("n_total"), F.count("ground_truth_type").alias("n_labelled"), F.count_if(F.col("ground_truth_type") != "NONE").alias("n_positive"), F.count_if(F.col("ground_truth_type").isNull()).alias("n_unlabelled"))


def _signals(spark, sf_dir):
    s = table(spark, sf_dir, "signals").select("id", "created_at", "status", "merged_type", "merged_conf", "feedback_type", "feedback_correct_type").distinct()
    return s.withColumn("created_ts", K.parse_time(F.col("created_at")))


def feedback_truth(spark, sf_dir):
    return K.feedback_truth(_signals(spark, sf_dir)).select("id", "truth")


def signal_archive(spark, sf_dir):
    return K.archive_split(_signals(spark, sf_dir), F.expr("TIMESTAMP '2025-06-01 00:00:00'")).groupBy("place", "status").agg(F.count(F.lit(1)).alias("n"))


def pending_signals(spark, sf_dir):
    return K.pending(_signals(spark, sf_dir)).select("id", "merged_type", "merged_conf")


def pending_newest(spark, sf_dir):
    return K.pending(_signals(spark, sf_dir), limit=30, oldest_first=False).select("id", "merged_type", "merged_conf")


def captured_signals(spark, sf_dir):
    s = table(spark, sf_dir, "span_signals").select("id", "merged_type", F.nanvl("merged_conf", F.lit(None).cast("double")).alias("merged_conf")).distinct()
    return K.capture_uncertain(s)


def learned_signals(spark, sf_dir):
    """Detections that a learning loop captures, beside the signals it has."""
    e = B.entity_spans(spark, sf_dir)
    have = e.where("source = 'rule' AND confidence < 0.95").select(F.col("span_id").alias("id"), F.lit("reviewed").alias("status")).distinct()
    return K.learn_from(e, have, F.expr("TIMESTAMP '2026-01-01 00:00:00'"))[1].select("id", "status", "merged_type")


def missed_reports(spark, sf_dir):
    """Reports of what reviewers confirmed: where the text stands first in its document."""
    c = table(spark, sf_dir, "corrections").where("decision = 'confirmed'").select(clean_key(F.col("document_id")).alias("doc"), F.col("entity_text").alias("missed_text"), F.col("detected_type").alias("correct_type")).where("doc IS NOT NULL AND missed_text IS NOT NULL").distinct()
    return K.missed_reports(c, B.texts(spark, sf_dir))


def _reviewed(spark, sf_dir):
    s = table(spark, sf_dir, "signals").select("id", "status", "ground_truth_type", "feedback_at").distinct()
    return s.withColumn("feedback_ts", K.parse_time(F.col("feedback_at"))).drop("feedback_at")


def labelled_signals(spark, sf_dir):
    return K.labelled_signals(_reviewed(spark, sf_dir)).select("id", "ground_truth_type", F.col("place").cast("long").alias("place"))


def signals_used(spark, sf_dir):
    s = _reviewed(spark, sf_dir)
    used = K.mark_used(s, K.labelled_signals(s), "run-1")
    return used.groupBy("status", "run_id").agg(F.count(F.lit(1)).alias("n"))


def store_stats(spark, sf_dir):
    s = K.archive_split(_signals(spark, sf_dir).join(_reviewed(spark, sf_dir).select("id", "ground_truth_type").distinct(), "id"), F.expr("TIMESTAMP '2025-06-01 00:00:00'"))
    missed = table(spark, sf_dir, "corrections").select("id", F.when(F.col("reviewed_at").isNull(), "pending").otherwise("done").alias("status")).distinct()
    return K.store_stats(s.where("place = 'active'"), s.where("place = 'archive'"), missed, _models(spark, sf_dir))


def _models(spark, sf_dir):
    """The model versions that signals name: the newest is active, the others were rolled back."""
    s = table(spark, sf_dir, "signals").groupBy(F.col("model_version").alias("version")).agg(F.max(K.parse_time(F.col("created_at"))).alias("promoted_at"), F.avg("merged_conf").alias("f1")).where("version IS NOT NULL")
    newest = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("promoted_at").desc_nulls_last(), F.desc("version"))) == 1
    return s.withColumn("status", F.when(newest, "active").otherwise("rolled_back"))


def model_registry(spark, sf_dir):
    """A version promoted by hand: it is active, the active one is rolled back, and the two rolled back last are kept."""
    now = F.expr("TIMESTAMP '2026-01-01 00:00:00'")
    m = K.stage_model(_models(spark, sf_dir), "m-next", {"f1": 0.9}, now)
    return K.retained_models(K.promote(m, "m-next", now)).select("version", "status")


def model_rollback(spark, sf_dir):
    return K.rollback(_models(spark, sf_dir), F.expr("TIMESTAMP '2026-01-01 00:00:00'")).select("version", "status")


def model_shadow(spark, sf_dir):
    """A good and a bad version staged, a day in the shadow, then promotion."""
    at = lambda d: F.expr(f"TIMESTAMP '2026-01-{d:02d} 00:00:00'")
    m = K.stage_model(K.stage_model(_models(spark, sf_dir), "m-good", {"f1": 2.0}, at(1)), "m-bad", {"f1": -1.0}, at(1))
    return K.advance_models(K.advance_models(m, at(1)), at(2)).select("version", "status")


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("log"), (F.col("user_id") % 16).cast("string")).alias("log"), "event_id", "event_type", F.col("ts").alias("at"), "user_id", F.col("props").alias("details"))


def _log(spark, sf_dir):
    w = Window.partitionBy("log").orderBy("at", "event_id")
    return _events(spark, sf_dir).withColumn("sequence", F.row_number().over(w).cast("long")).drop("event_id")


def audit_chain(spark, sf_dir):
    return A.verify(A.chain(_log(spark, sf_dir))).select("log", "n_events", "valid")


def audit_tampered(spark, sf_dir):
    c = A.chain(_log(spark, sf_dir))
    bad = c.where("sequence <> 7").withColumn("details", F.when(F.col("sequence") == 3, F.lit("{}")).otherwise(F.col("details")))
    return A.verify(bad).select("log", "first_bad", "valid")


def audit_page(spark, sf_dir):
    e = _events(spark, sf_dir).withColumnRenamed("event_id", "sequence")
    return A.query(e, event_type="click", limit=50, offset=100).select("sequence", "event_type", "user_id")


def audit_stats(spark, sf_dir):
    return A.stats(_events(spark, sf_dir))


def queries():
    fs = (
        review_queue, review_stats, top_false_positives, document_entities, newest_corrections, patterns_of_type, entities_latest, entities_upserted, entities_patched, appended_rows, deleted_cascade, marked_scanned, applied_decisions,
        entities_without_deleted, unscanned_documents, span_signal_counts, feedback_truth, signal_archive, pending_signals, pending_newest, captured_signals, learned_signals, missed_reports, labelled_signals, signals_used, store_stats,
        model_registry, model_rollback, model_shadow, audit_chain, audit_tampered, audit_page, audit_stats,
    )
    return {f.__name__: f for f in fs}


_TIME = "coalesce(" + ", ".join(f"TRY_CAST(try_strptime(rtrim(trim(created_at), 'Z'), '{f}') AS TIMESTAMP)" for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d")) + ")"
_SIG = f"SELECT DISTINCT id, status, merged_type, merged_conf, feedback_type, feedback_correct_type, {_TIME} AS created_ts FROM signals"


def oracle_sql():
    logs = "SELECT concat('log', user_id % 16) AS log, count(*) AS n_events"
    ekey = B.KEY.format("entity_id")
    fb = _TIME.replace("created_at", "feedback_at")
    rev = f"SELECT DISTINCT id, status, ground_truth_type, {fb} AS feedback_ts FROM signals"
    models = f"SELECT model_version AS version, max({_TIME}) AS promoted_at, row_number() OVER (ORDER BY max({_TIME}) DESC NULLS LAST, model_version DESC) AS k FROM signals WHERE model_version IS NOT NULL GROUP BY model_version"
    how = "CASE WHEN confidence >= 0.9 THEN 'confirmed' WHEN confidence >= 0.6 THEN 'changed' ELSE 'rejected' END"
    before = "greatest(start - 50, 0)"
    place = "CASE WHEN created_ts < TIMESTAMP '2025-06-01' - INTERVAL 90 DAYS AND coalesce(status, '') <> 'training' THEN 'archive' ELSE 'active' END"
    return {
        "document_entities": f'SELECT doc, span_id, row_number() OVER (PARTITION BY doc ORDER BY start, "end", span_id) AS place FROM ({B.SPANS})',
        "newest_corrections": f"SELECT detected_type, id, row_number() OVER (PARTITION BY detected_type ORDER BY reviewed_at DESC NULLS LAST, id) AS place FROM ({_CORR}) QUALIFY place <= 20",
        "patterns_of_type": f"SELECT coalesce(CASE WHEN decision = 'changed' THEN correct_type END, detected_type) AS entity_type, lower(trim(entity_text)) AS text, decision, count(*) AS n FROM ({_CORR}) WHERE entity_text IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
        "entities_latest": "SELECT id, entity_type, round(llm, 6) AS llm_confidence FROM (SELECT DISTINCT id, entity_type, confidence, CASE WHEN isnan(llm_confidence) THEN NULL ELSE llm_confidence END AS llm FROM entities) QUALIFY row_number() OVER (PARTITION BY id ORDER BY llm DESC NULLS LAST, entity_type DESC NULLS LAST, confidence DESC NULLS LAST) = 1",
        "entities_upserted": f"WITH c AS (SELECT {ekey} AS span_id, max(correct_type) AS entity_type FROM corrections WHERE decision = 'changed' AND {ekey} IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT span_id, entity_type, source FROM ({B.SPANS})) SELECT * FROM e WHERE span_id NOT IN (SELECT span_id FROM c) UNION ALL SELECT span_id, entity_type, 'review' FROM c",
        "entities_patched": f"SELECT e.span_id, coalesce(c.confidence, e.confidence) AS confidence FROM (SELECT DISTINCT span_id, confidence FROM ({B.SPANS})) e LEFT JOIN (SELECT {ekey} AS span_id, max(CASE WHEN isnan(ner_confidence) THEN NULL ELSE ner_confidence END) AS confidence FROM corrections WHERE {ekey} IS NOT NULL GROUP BY 1) c ON e.span_id = c.span_id",
        "appended_rows": "SELECT DISTINCT id, role, conversation_id FROM messages",
        "deleted_cascade": "WITH m AS (SELECT DISTINCT id, conversation_id FROM messages) SELECT * FROM m WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT conversation_id FROM m WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING count(*) <= 3)",
        "marked_scanned": f"SELECT * FROM (SELECT count_if(scanned_at IS NULL) AS n_new, CAST(0 AS BIGINT) AS n_open FROM (SELECT DISTINCT id, scanned_at FROM scan_documents)), (SELECT count_if(confidence >= 0.95) AS n_auto, count_if(confidence < 0.95) AS n_review FROM ({B.SPANS}) s WHERE doc IN (SELECT id FROM scan_documents WHERE scanned_at IS NULL))",
        "applied_decisions": f"""SELECT sha256(concat(span_id, '|', decision)) AS id, span_id AS entity_id, decision, CASE WHEN decision = 'changed' THEN 'OTHER' END AS correct_type, substr(doc_text, {before} + 1, start - {before}) AS context_before, substr(doc_text, "end" + 1, 50) AS context_after FROM (SELECT *, {how} AS decision FROM ({B.SPANS})) e LEFT JOIN ({B.TEXTS}) t ON e.doc = t.doc""",
        "pending_newest": f"SELECT id, merged_type, merged_conf FROM ({_SIG}) WHERE status = 'pending' AND merged_conf < 0.95 ORDER BY created_ts DESC NULLS LAST, id LIMIT 30",
        "captured_signals": "SELECT DISTINCT id, merged_type, merged_conf, 'pending' AS status FROM span_signals WHERE merged_conf < 0.95 AND NOT isnan(merged_conf)",
        "learned_signals": f"WITH h AS (SELECT DISTINCT span_id FROM ({B.SPANS}) WHERE source = 'rule' AND confidence < 0.95) SELECT span_id AS id, 'reviewed' AS status, NULL AS merged_type FROM h UNION ALL SELECT span_id, 'pending', entity_type FROM ({B.SPANS}) WHERE confidence < 0.95 AND span_id NOT IN (FROM h)",
        "missed_reports": f"SELECT c.doc, missed_text, correct_type, CAST(CASE WHEN instr(doc_text, missed_text) > 0 THEN instr(doc_text, missed_text) - 1 END AS INT) AS missed_start, CAST(CASE WHEN instr(doc_text, missed_text) > 0 THEN instr(doc_text, missed_text) - 1 + length(missed_text) END AS INT) AS missed_end FROM (SELECT DISTINCT {B.KEY.format('document_id')} AS doc, entity_text AS missed_text, detected_type AS correct_type FROM corrections WHERE decision = 'confirmed' AND entity_text IS NOT NULL) c LEFT JOIN ({B.TEXTS}) t ON c.doc = t.doc WHERE c.doc IS NOT NULL",
        "labelled_signals": f"SELECT id, ground_truth_type, row_number() OVER (ORDER BY feedback_ts DESC NULLS LAST, id) AS place FROM ({rev}) WHERE status = 'reviewed' AND ground_truth_type IS NOT NULL",
        "signals_used": f"WITH u AS (SELECT id FROM ({rev}) WHERE status = 'reviewed' AND ground_truth_type IS NOT NULL) SELECT CASE WHEN id IN (FROM u) THEN 'training' ELSE status END AS status, CASE WHEN id IN (FROM u) THEN 'run-1' END AS run_id, count(*) AS n FROM ({rev}) GROUP BY ALL",
        "store_stats": f"WITH s AS (SELECT s.id, CASE WHEN {place} = 'archive' AND status = 'pending' THEN 'expired' ELSE status END AS status, {place} AS place, ground_truth_type FROM ({_SIG}) s JOIN (SELECT DISTINCT id, ground_truth_type FROM signals) t ON s.id = t.id) SELECT count_if(place = 'active') AS n_active, count_if(place = 'active' AND status = 'pending') AS n_pending, count_if(place = 'active' AND status = 'reviewed') AS n_reviewed, count_if(place = 'active' AND status = 'reviewed' AND ground_truth_type IS NOT NULL) AS n_labelled, (SELECT count_if(reviewed_at IS NULL) FROM (SELECT DISTINCT id, reviewed_at FROM corrections)) AS n_missed, count_if(place = 'archive') AS n_archived, (SELECT version FROM ({models}) WHERE k = 1) AS active_model FROM s",
        "model_registry": f"SELECT 'm-next' AS version, 'active' AS status UNION ALL SELECT version, 'rolled_back' FROM ({models}) WHERE k <= 2",
        "model_rollback": f"SELECT version, CASE WHEN k = 2 OR (k = 1 AND n = 1) THEN 'active' ELSE 'rolled_back' END AS status FROM (SELECT *, count(*) OVER () AS n FROM ({models}))",
        "model_shadow": f"SELECT version, 'rolled_back' AS status FROM ({models}) UNION ALL SELECT 'm-good', 'active' UNION ALL SELECT 'm-bad', 'refused'",
        "review_queue": f"SELECT span_id, e.doc, entity_type, confidence FROM ({B.SPANS}) e JOIN (SELECT DISTINCT id AS doc FROM scan_documents WHERE content IS NOT NULL) d ON e.doc = d.doc WHERE confidence < 0.95 AND NOT EXISTS (SELECT 1 FROM ({_CORR}) c WHERE c.entity_key = e.span_id) ORDER BY confidence, span_id LIMIT 100",
        "review_stats": f"SELECT * FROM (SELECT count(*) AS n_documents, count_if(scanned_at IS NULL) AS n_unscanned FROM (SELECT DISTINCT id, scanned_at FROM scan_documents)), (SELECT count(*) AS n_entities, count_if(confidence >= 0.95) AS n_auto FROM ({B.SPANS})), (SELECT count(*) AS n_reviewed, count_if(decision = 'confirmed') AS n_confirmed, count_if(decision = 'rejected') AS n_rejected, count_if(decision = 'changed') AS n_changed FROM ({_CORR}))",
        "top_false_positives": f"SELECT entity_text, detected_type, count(*) AS n FROM ({_CORR}) WHERE decision = 'rejected' GROUP BY ALL ORDER BY n DESC, entity_text, detected_type LIMIT 10",
        "entities_without_deleted": "SELECT DISTINCT id FROM entities WHERE id NOT IN (SELECT record_id FROM deletions WHERE table_name = 'entities')",
        "unscanned_documents": "SELECT DISTINCT id, source FROM scan_documents WHERE scanned_at IS NULL",
        "span_signal_counts": "SELECT count(*) AS n_total, count(ground_truth_type) AS n_labelled, count_if(ground_truth_type <> 'NONE') AS n_positive, count_if(ground_truth_type IS NULL) AS n_unlabelled FROM (SELECT DISTINCT id, ground_truth_type FROM span_signals)",
        "feedback_truth": f"SELECT id, CASE lower(trim(feedback_type)) WHEN 'tp' THEN merged_type WHEN 'wl' THEN feedback_correct_type WHEN 'fp' THEN 'NONE' END AS truth FROM ({_SIG})",
        "signal_archive": f"SELECT place, CASE WHEN place = 'archive' AND status = 'pending' THEN 'expired' ELSE status END AS status, count(*) AS n FROM (SELECT *, CASE WHEN created_ts < TIMESTAMP '2025-06-01' - INTERVAL 90 DAYS AND coalesce(status, '') <> 'training' THEN 'archive' ELSE 'active' END AS place FROM ({_SIG})) GROUP BY ALL",
        "pending_signals": f"SELECT id, merged_type, merged_conf FROM ({_SIG}) WHERE status = 'pending' AND merged_conf < 0.95 ORDER BY created_ts NULLS FIRST, id LIMIT 50",
        "audit_chain": f"{logs}, true AS valid FROM events GROUP BY 1",
        "audit_tampered": "SELECT concat('log', user_id % 16) AS log, CAST(3 AS BIGINT) AS first_bad, false AS valid FROM events GROUP BY 1",
        "audit_page": "SELECT event_id AS sequence, event_type, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
        "audit_stats": "SELECT event_type, count(*) AS n_events, min(ts) AS first_at, max(ts) AS last_at, count_if(ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS) AS n_recent FROM events GROUP BY event_type",
    }
