"""Queries over evaluations: detections against reviewed or labelled spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog import lists as L
from veilwork.functions.folds import first_come_sql
from veilwork.operators import evaluate as M
from veilwork.plans import base as B
from veilwork.runtime import clean_key, table


def _gold(spark, sf_dir):
    """Gold spans: what reviewers confirmed, or gave another type."""
    c = table(spark, sf_dir, "corrections").where("decision IN ('confirmed', 'changed') AND entity_start IS NOT NULL AND entity_end IS NOT NULL")
    kind = F.when(F.col("decision") == "changed", F.coalesce("correct_type", "detected_type")).otherwise(F.col("detected_type"))
    return c.select(F.col("id").alias("span_id"), clean_key(F.col("document_id")).alias("doc"), F.col("entity_start").alias("start"), F.col("entity_end").alias("end"), kind.alias("entity_type")).where("doc IS NOT NULL").distinct()


def _pred(spark, sf_dir):
    return B.entity_spans(spark, sf_dir)


_GOLD = f"""SELECT DISTINCT id AS span_id, {B.KEY.format('document_id')} AS doc, entity_start AS start, entity_end AS "end", CASE WHEN decision = 'changed' THEN coalesce(correct_type, detected_type) ELSE detected_type END AS entity_type
FROM corrections WHERE decision IN ('confirmed', 'changed') AND entity_start IS NOT NULL AND entity_end IS NOT NULL AND {B.KEY.format('document_id')} IS NOT NULL"""
_PRED = B.SPANS


def greedy_matches(spark, sf_dir):
    return M.greedy_matches(_pred(spark, sf_dir), _gold(spark, sf_dir))


def score_table(spark, sf_dir):
    p, g = _pred(spark, sf_dir), _gold(spark, sf_dir)
    return M.score_table(M.outcomes(p, g, M.greedy_matches(p, g)))


def score_by_decision(spark, sf_dir):
    c = table(spark, sf_dir, "corrections").select("id", "decision", "detected_type", "correct_type").distinct()
    o = c.select(F.element_at(F.create_map(F.lit("confirmed"), F.lit("tp"), F.lit("rejected"), F.lit("fp"), F.lit("changed"), F.lit("fn")), F.col("decision")).alias("outcome"), F.col("detected_type").alias("entity_type"), F.col("decision").alias("component"))
    t = M.score_table(o)
    return t.select("entity_type", "component", "level", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def semeval_modes(spark, sf_dir):
    return M.semeval(_pred(spark, sf_dir), _gold(spark, sf_dir))


def correction_scores(spark, sf_dir):
    c = table(spark, sf_dir, "corrections").select("id", "decision", "detected_type", "correct_type").distinct()
    return M.from_corrections(c).withColumn("precision", F.round("precision", 9))


def exact_counts(spark, sf_dir):
    return M.exact_counts(_pred(spark, sf_dir), _gold(spark, sf_dir))


def confusion_matrix(spark, sf_dir):
    s = table(spark, sf_dir, "span_signals").select("id", "ground_truth_type", "merged_type").distinct().where("ground_truth_type IS NOT NULL")
    return M.confusion(s, "ground_truth_type", "merged_type")


def _scored(spark, sf_dir):
    s = table(spark, sf_dir, "span_signals").select("id", "merged_conf", "merged_type", "ground_truth_type").distinct().where("ground_truth_type IS NOT NULL AND merged_conf IS NOT NULL")
    return s.select("merged_conf", (F.col("merged_type") == F.col("ground_truth_type")).alias("ok"))


_SCORED = "SELECT merged_conf, merged_type = ground_truth_type AS ok FROM (SELECT DISTINCT id, merged_conf, merged_type, ground_truth_type FROM span_signals) WHERE ground_truth_type IS NOT NULL AND merged_conf IS NOT NULL"


def calibration_bins(spark, sf_dir):
    return M.calibration(_scored(spark, sf_dir), "merged_conf", "ok").select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("share", 9).alias("share"))


def calibration_error(spark, sf_dir):
    return M.calibration_error(_scored(spark, sf_dir), "merged_conf", "ok").select(F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"))


def threshold_sweep(spark, sf_dir):
    t = M.threshold_sweep(_scored(spark, sf_dir).where("ok IS NOT NULL"), "merged_conf", "ok")
    return t.select("threshold", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


def error_reasons(spark, sf_dir):
    e = B.entity_spans(spark, sf_dir)
    return e.select("span_id", M.error_reason(F.col("text"), F.col("entity_type")).alias("reason"))


def _tags(spark, sf_dir):
    tag = F.element_at(F.array(*map(F.lit, ["O", "B-NAME", "I-NAME", "B-DATE", "I-DATE"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), tag.alias("tag"))


def bio_spans(spark, sf_dir):
    return M.bio_spans(_tags(spark, sf_dir))


def gold_labels(spark, sf_dir):
    return M.label_by_gold(_pred(spark, sf_dir), _gold(spark, sf_dir).select("doc", "start", "end", "entity_type"))


def run_trend(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return M.run_trend(o.select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"), (F.col("o_custkey") % 1000 / 1000).alias("f1"))).select("dataset", "run_id", "delta_f1", "is_latest")


def missed_trace(spark, sf_dir):
    p = _pred(spark, sf_dir)
    t = M.trace_missed(_gold(spark, sf_dir), p.where("confidence >= 0.9"), {"rule": p.where("source = 'rule'"), "model": p.where("source = 'model'")})
    return t.select("span_id", "seen_rule", "seen_model", "issue")


def _types(spark, sf_dir):
    """Every type and label that the tables name."""
    d = table(spark, sf_dir, "detector_labels")
    some = table(spark, sf_dir, "entities").select(F.col("entity_type").alias("t")).unionByName(d.select(F.col("entity_type").alias("t"))).unionByName(d.select(F.col("raw_label").alias("t")))
    return some.unionByName(table(spark, sf_dir, "span_signals").select(F.explode(F.array("phi_bert_type", "pii_bert_type", "presidio_type", "rule_type")).alias("t"))).where("t IS NOT NULL").distinct()


def type_groups(spark, sf_dir):
    return _types(spark, sf_dir).select("t", M.type_group(F.col("t")).alias("type_group"), M.report_type(F.col("t")).alias("reported"), M.evaluation_category(F.col("t")).alias("category"), M.gold_label(F.col("t")).alias("label"))


def type_categories(spark, sf_dir):
    return _types(spark, sf_dir).select("t", M.category(F.col("t")).alias("category"))


def run_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = M.run_summary(o.select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"), (F.col("o_custkey") % 1000 / 1000).alias("f1")))
    return r.select("dataset", "n_runs", F.round("avg_f1", 9).alias("avg_f1"), "best_f1", "worst_f1", F.round("recent_f1", 9).alias("recent_f1"), "trend")


def error_examples(spark, sf_dir):
    s = table(spark, sf_dir, "span_signals").select("id", "ground_truth_type", "merged_type", "span_text").distinct().where("ground_truth_type IS NOT NULL")
    return M.error_examples(s, "ground_truth_type", "merged_type", "span_text").select("truth", "named", "n", F.array_join("examples", "|").alias("examples"))


def calibration_samples(spark, sf_dir):
    s = B.entity_spans(spark, sf_dir).select("doc", "span_id", "start", "end", "entity_type", F.col("confidence").alias("ner"))
    return M.calibration_samples(s, _gold(spark, sf_dir), ["ner"]).select("span_id", "detector", "score", "actual")


def captured_errors(spark, sf_dir):
    p = _pred(spark, sf_dir)
    return M.errors_as_corrections(p, M.greedy_matches(p, _gold(spark, sf_dir)), B.texts(spark, sf_dir)).select("span_id", "entity_text", "decision", "context_before", "context_after")


def recommended_threshold(spark, sf_dir):
    return M.recommended_threshold(M.threshold_sweep(_scored(spark, sf_dir).where("ok IS NOT NULL"), "merged_conf", "ok"), 0.9)


def queries():
    fs = (greedy_matches, score_table, score_by_decision, semeval_modes, correction_scores, exact_counts, confusion_matrix, calibration_bins, calibration_error, threshold_sweep, recommended_threshold, error_reasons, bio_spans, gold_labels, run_trend, run_summary, error_examples, calibration_samples, captured_errors, missed_trace, type_groups, type_categories)
    return {f.__name__: f for f in fs}


def _member_sql(n: str, groups: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {n} IN ({B.quoted([m.replace('_', '').replace('-', '') for m in members])}) THEN '{name}'" for name, members in groups.items()) + " END"


def _group_sql(c: str) -> str:
    n = f"translate(upper({c}), '_- ', '')"
    return f"coalesce({_member_sql(n, L.TYPE_GROUPS)}, {n})"


def label_sql(c: str) -> str:
    """The type that a label means, in SQL."""
    bare = f"upper(regexp_replace(trim({c}), '^[BbIi]-', ''))"
    n = f"translate({bare}, '_- ', '')"
    return f"CASE WHEN {n} NOT IN ({B.quoted([x.replace('_', '') for x in L.EXCLUDED_LABELS])}) THEN coalesce({_member_sql(n, L.GOLD_LABELS)}, {bare}) END"


def _greedy_sql() -> str:
    shared = "greatest(least(p_e, g_e) - greatest(p_s, g_s), 0)"
    near = f"""SELECT p.doc, pred, gold, p_s, p_e, g_s, ratio FROM (SELECT *, {shared} / nullif(least(p_e - p_s, g_e - g_s), 0) AS ratio, {shared} AS shared FROM (SELECT doc, span_id AS pred, start AS p_s, "end" AS p_e, {_group_sql('entity_type')} AS p_t FROM ({_PRED})) p JOIN (SELECT doc AS g_d, span_id AS gold, start AS g_s, "end" AS g_e, {_group_sql('entity_type')} AS g_t FROM ({_GOLD})) g ON doc = g_d AND p_t = g_t) p WHERE shared > 0 AND ratio >= 0.5"""
    lists = f"SELECT doc, list([{{'pred': pred, 'gold': gold}}] ORDER BY p_s, p_e, pred, -ratio, g_s, gold) AS c FROM ({near}) GROUP BY doc"
    return f"SELECT doc, k.pred AS pred, k.gold AS gold FROM (SELECT doc, unnest({first_come_sql('c', 'pred', 'gold')}) AS k FROM ({lists}))"


def _score_sql() -> str:
    m = f"m AS ({_greedy_sql()}), p AS ({_PRED}), g AS ({_GOLD})"
    rows = """SELECT 'tp' AS outcome, g.entity_type, p.source AS component FROM m JOIN g ON g.doc = m.doc AND g.span_id = m.gold JOIN p ON p.doc = m.doc AND p.span_id = m.pred
UNION ALL SELECT 'fp', entity_type, source FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc = p.doc AND m.pred = p.span_id)
UNION ALL SELECT 'fn', entity_type, 'none' FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc = g.doc AND m.gold = g.span_id)"""
    return f"""WITH {m} SELECT entity_type, component, level, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
FROM (SELECT entity_type, component, CAST(grouping_id(entity_type, component) AS BIGINT) AS level, count_if(outcome = 'tp') AS tp, count_if(outcome = 'fp') AS fp, count_if(outcome = 'fn') AS fn FROM ({rows}) GROUP BY GROUPING SETS ((), (entity_type), (component)))"""


def _semeval_sql() -> str:
    side = lambda src, name: f'{name} AS (SELECT *, row_number() OVER (PARTITION BY doc, start, "end" ORDER BY span_id) AS k FROM ({src}))'
    eq = 'eq AS (SELECT g.doc, g.span_id AS gold, p.span_id AS pred, g.entity_type IS NOT DISTINCT FROM p.entity_type AS same FROM g JOIN p ON g.doc = p.doc AND g.start = p.start AND g."end" = p."end" AND g.k = p.k)'
    left = lambda s, key: f"l{s} AS (SELECT * FROM {s} WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.doc = {s}.doc AND eq.{key} = {s}.span_id))"
    cand = """c AS (SELECT lg.doc, list([{'pred': lp.span_id, 'gold': lg.span_id, 'same': lg.entity_type IS NOT DISTINCT FROM lp.entity_type}] ORDER BY lg.start, lg."end", lg.span_id, lp.start, lp."end", lp.span_id) AS c FROM lg JOIN lp ON lg.doc = lp.doc AND lg.start < lp."end" AND lp.start < lg."end" GROUP BY lg.doc)"""
    ov = f"ov AS (SELECT k.same AS same FROM (SELECT unnest({first_come_sql('c', 'pred', 'gold')}) AS k FROM c))"
    n = """n AS (SELECT (SELECT count(*) FROM eq WHERE same) AS es, (SELECT count(*) FROM eq WHERE NOT same) AS ed, (SELECT count(*) FROM ov WHERE same) AS os, (SELECT count(*) FROM ov WHERE NOT same) AS od,
(SELECT count(*) FROM lg) - (SELECT count(*) FROM ov) AS missed, (SELECT count(*) FROM lp) - (SELECT count(*) FROM ov) AS spurious)"""
    modes = """SELECT 'strict' AS mode, es AS correct, ed + os + od AS incorrect, 0 AS partial, missed, spurious FROM n UNION ALL SELECT 'exact', es + ed, os + od, 0, missed, spurious FROM n
UNION ALL SELECT 'partial', es + ed, 0, os + od, missed, spurious FROM n UNION ALL SELECT 'type', es, ed + od, os, missed, spurious FROM n"""
    return f"""WITH {side(_GOLD, 'g')}, {side(_PRED, 'p')}, {eq}, {left('g', 'gold')}, {left('p', 'pred')}, {cand}, {ov}, {n}, m AS ({modes}),
t AS (SELECT *, correct + incorrect + partial + missed AS possible, correct + incorrect + partial + spurious AS actual, correct + CASE WHEN mode = 'partial' THEN 0.5 * partial ELSE 0 END AS credit FROM m),
s AS (SELECT * EXCLUDE (credit), coalesce(credit / nullif(actual, 0), 0) AS precision, coalesce(credit / nullif(possible, 0), 0) AS recall FROM t)
SELECT mode, CAST(correct AS BIGINT) AS correct, CAST(incorrect AS BIGINT) AS incorrect, CAST(partial AS BIGINT) AS partial, missed, spurious, CAST(possible AS BIGINT) AS possible, CAST(actual AS BIGINT) AS actual, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS DOUBLE) AS f1 FROM s"""


def oracle_sql():
    c = "SELECT DISTINCT id, decision, detected_type, correct_type FROM corrections"
    f1 = "round(CASE WHEN 2 * tp + fp + fn = 0 OR tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1"
    prf = f"round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, {f1}"
    words = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))"
    shared = 'greatest(least("end", g_e) - greatest(start, g_s), 0) / greatest("end" - start, g_e - g_s)'
    d = "SELECT entity_type AS t FROM entities UNION SELECT entity_type FROM detector_labels UNION SELECT raw_label FROM detector_labels UNION SELECT unnest([phi_bert_type, pii_bert_type, presidio_type, rule_type]) FROM span_signals"
    flat = "translate(upper(t), '_', '')"
    norm = "translate(upper(t), '_- ', '')"
    parts = " ".join(f"WHEN regexp_matches({norm}, '{'|'.join(p.split())}') THEN '{name}'" for name, p in M.CATEGORY_PARTS)
    runs = "(SELECT o_orderpriority AS dataset, o_custkey % 1000 / 1000 AS f1, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)"
    scored_sweep = f"SELECT threshold, count_if(merged_conf >= threshold AND ok) AS tp, count_if(merged_conf < threshold AND ok) AS fn FROM ({_SCORED}), (SELECT CAST(unnest(range(10, 86, 5)) AS DOUBLE) / 100 AS threshold) WHERE ok IS NOT NULL GROUP BY threshold"
    near = f'greatest(least("end", g_e) - greatest(start, g_s), 0) / nullif(least("end" - start, g_e - g_s), 0) >= 0.5'
    before = "greatest(start - 50, 0)"
    return {
        "greedy_matches": _greedy_sql(),
        "score_table": _score_sql(),
        "semeval_modes": _semeval_sql(),
        "type_groups": f"SELECT t, {_group_sql('t')} AS type_group, coalesce({_member_sql(flat, L.REPORT_TYPES)}, upper(t)) AS reported, {_member_sql(norm, L.EVALUATION_CATEGORIES)} AS category, {label_sql('t')} AS label FROM ({d}) WHERE t IS NOT NULL",
        "type_categories": f"SELECT t, CASE WHEN {norm} = '' THEN 'OTHER' {parts} ELSE 'OTHER' END AS category FROM ({d}) WHERE t IS NOT NULL",
        "run_summary": f"SELECT dataset, count(*) AS n_runs, round(avg(f1), 9) AS avg_f1, max(f1) AS best_f1, min(f1) AS worst_f1, round(avg(f1) FILTER (WHERE k <= 5), 9) AS recent_f1, CASE WHEN count(*) < 2 THEN 'insufficient_data' WHEN max(f1) FILTER (WHERE k = 1) > arg_max(f1, k) FILTER (WHERE k <= 5) THEN 'improving' WHEN max(f1) FILTER (WHERE k = 1) < arg_max(f1, k) FILTER (WHERE k <= 5) THEN 'declining' ELSE 'stable' END AS trend FROM {runs} WHERE k <= 100 GROUP BY dataset",
        "error_examples": "SELECT truth, named, CAST(sum(n) AS BIGINT) AS n, string_agg(example, '|' ORDER BY example) FILTER (WHERE k <= 5) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY truth, named ORDER BY example NULLS FIRST) AS k FROM (SELECT ground_truth_type AS truth, merged_type AS named, span_text AS example, count(*) AS n FROM (SELECT DISTINCT id, ground_truth_type, merged_type, span_text FROM span_signals) WHERE ground_truth_type IS NOT NULL AND ground_truth_type IS DISTINCT FROM merged_type GROUP BY ALL)) GROUP BY truth, named",
        "calibration_samples": f"""SELECT span_id, 'ner' AS detector, confidence AS score, coalesce(bool_or({near} AND g_t = {_group_sql('entity_type')}), false) AS actual FROM ({_PRED}) p LEFT JOIN (SELECT doc AS g_d, start AS g_s, "end" AS g_e, {_group_sql('entity_type')} AS g_t FROM ({_GOLD})) g ON p.doc = g_d WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY p.doc, span_id, confidence""",
        "captured_errors": f"""SELECT p.span_id, p.text AS entity_text, CASE WHEN m.pred IS NULL THEN 'rejected' ELSE 'confirmed' END AS decision, substr(doc_text, {before} + 1, start - {before}) AS context_before, substr(doc_text, "end" + 1, 50) AS context_after FROM ({_PRED}) p JOIN ({B.TEXTS}) t ON p.doc = t.doc LEFT JOIN ({_greedy_sql()}) m ON m.doc = p.doc AND m.pred = p.span_id""",
        "recommended_threshold": f"SELECT coalesce(min(threshold) FILTER (WHERE tp / nullif(tp + fn, 0) >= 0.9), 0.3) AS threshold FROM ({scored_sweep})",
        "score_by_decision": f"SELECT entity_type, component, level, tp, fp, fn, {prf} FROM (SELECT entity_type, component, CAST(grouping_id(entity_type, component) AS BIGINT) AS level, count_if(outcome = 'tp') AS tp, count_if(outcome = 'fp') AS fp, count_if(outcome = 'fn') AS fn FROM (SELECT CASE decision WHEN 'confirmed' THEN 'tp' WHEN 'rejected' THEN 'fp' WHEN 'changed' THEN 'fn' END AS outcome, detected_type AS entity_type, decision AS component FROM ({c})) GROUP BY GROUPING SETS ((), (entity_type), (component)))",
        "correction_scores": f"SELECT entity_type, tp, fp, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision FROM (SELECT t AS entity_type, count_if(o = 'tp') AS tp, count_if(o = 'fp') AS fp FROM (SELECT 'tp' AS o, detected_type AS t FROM ({c}) WHERE decision = 'confirmed' UNION ALL SELECT 'fp', detected_type FROM ({c}) WHERE decision IN ('rejected', 'changed') UNION ALL SELECT 'tp', coalesce(correct_type, detected_type) FROM ({c}) WHERE decision = 'changed') GROUP BY t)",
        "exact_counts": f"""WITH p AS (SELECT doc, start, "end", min(entity_type) AS p FROM ({_PRED}) GROUP BY ALL), g AS (SELECT doc, start, "end", min(entity_type) AS g FROM ({_GOLD}) GROUP BY ALL) SELECT coalesce(g, p) AS entity_type, coalesce(count_if(p = g), 0) AS tp, count_if(g IS NULL) AS fp, count_if(p IS NULL) AS fn, coalesce(count_if(p <> g), 0) AS type_errors FROM p FULL JOIN g USING (doc, start, "end") GROUP BY 1""",
        "confusion_matrix": "SELECT ground_truth_type AS truth, merged_type AS named, count(*) AS n FROM (SELECT DISTINCT id, ground_truth_type, merged_type FROM span_signals) WHERE ground_truth_type IS NOT NULL GROUP BY ALL",
        "calibration_bins": f"SELECT CAST(floor(merged_conf * 10) AS INT) AS bin, count(*) AS n, round(avg(merged_conf), 9) AS mean_p, round(avg(CAST(ok AS INT)), 9) AS share FROM ({_SCORED}) WHERE merged_conf < 1 GROUP BY 1",
        "calibration_error": f"SELECT round(brier, 9) AS brier, round(gap / total, 9) AS ece FROM (SELECT avg((merged_conf - CAST(ok AS INT)) ** 2) AS brier, count(*) AS total FROM ({_SCORED})), (SELECT sum(n * abs(p - s)) AS gap FROM (SELECT count(*) AS n, avg(merged_conf) AS p, avg(CAST(ok AS INT)) AS s FROM ({_SCORED}) WHERE merged_conf < 1 GROUP BY floor(merged_conf * 10)))",
        "threshold_sweep": f"SELECT threshold, tp, fp, fn, {f1} FROM (SELECT threshold, count_if(merged_conf >= threshold AND ok) AS tp, count_if(merged_conf >= threshold AND NOT ok) AS fp, count_if(merged_conf < threshold AND ok) AS fn FROM ({_SCORED}), (SELECT CAST(unnest(range(10, 86, 5)) AS DOUBLE) / 100 AS threshold) WHERE ok IS NOT NULL GROUP BY threshold)",
        "error_reasons": f"SELECT span_id, CASE WHEN length(text) <= 2 THEN 'too_short' WHEN regexp_full_match(text, '[0-9]+') AND length(text) < 5 THEN 'short_number' WHEN lower(text) IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for') THEN 'common_word' WHEN entity_type IN ('ADDRESS', 'LOCATION') AND {words} = 1 THEN 'single_word_address' WHEN entity_type IN ('NAME_PERSON', 'NAME_PATIENT') AND {words} = 1 THEN 'single_word_name' WHEN regexp_matches(text, '[0-9]') AND regexp_matches(text, '\\p{{L}}') THEN 'mixed_alphanumeric' ELSE 'unknown' END AS reason FROM ({B.SPANS})",
        "bio_spans": "WITH t AS (SELECT o_custkey AS doc, o_orderkey AS pos, ['O', 'B-NAME', 'I-NAME', 'B-DATE', 'I-DATE'][o_orderkey % 5 + 1] AS tag FROM orders), k AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS kind FROM t), f AS (SELECT *, CASE WHEN kind IS NOT NULL AND (tag LIKE 'B-%' OR coalesce(lag(kind) OVER w <> kind, true)) THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos)) SELECT doc, kind AS entity_type, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM f) WHERE kind IS NOT NULL GROUP BY doc, run, kind",
        "gold_labels": f"""SELECT doc, span_id, coalesce(arg_max(g_t, row(near, ratio, g_t)) FILTER (WHERE near OR ratio > 0.5), 'NONE') AS truth FROM (SELECT p.doc, span_id, g_t, abs(start - g_s) <= 2 AND abs("end" - g_e) <= 2 AS near, {shared} AS ratio FROM ({_PRED}) p LEFT JOIN (SELECT doc AS gd, start AS g_s, "end" AS g_e, entity_type AS g_t FROM ({_GOLD})) g ON p.doc = g.gd) GROUP BY doc, span_id""",
        "missed_trace": f"""SELECT span_id, r AS seen_rule, m AS seen_model, CASE WHEN r OR m THEN 'lost in merge' ELSE 'never detected' END AS issue FROM (SELECT span_id, EXISTS (SELECT 1 FROM p WHERE p.doc = g.doc AND source = 'rule' AND g.start < p."end" AND p.start < g."end") AS r, EXISTS (SELECT 1 FROM p WHERE p.doc = g.doc AND source = 'model' AND g.start < p."end" AND p.start < g."end") AS m FROM ({_GOLD}) g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = g.doc AND confidence >= 0.9 AND g.start < p."end" AND p.start < g."end"))""".replace(" p WHERE", f" ({_PRED}) p WHERE"),
        "run_trend": "SELECT o_orderpriority AS dataset, o_orderkey AS run_id, round(f1 - lag(f1) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey), 9) AS delta_f1, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest FROM (SELECT *, o_custkey % 1000 / 1000 AS f1 FROM orders)",
    }
