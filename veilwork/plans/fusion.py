"""Queries over fused evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog import lists as L
from veilwork.operators import fuse as E
from veilwork.operators import plugins as P
from veilwork.plans import base as B
from veilwork.runtime import table

_NONE = lambda c: F.when(F.length(F.trim(c)) > 0, F.upper(F.trim(c)))


def overlap_islands(spark, sf_dir):
    return E.overlap_groups(B.entity_spans(spark, sf_dir)).select("doc", "span_id", "grp")


def signal_vector(spark, sf_dir):
    return E.group_evidence(B.entity_spans(spark, sf_dir))


def tiered_merge(spark, sf_dir):
    return E.tiered_merge(B.entity_spans(spark, sf_dir))


def _signals(spark, sf_dir):
    s = table(spark, sf_dir, "span_signals")
    return s.select(
        F.col("id").alias("signal_id"), F.col("phi_bert_conf").alias("phi_conf"), F.col("pii_bert_conf").alias("pii_conf"), (F.col("rule_conf") / 100).alias("rule_conf"), (F.coalesce("rule_has_checksum", F.lit(0)) == 1).alias("has_checksum"),
        _NONE(F.regexp_replace("phi_bert_type", "(?i)^[bi]-", "")).alias("phi_type"), _NONE(F.col("pii_bert_type")).alias("pii_type"), _NONE(F.col("rule_type")).alias("rule_type"),
    ).distinct()


def staged_decision(spark, sf_dir):
    d = E.decide(_signals(spark, sf_dir))
    r = lambda c: F.round(c, 8).alias(c)
    return d.select("signal_id", r("phi_cal"), r("pii_cal"), "tier", r("combined"), r("final_conf"), "accepted", "final_type", "needs_review")


def two_model_decision(spark, sf_dir):
    s = _signals(spark, sf_dir)
    ok, conf, kind = E.resolve_two(F.col("phi_conf"), F.col("pii_conf"), F.col("phi_type"), F.col("pii_type"))
    return s.select("signal_id", ok.alias("accepted"), F.round(conf, 8).alias("confidence"), kind.alias("entity_type"), F.round(F.coalesce(F.col("phi_conf") * F.col("pii_conf"), F.lit(0.0)), 12).alias("agreement"))


def evidence_decision(spark, sf_dir):
    cols = [f"{d}_{x}" for d in ("rule", "presidio", "pii_bert", "phi_bert") for x in ("detected", "conf", "type")]
    s = table(spark, sf_dir, "span_signals").select("id", *cols, "sources_agree_count", "merged_type", "merged_conf").distinct()
    return E.accept_by_evidence(s).select("id", "evidence_type", F.round("evidence_conf", 9).alias("evidence_conf"), "evidence_ok")


def type_confusion(spark, sf_dir):
    s = B.entity_spans(spark, sf_dir)
    digits = F.concat(F.col("text"), F.lit(" "), F.regexp_replace("span_id", "[^0-9]", ""))
    long = s.withColumn("text", F.when(F.col("entity_type").isin("MRN", "DATE"), digits).otherwise(F.col("text")))
    kind, conf = E.repair_types(F.col("entity_type"), F.col("text"), F.col("confidence"))
    return long.select("span_id", kind.alias("entity_type"), F.round(conf, 8).alias("confidence"))


def person_refine(spark, sf_dir):
    s = B.spans_in_texts(spark, sf_dir).where("entity_type LIKE 'NAME%'")
    return s.select("span_id", E.refine_person(F.col("doc_text"), F.col("start"), F.col("end"), F.lit("NAME_PERSON")).alias("entity_type"))


def document_features(spark, sf_dir):
    return E.document_features(B.spans_in_texts(spark, sf_dir))


def _mentions(spark, sf_dir):
    # names that end in the same word co-refer
    s = B.entity_spans(spark, sf_dir).where("entity_type LIKE 'NAME%'")
    return s.select("doc", F.lower(F.regexp_extract("text", "[A-Za-z]+$", 0)).alias("cluster"), F.col("text").alias("mention"), F.col("start").alias("m_start"), F.col("end").alias("m_end"), "span_id")


def _seen(spark, sf_dir):
    return B.entity_spans(spark, sf_dir).where("entity_type LIKE 'NAME%' AND confidence >= 0.8")


def coref_propagation(spark, sf_dir):
    m = _mentions(spark, sf_dir).drop("span_id").distinct()
    return E.coref_spans(m, _seen(spark, sf_dir))


def coref_columns(spark, sf_dir):
    m = _mentions(spark, sf_dir).drop("span_id").distinct()
    return E.coref_columns(_seen(spark, sf_dir), m).select("doc", "span_id", "in_cluster", F.coalesce("cluster", F.lit("")).alias("cluster"), "cluster_size", F.coalesce("anchor_type", F.lit("")).alias("anchor_type"), F.round("anchor_conf", 9).alias("anchor_conf"))


def score_agreement(spark, sf_dir):
    s = _signals(spark, sf_dir)
    return s.select("signal_id", F.round(E.agreement(F.col("phi_conf"), F.col("pii_conf")), 12).alias("agreement"), F.round(E.disagreement(F.col("phi_conf"), F.col("pii_conf")), 12).alias("disagreement"))


def listed_spans(spark, sf_dir):
    """Spans through an allow list (towns) and a block list (drugs)."""
    t = table(spark, sf_dir, "dictionary_terms")
    out = E.apply_lists(B.entity_spans(spark, sf_dir), t.where("category = 'TOWN'"), t.where("category = 'DRUG'").select("term", F.lit("DRUG").alias("entity_type")))
    return out.select("span_id", "entity_type", "confidence")


def rule_mentions(spark, sf_dir):
    """Mentions that the co-reference rule finds in messages."""
    m = table(spark, sf_dir, "messages").select("id", "content").distinct()
    return P.resolve_coref("same_last_word", m, "id", "content").groupBy("doc", "cluster").agg(F.count(F.lit(1)).alias("n"))


def _letters_only():
    """A verifier by rule: a question about a text without digits is answered with yes."""
    return lambda prompts: ["NO, it has digits" if any(c.isdigit() for c in p[4 : p.index('" a ')]) else "Yes." for p in prompts]


def _broken():
    def ask(prompts):
        raise ConnectionError("no service")

    return ask


def verified_spans(spark, sf_dir):
    """Verdicts on every span under the threshold, and what stays."""
    P.register_verifier("letters", _letters_only)
    s = B.entity_spans(spark, sf_dir)
    v = P.verify(s, B.texts(spark, sf_dir), "letters")
    kept = P.apply_verdicts(s, v).select("span_id", F.lit(True).alias("kept"))
    return s.select("span_id").join(v, "span_id", "left").join(kept, "span_id", "left").select("span_id", F.coalesce("decision", F.lit("not asked")).alias("decision"), F.coalesce("verdict_conf", F.lit(0.0)).alias("verdict_conf"), F.coalesce("kept", F.lit(False)).alias("kept"))


def unverified_spans(spark, sf_dir):
    """A verifier that is down leaves every span uncertain."""
    P.register_verifier("broken", _broken)
    return P.verify(B.entity_spans(spark, sf_dir), B.texts(spark, sf_dir), "broken").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def _emails():
    import re

    p = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+")
    return lambda texts: [[(m.start(), m.end(), "EMAIL", 0.9) for m in p.finditer(t)] for t in texts]


def model_spans(spark, sf_dir):
    """A detector that is a Python function, over messages."""
    P.register_detector("emails", P.model_detector(_emails))
    m = table(spark, sf_dir, "messages").select("id", "content").distinct()
    return P.run_detector("emails", m, "id", "content").select("id", "start", "end", "text", "confidence", "source")


def compared_detectors(spark, sf_dir):
    """Two detectors against reviewed spans."""
    from veilwork.plans.evaluation import _gold

    P.register_detector("emails", P.model_detector(_emails))
    P.register_detector("nothing", P.model_detector(lambda: lambda texts: [[] for _ in texts]))
    gold = _gold(spark, sf_dir).where("entity_type = 'EMAIL'")
    return P.compare_detectors(["emails", "nothing"], B.texts(spark, sf_dir), "doc", "doc_text", gold).select("detector", "fn", F.col("recall").isNotNull().alias("scored")).where("detector = 'nothing'")


def queries():
    more = (coref_columns, score_agreement, listed_spans, rule_mentions, verified_spans, unverified_spans, model_spans, compared_detectors)
    return {f.__name__: f for f in more} | {f.__name__: f for f in (overlap_islands, signal_vector, tiered_merge, staged_decision, two_model_decision, evidence_decision, type_confusion, person_refine, document_features, coref_propagation)}


_ISLANDS = f"""SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc ORDER BY start, "end" DESC, span_id ROWS UNBOUNDED PRECEDING) AS INT) AS grp FROM (SELECT *, CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max("end") OVER (PARTITION BY doc ORDER BY start, "end" DESC, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({B.SPANS})))"""
_SIGNALS = """SELECT DISTINCT id AS signal_id, phi_bert_conf AS phi_conf, pii_bert_conf AS pii_conf, rule_conf / 100 AS rule_conf, coalesce(rule_has_checksum, 0) = 1 AS has_checksum,
 nullif(upper(trim(regexp_replace(phi_bert_type, '^[bBiI]-', ''))), '') AS phi_type, nullif(upper(trim(pii_bert_type)), '') AS pii_type, nullif(upper(trim(rule_type)), '') AS rule_type FROM span_signals"""


def _platt(c, model):
    a, b = L.PLATT[model]
    return f"CASE WHEN coalesce({c}, 0) > 0 THEN 1 / (1 + exp(-({a} * {c} + {b}))) ELSE 0 END"


def oracle_sql():
    clinical, general = B.quoted(L.CLINICAL_TYPES), B.quoted(L.GENERAL_TYPES)
    first = lambda col, order: f"arg_max({col}, {order})"
    longest = 'row("end" - start, -start, span_id)'
    surest = "row(confidence, span_id)"
    rank = "CASE source WHEN 'rule' THEN 4 WHEN 'presidio' THEN 3 WHEN 'merged' THEN 2 WHEN 'dictionary' THEN 2 WHEN 'model' THEN 1 ELSE 0 END"
    left, right = "lower(substr(doc_text, greatest(start - 50, 0) + 1, start - greatest(start - 50, 0)))", 'substr(lower(substr(doc_text, "end" + 1, 30)), 1, 15)'
    staff = " OR ".join([f"contains({left}, '{w}')" for w in L.STAFF_BEFORE] + [f"contains({right}, '{w}')" for w in L.STAFF_BEHIND])
    n, bare = "length(regexp_replace(t, '[^0-9]', '', 'g'))", "replace(replace(t, '-', ''), ' ', '')"
    m = "SELECT DISTINCT doc, lower(regexp_extract(text, '[A-Za-z]+$')) AS cluster, text AS mention, start AS m_start, \"end\" AS m_end FROM (" + B.SPANS + ") WHERE entity_type LIKE 'NAME%'"
    seen = f"SELECT * FROM ({B.SPANS}) WHERE entity_type LIKE 'NAME%' AND confidence >= 0.8"
    decided = f"""SELECT *, CASE WHEN has_checksum AND coalesce(rule_conf, 0) >= 0.95 THEN 0.99 ELSE combined + (1 - combined) * [{', '.join(map(str, L.TIER_BOOST))}][tier + 1] END AS final_conf FROM (SELECT *, CASE WHEN lead_type IN ({clinical}) THEN (CASE WHEN phi_cal > 0 THEN phi_cal ELSE pii_cal END) WHEN lead_type IN ({general}) THEN (CASE WHEN pii_cal > 0 THEN pii_cal ELSE phi_cal END) ELSE 1 - (1 - phi_cal) * (1 - pii_cal) END AS combined
FROM (SELECT *, {_platt('phi_conf', 'phi')} AS phi_cal, {_platt('pii_conf', 'pii')} AS pii_cal, CASE WHEN has_checksum THEN 3 WHEN coalesce(rule_conf, 0) >= 0.9 THEN 2 WHEN coalesce(rule_conf, 0) > 0 THEN 1 ELSE 0 END AS tier, coalesce(phi_type, pii_type, rule_type) AS lead_type, list_distinct(list_filter([phi_type, pii_type, rule_type], lambda x: x IS NOT NULL)) AS kinds FROM ({_SIGNALS})))"""
    a, b = "coalesce(phi_conf, 0)", "coalesce(pii_conf, 0)"
    best = "list_last(list_sort([row(coalesce(phi_conf, 0), phi_type), row(coalesce(pii_conf, 0), pii_type), row(coalesce(rule_conf, 0), rule_type)], 'ASC', 'NULLS FIRST'))[2]"
    sure = [("rule", 0.9), ("presidio", 0.7), ("pii_bert", 0.7), ("phi_bert", 0.7)]
    kinds = " ".join(f"WHEN {d}_detected = 1 AND {d}_conf >= {t} THEN {d}_type" for d, t in sure)
    confs = " ".join(f"WHEN {d}_detected = 1 AND {d}_conf >= {t} THEN {d}_conf" for d, t in sure)
    top = "greatest(" + ", ".join(f"coalesce({d}_conf, 0)" for d, _ in sure) + ")"
    from veilwork.plans.evaluation import _GOLD

    number = "regexp_matches(text, '[0-9]')"
    asked = f"coalesce(confidence < 0.95 AND doc IN (SELECT doc FROM ({B.TEXTS})), false)"
    clusters = f"SELECT m.doc, cluster, arg_max(entity_type, row(confidence, span_id)) AS t, max(confidence) AS c FROM m JOIN s ON m.doc = s.doc AND least(m_end, \"end\") - greatest(m_start, start) > 0 AND (least(m_end, \"end\") - greatest(m_start, start)) / least(m_end - m_start, \"end\" - start) > 0.5 GROUP BY m.doc, cluster"
    mail, word = "[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+", "(?:[A-Z][\\w''-]+ )*[A-Z][\\w''-]+"
    msg = "(SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL)"
    from veilwork.catalog.rules import Rule
    from veilwork.plans.detection import span_sql

    return {
        "coref_columns": f"""WITH m AS ({m}), s AS ({seen}), a AS ({clusters}), z AS (SELECT doc, cluster, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT doc, m_start, m_end, min(cluster) AS cluster FROM m GROUP BY ALL)
SELECT s.doc, span_id, p.cluster IS NOT NULL AS in_cluster, coalesce(p.cluster, '') AS cluster, coalesce(n, 0) AS cluster_size, coalesce(t, '') AS anchor_type, round(coalesce(c, 0), 9) AS anchor_conf FROM s LEFT JOIN p ON p.doc = s.doc AND m_start = start AND m_end = "end" LEFT JOIN z ON z.doc = s.doc AND z.cluster = p.cluster LEFT JOIN a ON a.doc = s.doc AND a.cluster = p.cluster""",
        "score_agreement": f"SELECT signal_id, round(coalesce(phi_conf * pii_conf, 0), 12) AS agreement, round(abs({a} - {b}), 12) AS disagreement FROM ({_SIGNALS})",
        "listed_spans": f"SELECT span_id, CASE WHEN d.k IS NOT NULL THEN 'DRUG' ELSE entity_type END AS entity_type, CASE WHEN d.k IS NOT NULL THEN 0.99 ELSE confidence END AS confidence FROM ({B.SPANS}) s LEFT JOIN (SELECT DISTINCT lower(trim(term)) AS k FROM dictionary_terms WHERE category = 'DRUG') d ON lower(trim(text)) = d.k WHERE lower(trim(text)) NOT IN (SELECT lower(trim(term)) FROM dictionary_terms WHERE category = 'TOWN')",
        "rule_mentions": f"SELECT id AS doc, lower(regexp_extract(text, '[^ ]+$')) AS cluster, count(*) AS n FROM ({span_sql(Rule('mention', 'MENTION', 1.0, word.replace(chr(39) * 2, chr(39))), msg, 'id', 'content')}) GROUP BY ALL",
        "verified_spans": f"SELECT span_id, CASE WHEN NOT ({asked}) THEN 'not asked' WHEN {number} THEN 'no' ELSE 'yes' END AS decision, CAST(CASE WHEN {asked} THEN 0.9 ELSE 0 END AS DOUBLE) AS verdict_conf, NOT ({asked} AND {number}) AS kept FROM ({B.SPANS})",
        "unverified_spans": f"SELECT 'uncertain' AS decision, count(*) AS n FROM ({B.SPANS}) WHERE {asked}",
        "model_spans": f"SELECT id, start, CAST(start + length(text) AS INT) AS \"end\", text, CAST(0.9 AS DOUBLE) AS confidence, 'emails' AS source FROM ({span_sql(Rule('m', 'EMAIL', 0.9, mail), msg, 'id', 'content')})",
        "compared_detectors": f"SELECT 'nothing' AS detector, count(*) AS fn, true AS scored FROM (SELECT DISTINCT doc, span_id FROM ({_GOLD}) WHERE entity_type = 'EMAIL')",
        "evidence_decision": f"SELECT id, t AS evidence_type, round(c, 9) AS evidence_conf, t <> 'NONE' AS evidence_ok FROM (SELECT DISTINCT id, CASE {kinds} WHEN coalesce(sources_agree_count, 0) >= 1 THEN merged_type ELSE 'NONE' END AS t, CASE {confs} WHEN coalesce(sources_agree_count, 0) >= 2 THEN least(0.8, {top} + 0.1) WHEN sources_agree_count = 1 THEN merged_conf ELSE 0 END AS c FROM span_signals)",
        "overlap_islands": f"SELECT doc, span_id, grp FROM ({_ISLANDS})",
        "signal_vector": f"""SELECT *, CAST(length(text) AS INT) AS span_length, regexp_matches(text, '[0-9]') AS has_digits, regexp_matches(text, '\\p{{L}}') AS has_letters, regexp_matches(replace(replace(text, '-', ''), ' ', ''), '^[0-9]+$') AS all_digits, regexp_matches(text, '\\p{{Lu}}') AND NOT regexp_matches(text, '\\p{{Ll}}') AS all_caps, regexp_matches(text, '\\p{{Lu}}') AND regexp_matches(text, '\\p{{Ll}}') AS mixed_case, n_types = 1 AS consensus
FROM (SELECT doc, grp, {first('start', longest)} AS start, {first('"end"', longest)} AS "end", {first('text', longest)} AS text, {first('entity_type', surest)} AS best_type, max(confidence) AS best_conf, max(CASE WHEN source = 'model' THEN confidence END) AS model_conf, max(CASE WHEN source = 'rule' THEN confidence END) AS rule_conf, max(CASE WHEN source = 'dictionary' THEN confidence END) AS dictionary_conf, count(DISTINCT source) AS n_sources, count(DISTINCT entity_type) AS n_types, count(*) AS n_spans FROM ({_ISLANDS}) GROUP BY doc, grp)""",
        "tiered_merge": f"""WITH i AS ({_ISLANDS}), v AS (SELECT doc, grp, arg_max(entity_type, row(s, entity_type)) AS entity_type FROM (SELECT doc, grp, entity_type, round(sum(confidence), 6) AS s FROM i GROUP BY ALL) GROUP BY doc, grp)
SELECT e.doc, e.grp, start, "end", text, entity_type, round(CASE WHEN n > 1 THEN least(c + 0.05, 0.99) ELSE c END, 6) AS confidence FROM (SELECT doc, grp, arg_max(start, row({rank}, confidence, span_id)) AS start, arg_max("end", row({rank}, confidence, span_id)) AS "end", arg_max(text, row({rank}, confidence, span_id)) AS text, max(confidence) AS c, count(DISTINCT source) AS n FROM i GROUP BY doc, grp) e JOIN v ON e.doc = v.doc AND e.grp = v.grp""",
        "staged_decision": f"""SELECT signal_id, round(phi_cal, 8) AS phi_cal, round(pii_cal, 8) AS pii_cal, tier, round(combined, 8) AS combined, round(final_conf, 8) AS final_conf, final_conf >= 0.2 AS accepted, CASE WHEN has_checksum AND rule_type IS NOT NULL THEN rule_type WHEN len(kinds) = 1 THEN kinds[1] WHEN phi_type IN ({clinical}) THEN phi_type WHEN pii_type IN ({general}) THEN pii_type ELSE {best} END AS final_type, final_conf >= 0.2 AND final_conf < 0.95 AS needs_review FROM ({decided})""",
        "two_model_decision": f"""SELECT signal_id, conf >= 0.25 AS accepted, round(conf, 8) AS confidence, CASE WHEN phi_type IS NULL THEN pii_type WHEN pii_type IS NULL THEN phi_type WHEN phi_type = pii_type THEN phi_type WHEN {a} > {b} THEN phi_type ELSE pii_type END AS entity_type, round(coalesce(phi_conf * pii_conf, 0), 12) AS agreement FROM (SELECT *, CASE WHEN {a} > 0 AND {b} > 0 THEN least(greatest({a}, {b}) + 0.1, 0.99) ELSE greatest({a}, {b}) END AS conf FROM ({_SIGNALS}))""",
        "type_confusion": f"""SELECT span_id, CASE WHEN entity_type = 'MRN' AND {n} IN (15, 16) AND length({bare}) <= 19 OR entity_type = 'DATE' AND {n} IN (15, 16) AND regexp_full_match({bare}, '[0-9]+') THEN 'CREDIT_CARD' ELSE entity_type END AS entity_type, round(CASE WHEN entity_type = 'MRN' AND {n} IN (15, 16) AND length({bare}) <= 19 THEN confidence * 0.95 WHEN entity_type = 'DATE' AND {n} IN (15, 16) AND regexp_full_match({bare}, '[0-9]+') THEN confidence * 0.9 ELSE confidence END, 8) AS confidence FROM (SELECT *, CASE WHEN entity_type IN ('MRN', 'DATE') THEN concat(text, ' ', regexp_replace(span_id, '[^0-9]', '', 'g')) ELSE text END AS t FROM ({B.SPANS}))""",
        "person_refine": f"SELECT span_id, CASE WHEN {staff} THEN 'NAME_PROVIDER' ELSE 'NAME_PATIENT' END AS entity_type FROM ({B.IN_TEXTS}) WHERE entity_type LIKE 'NAME%'",
        "document_features": f"""SELECT doc, bool_or(entity_type = 'SSN') AS has_ssn, bool_or(entity_type IN ('DATE', 'DATE_DOB')) AS has_dates, bool_or(entity_type IN ('MRN', 'DRUG', 'LAB_TEST', 'FACILITY')) AS has_medical, count(*) AS n_entities, round(least(1, sum(greatest("end" - start, 0)) / max(length(doc_text))), 9) AS density FROM ({B.IN_TEXTS}) GROUP BY doc""",
        "coref_propagation": f"""WITH m AS ({m}), s AS ({seen}), a AS (SELECT m.doc, cluster, arg_max(entity_type, row(confidence, span_id)) AS t, max(confidence) AS c FROM m JOIN s ON m.doc = s.doc AND least(m_end, "end") - greatest(m_start, start) > 0 AND (least(m_end, "end") - greatest(m_start, start)) / least(m_end - m_start, "end" - start) > 0.5 GROUP BY m.doc, cluster)
SELECT m.doc, m_start AS start, m_end AS "end", mention AS text, t AS entity_type, round(c * 0.8, 9) AS confidence FROM m JOIN a ON m.doc = a.doc AND m.cluster = a.cluster WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = m.doc AND m_start < "end" AND start < m_end) AND lower(mention) NOT IN ({B.quoted(E.PRONOUNS)}) AND length(mention) > 2""",
    }
