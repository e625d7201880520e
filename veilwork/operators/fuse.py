"""Overlap grouping, evidence per group, calibration, decisions and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.catalog import lists as L
from veilwork.operators.suppress import before, behind


def overlap_groups(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """``spans`` with ``grp``: the number of the island of overlapping spans within its document, from 1.

    Touching spans ([0,5) and [5,9)) are two islands; chains of overlaps are one.
    """
    w = Window.partitionBy(doc).orderBy("start", F.desc("end"), "span_id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return spans.withColumn("_new", fresh).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def shape_features(text: Column) -> dict[str, Column]:
    bare = F.translate(text, "- ", "")
    return {
        "span_length": F.length(text),
        "has_digits": text.rlike("[0-9]"),
        "has_letters": text.rlike(r"\p{L}"),
        "all_digits": bare.rlike(r"^[0-9]+$"),
        "all_caps": text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}"),
        "mixed_case": text.rlike(r"\p{Lu}") & text.rlike(r"\p{Ll}"),
    }


def group_evidence(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per island: canonical (longest) span, best confidence, votes of each source."""
    g = overlap_groups(spans, doc)
    longest = F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), F.col("span_id").alias("i"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("text").alias("text"))
    surest = F.struct(F.col("confidence").alias("c"), F.col("span_id").alias("i"), F.col("entity_type").alias("t"))
    by = lambda s: F.max(F.when(F.col("source") == s, F.col("confidence")))
    out = g.groupBy(doc, "grp").agg(
        F.max(longest).alias("l"),
        F.max(surest).alias("b"),
        by("model").alias("model_conf"),
        by("rule").alias("rule_conf"),
        by("dictionary").alias("dictionary_conf"),
        F.count_distinct("source").alias("n_sources"),
        F.count_distinct("entity_type").alias("n_types"),
        F.count(F.lit(1)).alias("n_spans"),
    )
    out = out.select(doc, "grp", F.col("l.start").alias("start"), F.col("l.end").alias("end"), F.col("l.text").alias("text"), F.col("b.t").alias("best_type"), F.col("b.c").alias("best_conf"), "model_conf", "rule_conf", "dictionary_conf", "n_sources", "n_types", "n_spans")
    return out.withColumns(shape_features(F.col("text")) | {"consensus": F.col("n_types") == 1})


def sigmoid(x: Column) -> Column:
    x = F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def calibrate(raw: Column, model: str) -> Column:
    """Platt-scaled score; an absent score (null or 0) stays 0."""
    a, b = L.PLATT[model]
    return F.when(F.coalesce(raw, F.lit(0.0)) > 0, sigmoid(raw * a + b)).otherwise(0.0)


def combine(phi: Column, pii: Column, entity_type: Column) -> Column:
    """One probability from two calibrated scores: the authority's for its types, else noisy-or."""
    return (
        F.when(entity_type.isin(L.CLINICAL_TYPES), F.when(phi > 0, phi).otherwise(pii))
        .when(entity_type.isin(L.GENERAL_TYPES), F.when(pii > 0, pii).otherwise(phi))
        .otherwise(F.lit(1.0) - (F.lit(1.0) - phi) * (F.lit(1.0) - pii))
    )


def rule_tier(conf: Column, checksum: Column) -> Column:
    return F.when(checksum, 3).when(conf >= 0.90, 2).when(conf > 0, 1).otherwise(0)


def boost(score: Column, tier: Column) -> Column:
    return score + (F.lit(1.0) - score) * F.element_at(F.array(*map(F.lit, L.TIER_BOOST)), tier + 1)


def decide(signals: DataFrame) -> DataFrame:
    """Adds calibrated scores, tier, boosted score, acceptance, resolved type and the need for review.

    Needs phi_conf, pii_conf, rule_conf (0 or null: absent), has_checksum,
    phi_type, pii_type, rule_type.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    kinds = F.array_distinct(F.array_compact(F.array("phi_type", "pii_type", "rule_type")))
    s = signals.withColumns({"phi_cal": calibrate(zero("phi_conf"), "phi"), "pii_cal": calibrate(zero("pii_conf"), "pii"), "tier": rule_tier(zero("rule_conf"), F.col("has_checksum"))})
    s = s.withColumn("lead_type", F.coalesce("phi_type", "pii_type", "rule_type"))
    s = s.withColumn("combined", combine(F.col("phi_cal"), F.col("pii_cal"), F.col("lead_type")))
    fast = F.col("has_checksum") & (zero("rule_conf") >= 0.95)
    s = s.withColumn("final_conf", F.when(fast, 0.99).otherwise(boost(F.col("combined"), F.col("tier"))))
    s = s.withColumn("accepted", F.col("final_conf") >= 0.20)
    best = F.array_max(F.array(*(F.struct(zero(f"{d}_conf").alias("c"), F.col(f"{d}_type").alias("t")) for d in ("phi", "pii", "rule"))))["t"]
    kind = (
        F.when(F.col("has_checksum") & F.col("rule_type").isNotNull(), F.col("rule_type"))
        .when(F.size(kinds) == 1, kinds[0])
        .when(F.col("phi_type").isin(L.CLINICAL_TYPES), F.col("phi_type"))
        .when(F.col("pii_type").isin(L.GENERAL_TYPES), F.col("pii_type"))
        .otherwise(best)
    )
    return s.withColumn("final_type", kind).withColumn("needs_review", F.col("accepted") & (F.col("final_conf") < 0.95))


def resolve_two(phi_conf: Column, pii_conf: Column, phi_type: Column, pii_type: Column) -> tuple[Column, Column, Column]:
    """The two-model decision: (accepted, confidence, type)."""
    a, b = F.coalesce(phi_conf, F.lit(0.0)), F.coalesce(pii_conf, F.lit(0.0))
    top = F.greatest(a, b)
    conf = F.when((a > 0) & (b > 0), F.least(top + 0.10, F.lit(0.99))).otherwise(top)
    kind = F.when(phi_type.isNull(), pii_type).when(pii_type.isNull(), phi_type).when(phi_type == pii_type, phi_type).when(a > b, phi_type).otherwise(pii_type)
    return conf >= 0.25, conf, kind


def tiered_merge(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """One span per island: boundary from the best source tier, type by summed confidence, bonus for several sources."""
    g = overlap_groups(spans, doc)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in (("rule", 4), ("presidio", 3), ("merged", 2), ("dictionary", 2), ("model", 1)) for x in kv]), F.col("source"))
    edge = F.max(F.struct(F.coalesce(rank, F.lit(0)).alias("r"), F.col("confidence").alias("c"), F.col("span_id").alias("i"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("text").alias("text")))
    bounds = g.groupBy(doc, "grp").agg(edge.alias("e"), F.max("confidence").alias("c"), F.count_distinct("source").alias("n"))
    votes = g.groupBy(doc, "grp", "entity_type").agg(F.round(F.sum("confidence"), 6).alias("s")).groupBy(doc, "grp").agg(F.max(F.struct("s", "entity_type")).alias("v"))
    conf = F.when(F.col("n") > 1, F.least(F.col("c") + 0.05, F.lit(0.99))).otherwise(F.col("c"))
    return bounds.join(votes, [doc, "grp"]).select(doc, "grp", F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.text").alias("text"), F.col("v.entity_type").alias("entity_type"), F.round(conf, 6).alias("confidence"))


def repair_types(entity_type: Column, text: Column, confidence: Column) -> tuple[Column, Column]:
    """A record number or date of 15 or 16 digits is a card number."""
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))
    bare = F.translate(text, "- ", "")
    mrn = (entity_type == "MRN") & n.isin(15, 16) & (F.length(bare) <= 19)
    date = (entity_type == "DATE") & n.isin(15, 16) & bare.rlike("^[0-9]+$")
    return F.when(mrn | date, "CREDIT_CARD").otherwise(entity_type), F.when(mrn, confidence * 0.95).when(date, confidence * 0.90).otherwise(confidence)


def refine_person(text: Column, start: Column, end: Column, entity_type: Column) -> Column:
    """A person is staff if the words around say so, else a patient."""
    left, right = F.lower(before(text, start, 50)), F.lower(behind(text, end, 30))
    words = lambda c, ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(c, w))
    staff = words(left, L.STAFF_BEFORE) | words(F.substring(right, 1, 15), L.STAFF_BEHIND)
    return F.when(~entity_type.isin("NAME_PERSON", "PERSON"), entity_type).when(staff, "NAME_PROVIDER").otherwise("NAME_PATIENT")


def document_features(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """Per document: kinds present, counts, share of characters covered by spans."""
    has = lambda *t: F.coalesce(F.bool_or(F.col("entity_type").isin(*t)), F.lit(False))
    out = spans.groupBy(doc).agg(
        has("SSN").alias("has_ssn"),
        has("DATE", "DATE_DOB").alias("has_dates"),
        has("MRN", "DRUG", "LAB_TEST", "FACILITY").alias("has_medical"),
        F.count(F.lit(1)).alias("n_entities"),
        F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0))).alias("chars"),
        F.max(F.length("doc_text")).alias("n"),
    )
    return out.select(doc, "has_ssn", "has_dates", "has_medical", "n_entities", F.round(F.least(F.lit(1.0), F.col("chars") / F.col("n")), 9).alias("density"))


def coref_anchors(mentions: DataFrame, spans: DataFrame) -> DataFrame:
    """Per cluster the surest span that covers a mention (equal, or over half of the shorter).

    ``mentions``: doc, cluster, mention, m_start, m_end.
    """
    shared = F.least("m_end", "end") - F.greatest("m_start", "start")
    half = shared / F.least(F.col("m_end") - F.col("m_start"), F.col("end") - F.col("start")) > 0.5
    near = mentions.join(spans, "doc").where((shared > 0) & half)
    best = near.groupBy("doc", "cluster").agg(F.max(F.struct("confidence", F.col("span_id").alias("i"), F.col("entity_type").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"))).alias("a"))
    return best.select("doc", "cluster", F.col("a.t").alias("anchor_type"), F.col("a.confidence").alias("anchor_conf"), F.col("a.s").alias("anchor_start"), F.col("a.e").alias("anchor_end"))


def coref_columns(spans: DataFrame, mentions: DataFrame) -> DataFrame:
    """``spans`` with in_cluster, cluster, cluster_size, anchor_type and anchor_conf: the co-reference cluster of the mention at the very place."""
    anchors = coref_anchors(mentions, spans).select("doc", "cluster", "anchor_type", "anchor_conf")
    sizes = mentions.groupBy("doc", "cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    place = mentions.groupBy("doc", F.col("m_start").alias("start"), F.col("m_end").alias("end")).agg(F.min("cluster").alias("cluster"))
    out = spans.join(place, ["doc", "start", "end"], "left").join(sizes, ["doc", "cluster"], "left").join(anchors, ["doc", "cluster"], "left")
    return out.withColumn("in_cluster", F.col("cluster").isNotNull()).fillna(0, ["cluster_size"]).fillna(0.0, ["anchor_conf"])


def agreement(a: Column, b: Column) -> Column:
    """How far two scores agree: their product; 0 where one is absent."""
    return F.coalesce(a * b, F.lit(0.0))


def disagreement(a: Column, b: Column) -> Column:
    """How far two scores differ."""
    return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))


PRONOUNS = "he she they it his her their its him them who whom whose that this these those i we you me us my our your".split()


def coref_spans(mentions: DataFrame, spans: DataFrame) -> DataFrame:
    """Mentions that no span covers inherit their cluster's type, at four fifths of its confidence; pronouns do not."""
    anchors = coref_anchors(mentions, spans)
    hit = spans.select("doc", F.col("start").alias("_s"), F.col("end").alias("_e"))
    free = mentions.join(hit, (mentions["doc"] == hit["doc"]) & (F.col("m_start") < F.col("_e")) & (F.col("_s") < F.col("m_end")), "left_anti")
    free = free.where(~F.lower("mention").isin(PRONOUNS) & (F.length("mention") > 2))
    return free.join(anchors, ["doc", "cluster"]).select("doc", F.col("m_start").alias("start"), F.col("m_end").alias("end"), F.col("mention").alias("text"), F.col("anchor_type").alias("entity_type"), F.round(F.col("anchor_conf") * 0.8, 9).alias("confidence"))


def apply_lists(spans: DataFrame, allowed: DataFrame, blocked: DataFrame) -> DataFrame:
    """Spans whose text is on the allow list go; on the block list (term, entity_type) they are certain and take its type."""
    key = F.lower(F.trim(F.col("text")))
    a = allowed.select(F.lower(F.trim("term")).alias("_a")).distinct()
    b = blocked.select(F.lower(F.trim("term")).alias("_b"), F.col("entity_type").alias("_t")).groupBy("_b").agg(F.min("_t").alias("_t"))
    out = spans.join(a, key == F.col("_a"), "left_anti").join(b, key == F.col("_b"), "left")
    hit = F.col("_b").isNotNull()
    return out.withColumns({"confidence": F.when(hit, 0.99).otherwise(F.col("confidence")), "entity_type": F.coalesce("_t", "entity_type")}).drop("_b", "_t")


def accept_by_evidence(signals: DataFrame) -> DataFrame:
    """Acceptance without a trained model: the first sure detector, else two weak ones, else one.

    Needs ``<detector>_detected/_conf/_type`` of rule, presidio, pii_bert and phi_bert, merged_type, merged_conf and sources_agree_count.
    """
    ladder = [("rule", 0.9), ("presidio", 0.7), ("pii_bert", 0.7), ("phi_bert", 0.7)]
    on = lambda d: F.coalesce(F.col(f"{d}_detected").cast("int"), F.lit(0)) == 1
    kind, conf = None, None
    for d, least in ladder:
        sure = on(d) & (F.col(f"{d}_conf") >= least)
        kind = F.when(sure, F.col(f"{d}_type")) if kind is None else kind.when(sure, F.col(f"{d}_type"))
        conf = F.when(sure, F.col(f"{d}_conf")) if conf is None else conf.when(sure, F.col(f"{d}_conf"))
    agree = F.coalesce(F.col("sources_agree_count"), F.lit(0))
    top = F.greatest(*(F.coalesce(F.col(f"{d}_conf"), F.lit(0.0)) for d, _ in ladder))
    kind = kind.when(agree >= 1, F.col("merged_type")).otherwise("NONE")
    conf = conf.when(agree >= 2, F.least(F.lit(0.8), top + 0.1)).when(agree == 1, F.col("merged_conf")).otherwise(0.0)
    return signals.withColumns({"evidence_type": kind, "evidence_conf": conf, "evidence_ok": kind != "NONE"})


def stack_status() -> dict[str, object]:
    """What the engine can do here."""
    from veilwork.catalog.rules import CHECKSUM_RULES, RULES
    from veilwork.operators.plugins import detectors

    return {"rules": len(RULES), "checksum_rules": len(CHECKSUM_RULES), "detectors": detectors(), "calibrated": sorted(L.PLATT)}
