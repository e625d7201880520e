"""Surfaces for detectors and verifiers that come from outside (models, services)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.catalog.rules import Rule
from veilwork.functions.spans import extract

SPANS = "start int, end int, text string, entity_type string, confidence double"
_detectors: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}


def register_detector(name: str, fn: Callable[[DataFrame, str, str], DataFrame]) -> None:
    """``fn(df, id_col, text_col)`` gives rows (id, start, end, text, entity_type, confidence)."""
    _detectors[name] = fn


def detectors() -> list[str]:
    return sorted(_detectors)


def run_detector(name: str, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _detectors[name](df, id_col, text_col).withColumn("source", F.lit(name))


def model_detector(load: Callable[[], Callable[[list[str]], list[list[tuple]]]]) -> Callable[[DataFrame, str, str], DataFrame]:
    """A detector from a model: ``load()`` runs once per task and returns texts -> lists of (start, end, type, confidence)."""

    def detector(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        kind = df.schema[id_col].dataType.simpleString()

        def run(batches):
            model = load()
            for b in batches:
                rows = [
                    (i, s, e, t[s:e], kind_, float(c))
                    for i, t, found in zip(b["id"], b["t"], model(list(b["t"])), strict=True)
                    for s, e, kind_, c in found
                ]
                yield pd.DataFrame(rows, columns=["id", "start", "end", "text", "entity_type", "confidence"])

        own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
        return own.mapInPandas(run, f"id {kind}, {SPANS}")

    return detector


_coref: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}


def register_coref(name: str, fn: Callable[[DataFrame, str, str], DataFrame]) -> None:
    """``fn(df, id_col, text_col)`` gives mentions (doc, cluster, mention, m_start, m_end)."""
    _coref[name] = fn


def resolve_coref(name: str, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _coref[name](df, id_col, text_col)


def same_last_word(df: DataFrame, id_col: str, text_col: str, pattern: str = r"(?:[A-Z][\w'-]+ )*[A-Z][\w'-]+") -> DataFrame:
    """A co-reference by rule: runs of capitalised words that end in the same word are one cluster."""
    m = extract(df, id_col, text_col, [Rule("mention", "MENTION", 1.0, pattern)])
    return m.select(F.col("id").alias("doc"), F.lower(F.regexp_extract("text", r"[^ ]+$", 0)).alias("cluster"), F.col("text").alias("mention"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))


register_coref("same_last_word", same_last_word)

_verifiers: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {"none": lambda: lambda prompts: [""] * len(prompts)}


def register_verifier(name: str, load: Callable[[], Callable[[list[str]], list[str]]]) -> None:
    """``load()`` runs once per task and returns prompts -> answers; a service, a model or a rule.  ``none`` answers nothing."""
    _verifiers[name] = load


def verifiers() -> list[str]:
    return sorted(_verifiers)


def _answers(load):
    def run(batches):
        ask = load()
        down = False  # a verifier that has failed once is not asked again by this task
        for b in batches:
            prompts = b["prompt"].tolist()
            try:
                said = [""] * len(prompts) if down else ask(prompts)
            except Exception:
                said, down = [""] * len(prompts), True
            yield pd.DataFrame({"key": b["key"], "answer": said})

    return run


def verify(spans: DataFrame, texts: DataFrame, name: str, threshold: float = 0.95, size: int = 500) -> DataFrame:
    """(span_id, decision, verdict_conf) of the spans under the threshold, asked in batches; each distinct question once.

    ``spans``: doc, span_id, start, end, text, entity_type, confidence; ``texts``: doc, doc_text.
    An absent or failing verifier leaves them uncertain.
    """
    s = spans.where(F.col("confidence") < threshold).join(texts, "doc")
    prompt = verification_prompt(F.col("text"), F.col("entity_type"), centred_context(F.col("doc_text"), F.col("start"), F.col("end"), size))
    asked = s.select("span_id", prompt.alias("prompt")).withColumn("key", F.md5("prompt"))
    answers = asked.select("key", "prompt").dropDuplicates(["key"]).mapInPandas(_answers(_verifiers[name]), "key string, answer string")
    decision, conf = parse_verdict(F.col("answer"))
    return asked.select("span_id", "key").join(answers, "key").select("span_id", decision.alias("decision"), conf.alias("verdict_conf"))


def compare_detectors(names: list[str], df: DataFrame, id_col: str, text_col: str, gold: DataFrame) -> DataFrame:
    """(detector, tp, fp, fn, precision, recall, f1) of registered detectors against gold spans (doc, span_id, start, end, entity_type)."""
    from veilwork.operators.evaluate import greedy_matches, scores

    out = None
    for name in names:
        p = run_detector(name, df, id_col, text_col).withColumnRenamed("id", "doc")
        p = p.withColumn("span_id", F.concat_ws("-", F.col("doc").cast("string"), "start", "end", "entity_type"))
        hits = greedy_matches(p, gold).agg(F.count(F.lit(1)).alias("tp"))
        # three single rows
        one = hits.crossJoin(p.select("doc", "span_id").distinct().agg(F.count(F.lit(1)).alias("np"))).crossJoin(gold.select("doc", "span_id").distinct().agg(F.count(F.lit(1)).alias("ng")))
        one = one.select(F.lit(name).alias("detector"), "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))
        out = one if out is None else out.unionByName(one)
    return scores(out)


def verification_prompt(text: Column, entity_type: Column, context: Column) -> Column:
    return F.concat(F.lit('Is "'), text, F.lit('" a '), entity_type, F.lit(" in this text? Answer YES or NO.\n"), context)


def centred_context(text: Column, start: Column, end: Column, size: int = 500) -> Column:
    """``size`` characters around a span."""
    middle = ((start + end) / 2).cast("int")
    return F.substring(text, F.greatest(middle - size // 2, F.lit(0)) + 1, F.lit(size))


def parse_verdict(answer: Column) -> tuple[Column, Column]:
    """(decision, confidence) of a free answer: yes, no, or uncertain."""
    a = F.upper(F.trim(F.coalesce(answer, F.lit(""))))
    yes, no = F.contains(a, F.lit("YES")), F.contains(a, F.lit("NO"))
    decision = F.when(a.startswith("YES"), "yes").when(a.startswith("NO"), "no").when(yes & ~no, "yes").when(no & ~yes, "no").otherwise("uncertain")
    conf = F.when(a.startswith("YES") | a.startswith("NO"), 0.90).when(yes != no, 0.75).otherwise(0.50)
    return decision, conf


def apply_verdicts(spans: DataFrame, verdicts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Spans under the threshold that a verifier denies are dropped; ``verdicts``: span_id, decision."""
    v = verdicts.select("span_id", F.col("decision").alias("_v"))
    out = spans.join(v, "span_id", "left")
    return out.where((F.col("confidence") >= threshold) | (F.coalesce("_v", F.lit("uncertain")) != "no")).drop("_v")
