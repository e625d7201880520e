"""Filters that drop findings which are none, and repairs of findings that are off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.catalog import lists as L
from veilwork.functions.spans import overlap_pairs

ALLOWLIST = sorted({t for terms in L.ALLOWED.values() for t in terms})


def clean(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def is_allowed(text: Column) -> Column:
    return clean(text).isin(ALLOWLIST)


def before(text: Column, start: Column, window: int = 60) -> Column:
    """Up to ``window`` characters before a place."""
    s = F.greatest(start - window, F.lit(0))
    return F.substring(text, s + 1, start - s)


def behind(text: Column, end: Column, window: int = 60) -> Column:
    return F.substring(text, end + 1, F.lit(window))


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def context_excluded(entity_type: Column, context: Column) -> Column:
    """Whether what stands before makes a date, telephone or account number harmless."""
    low = F.lower(context)
    return (
        F.when(entity_type.isin(L.DATE_TYPES), _any(low, L.DATE_CONTEXTS))
        .when(entity_type.isin(L.PHONE_TYPES), _any(low, L.PHONE_CONTEXTS))
        .when(entity_type.isin(L.ACCOUNT_TYPES), _any(low, L.ACCOUNT_CONTEXTS))
        .otherwise(False)
    )


def exclusion_reason(text: Column, entity_type: Column, context: Column | None = None) -> Column:
    """Name of the first exclusion that holds (``exact``, a rule, ``user_agent_context``), or null."""
    kind = F.upper(entity_type)
    out = F.when(clean(text).isin(L.EXACT_EXCLUSIONS), F.lit("exact"))
    for name, types, pattern, ignore in L.EXCLUSIONS:
        out = out.when(kind.isin(types.split()) & text.rlike(f"{'(?i)' if ignore else ''}^(?:{pattern})"), F.lit(name))
    if context is not None:
        low = F.lower(context)
        inside = F.contains(low, F.lit("mozilla/")) | F.contains(low, F.lit("user-agent"))
        out = out.when(inside & clean(text).isin("compatible", "msie", "rv:", "wow64", "win64", "x64", "arm"), F.lit("user_agent_context"))
    return out


def term_reason(term: Column, min_length: int = 4) -> Column:
    """Why a dictionary term is not usable, or null."""
    t = F.regexp_replace(term, r"^\s+|\s+$", "")
    return (
        F.when(term.isNull() | (t == ""), "empty")
        .when(F.length(t) < min_length, "too_short")
        .when(F.lower(t).isin(L.BLOCKED_TERMS), "blocklisted")
        .when(t.rlike("(?i)^(?:" + "|".join(L.GARBAGE_TERMS) + ")"), "garbage_pattern")
        .when(~t.rlike(r"^\p{L}"), "starts_with_non_letter")
    )


def is_drug_name(name: Column) -> Column:
    n = F.trim(name)
    return F.length(n).between(3, 100) & n.rlike("^[A-Za-z]") & ~n.rlike(r"(?i)^\d|\d+\s*(?:mg|ml|mcg|%)|^\([A-Z]\)-|^\d+:\d+")


def repair_positions(spans: DataFrame) -> DataFrame:
    """Spans (…, start, end, text) of a text ``doc_text``: those out of bounds or not near their place are dropped, others moved.

    A span whose text differs by outer blanks takes the text at its place; any
    other is looked for within twenty characters.
    """
    here = F.substring(F.col("doc_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    blank = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    low = F.greatest(F.col("start") - 20, F.lit(0))
    region = F.substring(F.col("doc_text"), low + 1, F.least(F.length("doc_text"), F.col("end") + 20) - low)
    at = F.call_function("instr", region, F.col("text"))
    state = F.when(here == F.col("text"), "exact").when(blank(here) == blank(F.col("text")), "blanks").when(at > 0, "moved").otherwise("lost")
    ok = spans.where((F.col("start") >= 0) & (F.col("end") <= F.length("doc_text")) & (F.col("start") < F.col("end")))
    ok = ok.withColumns({"_state": state, "_here": here, "_at": low + at - 1}).where("_state <> 'lost'")
    moved = F.col("_state") == "moved"
    start = F.when(moved, F.col("_at")).otherwise(F.col("start"))
    return ok.withColumns(
        {
            "text": F.when(F.col("_state") == "blanks", F.col("_here")).otherwise(F.col("text")),
            "end": F.when(moved, F.col("_at") + F.length("text")).otherwise(F.col("end")),
            "start": start,
            "repair": F.col("_state"),
        }
    ).drop("_state", "_here", "_at")


def drop_covered(spans: DataFrame, proven: DataFrame, doc: str = "doc") -> DataFrame:
    """The spans that touch no proven span of their document; ``span_id`` names a span within its document."""
    key = lambda df, *more: df.select(F.col(doc).alias("doc"), "start", "end", *more)
    hit = overlap_pairs(key(spans, "span_id"), key(proven)).select(F.col("doc").alias(doc), "span_id").distinct()
    return spans.join(hit, [doc, "span_id"], "left_anti")


def drop_other(spans: DataFrame) -> DataFrame:
    """The spans of a type that says something: OTHER goes."""
    return spans.where(F.coalesce(F.upper("entity_type"), F.lit("")) != "OTHER")


def span_problems(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """Per span: does it lie in its text, does the text agree, does it overlap the next one."""
    w = Window.partitionBy(doc).orderBy("start", "end", "span_id")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("doc_text"))
    same = F.substring(F.col("doc_text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return spans.select(
        doc, "span_id", F.coalesce(inside, F.lit(False)).alias("in_bounds"), F.coalesce(inside & same, F.lit(False)).alias("text_agrees"), F.coalesce(F.lead("start").over(w) < F.col("end"), F.lit(False)).alias("overlaps_next")
    )
