"""Queries over filters and repairs of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog import lists as L
from veilwork.operators import suppress as S
from veilwork.plans import base as B
from veilwork.runtime import table


EXCLUDED_TYPES = sorted({t for _, types, _, _ in L.EXCLUSIONS for t in types.split()})


def allowlist_filter(spark, sf_dir):
    both = table(spark, sf_dir, "span_signals").select(F.col("span_text").alias("text")).unionByName(table(spark, sf_dir, "dictionary_terms").select(F.col("term").alias("text")))
    words = both.unionByName(B.texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("doc_text", F.lit("[A-Za-z/]+"), F.lit(0))).alias("text")))
    return words.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where(S.is_allowed(F.col("text")))


def context_filter(spark, sf_dir):
    s = B.spans_in_texts(spark, sf_dir).withColumn("context", S.before(F.col("doc_text"), F.col("start")))
    return s.select("span_id", "entity_type", S.context_excluded(F.col("entity_type"), F.col("context")).alias("excluded"))


def exclusion_filter(spark, sf_dir):
    words = B.texts(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all("doc_text", F.lit("[A-Za-z0-9.]+"), F.lit(0)))).alias("text")).distinct()
    typed = words.select("text", F.explode(F.array(*map(F.lit, EXCLUDED_TYPES))).alias("entity_type"))
    return typed.withColumn("reason", S.exclusion_reason(F.col("text"), F.col("entity_type"))).where("reason IS NOT NULL")


def position_repair(spark, sf_dir):
    return S.repair_positions(B.spans_in_texts(spark, sf_dir)).select("span_id", "start", "end", "text", "repair")


def span_validity(spark, sf_dir):
    return S.span_problems(B.spans_in_texts(spark, sf_dir))


def covered_spans(spark, sf_dir):
    s = B.entity_spans(spark, sf_dir)
    return S.drop_covered(s.where("source <> 'rule'"), s.where("source = 'rule'")).select("span_id", "doc", "start", "end")


def term_validity(spark, sf_dir):
    terms = table(spark, sf_dir, "dictionary_terms").select("term").unionByName(table(spark, sf_dir, "entities").select(F.col("text").alias("term"))).distinct()
    return terms.select("term", F.coalesce(S.term_reason(F.col("term")), F.lit("valid")).alias("reason"))


def suppression_stats(spark, sf_dir):
    """Entries of the allow lists and of the exclusions, by kind."""
    rows = [("allowed", k, t) for k, terms in L.ALLOWED.items() for t in set(terms)] + [("excluded", t, name) for name, types, _, _ in L.EXCLUSIONS for t in types.split()]
    return spark.createDataFrame(rows, "list string, part string, entry string").groupBy("list", "part").agg(F.count(F.lit(1)).alias("n"))


def without_other(spark, sf_dir):
    s = table(spark, sf_dir, "span_signals").select("id", F.col("merged_type").alias("entity_type")).distinct()
    return S.drop_other(s)


def agent_filter(spark, sf_dir):
    """Exclusions of every type, inside a browser's name and outside."""
    words = B.texts(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all("doc_text", F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("text")).distinct()
    words = words.unionByName(spark.createDataFrame([(w,) for w in ("compatible", "WOW64", "x64", "arm")], "text string"))
    inside = F.when(F.length("text") % 2 == 1, F.lit("User-Agent: Mozilla/5.0 (")).otherwise(F.lit("said"))
    return words.select("text", S.exclusion_reason(F.col("text"), F.lit("OTHER"), inside).alias("reason")).where("reason IS NOT NULL").distinct()


def _exclusion_sql() -> str:
    t = "lower(trim(text, E' \\t\\r\\n'))"
    out = f"CASE WHEN {t} IN ({B.quoted(L.EXACT_EXCLUSIONS)}) THEN 'exact'"
    for name, types, pattern, ignore in L.EXCLUSIONS:
        p = pattern.replace("'", "''")
        out += f" WHEN entity_type IN ({B.quoted(types.split())}) AND regexp_matches(text, '{'(?i)' if ignore else ''}^(?:{p})') THEN '{name}'"
    return out + " END"


_HERE = 'substr(doc_text, start + 1, "end" - start)'
_LOW = "greatest(start - 20, 0)"
_AT = f'instr(substr(doc_text, {_LOW} + 1, least(length(doc_text), "end" + 20) - {_LOW}), text)'
_BLANK = lambda c: f"trim({c}, E' \\t\\n\\r\\f\\x0B')"


def queries():
    return {f.__name__: f for f in (allowlist_filter, context_filter, exclusion_filter, position_repair, span_validity, covered_spans, term_validity, suppression_stats, without_other, agent_filter)}


def oracle_sql():
    context = "lower(substr(doc_text, greatest(start - 60, 0) + 1, start - greatest(start - 60, 0)))"
    t = "trim(term, E' \\t\\r\\n')"
    state = f"CASE WHEN {_HERE} = text THEN 'exact' WHEN {_BLANK(_HERE)} = {_BLANK('text')} THEN 'blanks' WHEN {_AT} > 0 THEN 'moved' END"
    return {
        "allowlist_filter": f"SELECT text, count(*) AS n FROM (SELECT span_text AS text FROM span_signals UNION ALL SELECT term FROM dictionary_terms UNION ALL SELECT unnest(regexp_extract_all(doc_text, '[A-Za-z/]+')) FROM ({B.TEXTS})) WHERE lower(trim(text, E' \\t\\r\\n')) IN ({B.quoted(S.ALLOWLIST)}) GROUP BY text",
        "context_filter": f"SELECT span_id, entity_type, CASE WHEN entity_type IN ({B.quoted(L.DATE_TYPES)}) THEN regexp_matches({context}, '{B.alternatives(L.DATE_CONTEXTS)}') WHEN entity_type IN ({B.quoted(L.PHONE_TYPES)}) THEN regexp_matches({context}, '{B.alternatives(L.PHONE_CONTEXTS)}') WHEN entity_type IN ({B.quoted(L.ACCOUNT_TYPES)}) THEN regexp_matches({context}, '{B.alternatives(L.ACCOUNT_CONTEXTS)}') ELSE false END AS excluded FROM ({B.IN_TEXTS})",
        "exclusion_filter": f"SELECT * FROM (SELECT text, entity_type, {_exclusion_sql()} AS reason FROM (SELECT DISTINCT unnest(regexp_extract_all(doc_text, '[A-Za-z0-9.]+')) AS text FROM ({B.TEXTS})), (SELECT unnest([{B.quoted(EXCLUDED_TYPES)}]) AS entity_type)) WHERE reason IS NOT NULL",
        "position_repair": f"""SELECT span_id, CAST(CASE WHEN st = 'moved' THEN pos ELSE start END AS INT) AS start, CAST(CASE WHEN st = 'moved' THEN pos + length(text) ELSE "end" END AS INT) AS "end", CASE WHEN st = 'blanks' THEN here ELSE text END AS text, st AS repair
FROM (SELECT *, {state} AS st, {_HERE} AS here, {_LOW} + {_AT} - 1 AS pos FROM ({B.IN_TEXTS}) WHERE start >= 0 AND "end" <= length(doc_text) AND start < "end") WHERE st IS NOT NULL""",
        "span_validity": f"""SELECT doc, span_id, coalesce(start >= 0 AND start < "end" AND "end" <= length(doc_text), false) AS in_bounds, coalesce(start >= 0 AND start < "end" AND "end" <= length(doc_text) AND {_HERE} = text, false) AS text_agrees, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start, "end", span_id) < "end", false) AS overlaps_next FROM ({B.IN_TEXTS})""",
        "suppression_stats": "SELECT * FROM (VALUES " + ", ".join([f"('allowed', '{k}', CAST({len(set(v))} AS BIGINT))" for k, v in L.ALLOWED.items()] + [f"('excluded', '{t}', CAST({sum(t in types.split() for _, types, _, _ in L.EXCLUSIONS)} AS BIGINT))" for t in EXCLUDED_TYPES]) + ") AS t(list, part, n)",
        "without_other": "SELECT DISTINCT id, merged_type AS entity_type FROM span_signals WHERE coalesce(upper(merged_type), '') <> 'OTHER'",
        "agent_filter": f"SELECT text, reason FROM (SELECT text, coalesce({_exclusion_sql().replace('entity_type', chr(39) + 'OTHER' + chr(39))}, CASE WHEN length(text) % 2 = 1 AND lower(text) IN ('compatible', 'msie', 'rv:', 'wow64', 'win64', 'x64', 'arm') THEN 'user_agent_context' END) AS reason FROM (SELECT unnest(regexp_extract_all(doc_text, '[A-Za-z0-9]+')) AS text FROM ({B.TEXTS}) UNION SELECT unnest(['compatible', 'WOW64', 'x64', 'arm']))) WHERE reason IS NOT NULL",
        "covered_spans": f"""SELECT span_id, doc, start, "end" FROM ({B.SPANS}) a WHERE source <> 'rule' AND NOT EXISTS (SELECT 1 FROM ({B.SPANS}) b WHERE b.source = 'rule' AND a.doc = b.doc AND a.start < b."end" AND b.start < a."end")""",
        "term_validity": f"""SELECT term, CASE WHEN term IS NULL OR {t} = '' THEN 'empty' WHEN length({t}) < 4 THEN 'too_short' WHEN lower({t}) IN ({B.quoted(L.BLOCKED_TERMS)}) THEN 'blocklisted' WHEN regexp_matches({t}, '(?i)^(?:{'|'.join(L.GARBAGE_TERMS)})') THEN 'garbage_pattern' WHEN NOT regexp_matches({t}, '^\\p{{L}}') THEN 'starts_with_non_letter' ELSE 'valid' END AS reason FROM (SELECT term FROM dictionary_terms UNION SELECT text FROM entities)""",
    }
