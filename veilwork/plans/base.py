"""Tables as the queries see them: one row per id."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.runtime import clean_key, table

KEY = "nullif(translate(regexp_replace(lower(trim({0}, E' \\t\\r\\n')), '^urn:', ''), '_', '-'), '')"
SPANS = "SELECT DISTINCT id AS span_id, " + KEY.format("document_id") + ' AS doc, text, start_idx AS start, end_idx AS "end", entity_type, confidence, source FROM entities WHERE document_id IS NOT NULL'
TEXTS = "SELECT DISTINCT id AS doc, content AS doc_text FROM scan_documents WHERE content IS NOT NULL"


def entity_spans(spark, sf_dir):
    """Detections, one row per id, with the key of their document."""
    e = table(spark, sf_dir, "entities").where("document_id IS NOT NULL")
    return e.select(
        F.col("id").alias("span_id"), clean_key(F.col("document_id")).alias("doc"), "text", F.col("start_idx").alias("start"), F.col("end_idx").alias("end"), "entity_type", "confidence", "source"
    ).distinct()


def texts(spark, sf_dir):
    return table(spark, sf_dir, "scan_documents").where("content IS NOT NULL").select(F.col("id").alias("doc"), F.col("content").alias("doc_text")).distinct()


def spans_in_texts(spark, sf_dir):
    return entity_spans(spark, sf_dir).join(texts(spark, sf_dir), "doc")


IN_TEXTS = f"SELECT s.*, t.doc_text FROM ({SPANS}) s JOIN ({TEXTS}) t ON s.doc = t.doc"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def alternatives(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


def long_counts(sql: str) -> str:
    """``count_if(x)`` as ``count(*) FILTER (WHERE x)``, which is a BIGINT in every engine."""
    out, rest = "", sql
    while (at := rest.find("count_if(")) >= 0:
        out, rest, depth, end = out + rest[:at], rest[at + 9 :], 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        out, rest = f"{out}count(*) FILTER (WHERE {rest[: end - 1]})", rest[end:]
    return out + rest
