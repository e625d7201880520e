"""Exports: corrections, audit logs, data sets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORRECTION_FIELDS = ["entity_text", "detected_type", "decision", "correct_type", "context_before", "context_after", "ner_confidence", "llm_confidence"]
AUDIT_FIELDS = ["id", "sequence", "event_type", "timestamp", "user_id", "conversation_id", "details", "ip_address", "user_agent", "prev_hash", "hash"]


def correction_json(corrections: DataFrame) -> DataFrame:
    """One JSON object per correction, with all its fields."""
    return corrections.select("id", F.to_json(F.struct(*CORRECTION_FIELDS)).alias("json"))


def export_corrections(corrections: DataFrame, path: str) -> None:
    """Corrections as JSON lines, absent values left out."""
    corrections.select(*CORRECTION_FIELDS).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nulls as empty fields; quotes inside a field are doubled."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """A log in the eleven columns of its export; columns that the log lacks are null."""
    have = set(events.columns)
    named = {"timestamp": F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")} | {c: F.col(c) for c in AUDIT_FIELDS if c in have}
    return events.select(*(named.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in AUDIT_FIELDS))


def export_audit(log: DataFrame, path: str, now: Column, as_json: bool = False) -> DataFrame:
    """The log written to ``path`` as CSV or JSON lines; gives the event that says so, to be appended to the log.

    The event: event_type, at, details (JSON with the number of records, the path and the layout).
    """
    rows = audit_rows(log)
    if as_json:
        rows.write.mode("overwrite").json(path)
    else:
        write_csv(rows, path)
    what = F.to_json(F.struct(F.col("n").alias("records_exported"), F.lit(path).alias("output_path"), F.lit("json" if as_json else "csv").alias("format")))
    return log.agg(F.count(F.lit(1)).alias("n")).select(F.lit("AUDIT_EXPORTED").alias("event_type"), now.alias("at"), what.alias("details"))


def write_dataset(samples: DataFrame, path: str, **metadata: Column) -> None:
    """Samples as JSON lines, and beside them one row of counts."""
    samples.write.mode("overwrite").json(f"{path}/samples")
    samples.agg(F.count(F.lit(1)).alias("n_samples"), *(v.alias(k) for k, v in metadata.items())).write.mode("overwrite").json(f"{path}/metadata")


def _show(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    text = F.format_string("%.4f", F.col(c)) if kind in ("double", "float") else F.col(c).cast("string")
    return F.coalesce(text, F.lit(""))


def markdown_rows(table: DataFrame) -> DataFrame:
    """(row): every row of a table as a line of Markdown; written with ``df.write.text`` where it is large."""
    return table.select(F.concat(F.lit("| "), F.array_join(F.array(*(_show(table, c) for c in table.columns)), " | "), F.lit(" |")).alias("row"))


def markdown(title: str, table: DataFrame) -> str:
    """A report table as Markdown; all its rows come to the driver, so it is for reports, which are small."""
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns)
    return f"# {title}\n\n{head}\n" + "\n".join(r["row"] for r in markdown_rows(table).collect()) + "\n"
