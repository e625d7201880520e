"""Queries over orphan references."""

from __future__ import annotations

from veilwork.operators.references import REVIEW_STORE, orphan_counts, orphan_references
from veilwork.runtime import table


def p6_found(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("entities", "corrections", "scan_documents")}
    return orphan_references(tables, table(spark, sf_dir, "deletions"), REVIEW_STORE)


def p6_counts(spark, sf_dir):
    return orphan_counts(p6_found(spark, sf_dir))


_KEY = "nullif(translate(regexp_replace(lower(trim({0}, E' \\t\\r\\n')), '^urn:', ''), '_', '-'), '')"


def _part(child, col, parent, time):
    return f"""SELECT '{child}' AS child_table, '{col}' AS ref_column, id AS child_id, '{parent}' AS parent, {_KEY.format(col)} AS key, {time} AS at FROM {child}"""


_ORPHANS = f"""WITH refs AS ({_part('entities', 'document_id', 'scan_documents', 'created_at')} UNION ALL {_part('corrections', 'entity_id', 'entities', 'reviewed_at')} UNION ALL {_part('corrections', 'document_id', 'scan_documents', 'reviewed_at')}),
known AS (SELECT parent, key, min(born) AS born FROM (SELECT 'scan_documents' AS parent, {_KEY.format('id')} AS key, created_at AS born FROM scan_documents UNION ALL SELECT 'entities', {_KEY.format('id')}, created_at FROM entities) GROUP BY ALL),
gone AS (SELECT DISTINCT table_name AS parent, {_KEY.format('record_id')} AS key FROM deletions),
found AS (SELECT DISTINCT child_table, ref_column, child_id,
 CASE WHEN k.key IS NULL AND g.key IS NOT NULL THEN 'deleted' WHEN k.key IS NULL THEN 'missing' WHEN k.born > r.at THEN 'late' END AS kind,
 coalesce(strftime(r.at, '%Y-%m'), 'unknown') AS period
 FROM refs r LEFT JOIN known k ON r.parent = k.parent AND r.key = k.key LEFT JOIN gone g ON r.parent = g.parent AND r.key = g.key WHERE r.key IS NOT NULL)
"""


def queries():
    return {"p6_found": p6_found, "p6_counts": p6_counts}


def oracle_sql():
    return {
        "p6_found": _ORPHANS + "SELECT * FROM found WHERE kind IS NOT NULL",
        "p6_counts": _ORPHANS + "SELECT child_table, ref_column, kind, period, count(*) AS n_orphans FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    }
