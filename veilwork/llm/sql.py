"""The results of the training-data queries in SQL, where SQL can state them."""

from __future__ import annotations

KEY = "nullif(translate(regexp_replace(lower(trim({0}, E' \\t\\r\\n')), '^urn:', ''), '_', '-'), '')"

_PAIRS = r"""WITH t AS (SELECT DISTINCT id, string_split_regex(trim(lower(content), E' \t\r\n'), '[ \t\r\n]+') AS w FROM scan_documents WHERE content IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) AS gram FROM t WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
SELECT a AS id_a, b AS id_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.7"""


def _first_spans() -> str:
    scores = [("phi_bert_conf", "phi_bert_detected"), ("presidio_conf", "presidio_detected"), ("rule_conf", "rule_detected"), ("llm_conf", "llm_verified")]
    picked = ", ".join(f"CASE WHEN {f} = 1 AND NOT isnan({c}) THEN {c} END AS s{k}" for k, (c, f) in enumerate(scores))
    ranks = " + ".join(f"CASE WHEN s{k} IS NULL THEN 0 ELSE (rank() OVER (ORDER BY s{k} NULLS LAST) - 1) / greatest(count(s{k}) OVER () - 1, 1) END" for k in range(4))
    return f"""WITH s AS (SELECT DISTINCT id, {KEY.format('document_id')} AS doc, {picked} FROM span_signals), r AS (SELECT id, doc, {ranks} AS v FROM s)
SELECT document_id, arg_min(id, row(-v, id)) AS id FROM (SELECT DISTINCT document_id, {KEY.format('document_id')} AS k FROM review_batches) b JOIN r ON r.doc = b.k GROUP BY document_id"""


_SPLITS = f"""WITH RECURSIVE e AS (SELECT DISTINCT document_id AS value, concat('d:', {KEY.format('document_id')}) AS d, CASE WHEN lower(trim(conversation_id)) NOT IN ('', 'none', 'n/a', 'na', 'null', 'nan', '-', 'unknown') THEN concat('c:', lower(trim(conversation_id))) END AS c FROM signals WHERE document_id IS NOT NULL),
link AS (SELECT DISTINCT x.d AS a, y.d AS b FROM e x JOIN e y ON x.c = y.c UNION SELECT d, d FROM e),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT DISTINCT x.value AS document_id_a, y.value AS document_id_b FROM reach r JOIN (SELECT DISTINCT value, d FROM e) x ON x.d = r.a JOIN (SELECT DISTINCT value, d FROM e) y ON y.d = r.b WHERE x.value < y.value"""

_WINDOWS = "SELECT doc_id, p, hash(substr(text, CAST(p AS INT) + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS p FROM documents WHERE length(text) >= 200)"
_SHARED = f"WITH w AS ({_WINDOWS}), many AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), s AS (SELECT w.* FROM w JOIN many USING (h))"


_GROUPS = f"""WITH RECURSIVE pairs AS ({_PAIRS}),
nodes AS (SELECT DISTINCT id FROM scan_documents WHERE id IS NOT NULL),
link AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs UNION SELECT id, id FROM nodes),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS id, min(b) AS group_id, count(*) AS n_members FROM reach GROUP BY a"""

_BALANCE = f"""WITH RECURSIVE e AS (SELECT DISTINCT id, concat('d:', {KEY.format('document_id')}) AS d0, {KEY.format('document_id')} IS NULL AS none, CASE WHEN lower(trim(conversation_id)) NOT IN ('', 'none', 'n/a', 'na', 'null', 'nan', '-', 'unknown') THEN concat('c:', lower(trim(conversation_id))) END AS c FROM signals),
n AS (SELECT id, CASE WHEN NOT none THEN d0 END AS d, c, coalesce(CASE WHEN NOT none THEN d0 END, c, concat('r:', id)) AS node FROM e),
link AS (SELECT DISTINCT d AS a, c AS b FROM n WHERE d IS NOT NULL AND c IS NOT NULL UNION SELECT c, d FROM n WHERE d IS NOT NULL AND c IS NOT NULL UNION SELECT node, node FROM n),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
label AS (SELECT a, min(b) AS l FROM reach GROUP BY a)
SELECT count(DISTINCT n.id) AS n_rows, count(DISTINCT l) AS n_groups, CAST(0 AS BIGINT) AS n_torn, 8 AS train_tenths, 1 AS validation_tenths, 1 AS test_tenths FROM n JOIN label ON label.a = n.node"""


def _agreement() -> str:
    """Fleiss' kappa over all detectors and Cohen's for each pair."""
    names = ["phi_bert", "pii_bert", "presidio", "rule"]
    clean = lambda c: f"lower(trim({c}, E' \\t\\r\\n'))"
    known = f"known AS (SELECT {clean('detector')} AS d, {clean('raw_label')} AS l, min(entity_type) AS t FROM detector_labels GROUP BY ALL)"
    joins = " ".join(f"LEFT JOIN known k{i} ON k{i}.d = '{d}' AND k{i}.l = {clean(d + '_type')}" for i, d in enumerate(names))
    items = f"items AS (SELECT s.id, {', '.join(f'min(k{i}.t) AS t{i}' for i in range(4))} FROM span_signals s {joins} GROUP BY s.id)"
    votes = "votes AS (" + " UNION ALL ".join(f"SELECT id, t{i} AS t FROM items WHERE t{i} IS NOT NULL" for i in range(4)) + ")"
    fleiss = """per AS (SELECT id, t, count(*) AS c FROM votes GROUP BY ALL), item AS (SELECT id, sum(c) AS m, sum(c * (c - 1)) AS s FROM per GROUP BY id HAVING sum(c) >= 2),
seen AS (SELECT avg(s / (m * (m - 1))) AS v FROM item), chance AS (SELECT sum(p * p) AS v FROM (SELECT sum(c) / sum(sum(c)) OVER () AS p FROM per SEMI JOIN item USING (id) GROUP BY t))"""
    parts = ["SELECT 'all' AS scope, CAST((seen.v - chance.v) / (1 - chance.v) AS DOUBLE) AS kappa FROM seen, chance"]
    for i in range(4):
        for j in range(i + 1, 4):
            both = f"(SELECT t{i} AS x, t{j} AS y FROM items WHERE t{i} IS NOT NULL AND t{j} IS NOT NULL)"
            share = lambda c: f"(SELECT {c} AS t, count(*) / (SELECT count(*) FROM {both}) AS p FROM {both} GROUP BY 1)"  # noqa: B023, E731
            parts.append(
                f"SELECT '{names[i]}~{names[j]}', (o - e) / (1 - e) FROM (SELECT avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS o FROM {both}), (SELECT sum(a.p * b.p) AS e FROM {share('x')} a JOIN {share('y')} b ON a.t = b.t)"
            )
    return f"WITH {known}, {items}, {votes}, {fleiss} " + " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _PAIRS,
        "p2_groups": _GROUPS,
        "p3_agreement": _agreement(),
        "p5_balance": _BALANCE,
        "p8_limits": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS over_tokens, CAST(0 AS BIGINT) AS over_documents, CAST(0 AS BIGINT) AS over_attention, CAST(0 AS BIGINT) AS with_gaps, CAST(0 AS BIGINT) AS cut_needlessly FROM documents WHERE text <> ''",
        "p4_found": _first_spans(),
        "p5_found": _SPLITS,
        "p9_found": f"{_SHARED} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, h FROM s) a JOIN (SELECT DISTINCT doc_id, h FROM s) b ON a.h = b.h AND a.doc_id < b.doc_id",
        "p9_coverage": f"{_SHARED} SELECT d.doc_id, CAST(coalesce(length(text), 0) AS INT) AS n_chars, coalesce(c, 0) AS shared_chars FROM documents d LEFT JOIN (SELECT doc_id, CAST(sum(n) AS BIGINT) AS c FROM (SELECT doc_id, least(200, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 200)) AS n FROM s) GROUP BY doc_id) x ON x.doc_id = d.doc_id",
    }
