"""Queries over rule, checksum and secret detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog import rules as R
from veilwork.functions import validators as V
from veilwork.operators import detect as D
from veilwork.runtime import table


def detect_spans(spark, sf_dir):
    hits = D.detect(table(spark, sf_dir, "documents"), "doc_id", "text")
    return hits.withColumnRenamed("id", "doc_id")


def detect_messages(spark, sf_dir):
    hits = D.detect(table(spark, sf_dir, "messages").select("id", "content").distinct(), "id", "content")
    return hits.withColumnRenamed("id", "message_id").drop("has_checksum")


def rule_hits(spark, sf_dir):
    return D.hits_by_rule(D.detect(table(spark, sf_dir, "documents"), "doc_id", "text"))


def checksum_spans(spark, sf_dir):
    return D.detect_checksums(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def secret_spans(spark, sf_dir):
    return D.detect_secrets(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("entropy", F.round("entropy", 9)).withColumnRenamed("id", "doc_id")


def rule_catalog(spark, sf_dir):
    return D.Catalog().table(spark)


def rule_suggestions(spark, sf_dir):
    c = table(spark, sf_dir, "corrections").select("id", "decision", "entity_text").distinct()
    return D.suggest_rules(c).select("text", "n_rejected")


def term_entropy(spark, sf_dir):
    return table(spark, sf_dir, "dictionary_terms").select("term", "category", F.round(V.entropy(F.col("term")), 9).alias("bits"))


_NUMBERS = {
    "ssn": "lpad(cast((o_orderkey * 7919) % 1000000000 as string), 9, '0')",
    "npi": "lpad(cast(1000000000 + (o_orderkey * 104729) % 1000000000 as string), 10, '0')",
    "sin": "lpad(cast((o_orderkey * 15485863) % 1000000000 as string), 9, '0')",
    "card": "lpad(cast(4000000000000000 + (o_orderkey * 982451653) % 1000000000000 as string), 16, '0')",
    "zip": "lpad(cast((o_orderkey * 37) % 100000 as string), 5, '0')",
    "dea": "concat(chr(cast(65 + o_orderkey % 26 as int)), 'B', lpad(cast((o_orderkey * 6151) % 10000000 as string), 7, '0'))",
    "iban": "concat('GB', lpad(cast(o_orderkey % 97 as string), 2, '0'), 'WEST', lpad(cast((o_orderkey * 7919) % 100000000000000 as string), 14, '0'))",
}


def validator_checks(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey", *(F.expr(e).alias(n) for n, e in _NUMBERS.items()))
    return keys.select("o_orderkey", *(F.coalesce(V.CHECKS[n](F.col(n)), F.lit(False)).alias(f"{n}_ok") for n in _NUMBERS), V.luhn_digit(F.col("ssn")).alias("check_digit"))


# ---- the same in DuckDB ----
def _luhn(d: str) -> str:
    x = f"CAST(substr({d}, CAST(i AS INT), 1) AS INT)"
    return f"(coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN (CASE WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END) ELSE {x} END)), 1) % 10 = 0)"


def _sql_check(name: str, c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    if name == "luhn":
        return f"(length({d}) >= 10 AND {_luhn(d)})"
    if name == "card":
        return f"(length({d}) BETWEEN 13 AND 19 AND {_luhn(d)})"
    if name == "ssn":
        return f"(length({d}) = 9 AND substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 3) < '900' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"
    if name == "sin":
        return f"(length({d}) = 9 AND {_luhn(d)})"
    if name == "npi":
        return f"(length({d}) = 10 AND substr({d}, 1, 1) IN ('1', '2') AND {_luhn(f'concat(\'80840\', {d})')})"
    if name == "zip":
        return f"(length({d}) IN (5, 9) AND substr({d}, 1, 3) IN ({', '.join(repr(p) for p in R.ZIP_PREFIXES)}))"
    if name == "dea":
        code = f"regexp_extract(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '[A-Z]{{2}}([0-9]{{7}})', 1)"
        n = [f"TRY_CAST(substr({code}, {i}, 1) AS INT)" for i in range(1, 8)]
        return f"coalesce(({n[0]} + {n[2]} + {n[4]} + 2 * ({n[1]} + {n[3]} + {n[5]})) % 10 = {n[6]}, false)"
    code = f"upper(regexp_replace({c}, '\\s', '', 'g'))"
    values = f"list_transform(string_split(concat(substr({code}, 5), substr({code}, 1, 4)), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN CAST(x AS BIGINT) ELSE CAST(ascii(x) - 55 AS BIGINT) END)"
    return f"(length({code}) BETWEEN 15 AND 34 AND regexp_full_match({code}, '[A-Z0-9]+') AND list_reduce({values}, lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1)"


def span_sql(rule: R.Rule, source: str, id_col: str, text_col: str) -> str:
    """One rule's spans in SQL."""
    p = rule.regex.replace("(?!Mr\\.|Ms\\.|Mrs\\.|Dr\\.|Prof\\.)", "").replace("'", "''")
    groups = f", regexp_extract_all({text_col}, '{p}', 1) AS q" if rule.group else ""
    text = "q[i]" if rule.group else "m[i]"
    at = "CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT)"
    shift = {"lead": "0", "trail": "length(m[i]) - length(q[i])", "inner": "instr(m[i], q[i]) - 1", None: "0"}[rule.group]
    # RE2 knows word borders in ASCII only; beside other letters and digits these two rules need a look at the neighbours
    edge = rule.name in ("license_plate_us", "social_handle")
    keep = f", {text_col} AS whole" if edge else ""
    out = f"""SELECT {id_col} AS id, '{rule.name}' AS rule, '{rule.entity_type}' AS entity_type, CAST({at} + {shift} AS INT) AS start, {text} AS text, CAST({rule.confidence} AS DOUBLE) AS confidence, {str(rule.check is not None).lower()} AS has_checksum{', whole' if edge else ''}
FROM (SELECT {id_col}, m, g{', q' if rule.group else ''}{', whole' if edge else ''}, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {id_col}, regexp_extract_all({text_col}, '{p}') AS m, string_split_regex({text_col}, '{p}') AS g{groups}{keep} FROM {source} WHERE {text_col} IS NOT NULL) WHERE len(m) > 0)"""
    tests = []
    if rule.check:
        tests.append(_sql_check(rule.check, "text"))
    if rule.name == "username_dot":
        tests.append("NOT regexp_matches(text, '^(Mr|Ms|Mrs|Dr|Prof)[.]')")
    if edge:
        tests += ["NOT regexp_matches(substr(whole, start, 1), '[\\p{L}\\p{N}]')" if rule.name == "license_plate_us" else "true", "NOT regexp_matches(substr(whole, start + length(text) + 1, 1), '[^\\x00-\\x7F]') OR NOT regexp_matches(substr(whole, start + length(text) + 1, 1), '[\\p{L}\\p{N}]')"]
    cols = "id, rule, entity_type, start, text, confidence, has_checksum"
    kept = f"SELECT * FROM ({out}) WHERE ({') AND ('.join(tests)})" if tests else out
    if rule.name == "license_plate_us":
        # a blank before a letter beyond ASCII ends at a border, and so belongs to the match
        more = "regexp_matches(text, '[0-9]$') AND regexp_matches(substr(whole, start + length(text) + 1, 2), '^[-\\s][^\\x00-\\x7F]') AND regexp_matches(substr(whole, start + length(text) + 2, 1), '[\\p{L}\\p{N}]')"
        kept = f"SELECT * REPLACE (CASE WHEN {more} THEN concat(text, substr(whole, start + length(text) + 1, 1)) ELSE text END AS text) FROM ({kept})"
    return f"SELECT {cols} FROM ({kept})"


def _all(rules, source, id_col, text_col, head):
    parts = " UNION ALL ".join(span_sql(r, source, id_col, text_col) for r in rules)
    return f'SELECT {head} FROM ({parts})'


def _number_sql() -> str:
    made = ", ".join(e.replace(" as string)", " AS VARCHAR)").replace(" as int)", " AS INT)") + f" AS {n}" for n, e in _NUMBERS.items())
    checks = ", ".join(f"{_sql_check(n, n)} AS {n}_ok" for n in _NUMBERS)
    x = "CAST(substr(reverse(ssn), CAST(i AS INT), 1) AS INT)"
    digit = f"CAST((10 - list_sum(list_transform(range(1, length(ssn) + 1), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN {x} > 4 THEN {x} * 2 - 9 ELSE {x} * 2 END) ELSE {x} END)) % 10) % 10 AS VARCHAR)"
    return f"SELECT o_orderkey, {checks}, {digit} AS check_digit FROM (SELECT o_orderkey, {made} FROM orders)"


def _checksum_sql() -> str:
    """The proven rules, each document's hits folded in order."""
    hits = " UNION ALL ".join(span_sql(r, "documents", "doc_id", "text") for r in R.CHECKSUM_RULES)
    one = "{'start': start, 'neg': -confidence, 'e': start + length(text), 'rule': rule, 'entity_type': entity_type, 'text': text}"
    step = "CASE WHEN x[1].start >= kept[-1].e THEN list_concat(kept, x) WHEN x[1].neg < kept[-1].neg THEN list_concat(kept[1:len(kept) - 1], x) ELSE kept END"
    lists = f"SELECT id, list([s] ORDER BY s.start, s.neg, s.e, s.rule, s.entity_type, s.text) AS h FROM (SELECT DISTINCT id, {one} AS s FROM ({hits})) GROUP BY id"
    return f"""SELECT id AS doc_id, x.rule, x.entity_type, x.start, CAST(x.e AS INT) AS "end", x.text, -x.neg AS confidence FROM (SELECT id, unnest(list_reduce(h, lambda kept, x: {step})) AS x FROM ({lists}))"""


def _entropy_sql(c: str) -> str:
    return f"coalesce(-list_sum(list_transform(list_distinct(string_split({c}, '')), lambda x: (len(list_filter(string_split({c}, ''), lambda y: y = x)) / length({c})) * log2(len(list_filter(string_split({c}, ''), lambda y: y = x)) / length({c})))), 0)"


def _secret_sql() -> str:
    found = span_sql(R.Rule("secret", "PASSWORD", 0.6, R.SECRET_SHAPE), "documents", "doc_id", "text")
    has = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    before, around = "lower(substr(t, greatest(start - 20, 0) + 1, least(start, 20)))", "lower(substr(t, greatest(start - 100, 0) + 1, least(start, 100) + length(text) + 100))"
    # beside a letter or digit beyond ASCII there is no border
    edge = "NOT regexp_matches(substr(t, start, CASE WHEN start = 0 THEN 0 ELSE 1 END), '[\\p{L}\\p{N}]') AND NOT regexp_matches(substr(t, start + length(text) + 1, 1), '[\\p{L}\\p{N}]')"
    m = lambda p: f"regexp_matches(text, '{p}')"
    special, letter, digit = m("[^\\p{L}\\p{N}]"), m("\\p{L}"), m("\\p{Nd}")
    ok = f"""{edge} AND NOT ({has(before, R.SECRET_LABELS)} AND regexp_matches({before}, '[:=]\\s*$')) AND NOT {has('lower(text)', R.SECRET_SELF)} AND NOT {m('^[A-Z][a-z]+[._][A-Z][a-z]+$')}
AND CAST({letter} AS INT) + CAST({digit} AS INT) + CAST({special} AS INT) >= 2 AND (({m('\\p{Lu}')} AND {m('\\p{Ll}')}) OR {special}) AND NOT {has(around, R.SECRET_NEGATIVES)}"""
    conf = f"CASE WHEN entropy < 2.8 THEN NULL WHEN {has(around, R.SECRET_HINTS)} THEN 0.9 WHEN entropy >= 3.5 THEN 0.75 WHEN entropy >= 3.0 THEN 0.6 END"
    return f"""SELECT doc_id, start, CAST(start + length(text) AS INT) AS "end", text, CAST(confidence AS DOUBLE) AS confidence, round(entropy, 9) AS entropy FROM (SELECT doc_id, start, text, entropy, {conf} AS confidence FROM (SELECT id AS doc_id, start, f.text, d.text AS t, {_entropy_sql('f.text')} AS entropy FROM ({found}) f JOIN documents d ON f.id = d.doc_id) WHERE {ok}) WHERE confidence IS NOT NULL"""


def _catalog_sql() -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({text(r.name)}, {text(r.entity_type)}, CAST({r.confidence} AS DOUBLE), {text(r.regex)}, {text(r.check)}, {str(r.group is not None).lower()})" for r in R.RULES)
    return f"SELECT * FROM (VALUES {rows}) AS t(rule, entity_type, confidence, pattern, validator, emits_group)"


def queries():
    return {
        "detect_spans": detect_spans,
        "detect_messages": detect_messages,
        "rule_hits": rule_hits,
        "checksum_spans": checksum_spans,
        "secret_spans": secret_spans,
        "rule_catalog": rule_catalog,
        "rule_suggestions": rule_suggestions,
        "term_entropy": term_entropy,
        "validator_checks": validator_checks,
    }


def oracle_sql():
    spans = _all(R.RULES, "documents", "doc_id", "text", 'id AS doc_id, rule, entity_type, start, CAST(start + length(text) AS INT) AS "end", text, confidence, has_checksum')
    return {
        "detect_spans": spans,
        "detect_messages": _all(R.RULES, "(SELECT DISTINCT id, content FROM messages)", "id", "content", 'id AS message_id, rule, entity_type, start, CAST(start + length(text) AS INT) AS "end", text, confidence'),
        "rule_hits": f"SELECT rule, entity_type, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM ({spans}) GROUP BY ALL",
        "checksum_spans": _checksum_sql(),
        "secret_spans": _secret_sql(),
        "rule_catalog": _catalog_sql(),
        "rule_suggestions": "SELECT lower(trim(entity_text)) AS text, count(*) AS n_rejected FROM (SELECT DISTINCT id, decision, entity_text FROM corrections) WHERE decision = 'rejected' AND entity_text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10",
        "term_entropy": "SELECT term, category, round(coalesce(-list_sum(list_transform(list_distinct(string_split(term, '')), lambda x: (len(list_filter(string_split(term, ''), lambda y: y = x)) / length(term)) * log2(len(list_filter(string_split(term, ''), lambda y: y = x)) / length(term)))), 0), 9) AS bits FROM dictionary_terms",
        "validator_checks": _number_sql(),
    }
