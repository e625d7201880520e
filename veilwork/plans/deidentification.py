"""Queries over de-identified texts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog import rules as R
from veilwork.catalog.rules import SMALL_ZIP_PREFIXES
from veilwork.operators import deidentify as S
from veilwork.operators import detect as D
from veilwork.operators import fuse as E
from veilwork.operators import sessions as C
from veilwork.plans import base as B
from veilwork.runtime import table

_LAYOUTS = ["MM/dd/yyyy", "MM-dd-yyyy", "MM/dd/yy", "yyyy-MM-dd", "yyyy/MM/dd", "MMMM dd, yyyy", "dd MMM yyyy", "dd.MM.yyyy"]
_PRINT = {"MM/dd/yyyy": "%m/%d/%Y", "MM-dd-yyyy": "%m-%d-%Y", "MM/dd/yy": "%m/%d/%y", "yyyy-MM-dd": "%Y-%m-%d", "yyyy/MM/dd": "%Y/%m/%d", "MMMM dd, yyyy": "%B %d, %Y", "dd MMM yyyy": "%d %b %Y"}


def _print_sql(layout: str, moved: str) -> str:
    show = f"strftime({moved}, '{_PRINT[layout]}')"
    # "05 May 1998" is read, and so written, with the full name of the month
    return f"CASE WHEN month(CAST(o_orderdate AS DATE)) = 5 THEN strftime({moved}, '%d %B %Y') ELSE {show} END" if layout == "dd MMM yyyy" else show


def date_shift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_custkey").cast("string").alias("conv"))
    pick = F.lit(None).cast("string")
    for k, f in enumerate(_LAYOUTS):
        pick = F.when(F.col("o_orderkey") % len(_LAYOUTS) == k, F.date_format("d", f)).otherwise(pick)
    off = S.date_offset(F.col("conv"))
    return o.withColumn("written", pick).select("o_orderkey", off.alias("days"), S.shift_date(F.col("written"), off).alias("shifted"), S.shift_year(F.col("written"), off).alias("year_only"))


def zip_generalise(spark, sf_dir):
    z = F.expr("concat(lpad(cast((c_custkey * 37) % 100000 as string), 5, '0'), CASE WHEN c_custkey % 3 = 0 THEN '-1234' ELSE '' END)")
    return table(spark, sf_dir, "customer").select("c_custkey", S.generalise_zip(z).alias("zip3"), S.generalise_zips_in(F.concat(F.lit("at "), z, F.lit(" now"))).alias("in_text"))


def age_generalise(spark, sf_dir):
    a = (F.col("c_custkey") % 130).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", S.generalise_age(a).alias("age"), S.generalise_ages_in(F.concat(F.lit("seen, age: "), a, F.lit(", a "), a, F.lit("-year-old"))).alias("in_text"))


def lookup_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.lookup_hash(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("hash"))


def _redactable(spark, sf_dir):
    """Merged spans whose text agrees with their place."""
    m = E.tiered_merge(B.entity_spans(spark, sf_dir)).join(B.texts(spark, sf_dir), "doc")
    ok = m.where((F.col("start") >= 0) & (F.substring(F.col("doc_text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")))
    return ok.select("doc", F.concat(F.lit("g"), F.col("grp").cast("string")).alias("span_id"), "start", "end", "text", "entity_type")


def token_assign(spark, sf_dir):
    return S.assign_tokens(_redactable(spark, sf_dir)).select("doc", "span_id", "token")


def redact_texts(spark, sf_dir):
    return S.redact(B.texts(spark, sf_dir), S.assign_tokens(_redactable(spark, sf_dir))).select("doc", "redacted", F.size("token_map").cast("long").alias("n_tokens"))


def restore_texts(spark, sf_dir):
    """Every text, redacted and restored to the letter."""
    r = S.redact(B.texts(spark, sf_dir), S.assign_tokens(_redactable(spark, sf_dir)))
    return r.select("doc", S.restore_log(F.col("redacted"), F.col("log")).alias("restored"))


def redaction_log(spark, sf_dir):
    r = S.redact(B.texts(spark, sf_dir), S.assign_tokens(_redactable(spark, sf_dir)))
    return r.select("doc", F.explode("log").alias("x")).select("doc", "x.start", "x.end", "x.token", "x.original")


def safe_harbor(spark, sf_dir):
    return S.safe_harbor(B.texts(spark, sf_dir), _redactable(spark, sf_dir)).select("doc", "text", F.size("changes").cast("long").alias("n_changes"))


def safe_harbor_changes(spark, sf_dir):
    out = S.safe_harbor(B.texts(spark, sf_dir), _redactable(spark, sf_dir))
    return out.select("doc", F.explode("changes").alias("x")).select("doc", "x.original", "x.transformed", "x.type", "x.start", "x.end")


def generalised_spans(spark, sf_dir):
    return _redactable(spark, sf_dir).select("doc", "span_id", S.generalise(F.col("text"), F.col("entity_type"), F.col("doc")).alias("value"))


def message_tokens(spark, sf_dir):
    m = table(spark, sf_dir, "messages").select("id", "content").distinct()
    return m.select("id", F.size(F.coalesce(S.find_tokens(F.col("content")), F.array())).cast("long").alias("n_tokens"))


def encrypted_roundtrip(spark, sf_dir):
    key = S.derive_key("a password", b"salt", 1000)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("sealed"))
    sealed = S.encrypt(c, "sealed", key).withColumn("n_bytes", F.octet_length("sealed"))
    return S.decrypt(sealed, "sealed", key).select("c_custkey", F.col("sealed").alias("c_name"), "n_bytes")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "messages").select("id", "conversation_id", "role", "content", "content_redacted", "created_at", "compacted").distinct()


def conversation_context(spark, sf_dir):
    return C.context(_messages(spark, sf_dir)).select("conversation_id", "n_messages", "tokens")


def compaction_split(spark, sf_dir):
    return C.compaction(_messages(spark, sf_dir), limit=400, keep=10)


def recent_messages(spark, sf_dir):
    return C.recent_messages(_messages(spark, sf_dir), 3).select("conversation_id", "id")


def recent_conversations(spark, sf_dir):
    return C.recent_conversations(_messages(spark, sf_dir)).select("conversation_id", "n_messages")


def expired_conversations(spark, sf_dir):
    return C.expired_conversations(_messages(spark, sf_dir), F.expr("TIMESTAMP '2025-03-01 00:00:00'"))


def _message_spans(spark, sf_dir):
    """Merged findings of every rule in messages, keyed by ``message_id``."""
    hits = D.detect(table(spark, sf_dir, "messages").select("id", "content").distinct(), "id", "content")
    one = hits.select(F.col("id").alias("doc"), F.concat_ws("-", "id", "start", "rule").alias("span_id"), "text", "start", "end", "entity_type", "confidence", F.lit("rule").alias("source"))
    m = E.tiered_merge(one)
    return m.select(F.col("doc").alias("message_id"), F.concat(F.lit("g"), F.col("grp").cast("string")).alias("span_id"), "start", "end", "text", "entity_type")


def _session(spark, sf_dir):
    return C.process_user_messages(_messages(spark, sf_dir), _message_spans(spark, sf_dir))


def session_redacted(spark, sf_dir):
    return _session(spark, sf_dir)[0]


def session_tokens(spark, sf_dir):
    """The tokens of each conversation, sealed with a password's key and opened again."""
    key = S.derive_key("a password", b"salt", 1000)
    return C.unseal(C.seal(_session(spark, sf_dir)[1], key), key)


def session_answers(spark, sf_dir):
    """An answer about every token: known ones become what they stand for, others stay."""
    tokens = _session(spark, sf_dir)[1]
    said = F.concat(F.lit("About "), "token", F.lit(" and [NOBODY_999]"))
    answers = tokens.select(F.concat("doc", "token").alias("id"), F.col("doc").alias("conversation_id"), said.alias("content"))
    return C.process_assistant_messages(answers, tokens)


def token_counts(spark, sf_dir):
    return C.count_tokens(_session(spark, sf_dir)[1])


def token_lookup(spark, sf_dir):
    """The first token of each kind looked up in every conversation."""
    tokens = _session(spark, sf_dir)[1]
    wanted = tokens.select("doc").distinct().select("doc", F.explode(F.array(*map(F.lit, ["[EMAIL_1]", "[PHONE_1]", "[SSN_1]"]))).alias("token"))
    return C.lookup_tokens(tokens, wanted)


def session_stats(spark, sf_dir):
    return C.session_stats(_messages(spark, sf_dir), _session(spark, sf_dir)[1])


def _conversations(spark, sf_dir):
    m = _messages(spark, sf_dir).where("conversation_id IS NOT NULL")
    return m.groupBy(F.col("conversation_id").alias("id")).agg(F.min("content").alias("title"), F.lit(None).cast("string").alias("active_summary"), F.count(F.lit(1)).alias("token_count"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def conversations_changed(spark, sf_dir):
    """Conversations created, given a summary, and deleted: those of more than 12 messages get one, those of one message go."""
    now = F.expr("TIMESTAMP '2026-01-01 00:00:00'")
    c = _conversations(spark, sf_dir)
    new = c.select(F.concat("id", F.lit("-copy")).alias("id"), "title").unionByName(c.select("id", F.lit("known").alias("title")))
    made = C.create_conversations(c, new, now)
    told = C.update_conversations(made, c.where("token_count > 12").select("id", F.lit("long").alias("active_summary")), now)
    gone = c.where("token_count = 1").select("id")
    out, _, _ = C.delete_conversations(told, _messages(spark, sf_dir), spark.createDataFrame([], "doc string, token string"), gone)
    return out.select("id", "active_summary", "token_count", "updated_at")


def conversation_summaries(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("id", C.append_summary(F.col("content_redacted"), F.col("role")).alias("summary"))


def queries():
    fs = (
        redaction_log, safe_harbor, safe_harbor_changes, generalised_spans, session_redacted, session_tokens, session_answers, token_counts, token_lookup, session_stats, conversations_changed, conversation_summaries,
    )
    return {f.__name__: f for f in fs} | {f.__name__: f for f in (date_shift, zip_generalise, age_generalise, lookup_hashes, token_assign, redact_texts, restore_texts, message_tokens, encrypted_roundtrip, conversation_context, compaction_split, recent_messages, recent_conversations, expired_conversations)}


_STRFTIME = {"M/d/yyyy": "%m/%d/%Y", "M-d-yyyy": "%m-%d-%Y", "M/d/yy": "%m/%d/%y", "M-d-yy": "%m-%d-%y", "yyyy-M-d": "%Y-%m-%d", "yyyy/M/d": "%Y/%m/%d", "MMMM d, yyyy": "%B %d, %Y", "MMM d, yyyy": "%b %d, %Y", "d MMMM yyyy": "%d %B %Y", "d MMM yyyy": "%d %b %Y"}


def _general_sql(text: str, kind: str, conv: str) -> str:
    """The value that may be kept of a date, age or postcode."""
    off = f"CAST(CAST(concat('0x', substr(sha256({conv}), 1, 8)) AS BIGINT) % 335 + 30 AS INT)"
    t, d = f"trim({text}, ' ')", f"regexp_replace({text}, '[^0-9]', '', 'g')"
    shifted = ", ".join(f"CASE WHEN regexp_full_match({t}, '{shape}') THEN strftime(CAST(try_strptime({t}, '{_STRFTIME[parse]}') AS DATE) + {off}, '{_STRFTIME[parse]}') END" for (parse, _), shape in zip(S.DATE_FORMATS, S._SHAPES, strict=True))
    age = f"CASE WHEN {d} = '' THEN {text} WHEN TRY_CAST({d} AS BIGINT) > 89 THEN '90+' ELSE CAST(TRY_CAST({d} AS BIGINT) AS VARCHAR) END"
    zip3 = f"CASE WHEN length({d}) < 5 THEN {text} WHEN substr({d}, 1, 3) IN ({B.quoted(SMALL_ZIP_PREFIXES)}) THEN '000XX' ELSE concat(substr({d}, 1, 3), 'XX') END"
    return f"CASE WHEN upper({kind}) IN ({B.quoted(S.DATE_KINDS)}) THEN coalesce({shifted}, {text}) WHEN upper({kind}) = 'AGE' THEN {age} WHEN upper({kind}) IN ('ZIP', 'ZIP_CODE', 'ZIPCODE', 'POSTAL_CODE') THEN {zip3} ELSE {text} END"


def oracle_sql():
    from veilwork.plans.detection import _all
    from veilwork.plans.fusion import oracle_sql as fused

    off = "CAST(CAST(concat('0x', substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 335 + 30 AS INT)"
    moved = "(CAST(o_orderdate AS DATE) + CAST(days AS INT))"
    shifted = "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN {_print_sql(f, moved)}" for k, f in enumerate(_LAYOUTS) if f in _PRINT) + " ELSE strftime(CAST(o_orderdate AS DATE), '%d.%m.%Y') END"
    year = f"CASE WHEN o_orderkey % 8 = 7 THEN CAST(year(CAST(o_orderdate AS DATE)) + days // 365 AS VARCHAR) ELSE CAST(year({moved}) AS VARCHAR) END"
    z = "concat(lpad(CAST((c_custkey * 37) % 100000 AS VARCHAR), 5, '0'), CASE WHEN c_custkey % 3 = 0 THEN '-1234' ELSE '' END)"
    small = B.quoted(SMALL_ZIP_PREFIXES)
    zip3 = f"CASE WHEN substr({z}, 1, 3) IN ({small}) THEN '000XX' ELSE concat(substr({z}, 1, 3), 'XX') END"
    tokens = f"""WITH m AS (SELECT s.doc, concat('g', CAST(grp AS VARCHAR)) AS span_id, start, "end", text, entity_type, doc_text, sha256(lower(trim(text, ' '))) AS hash FROM ({fused()['tiered_merge']}) s JOIN ({B.TEXTS}) t ON s.doc = t.doc WHERE start >= 0 AND substr(doc_text, start + 1, "end" - start) = text),
f AS (SELECT doc, hash, arg_min(entity_type, row(-start, span_id)) AS kind, min(row(-start, span_id)) AS u FROM m GROUP BY doc, hash),
k AS (SELECT doc, hash, concat('[', regexp_replace(kind, '^(?:NAME_|DATE_|ID_)', ''), '_', row_number() OVER (PARTITION BY doc, regexp_replace(kind, '^(?:NAME_|DATE_|ID_)', '') ORDER BY u, hash), ']') AS token FROM f)"""
    msgs = "SELECT DISTINCT id, conversation_id, role, content, content_redacted, created_at, compacted FROM messages"
    hits = _all(R.RULES, "(SELECT DISTINCT id, content FROM messages)", "id", "content", 'id AS doc, concat(id, \'-\', start, \'-\', rule) AS span_id, text, start, CAST(start + length(text) AS INT) AS "end", entity_type, confidence, \'rule\' AS source')
    merged = fused()["tiered_merge"].replace(B.SPANS, hits)
    session = f"""WITH m AS (SELECT t.id, content, coalesce(conversation_id, concat('message:', t.id)) AS conv, created_at, concat('g', CAST(grp AS VARCHAR)) AS span_id, start, "end", text, entity_type, sha256(lower(trim(text, ' '))) AS hash FROM ({merged}) s JOIN ({msgs}) t ON s.doc = t.id),
f AS (SELECT conv, hash, arg_min(entity_type, row(created_at, id, -start, span_id)) AS kind, min(row(created_at, id, -start, span_id)) AS u FROM m GROUP BY conv, hash),
k AS (SELECT conv, hash, concat('[', regexp_replace(kind, '^(?:NAME_|DATE_|ID_)', ''), '_', row_number() OVER (PARTITION BY conv, regexp_replace(kind, '^(?:NAME_|DATE_|ID_)', '') ORDER BY u, hash), ']') AS token FROM f)"""
    kept = f"SELECT m.conv AS doc, token, min({_general_sql('text', 'entity_type', 'm.conv')}) AS original FROM m JOIN k ON m.conv = k.conv AND m.hash = k.hash GROUP BY m.conv, token"
    size = "length(coalesce(content_redacted, content, ''))"
    return {
        "date_shift": f"SELECT o_orderkey, days, {shifted} AS shifted, {year} AS year_only FROM (SELECT *, {off} AS days FROM orders)",
        "zip_generalise": f"SELECT c_custkey, {zip3} AS zip3, concat('at ', {zip3}, ' now') AS in_text FROM customer",
        "age_generalise": "SELECT c_custkey, CASE WHEN c_custkey % 130 > 89 THEN '90+' ELSE CAST(c_custkey % 130 AS VARCHAR) END AS age, CASE WHEN c_custkey % 130 > 89 THEN 'seen, age 90+, a 90+ year old' ELSE concat('seen, age: ', c_custkey % 130, ', a ', c_custkey % 130, '-year-old') END AS in_text FROM customer",
        "lookup_hashes": "SELECT c_custkey, sha256(lower(trim(c_name))) AS hash FROM customer",
        "token_assign": f"{tokens} SELECT m.doc, m.span_id, token FROM m JOIN k ON m.doc = k.doc AND m.hash = k.hash",
        "redact_texts": f"""{tokens}, p AS (SELECT m.doc, doc_text, start, "end", token, lag("end", 1, 0) OVER w AS prev, row_number() OVER w AS rn, count(*) OVER (PARTITION BY m.doc) AS n FROM m JOIN k ON m.doc = k.doc AND m.hash = k.hash WINDOW w AS (PARTITION BY m.doc ORDER BY start)),
r AS (SELECT doc, string_agg(concat(substr(doc_text, prev + 1, start - prev), token, CASE WHEN rn = n THEN substr(doc_text, "end" + 1) ELSE '' END), '' ORDER BY start) AS redacted, count(DISTINCT token) AS n_tokens FROM p GROUP BY doc)
SELECT t.doc, coalesce(redacted, doc_text) AS redacted, coalesce(n_tokens, 0) AS n_tokens FROM ({B.TEXTS}) t LEFT JOIN r ON t.doc = r.doc""",
        "restore_texts": f"SELECT doc, doc_text AS restored FROM ({B.TEXTS})",
        "redaction_log": f"""{tokens}, p AS (SELECT m.doc, start, "end", token, text, sum(length(token) - ("end" - start)) OVER (PARTITION BY m.doc ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS moved FROM m JOIN k ON m.doc = k.doc AND m.hash = k.hash)
SELECT doc, CAST(start + coalesce(moved, 0) AS INT) AS start, CAST(start + coalesce(moved, 0) + length(token) AS INT) AS "end", token, text AS original FROM p""",
        "generalised_spans": f"{tokens} SELECT doc, span_id, {_general_sql('text', 'entity_type', 'doc')} AS value FROM m",
        "safe_harbor_changes": f"""{tokens} SELECT doc, text AS original, v AS transformed, entity_type AS type, start, "end" FROM (SELECT *, {_general_sql('text', 'entity_type', 'doc')} AS v FROM m) WHERE v <> text""",
        "safe_harbor": f"""{tokens}, c AS (SELECT *, lag("end", 1, 0) OVER w AS prev, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc) AS n FROM (SELECT *, {_general_sql('text', 'entity_type', 'doc')} AS v FROM m) WHERE v <> text WINDOW w AS (PARTITION BY doc ORDER BY start)),
r AS (SELECT doc, string_agg(concat(substr(doc_text, prev + 1, start - prev), v, CASE WHEN rn = n THEN substr(doc_text, "end" + 1) ELSE '' END), '' ORDER BY start) AS t, count(*) AS n_changes FROM c GROUP BY doc)
SELECT x.doc, coalesce(t, doc_text) AS text, coalesce(n_changes, 0) AS n_changes FROM ({B.TEXTS}) x LEFT JOIN r ON x.doc = r.doc""",
        "encrypted_roundtrip": "SELECT c_custkey, c_name, CAST(strlen(c_name) + 28 AS INT) AS n_bytes FROM customer",
        "session_redacted": f"""{session}, p AS (SELECT m.id, content, start, "end", token, lag("end", 1, 0) OVER w AS prev, row_number() OVER w AS rn, count(*) OVER (PARTITION BY m.id) AS n FROM m JOIN k ON m.conv = k.conv AND m.hash = k.hash WINDOW w AS (PARTITION BY m.id ORDER BY start)),
r AS (SELECT id, string_agg(concat(substr(content, prev + 1, start - prev), token, CASE WHEN rn = n THEN substr(content, "end" + 1) ELSE '' END), '' ORDER BY start) AS redacted FROM p GROUP BY id)
SELECT t.id, coalesce(redacted, content) AS redacted FROM ({msgs}) t LEFT JOIN r ON t.id = r.id""",
        "session_tokens": f"{session} SELECT doc, token, original FROM ({kept})",
        "session_answers": f"{session} SELECT concat(doc, token) AS id, concat('About ', original, ' and [NOBODY_999]') AS content FROM ({kept})",
        "token_counts": f"{session} SELECT doc, regexp_extract(token, '^\\[(.*)_\\d+\\]$', 1) AS kind, count(DISTINCT token) AS n FROM ({kept}) GROUP BY ALL",
        "token_lookup": f"{session}, t AS ({kept}) SELECT w.doc, w.token, t.original FROM (SELECT DISTINCT doc, unnest(['[EMAIL_1]', '[PHONE_1]', '[SSN_1]']) AS token FROM t) w LEFT JOIN t ON t.doc = w.doc AND t.token = w.token",
        "session_stats": f"{session}, t AS ({kept}) SELECT a.doc, n_messages, n_user, coalesce(n_tokens, 0) AS n_tokens FROM (SELECT coalesce(conversation_id, concat('message:', id)) AS doc, count(*) AS n_messages, count_if(lower(role) = 'user') AS n_user FROM ({msgs}) GROUP BY 1) a LEFT JOIN (SELECT doc, count(DISTINCT token) AS n_tokens FROM t GROUP BY doc) b ON a.doc = b.doc",
        "conversations_changed": f"""WITH c AS (SELECT conversation_id AS id, count(*) AS n, max(created_at) AS u FROM ({msgs}) WHERE conversation_id IS NOT NULL GROUP BY 1)
SELECT id, CASE WHEN n > 12 THEN 'long' END AS active_summary, n AS token_count, CASE WHEN n > 12 THEN TIMESTAMP '2026-01-01' ELSE u END AS updated_at FROM c WHERE n <> 1 UNION ALL SELECT concat(id, '-copy'), NULL, 0, TIMESTAMP '2026-01-01' FROM c""",
        "conversation_summaries": f"SELECT id, CASE WHEN length(coalesce(content_redacted, '')) > 0 THEN concat(content_redacted, E'\\n\\n---\\n\\n', role) ELSE role END AS summary FROM ({msgs})",
        "message_tokens": "SELECT id, coalesce(len(regexp_extract_all(content, '\\[[A-Z_]+_\\d+\\]')), 0) AS n_tokens FROM (SELECT DISTINCT id, content FROM messages)",
        "conversation_context": f"SELECT conversation_id, count(*) AS n_messages, CAST(sum({size}) AS BIGINT) // 4 AS tokens FROM ({msgs}) WHERE NOT coalesce(compacted, false) GROUP BY conversation_id",
        "compaction_split": f"SELECT conversation_id, id, (CAST(sum({size}) OVER (PARTITION BY conversation_id) AS BIGINT) // 4 > 400) AND row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) > 10 AS compact FROM ({msgs}) WHERE NOT coalesce(compacted, false)",
        "recent_conversations": f"SELECT conversation_id, count(*) AS n_messages FROM ({msgs}) GROUP BY conversation_id ORDER BY max(created_at) DESC NULLS LAST, conversation_id LIMIT 20",
        "expired_conversations": f"SELECT conversation_id FROM ({msgs}) GROUP BY conversation_id HAVING max(created_at) < TIMESTAMP '2025-03-01' - INTERVAL 30 DAYS",
        "recent_messages": f"SELECT conversation_id, id FROM ({msgs}) QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC) <= 3",
    }
