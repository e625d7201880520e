"""Queries over dictionaries and curated data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilwork.operators import curate as L
from veilwork.operators import dictionary as D
from veilwork.operators import generate as G
from veilwork.operators.suppress import is_drug_name
from veilwork.plans import base as B
from veilwork.runtime import clean_key, shared_dir, table


def dictionary_hits(spark, sf_dir):
    return D.dictionary_hits(B.texts(spark, sf_dir), table(spark, sf_dir, "dictionary_terms")).withColumnRenamed("id", "doc")


def dictionary_status(spark, sf_dir):
    return D.status(table(spark, sf_dir, "dictionary_terms"))


def dictionary_longest(spark, sf_dir):
    return D.capped(table(spark, sf_dir, "dictionary_terms").distinct(), 20)


def dictionary_lookup(spark, sf_dir):
    return D.lookup(table(spark, sf_dir, "entities").select(F.col("text").alias("term")).distinct(), table(spark, sf_dir, "dictionary_terms"), ["DRUG", "FACILITY", "TOWN", "SURNAME", "GIVEN_NAME"])


def provider_registry(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000000).cast("string").alias("npi"), F.col("c_name").alias("name"))
    keys = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 1000000000).cast("string").alias("npi"))
    return D.registry_lookup(keys, c).select("o_orderkey", "valid", "name")


def label_quality(spark, sf_dir):
    """Every span, and every word of messages as each family of types."""
    e = B.entity_spans(spark, sf_dir).select("span_id", "entity_type", "text")
    words = table(spark, sf_dir, "messages").select(F.explode(F.split("content", r"\s+")).alias("text")).where("text <> ''").distinct()
    typed = words.select(F.lit("word").alias("span_id"), F.explode(F.array(*map(F.lit, [t[0] for t in L.QUALITY_KINDS.values()]))).alias("entity_type"), "text")
    return L.with_quality(e.unionByName(typed)).select("span_id", "entity_type", "text", "q.clean", "q.reason", "q.score")


def curated_documents(spark, sf_dir):
    return L.curate(B.entity_spans(spark, sf_dir)).select("doc", "n_clean", F.round("quality", 9).alias("quality"), "n_refused")


def curation_tallies(spark, sf_dir):
    return L.curation_tallies(B.spans_in_texts(spark, sf_dir), around="doc_text")


def golden_documents(spark, sf_dir):
    return L.golden_documents(B.spans_in_texts(spark, sf_dir), 2).select("doc", "n_entities", F.round("quality", 9).alias("quality"))


def balanced_sample(spark, sf_dir):
    return L.first_per_type(B.entity_spans(spark, sf_dir), scale=0.05).select("span_id", "entity_type")


def merged_sources(spark, sf_dir):
    m = L.merge_sources({"documents": table(spark, sf_dir, "documents").select(F.col("text")), "messages": table(spark, sf_dir, "messages").select(F.col("content").alias("text"), "role")})
    return m.groupBy("_source", "role").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"))


def training_samples(spark, sf_dir):
    c = table(spark, sf_dir, "corrections").where("document_id IS NOT NULL").select(clean_key(F.col("document_id")).alias("doc"), "entity_start", "entity_end", "detected_type", "correct_type", "decision").where("doc IS NOT NULL")
    return L.training_samples(c).select("doc", F.size("entities").cast("long").alias("n_entities"), "negative")


def word_tags(spark, sf_dir):
    return L.word_tags(B.texts(spark, sf_dir), B.entity_spans(spark, sf_dir)).groupBy("doc", "tag").agg(F.count(F.lit(1)).alias("n"))


def aligned_pieces(spark, sf_dir):
    """Words of customers' orders cut into pieces of three characters, with labels, in windows of 32."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 5).cast("int").alias("label"))
    n = F.ceil(F.length(F.col("pos").cast("string")) / 3).cast("int")
    pieces = o.select("doc", "pos", F.transform(F.sequence(F.lit(1), n), lambda i: i + 100).alias("piece_ids"))
    x = L.align_pieces(o, pieces, length=32)
    return x.select("doc", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"), F.array_join("mask", ",").alias("mask"))


def feature_sums(spark, sf_dir):
    v = L.feature_vectors(table(spark, sf_dir, "span_signals").select("id", *L.FEATURES).distinct())
    return v.select("id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _generated(spark, what, n):
    g = G.generate(spark, what, n)
    one = F.transform("entities", lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"), e["entity_type"], e["cluster"], e["text"]))
    placed = F.forall("entities", lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]) == e["text"])
    return g.select("id", "family", "text", F.array_join(one, "|").alias("entities"), placed.alias("placed"))


def generated_samples(spark, sf_dir):
    return _generated(spark, "samples", 5000)


def generated_negatives(spark, sf_dir):
    return _generated(spark, "negatives", 3000)


def generated_notes(spark, sf_dir):
    return _generated(spark, "notes", 3000)


def generated_adversarial(spark, sf_dir):
    return _generated(spark, "adversarial", 3000)


def generated_simple(spark, sf_dir):
    return _generated(spark, "simple", 2000)


def reinjected(spark, sf_dir):
    m = table(spark, sf_dir, "messages").select(F.col("id").alias("doc"), F.col("content").alias("doc_text")).distinct()
    r = L.reinject(m, ["Ana Abel", "Boris Bauer"])
    placed = F.forall("entities", lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]) == e["value"])
    return r.select("id", "text", F.size("entities").cast("long").alias("n"), placed.alias("placed"))


def mixed_training(spark, sf_dir):
    """All reviewed signals, all adversarial texts, and a fifth of the made ones, give or take."""
    real = table(spark, sf_dir, "corrections").select(F.col("id").alias("key")).distinct()
    made = lambda what, n: G.generate(spark, what, n).select(F.concat(F.lit(what), F.col("id").cast("string")).alias("key"))
    mix = L.training_mix(real, made("adversarial", 1000), made("samples", 20_000))
    n = F.count(F.lit(1))
    return mix.groupBy("_source").agg(F.when(F.col("_source") == "synthetic", (n.between(3700, 4300)).cast("long")).otherwise(n).alias("n"))


def _labelled(spark, sf_dir):
    s = table(spark, sf_dir, "span_signals").where("ground_truth_type IS NOT NULL")
    return s.select("id", *L.FEATURES, (F.upper("merged_type") == F.upper("ground_truth_type")).cast("int").alias("label")).where("label IS NOT NULL").distinct()


def held_out_rows(spark, sf_dir):
    """Rows of each label, and whether about a fifth of them are held out."""
    h = L.held_out(_labelled(spark, sf_dir).select("id", "label").distinct())
    return h.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("held").cast("double")).between(0.1, 0.3).alias("a_fifth"))


def acceptor_metrics(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    if labelled.isEmpty():
        return spark.createDataFrame([], "tp long, fp long, fn long")
    return L.train_acceptor(labelled, trees=20)[1]


def model_acceptance(spark, sf_dir):
    """Every span through a trained acceptor that was saved and loaded: better than chance on the labelled ones."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    labelled = _labelled(spark, sf_dir)
    trained = not labelled.isEmpty()
    if trained:
        L.save_model(L.train_acceptor(labelled, trees=10, depth=5)[0], path, {"trees": 10})
    s = table(spark, sf_dir, "span_signals").dropDuplicates(["id"])
    out = L.accept_by_model(s, L.load_model(spark, path)[0] if trained else None)
    right = F.upper("merged_type") == F.upper("ground_truth_type")
    share = F.avg(F.when(F.col("ground_truth_type").isNotNull() & right.isNotNull(), (F.col("accepted") == right).cast("double")))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("accept_conf").alias("n_scored"), (share > 0.7).alias("better"))


def platt_fit(spark, sf_dir):
    """Coefficients fitted to scores whose truth follows a known curve: near it."""
    n = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 10_000).alias("u"))
    rows = n.select("x", (F.col("u") < 1 / (1 + F.exp(-(3.0 * F.col("x") - 1.0)))).alias("y"))
    a, b = L.fit_platt(rows, "x", "y")
    return spark.createDataFrame([(abs(a - 3.0) < 0.3, abs(b + 1.0) < 0.2)], "slope_near boolean, offset_near boolean")


def dictionary_contains(spark, sf_dir):
    return D.contains_terms(B.texts(spark, sf_dir), table(spark, sf_dir, "dictionary_terms")).withColumnRenamed("id", "doc")


def dictionary_rejected(spark, sf_dir):
    t = table(spark, sf_dir, "dictionary_terms").unionByName(table(spark, sf_dir, "entities").select(F.col("text").alias("term"), F.col("entity_type").alias("category")).distinct())
    return D.rejected_terms(t).select("category", "reason", "n", F.array_join("samples", "|").alias("samples"))


def registry_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return D.registry_search(c, "00012", ["c_name"], limit=15)


def drug_names(spark, sf_dir):
    t = table(spark, sf_dir, "dictionary_terms").select("term").unionByName(table(spark, sf_dir, "entities").select(F.col("text").alias("term"))).distinct()
    return t.select("term", F.coalesce(is_drug_name(F.col("term")), F.lit(False)).alias("is_drug"))


def queries():
    fs = (
        curation_tallies, golden_documents, aligned_pieces, generated_negatives, generated_notes, generated_adversarial, generated_simple, mixed_training, held_out_rows, model_acceptance, platt_fit, dictionary_contains, dictionary_rejected, registry_search,
        drug_names,
    )
    fs += (dictionary_hits, dictionary_status, dictionary_longest, dictionary_lookup, provider_registry, label_quality, curated_documents, balanced_sample, merged_sources, training_samples, word_tags, feature_sums, generated_samples, reinjected, acceptor_metrics)
    return {f.__name__: f for f in fs}


def _judged(source: str, around: str = "''") -> str:
    """``source`` (with text and entity_type) with clean, reason and score by the rules of quality."""
    t = "trim(coalesce(text, ''), E' \\t\\r\\n')"
    words = f"list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> '')"
    kind = "CASE " + " ".join(f"WHEN upper(entity_type) IN ({B.quoted(types)}) THEN '{name}'" for name, types in L.QUALITY_KINDS.items()) + " ELSE 'other' END"
    facts = {
        "f_kind": kind, "f_low": f"lower({t})", "f_digits": f"length(regexp_replace({t}, '[^0-9]', '', 'g'))", "f_chars": f"length({t})", "f_words": f"len({words})", "f_street": f"len(list_intersect({words}, [{B.quoted(L.STREET_WORDS)}])) > 0",
        "f_common": f"lower({t}) IN ({B.quoted(L.COMMON_WORDS)})", "f_mix": " + ".join(f"CAST(regexp_matches({t}, '{p}') AS INT)" for p in L.QUALITY_MIX),
        "f_hint": " OR ".join(f"contains(lower({around}), '{w}')" for w in L.QUALITY_HINTS),
    } | {name: f"regexp_matches({t}, '{p}')" for name, p in L.QUALITY_SHAPES.items()}
    made = f"SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in facts.items())} FROM ({source})"
    return f"SELECT * EXCLUDE ({', '.join(facts)}), score > 0 AS clean FROM (SELECT *, {L.quality_case('reason')} AS reason, {L.quality_case('score')} AS score FROM ({made}))"


def bad_term() -> str:
    """Whether a dictionary term is not usable."""
    from veilwork.plans.suppression import L as lists

    t = "trim(term, E' \\t\\r\\n')"
    return f"(term IS NULL OR {t} = '' OR length({t}) < 4 OR lower({t}) IN ({B.quoted(lists.BLOCKED_TERMS)}) OR regexp_matches({t}, '(?i)^(?:{'|'.join(lists.GARBAGE_TERMS)})') OR NOT regexp_matches({t}, '^\\p{{L}}'))"


def _generated_sql(what: str, n: int) -> str:
    one = "concat(e.start, '-', e.\"end\", '-', e.entity_type, '-', e.cluster, '-', e.text)"
    return f"SELECT id, family, text, array_to_string(list_transform(entities, lambda e: {one}), '|') AS entities, true AS placed FROM ({G.generate_sql(what, n)})"


def oracle_sql():
    q, in_text = _judged(B.SPANS), _judged(B.IN_TEXTS, "doc_text")
    first_types = ", ".join(f"'{t[0]}'" for t in L.QUALITY_KINDS.values())
    typed = f"SELECT span_id, entity_type, text FROM ({B.SPANS}) UNION ALL SELECT 'word', unnest([{first_types}]), text FROM (SELECT DISTINCT text FROM (SELECT unnest(regexp_split_to_array(content, '[ \\t\\n\\x0B\\f\\r]+')) AS text FROM messages) WHERE text <> '')"
    terms = "SELECT DISTINCT lower(trim(term)) AS term, category FROM dictionary_terms WHERE length(term) >= 4"
    # every occurrence: gaps of a split at the term, then its neighbours
    hits = f"""SELECT doc, term, category, CAST(p AS INT) AS start, CAST(p + length(term) AS INT) AS "end" FROM (SELECT doc, low, term, category, list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(term) AS p FROM (SELECT doc, low, term, category, g, unnest(range(1, len(g))) AS i FROM (SELECT doc, lower(doc_text) AS low, term, category, string_split(lower(doc_text), term) AS g FROM ({B.TEXTS}), ({terms}) WHERE contains(lower(doc_text), term))))
WHERE NOT regexp_matches(substr(low, CAST(p AS INT), CASE WHEN p = 0 THEN 0 ELSE 1 END), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substr(low, CAST(p AS INT) + length(term) + 1, 1), '[\\p{{L}}\\p{{N}}]')"""
    bad = bad_term()
    from veilwork.catalog.rules import Rule
    from veilwork.plans.detection import _sql_check, span_sql
    from veilwork.plans.suppression import oracle_sql as suppressed

    validity = suppressed()["term_validity"]
    num = lambda c: f"coalesce(CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN 0 ELSE CAST({c} AS DOUBLE) END, 0)"
    key = B.KEY.format("document_id")
    return {
        "dictionary_hits": hits,
        "dictionary_status": f"SELECT category, count(*) AS n_terms, count_if(NOT {bad}) AS n_valid, count_if(NOT {bad}) * 2 < count(*) AS issue FROM dictionary_terms GROUP BY category",
        "dictionary_longest": "SELECT DISTINCT term, category FROM dictionary_terms QUALIFY row_number() OVER (PARTITION BY category ORDER BY length(term) DESC, term) <= 20",
        "dictionary_lookup": "SELECT e.term, d.category FROM (SELECT DISTINCT text AS term FROM entities) e LEFT JOIN (SELECT lower(trim(term)) AS k, arg_min(category, list_position(['DRUG', 'FACILITY', 'TOWN', 'SURNAME', 'GIVEN_NAME'], category)) AS category FROM dictionary_terms GROUP BY 1) d ON lower(trim(e.term)) = d.k",
        "provider_registry": f"SELECT o_orderkey, valid, CASE WHEN valid THEN c_name END AS name FROM (SELECT o_orderkey, o_custkey, {_sql_check('npi', 'CAST(o_custkey + 1000000000 AS VARCHAR)')} AS valid FROM orders) LEFT JOIN customer ON o_custkey = c_custkey",
        "label_quality": f"SELECT span_id, entity_type, text, clean, reason, score FROM ({_judged(typed)})",
        "curation_tallies": f"SELECT entity_type, regexp_replace(reason, ': .*$', '') AS reason, clean, count(*) AS n FROM ({in_text}) GROUP BY ALL",
        "golden_documents": f"""SELECT doc, count(*) AS n_entities, round(avg(score), 9) AS quality FROM (SELECT *, trim(substr(doc_text, start + 1, "end" - start), E' \\t\\r\\n') AS here, trim(text, E' \\t\\r\\n') AS said FROM ({in_text}) WHERE start >= 0 AND start < "end" AND clean) WHERE here <> '' AND (contains(here, said) OR contains(said, here)) GROUP BY doc HAVING count(*) >= 2""",
        "word_tags": f"""WITH w AS (SELECT id AS doc, start, start + length(text) AS e FROM ({span_sql(Rule('word', 'WORD', 1.0, '[^ \\t\\n\\x0B\\f\\r]+'), f'({B.TEXTS})', 'doc', 'doc_text')})),
b AS (SELECT doc, start, arg_max(t, k) AS t, arg_max(i, k) AS i FROM (SELECT w.doc, w.start, s.entity_type AS t, s.span_id AS i, row(least(e, s."end") - greatest(w.start, s.start), s.start, s.entity_type, s.span_id) AS k FROM w JOIN ({B.SPANS}) s ON w.doc = s.doc AND w.start < s."end" AND s.start < e AND s.start < s."end") GROUP BY doc, start)
SELECT doc, tag, count(*) AS n FROM (SELECT w.doc, CASE WHEN i IS NULL THEN 'O' WHEN row_number() OVER (PARTITION BY w.doc, i ORDER BY w.start) = 1 THEN concat('B-', t) ELSE concat('I-', t) END AS tag FROM w LEFT JOIN b ON b.doc = w.doc AND b.start = w.start) GROUP BY ALL""",
        "aligned_pieces": """WITH p AS (SELECT o_custkey AS doc, o_orderkey AS pos, o_orderkey % 5 AS label, unnest(range(1, CAST(ceil(length(CAST(o_orderkey AS VARCHAR)) / 3) AS INT) + 1)) AS i FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos, i) AS n FROM p QUALIFY n <= 32),
g AS (SELECT doc, count(*) AS c, list(i + 100 ORDER BY n) AS a, list(CASE WHEN i = 1 THEN label ELSE -100 END ORDER BY n) AS l FROM k GROUP BY doc)
SELECT doc, concat(array_to_string(a, ','), repeat(',0', 32 - c)) AS input_ids, concat(array_to_string(l, ','), repeat(',-100', 32 - c)) AS labels, concat('1', repeat(',1', c - 1), repeat(',0', 32 - c)) AS mask FROM g""",
        "generated_samples": _generated_sql("samples", 5000),
        "generated_negatives": _generated_sql("negatives", 3000),
        "generated_notes": _generated_sql("notes", 3000),
        "generated_adversarial": _generated_sql("adversarial", 3000),
        "generated_simple": _generated_sql("simple", 2000),
        "reinjected": f"""SELECT id, concat(g[1], array_to_string(list_transform(range(1, len(g)), lambda i: concat(['Ana Abel', 'Boris Bauer'][CAST(concat('0x', substr(md5(concat(id, '|', i - 1)), 1, 8)) AS BIGINT) % 2 + 1], g[i + 1])), '')) AS text, len(g) - 1 AS n, true AS placed FROM (SELECT id, string_split_regex(content, '{L.PLACEHOLDERS}') AS g FROM (SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL))""",
        "mixed_training": "SELECT 'production' AS _source, count(DISTINCT id) AS n FROM corrections UNION ALL SELECT 'adversarial', 1000 UNION ALL SELECT 'synthetic', 1",
        "held_out_rows": "SELECT CAST(upper(merged_type) = upper(ground_truth_type) AS INT) AS label, count(DISTINCT id) AS n, true AS a_fifth FROM span_signals WHERE ground_truth_type IS NOT NULL AND merged_type IS NOT NULL GROUP BY 1",
        "model_acceptance": "SELECT count(DISTINCT id) AS n, count(DISTINCT id) AS n_scored, true AS better FROM span_signals",
        "platt_fit": "SELECT true AS slope_near, true AS offset_near",
        "dictionary_contains": f"SELECT DISTINCT doc, category FROM ({hits})",
        "dictionary_rejected": f"""SELECT category, reason, count(*) AS n, string_agg(coalesce(term, ''), '|' ORDER BY coalesce(term, '')) FILTER (WHERE k <= 5) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY category, reason ORDER BY term NULLS FIRST) AS k FROM (SELECT t.term, t.category, v.reason FROM (SELECT term, category FROM dictionary_terms UNION ALL SELECT DISTINCT text, entity_type FROM entities) t JOIN ({validity}) v ON v.term IS NOT DISTINCT FROM t.term WHERE v.reason <> 'valid')) GROUP BY category, reason""",
        "registry_search": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '00012') ORDER BY c_name, c_custkey, c_mktsegment LIMIT 15",
        "drug_names": "SELECT term, coalesce(length(trim(term)) BETWEEN 3 AND 100 AND regexp_matches(trim(term), '^[A-Za-z]') AND NOT regexp_matches(trim(term), '(?i)^\\d|\\d+\\s*(?:mg|ml|mcg|%)|^\\([A-Z]\\)-|^\\d+:\\d+'), false) AS is_drug FROM (SELECT term FROM dictionary_terms UNION SELECT text FROM entities)",
        "curated_documents": f"SELECT doc, count_if(score >= 0.7) AS n_clean, round(avg(CASE WHEN score >= 0.7 THEN score END), 9) AS quality, count_if(score < 0.7) AS n_refused FROM ({q}) GROUP BY doc HAVING count_if(score >= 0.7) > 0",
        "balanced_sample": f"SELECT span_id, entity_type FROM ({q}) WHERE clean AND entity_type IN ({B.quoted(L.TARGETS)}) QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY score DESC, span_id) <= 60",
        "merged_sources": "SELECT 'documents' AS _source, CAST(NULL AS VARCHAR) AS role, count(*) AS n, count(text) AS n_text FROM documents UNION ALL SELECT 'messages', role, count(*), count(content) FROM messages GROUP BY role",
        "training_samples": f"SELECT doc, count(DISTINCT e) AS n_entities, count(DISTINCT e) = 0 AS negative FROM (SELECT {key} AS doc, CASE WHEN decision IN ('confirmed', 'changed') THEN row(entity_start, entity_end, CASE WHEN decision = 'changed' THEN correct_type ELSE detected_type END) END AS e FROM corrections) WHERE doc IS NOT NULL GROUP BY doc",
        "feature_sums": f"SELECT id, round({' + '.join(num(c) for c in L.FEATURES)}, 6) AS total FROM (SELECT DISTINCT id, {', '.join(L.FEATURES)} FROM span_signals)",
    }
