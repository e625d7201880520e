"""Queries over formats; the inputs are made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilwork.operators.dictionary import load_terms
from veilwork.plans import base as B
from veilwork.runtime import shared_dir, table
from veilwork.sources import documents as D
from veilwork.sources import vocabularies as V
from veilwork.sources import writers as W


def html_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    page = F.concat(F.lit("<html><head><style>p {x}</style></head><body><!-- c --><p>"), F.col("text"), F.lit(" &amp; more</p><script>1 < 2</script></body></html>"))
    return d.select("doc_id", D.html_text(page).alias("content"))


def csv_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat(F.lit("key,name,note\n"), F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit('","a, b"\n,,\n'))
    return c.select("c_custkey", D.csv_text(line).alias("content"))


def hl7_messages(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    m = F.concat(F.lit("MSH|^~\\&|A|B|C|D|2024||ADT^A01|1\rPID|1||"), F.col("c_custkey").cast("string"), F.lit("||"), F.col("c_name"), F.lit("||19800101\rOBX|1|NM|GLU^Glucose||5.5\r"))
    return c.select("c_custkey", D.hl7_text(m).alias("content"))


def fhir_resources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    j = F.concat(F.lit('{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"'), F.col("c_custkey").cast("string"), F.lit('","name":[{"family":"'), F.col("c_name"), F.lit('","given":["Ana"]}],"birthDate":"1980-01-02"}},{"resource":{"resourceType":"Observation","code":{"text":"Glucose"},"valueQuantity":{"value":5,"unit":"mmol/L"}}}'), F.repeat(F.lit(',{"resource":{"resourceType":"DiagnosticReport","code":{"text":"CBC"},"conclusion":"fine"}}'), 12), F.lit("]}"))
    other = F.concat(F.lit('{"a":"'), F.repeat("c_name", 200), F.lit('"}'))
    return c.select("c_custkey", D.fhir_text(j).alias("content"), F.length(D.fhir_text(other)).alias("n_other"))


def clinical_xml(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    x = F.concat(F.lit('<?xml version="1.0"?><ClinicalDocument xmlns="urn:hl7-org:v3"><title>Note</title><recordTarget><patientRole><patient><name><given>Ana</given><family>'), F.col("c_name"), F.lit("</family></name></patient></patientRole></recordTarget><component><section><title>Plan</title><text>Rest  <b>now</b></text></section></component></ClinicalDocument>"))
    return c.select("c_custkey", D.cda_text(x).alias("content"), D.xml_text(x).alias("plain"), D.kind_of(F.lit("a.xml"), x).alias("kind"))


def text_chunks(spark, sf_dir):
    return D.chunks(B.texts(spark, sf_dir)).select(F.col("id").alias("doc"), "start", "chunk")


def _new(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _all_corrections(spark, sf_dir):
    c = table(spark, sf_dir, "corrections")
    number = lambda x: F.nanvl(x, F.lit(None).cast("double")).alias(x)
    return c.select("id", *(number(f) if f.endswith("confidence") else f for f in W.CORRECTION_FIELDS)).distinct()


def correction_export(spark, sf_dir):
    """Corrections written and read back."""
    path = _new(spark, "corrections")
    W.export_corrections(_all_corrections(spark, sf_dir), path)
    kinds = ", ".join(f"{f} {'double' if f.endswith('confidence') else 'string'}" for f in W.CORRECTION_FIELDS)
    return spark.read.schema(kinds).json(path)


def correction_objects(spark, sf_dir):
    """One JSON object per correction: its fields read out of it."""
    c = W.correction_json(_all_corrections(spark, sf_dir))
    return c.select("id", F.get_json_object("json", "$.entity_text").alias("entity_text"), F.get_json_object("json", "$.decision").alias("decision"), F.get_json_object("json", "$.ner_confidence").cast("double").alias("ner_confidence"))


def _audit_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(F.lit("main").alias("log"), F.col("event_id").cast("long").alias("sequence"), "event_type", F.col("ts").alias("at"), F.col("user_id").cast("string").alias("user_id"), F.col("props").alias("details"))
    return log.withColumn("id", F.sha2(F.col("sequence").cast("string"), 256)).withColumn("hash", F.sha2(F.concat_ws("|", "sequence", "event_type"), 256))


def audit_export(spark, sf_dir):
    """The log in its eleven columns, written as CSV and read back."""
    path = _new(spark, "audit")
    W.export_audit(_audit_log(spark, sf_dir), path, F.expr("TIMESTAMP '2026-01-01 00:00:00'"))
    back = spark.read.schema(", ".join(f"{c} string" for c in W.AUDIT_FIELDS)).option("header", True).option("escape", '"').csv(path)
    return back.select(*(F.coalesce(c, F.lit("")).alias(c) for c in W.AUDIT_FIELDS))


def audit_exported(spark, sf_dir):
    """The event that an export adds to the log."""
    e = W.export_audit(_audit_log(spark, sf_dir), _new(spark, "audit"), F.expr("TIMESTAMP '2026-01-01 00:00:00'"), as_json=True)
    return e.select("event_type", "at", F.get_json_object("details", "$.records_exported").cast("long").alias("n"), F.get_json_object("details", "$.format").alias("format"))


def dataset_export(spark, sf_dir):
    """Samples and their counts, written and read back."""
    path = _new(spark, "dataset")
    m = table(spark, sf_dir, "messages").select("id", "role", "content").distinct()
    W.write_dataset(m, path, n_texts=F.count("content"), n_user=F.count_if(F.col("role") == "user"))
    return spark.read.schema("n_samples long, n_texts long, n_user long").json(f"{path}/metadata").crossJoin(spark.read.schema("id string").json(f"{path}/samples").agg(F.count("id").alias("n_read")))


def report_rows(spark, sf_dir):
    s = table(spark, sf_dir, "entities").select("id", "entity_type", "confidence").distinct()
    return W.markdown_rows(s.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least")))


def imported_json(spark, sf_dir):
    """Messages as one JSON list of texts and objects, imported."""
    path = _new(spark, "import")
    m = table(spark, sf_dir, "messages").select("id", "content").distinct()
    obj = F.struct(F.when(F.col("content").startswith("a"), F.col("content")).alias("text"), F.when(~F.col("content").startswith("a"), F.col("content")).alias("content"), F.col("id").alias("source"))
    listed = m.agg(F.to_json(F.struct(F.collect_list(F.when(F.col("content").isNotNull(), obj)).alias("documents"))).alias("value"))
    listed.write.text(path)
    return D.import_json(spark, path)


def imported_texts(spark, sf_dir):
    """A folder of text files, one per region and an empty one."""
    path = _new(spark, "texts")
    for r in [*(x["r_name"] for x in table(spark, sf_dir, "region").select("r_name").collect()), " "]:  # five regions
        spark.createDataFrame([(r,)], "value string").coalesce(1).write.mode("append").text(f"{path}/{uuid.uuid4().hex}")
    return D.import_texts(spark, path).select(F.regexp_replace("content", r"\s+$", "").alias("content"), F.col("source").endswith(".txt").alias("is_text")).unionByName(D.import_text(spark, "one text").select("content", F.lit(False).alias("is_text")))


def gold_masks(spark, sf_dir):
    """Documents with their labelled spans as an array, read as gold."""
    s = B.spans_in_texts(spark, sf_dir).groupBy("doc", "doc_text").agg(F.collect_list(F.struct(F.concat(F.lit("B-"), "entity_type").alias("label"), "start", "end")).alias("privacy_mask"))
    return D.gold_samples(s, "doc_text", "privacy_mask")


def gold_tokens(spark, sf_dir):
    """A customer's orders as tokens with tags, read as gold."""
    tag = F.element_at(F.array(*map(F.lit, ["O", "B-FIRSTNAME", "I-FIRSTNAME", "B-JOBTITLE", "B-ZIPCODE"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("token"), tag.alias("tag")))).alias("x"))
    rows = o.select("o_custkey", F.transform("x", lambda y: y["token"]).alias("tokens"), F.transform("x", lambda y: y["tag"]).alias("tags"))
    return D.gold_from_tokens(rows, "o_custkey", "tokens", "tags")


def note_rows(spark, sf_dir):
    """Transcriptions of a hundred characters or more, from CSV."""
    path = _new(spark, "notes")
    p = table(spark, sf_dir, "part").select(F.concat(F.repeat(F.concat("p_name", F.lit(', "x"\n')), (F.col("p_partkey") % 9 + 1).cast("int")), F.lit("end.")).alias("transcription"), F.col("p_type").alias("medical_specialty"), F.col("p_brand").alias("description"), F.col("p_brand").alias("sample_name"))
    p.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return V.clinical_notes(spark, path)


def term_file(spark, sf_dir):
    """Dictionary terms as lines of a file with comments, loaded."""
    path = _new(spark, "terms")
    t = table(spark, sf_dir, "dictionary_terms").select(F.concat(F.lit("  "), "term", F.lit(" ")).alias("value"))
    t.unionByName(t.select(F.concat(F.lit("# "), "value").alias("value"))).write.text(path)
    return load_terms(spark.read.text(path), "value")


def vocabulary_terms(spark, sf_dir):
    """Drugs, diagnoses, tests and facilities out of files in their published layouts."""
    path = _new(spark, "vocabularies")
    p = table(spark, sf_dir, "part")
    drug = table(spark, sf_dir, "dictionary_terms").where("category = 'DRUG'").select("term").distinct()
    row = F.struct(F.col("term").alias("brand_name"), F.concat("term", F.lit(", 5mg")).alias("generic_name"), F.array(F.struct(F.concat(F.lit("base "), "term").alias("name"))).alias("active_ingredients"))
    drug.agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("value")).write.text(f"{path}/drugs")
    p.select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 16, "0"), F.rpad("p_name", 61, " "), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" in full"))).otherwise(F.lit("   .")))).write.text(f"{path}/codes")
    p.select(F.col("p_name").alias("LONG_COMMON_NAME"), F.col("p_type").alias("COMPONENT")).write.option("header", True).csv(f"{path}/tests")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("Facility Name")).write.option("header", True).csv(f"{path}/places")
    parts = {"drug": V.drug_names(spark, f"{path}/drugs"), "diagnosis": V.diagnoses(spark, f"{path}/codes"), "test": V.lab_tests(spark, f"{path}/tests"), "facility": V.facilities(spark, f"{path}/places")}
    out = None
    for kind, df in parts.items():
        tagged = df.select(F.lit(kind).alias("kind"), "term")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def registry_rows(spark, sf_dir):
    """The provider registry out of its published columns; every second row is an organisation."""
    path = _new(spark, "registry")
    c = table(spark, sf_dir, "customer")
    person = F.col("c_custkey") % 2 == 0
    cols = {"NPI": F.col("c_custkey").cast("string"), "Entity Type Code": F.when(person, "1").otherwise("2"), "Provider First Name": F.when(person, F.lit("Ana")), "Provider Last Name (Legal Name)": F.when(person, F.col("c_name")), "Provider Organization Name (Legal Business Name)": F.when(~person, F.concat("c_name", F.lit(" Inc."))), "Provider Credential Text": F.lit("MD")}
    cols |= {field: F.lit(name) for name, field in V.REGISTRY_FIELDS.items()}
    c.select(*(v.alias(k) for k, v in cols.items())).write.option("header", True).csv(path)
    return V.provider_registry(spark, path).select("npi", "entity_type", "provider_name", F.coalesce("last_name", F.lit("")).alias("last_name"), F.coalesce("credential", F.lit("")).alias("credential"), "city")


def paged_rows(spark, sf_dir):
    """A source that gives a thousand rows at a time, read to its end."""
    return V.paged(spark, lambda offset, size: [{"k": k} for k in range(offset, min(offset + size, 2500))], "k long")


def office_texts(spark, sf_dir):
    """A workbook, a letter, an RTF file, a page and a table, one each per region."""
    import io
    import zipfile

    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
        return out.getvalue()

    sheet, word = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    rows = []
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five regions
        k, n = r["r_regionkey"], r["r_name"]
        rows += [
            (f"/in/{k}.xlsx", packed({"xl/workbook.xml": f'<workbook xmlns="{sheet}"><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{sheet}"><sheetData><row><c t="inlineStr"><is><t>{n}</t></is></c><c><v>{k}</v></c></row></sheetData></worksheet>'})),
            (f"/in/{k}.docx", packed({"word/document.xml": f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>Dear {n}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})),
            (f"/in/{k}.rtf", f"{{\\rtf1{{\\fonttbl{{\\f0 Arial;}}}}\\f0 To {n}\\par now}}".encode()),
            (f"/in/{k}.html", f"<p>{n} &amp; co</p>".encode()),
            (f"/in/{k}.csv", f"a,b\n{n},{k}\n".encode()),
            (f"/in/{k}.txt", f"caf\xe9 {n}".encode("latin-1")),
            (f"/in/{k}.bin", b"x"),
            (f"/in/{k}.docx.docx", b"no archive"),
        ]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    return D.extract(files).select("path", "doc_type", "text", F.col("error").isNotNull().alias("failed"))


def queries():
    fs = (
        html_documents, csv_rows, hl7_messages, fhir_resources, clinical_xml, text_chunks, correction_export, correction_objects, audit_export, audit_exported, dataset_export, report_rows, imported_json, imported_texts, gold_masks,
        gold_tokens, note_rows, term_file, vocabulary_terms, registry_rows, paged_rows, office_texts,
    )
    return {f.__name__: f for f in fs}


def oracle_sql():
    ws = "[ \\t\\n\\r\\f\\x0B]"
    html = f"trim(regexp_replace(regexp_replace(regexp_replace(concat('<p>', text, ' &amp; more</p>'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{ws}+', ' ', 'g'))"
    for name, value in D.ENTITIES:
        v = "chr(160)" if value == "\u00a0" else "'" + value.replace("'", "''") + "'"
        html = f"replace({html}, '{name}', {v})"
    number = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}"
    corr = f"SELECT DISTINCT id, {', '.join(number(f) if f.endswith('confidence') else f for f in W.CORRECTION_FIELDS)} FROM corrections"
    from veilwork.plans.curation import bad_term
    from veilwork.plans.evaluation import label_sql
    from veilwork.plans.evaluation import oracle_sql as evaluated

    bio = evaluated()["bio_spans"].replace("'B-NAME', 'I-NAME', 'B-DATE', 'I-DATE'", "'B-FIRSTNAME', 'I-FIRSTNAME', 'B-JOBTITLE', 'B-ZIPCODE'")
    is_drug = lambda c: f"length({c}) BETWEEN 3 AND 100 AND regexp_matches({c}, '^[A-Za-z]') AND NOT regexp_matches({c}, '(?i)^\\d|\\d+\\s*(?:mg|ml|mcg|%)|^\\([A-Z]\\)-|^\\d+:\\d+')"
    return {
        "html_documents": f"SELECT doc_id, {html} AS content FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL)",
        "csv_rows": "SELECT c_custkey, concat('key | name | note', chr(10), c_custkey, ' | ', c_name, ' | a, b') AS content FROM customer",
        "hl7_messages": "SELECT c_custkey, concat('Message Type: ADT A01', chr(10), 'Patient ID: ', c_custkey, chr(10), 'Patient Name: ', c_name, chr(10), 'DOB: 19800101', chr(10), 'Observation: GLU Glucose = 5.5') AS content FROM customer",
        "fhir_resources": "SELECT c_custkey, concat('Patient: Ana ', c_name, chr(10), 'DOB: 1980-01-02', chr(10), 'ID: ', c_custkey, chr(10), 'Observation: Glucose = 5 mmol/L', repeat(concat(chr(10), 'Report: CBC', chr(10), 'Conclusion: fine'), 12)) AS content, CAST(length(c_name) * 200 + 8 AS INT) AS n_other FROM customer",
        "clinical_xml": "SELECT c_custkey, concat('Note', chr(10), 'Patient: Ana ', c_name, chr(10), 'Plan: Rest now') AS content, concat('Note Ana ', c_name, ' Plan Rest now') AS plain, 'cda' AS kind FROM customer",
        "text_chunks": f"SELECT doc, CAST(start AS INT) AS start, substr(doc_text, CAST(start AS INT) + 1, 1000) AS chunk FROM (SELECT doc, doc_text, unnest(range(0, greatest(CAST(ceil((length(doc_text) - 100) / 900) AS BIGINT), 1) * 900, 900)) AS start FROM ({B.TEXTS}) WHERE length(doc_text) > 0)",
        "correction_export": f"SELECT {', '.join(W.CORRECTION_FIELDS)} FROM ({corr})",
        "correction_objects": f"SELECT id, entity_text, decision, ner_confidence FROM ({corr})",
        "audit_export": "SELECT sha256(CAST(event_id AS VARCHAR)) AS id, CAST(event_id AS VARCHAR) AS sequence, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, CAST(user_id AS VARCHAR) AS user_id, '' AS conversation_id, coalesce(props, '') AS details, '' AS ip_address, '' AS user_agent, '' AS prev_hash, sha256(concat(event_id, '|', event_type)) AS hash FROM events",
        "audit_exported": "SELECT 'AUDIT_EXPORTED' AS event_type, TIMESTAMP '2026-01-01' AS at, count(*) AS n, 'json' AS format FROM events",
        "dataset_export": "SELECT count(*) AS n_samples, count(content) AS n_texts, count_if(role = 'user') AS n_user, count(*) AS n_read FROM (SELECT DISTINCT id, role, content FROM messages)",
        "report_rows": "SELECT concat('| ', entity_type, ' | ', count(*), ' | ', format('{:.4f}', min(confidence)), ' |') AS row FROM (SELECT DISTINCT id, entity_type, confidence FROM entities) GROUP BY entity_type",
        "imported_json": "SELECT content, id AS source FROM (SELECT DISTINCT id, content FROM messages) WHERE length(trim(content, ' ')) > 0",
        "imported_texts": "SELECT r_name AS content, true AS is_text FROM region UNION ALL SELECT 'one text', false",
        "gold_masks": f"""SELECT substr(md5(doc_text), 1, 12) AS id, start, "end", {label_sql('entity_type')} AS entity_type FROM ({B.IN_TEXTS}) WHERE {label_sql('entity_type')} IS NOT NULL""",
        "gold_tokens": f"""WITH t AS (SELECT o_custkey AS doc, o_orderkey AS pos, concat('w', o_orderkey) AS token, CAST(sum(length(concat('w', o_orderkey)) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS e FROM orders), i AS (SELECT doc, substr(md5(string_agg(token, ' ' ORDER BY pos)), 1, 12) AS id FROM t GROUP BY doc)
SELECT i.id, CAST(a.e - length(a.token) AS INT) AS start, b.e AS "end", {label_sql('s.entity_type')} AS entity_type FROM ({bio}) s JOIN t a ON a.doc = s.doc AND a.pos = s.first JOIN t b ON b.doc = s.doc AND b.pos = s.last JOIN i ON i.doc = s.doc WHERE {label_sql('s.entity_type')} IS NOT NULL""",
        "note_rows": "SELECT trim(t, ' ') AS text, p_type AS specialty, p_brand AS description, p_brand AS sample_name FROM (SELECT *, repeat(concat(p_name, ', \"x\"', chr(10)), CAST(p_partkey % 9 + 1 AS INT)) || 'end.' AS t FROM part) WHERE length(trim(t, ' ')) >= 100",
        "term_file": f"SELECT DISTINCT lower(trim(term)) AS term FROM dictionary_terms WHERE NOT {bad_term()} AND NOT starts_with(trim(term), '#')",
        "vocabulary_terms": f"""SELECT 'drug' AS kind, term FROM (SELECT DISTINCT trim(unnest(list_concat([term], string_split(concat(term, ', 5mg'), ','), [concat('base ', term)]))) AS term FROM dictionary_terms WHERE category = 'DRUG') WHERE {is_drug('term')}
UNION ALL SELECT DISTINCT 'diagnosis', concat(p_name, ' in full') FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT * FROM (SELECT 'test', p_name FROM part WHERE length(p_name) >= 5 UNION SELECT 'test', p_type FROM part WHERE length(p_type) >= 3)
UNION ALL SELECT DISTINCT 'facility', CASE WHEN n_name = upper(n_name) THEN array_to_string(list_transform(string_split(n_name, ' '), lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ') ELSE n_name END FROM nation WHERE length(n_name) >= 3""",
        "registry_rows": "SELECT CAST(c_custkey AS VARCHAR) AS npi, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '2' END AS entity_type, CASE WHEN c_custkey % 2 = 0 THEN concat('Ana ', c_name) ELSE concat(c_name, ' Inc.') END AS provider_name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS last_name, CASE WHEN c_custkey % 2 = 0 THEN 'MD' ELSE '' END AS credential, 'city' AS city FROM customer",
        "paged_rows": "SELECT range AS k FROM range(2500)",
        "office_texts": """SELECT concat('/in/', r_regionkey, '.', x.s) AS path, x.k AS doc_type, CASE x.s WHEN 'xlsx' THEN concat('=== Sheet: S ===', chr(10), r_name, ' | ', r_regionkey) WHEN 'docx' THEN concat('Dear ', r_name, chr(10), 'a | b') WHEN 'rtf' THEN concat('To ', r_name, chr(10), 'now') WHEN 'html' THEN concat(r_name, ' & co') WHEN 'csv' THEN concat('a | b', chr(10), r_name, ' | ', r_regionkey) WHEN 'txt' THEN concat('café ', r_name) END AS text, x.s IN ('bin', 'docx.docx') AS failed
FROM region, (SELECT unnest([{'s': 'xlsx', 'k': 'xlsx'}, {'s': 'docx', 'k': 'docx'}, {'s': 'rtf', 'k': 'rtf'}, {'s': 'html', 'k': 'html'}, {'s': 'csv', 'k': 'csv'}, {'s': 'txt', 'k': 'text'}, {'s': 'bin', 'k': 'unknown'}, {'s': 'docx.docx', 'k': 'docx'}]) AS x)""",
    }
