"""Documents of many formats to text.

``read_folder`` reads files as bytes and ``extract`` turns them into rows
(path, doc_type, text, errors).  Text formats are handled by JVM expressions;
office formats, which need unpacking, by one Arrow-batched function with
nothing but the standard library.  What cannot be read gives an error in its
row, never an exception.
"""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.operators.evaluate import bio_spans, gold_label

# fixed values: kinds by file extension
KINDS = {
    "txt": "text", "text": "text", "md": "text", "log": "text", "csv": "csv", "tsv": "tsv", "html": "html", "htm": "html", "json": "json", "fhir": "fhir", "hl7": "hl7", "xml": "xml", "cda": "cda", "ccd": "ccd",
    "xlsx": "xlsx", "xls": "xls", "docx": "docx", "doc": "doc", "rtf": "rtf", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image",
}
OFFICE = ["xlsx", "docx", "rtf"]
PLUGGED = ["xls", "doc", "pdf", "image"]
ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def kind_of(path: Column, head: Column) -> Column:
    """Kind by extension; XML is looked into for clinical documents."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ext), F.lit("unknown"))
    low = F.lower(F.substring(head, 1, 2000))
    clinical = F.contains(low, F.lit("clinicaldocument"))
    return F.when((kind == "xml") & clinical & F.contains(low, F.lit("continuityofcaredocument")), "ccd").when((kind == "xml") & clinical, "cda").otherwise(kind)


def html_text(html: Column) -> Column:
    """Tags away, white space collapsed, then entities resolved."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    for name, value in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def csv_text(text: Column, delimiter: str = ",") -> Column:
    """Non-empty rows, their fields joined by bars; quotes may hold delimiters."""
    rows = F.filter(F.split(text, r"\r\n|\r|\n"), lambda r: F.trim(F.replace(r, F.lit(delimiter), F.lit(""))) != "")
    outside = rf'{re.escape(delimiter)}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    fields = lambda r: F.transform(F.split(r, outside, -1), lambda x: F.replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"')))
    return F.array_join(F.transform(rows, lambda r: F.array_join(fields(r), " | ")), "\n")


def hl7_text(text: Column) -> Column:
    """Message type, patient and observations of an HL7 v2 message."""
    segments = F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: F.length(s) > 3)
    field = lambda s, i: F.coalesce(F.get(F.split(s, r"\|", -1), F.lit(i)), F.lit(""))
    part = lambda s, i: F.trim(F.replace(field(s, i), F.lit("^"), F.lit(" ")))
    line = lambda s: (
        F.when(s.startswith("MSH"), F.concat(F.lit("Message Type: "), part(s, 8)))
        .when(s.startswith("PID"), F.concat(F.lit("Patient ID: "), part(s, 3), F.lit("\nPatient Name: "), part(s, 5), F.lit("\nDOB: "), part(s, 7)))
        .when(s.startswith("OBX"), F.concat(F.lit("Observation: "), part(s, 3), F.lit(" = "), part(s, 5)))
    )
    return F.array_join(F.filter(F.transform(segments, line), lambda x: x.isNotNull()), "\n")


def fhir_text(text: Column, most_entries: int | None = None, most_chars: int | None = None) -> Column:
    """Patient, Observation, DiagnosticReport or Bundle as lines; other JSON as it is.

    Everything is read; ``most_entries`` of a bundle and ``most_chars`` of other JSON limit it where that is wanted.
    """

    def lines(j: Column) -> Column:
        g = lambda path: F.get_json_object(j, path)
        kind = g("$.resourceType")
        named = lambda label, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(label), v))
        name = F.coalesce(g("$.name[0].text"), F.concat_ws(" ", g("$.name[0].given[0]"), g("$.name[0].family")))
        patient = F.concat_ws("\n", named("Patient: ", name), named("DOB: ", g("$.birthDate")), named("Gender: ", g("$.gender")), named("ID: ", g("$.id")), named("Phone: ", g("$.telecom[0].value")))
        value = F.coalesce(F.concat_ws(" ", g("$.valueQuantity.value"), g("$.valueQuantity.unit")), g("$.valueString"))
        observation = F.concat_ws(" = ", named("Observation: ", F.coalesce(g("$.code.text"), g("$.code.coding[0].display"))), F.coalesce(F.when(value != "", value), g("$.valueString")))
        report = F.concat_ws("\n", named("Report: ", F.coalesce(g("$.code.text"), g("$.code.coding[0].display"))), named("Conclusion: ", g("$.conclusion")))
        return F.when(kind == "Patient", patient).when(kind == "Observation", observation).when(kind == "DiagnosticReport", report)

    listed = F.from_json(F.get_json_object(text, "$.entry"), "array<struct<resource:string>>")
    entries = F.array_join(F.filter(F.transform(F.slice(listed, 1, most_entries) if most_entries else listed, lambda e: lines(e["resource"])), lambda x: x.isNotNull()), "\n")
    bundle = F.get_json_object(text, "$.resourceType") == "Bundle"
    return F.when(bundle, entries).otherwise(F.coalesce(lines(text), F.substring(text, 1, most_chars) if most_chars else text))


def xml_text(text: Column) -> Column:
    """All text nodes, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>", " "), r"<[^>]+>", " "), r"\s+", " "))


def cda_text(text: Column) -> Column:
    """Title, patient, and the sections of a clinical document."""
    bare = F.regexp_replace(text, r"(?s)<\?xml.*?\?>", "")
    one = lambda p: F.trim(F.call_function("xpath_string", bare, F.lit(p)))
    local = lambda n: f"*[local-name()='{n}']"
    title = one(f"/*/{local('title')}")
    name = F.trim(F.concat_ws(" ", one(f"//{local('patient')}/{local('name')}/{local('given')}"), one(f"//{local('patient')}/{local('name')}/{local('family')}")))
    titles = F.call_function("xpath", bare, F.lit(f"//{local('section')}/{local('title')}/text()"))
    bodies = F.regexp_extract_all(bare, F.lit(r"(?s)<(?:\w+:)?section\b.*?<(?:\w+:)?text[^>]*>(.*?)</(?:\w+:)?text>"), F.lit(1))
    sections = F.zip_with(titles, bodies, lambda t, b: F.concat_ws(": ", t, xml_text(b)))
    return F.concat_ws("\n", F.when(title != "", title), F.when(name != "", F.concat(F.lit("Patient: "), name)), F.array_join(sections, "\n"))


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where that is not valid."""
    return F.coalesce(F.call_function("try_validate_utf8", content.cast("string")), F.decode(content, "ISO-8859-1"))


def _xlsx(data: bytes) -> str:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = [s.get("name") for s in book.find("m:sheets", ns)]
        out = []
        for k, name in enumerate(names, 1):
            out.append(f"=== Sheet: {name} ===")
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{{{ns['m']}}}row"):
                cells = []
                for c in row.findall("m:c", ns):
                    v = c.find("m:v", ns)
                    inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else "") or "")
                if any(cells):
                    out.append(" | ".join(cells))
    return "\n".join(out)


def _docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body:
        if e.tag == f"{w}p" and text(e).strip():
            out.append(text(e))
        for row in e.iter(f"{w}tr") if e.tag == f"{w}tbl" else ():
            out.append(" | ".join(text(c).strip() for c in row.findall(f"{w}tc")))
    return "\n".join(out)


def _rtf(data: bytes) -> str:
    t = data.decode("latin-1")
    t = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", t)
    t = re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), t)
    t = re.sub(r"\\(?:par|line)\b ?", "\n", t)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-z]+-?\d* ?", "", t)).strip()


READERS = {"xlsx": _xlsx, "docx": _docx, "rtf": _rtf}


def _unpacked(readers):
    def run(batches):
        for b in batches:
            texts, errors = [], []
            for kind, data in zip(b["doc_type"], b["content"], strict=True):
                try:
                    texts.append(readers[kind](bytes(data)))
                    errors.append(None)
                except KeyError:
                    texts.append(None)
                    errors.append(f"no reader for {kind}")
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"path": b["path"], "doc_type": b["doc_type"], "text": texts, "error": errors})

    return run


def read_folder(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content) of a folder's files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def extract(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """(path, doc_type, text, error) of (path, content); ``readers`` adds functions bytes -> text for further kinds."""
    readers = READERS | (readers or {})
    f = files.withColumn("raw", decoded(F.col("content"))).withColumn("doc_type", kind_of(F.col("path"), F.col("raw")))
    raw, kind = F.col("raw"), F.col("doc_type")
    text = (
        F.when(kind == "text", raw).when(kind == "html", html_text(raw)).when(kind == "csv", csv_text(raw)).when(kind == "tsv", csv_text(raw, "\t")).when(kind == "hl7", hl7_text(raw))
        .when(kind.isin("json", "fhir"), fhir_text(raw)).when(kind.isin("cda", "ccd"), cda_text(raw)).when(kind == "xml", xml_text(raw))
    )
    plain = f.where(~kind.isin(*readers, *PLUGGED)).select("path", "doc_type", text.alias("text"))
    plain = plain.withColumn("error", F.when(F.col("doc_type") == "unknown", "unsupported type").when(F.length(F.trim("text")) == 0, "no text"))
    packed = f.where(kind.isin(*readers, *PLUGGED)).select("path", "doc_type", "content").mapInPandas(_unpacked(readers), "path string, doc_type string, text string, error string")
    return plain.unionByName(packed)


def capabilities() -> dict[str, bool]:
    """Which kinds can be read here."""
    here = lambda m: importlib.util.find_spec(m) is not None
    return {k: True for k in sorted(set(KINDS.values()) - set(PLUGGED))} | {"pdf": here("pypdf"), "image": here("pytesseract"), "xls": here("xlrd"), "doc": False}


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """(content, source) of a JSON list, or of the list under ``documents``; items are texts or objects."""
    raw = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json(F.get_json_object("value", "$.documents"), "array<string>"), F.from_json("value", "array<string>"))
    x = raw.select(F.explode(items).alias("x"))
    obj = F.col("x").startswith("{")
    content = F.when(obj, F.coalesce(F.get_json_object("x", "$.content"), F.get_json_object("x", "$.text"))).otherwise(F.col("x"))
    return x.select(content.alias("content"), F.when(obj, F.get_json_object("x", "$.source")).alias("source")).where("length(trim(content)) > 0")


def import_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(content, source) of a folder's ``.txt`` and ``.text`` files, each once, empty ones left out; source is the path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,text}").text(folder, wholetext=True)
    return files.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source")).where(F.col("content").rlike(r"\S"))


def import_text(spark: SparkSession, text: str, source: str = "manual") -> DataFrame:
    """One text as a document."""
    return spark.createDataFrame([(text, source)], "content string, source string").where(F.length(F.trim("content")) > 0)


def sample_id(text: Column) -> Column:
    """The first twelve digits of a text's MD5."""
    return F.substring(F.md5(text), 1, 12)


def gold_samples(rows: DataFrame, text: str, spans: str) -> DataFrame:
    """(id, start, end, entity_type) of rows with an array of labelled spans, ``spans`` (label, start, end); labels that name nothing personal are left out."""
    x = rows.select(sample_id(F.col(text)).alias("id"), F.explode(spans).alias("s"))
    return x.select("id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), gold_label(F.col("s.label")).alias("entity_type")).where("entity_type IS NOT NULL")


def gold_from_tokens(rows: DataFrame, key: str, tokens: str, tags: str) -> DataFrame:
    """(id, start, end, entity_type) of rows with arrays of tokens and of their B-/I-/O tags; the text is the tokens with a blank between."""
    each = rows.select(F.col(key).alias("doc"), sample_id(F.array_join(tokens, " ")).alias("id"), F.posexplode(F.arrays_zip(F.col(tokens).alias("token"), F.col(tags).alias("tag"))).alias("pos", "x"))
    w = Window.partitionBy("doc").orderBy("pos")
    each = each.select("doc", "id", "pos", "x.tag", F.length("x.token").alias("n")).withColumn("end", F.sum(F.col("n") + 1).over(w) - 1)
    spans = bio_spans(each.select("doc", "pos", "tag"))
    at = lambda p: each.select("doc", F.col("pos").alias(p), (F.col("end") - F.col("n")).alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("id").alias(f"{p}_id"))
    out = spans.join(at("first"), ["doc", "first"]).join(at("last").drop("last_start"), ["doc", "last"])
    return out.select(F.col("first_id").alias("id"), F.col("first_start").cast("int").alias("start"), F.col("last_end").cast("int").alias("end"), gold_label(F.col("entity_type")).alias("entity_type")).where("entity_type IS NOT NULL")


def chunks(texts: DataFrame, id_col: str = "doc", text_col: str = "doc_text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, start, chunk): windows of ``size`` characters, each ``overlap`` into the last."""
    step = size - overlap
    n = F.length(text_col)
    last = F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    x = texts.where(n > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(starts).alias("start"))
    return x.select("id", "start", F.substring(F.col("t"), F.col("start") + 1, F.lit(size)).alias("chunk"))
