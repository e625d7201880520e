"""Fusion, de-identification, conversations, store, audit, evaluation, dictionaries, sources, streams."""

import datetime as dt
import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilwork import Client, Config, ConfigurationError, SessionExpired, scan
from veilwork.operators import audit as A
from veilwork.operators import curate as L
from veilwork.operators import generate as G
from veilwork.operators import deidentify as S
from veilwork.operators import dictionary as C
from veilwork.operators import evaluate as M
from veilwork.operators import fuse as E
from veilwork.operators import plugins as P
from veilwork.operators import references as R
from veilwork.operators import sessions as X
from veilwork.operators import store as K
from veilwork.sources import documents as D
from veilwork.sources import writers as W
from veilwork.streaming import detection as T

SPAN = "doc string, span_id string, start int, end int, text string, entity_type string, confidence double, source string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_islands_and_merge(spark):
    s = spark.createDataFrame(
        [
            ("d", "a", 0, 5, "abcde", "SSN", 0.8, "rule"), ("d", "b", 4, 9, "efghi", "PHONE", 0.9, "model"), ("d", "c", 8, 12, "ijkl", "PHONE", 0.2, "model"),
            ("d", "e", 12, 15, "mno", "AGE", 0.5, "model"), ("f", "g", 1, 2, "x", "AGE", 0.5, "model"),
        ],
        SPAN,
    )
    assert {(r["span_id"], r["grp"]) for r in E.overlap_groups(s).collect()} == {("a", 1), ("b", 1), ("c", 1), ("e", 2), ("g", 1)}
    m = {(r["doc"], r["grp"]): (r["start"], r["end"], r["entity_type"], r["confidence"]) for r in E.tiered_merge(s).collect()}
    assert m[("d", 1)] == (0, 5, "PHONE", 0.95) and m[("d", 2)] == (12, 15, "AGE", 0.5)
    g = E.group_evidence(s).where("doc = 'd' AND grp = 1").first()
    assert (g["n_sources"], g["n_spans"], g["best_type"], g["consensus"]) == (2, 3, "PHONE", False)
    assert E.tiered_merge(s.where("doc = 'z'")).count() == 0


def test_decisions(spark):
    df = spark.createDataFrame([(0.9, 0.0, 0.96, True, "MRN", None, "SSN"), (0.0, 0.0, None, False, None, None, None), (0.8, 0.7, 0.0, False, "EMAIL", "URL", None)], "phi_conf double, pii_conf double, rule_conf double, has_checksum boolean, phi_type string, pii_type string, rule_type string")
    a, b, c = E.decide(df).collect()
    assert (a["final_conf"], a["final_type"], a["tier"]) == (0.99, "SSN", 3)
    assert not b["accepted"] and b["combined"] == 0
    assert c["final_type"] == "URL" and 0 < c["combined"] < 1
    kind, conf = E.repair_types(F.lit("MRN"), F.lit("4111 1111-1111 1111"), F.lit(1.0))
    assert one(spark, kind, conf) == ["CREDIT_CARD", 0.95]
    t = F.lit("Seen by Dr. Smith, MD and Jones")
    assert one(spark, E.refine_person(t, F.lit(12), F.lit(17), F.lit("PERSON")), E.refine_person(F.lit("patient Jones"), F.lit(8), F.lit(13), F.lit("NAME_PERSON")), E.refine_person(t, F.lit(0), F.lit(1), F.lit("SSN"))) == ["NAME_PROVIDER", "NAME_PATIENT", "SSN"]


def test_safe_harbor(spark):
    shift = lambda x, n=30: S.shift_date(F.lit(x), F.lit(n))
    assert one(spark, shift("01/15/2024"), shift("3/5/99"), shift("2024-1-5"), shift("January 15, 2024"), shift("02/30/2020"), shift("soon")) == ["02/14/2024", "04/04/99", "2024-02-04", "February 14, 2024", "02/30/2020", "soon"]
    assert one(spark, S.shift_year(F.lit("3/5/99"), F.lit(400)), S.shift_year(F.lit("in 2019"), F.lit(364)), S.shift_year(F.lit("x"), F.lit(9))) == ["2000", "2019", "x"]
    assert one(spark, *(S.generalise_age(F.lit(x)) for x in ("89", "90", "099", "n/a"))) == ["89", "90+", "90+", "n/a"]
    assert one(spark, S.generalise_ages_in(F.lit("a 92-year-old, age: 93, aged 45, 91 yo"))) == ["a 90+ year old, age 90+, aged 45, 90+ year old"]
    assert one(spark, *(S.generalise_zip(F.lit(x)) for x in ("82301", "94110-1234", "123"))) == ["000XX", "941XX", "123"]
    d = one(spark, S.date_offset(F.lit("c1")), S.date_offset(F.lit("c1")))
    assert d[0] == d[1] and 30 <= d[0] < 365


def test_tokens_redact_and_restore(spark):
    text = "Ana met Bo 😀 and ana; [PERSON_9]."
    s = spark.createDataFrame([("d", "a", 0, 3, "Ana", "NAME_PERSON", 1.0, "rule"), ("d", "b", 8, 10, "Bo", "NAME_PATIENT", 1.0, "rule"), ("d", "c", 17, 20, "ana", "NAME_PERSON", 1.0, "rule"), ("d", "x", 9, 12, "o 😀", "OTHER", 1.0, "rule")], SPAN)
    texts = spark.createDataFrame([("d", text), ("e", None), ("f", "plain")], "doc string, doc_text string")
    t = {r["span_id"]: r["token"] for r in S.assign_tokens(s.where("span_id <> 'x'")).collect()}
    assert t == {"c": "[PERSON_1]", "a": "[PERSON_1]", "b": "[PATIENT_1]"}
    r = {x["doc"]: x for x in S.redact(texts, S.assign_tokens(s.where("span_id <> 'x'"))).withColumn("back", S.restore(F.col("redacted"), F.col("token_map"))).collect()}
    assert r["d"]["redacted"] == "[PERSON_1] met [PATIENT_1] 😀 and [PERSON_1]; [PERSON_9]."
    assert r["d"]["back"].lower() == text.lower() and r["e"]["redacted"] is None and r["f"]["redacted"] == "plain"
    over = S.redact(texts, S.assign_tokens(s)).where("doc = 'd'").first()["redacted"]
    assert over.count("[") == 4  # of two overlapping spans one is replaced
    key = S.derive_key("pw", b"salt", 10)
    secret = spark.createDataFrame([("geheim",), (None,)], "t string")
    sealed = S.encrypt(secret, "t", key)
    assert [r["t"] for r in S.decrypt(sealed, "t", key).collect()] == ["geheim", None]
    assert key.hex() not in sealed._jdf.queryExecution().toString().lower() and str(list(key))[1:-1] not in sealed._jdf.queryExecution().toString()
    back = S.redact(texts, S.assign_tokens(s)).select("doc", S.restore_log(F.col("redacted"), F.col("log")).alias("t"))
    assert dict(rows(back)) == {"d": text, "e": None, "f": "plain"}


def test_conversations(spark):
    t0 = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([(f"m{i:02d}", "c", "user", "Ana said hi " + "x" * 40, None, t0 + dt.timedelta(minutes=i), False) for i in range(6)] + [("z", "d", "user", None, None, None, None)], "id string, conversation_id string, role string, content string, content_redacted string, created_at timestamp, compacted boolean")
    c = {r["conversation_id"]: (r["n_messages"], r["tokens"]) for r in X.context(m).collect()}
    assert c == {"c": (6, 6 * 52 // 4), "d": (1, 0)}
    assert [r["id"] for r in X.compaction(m, limit=50, keep=4).where("compact").orderBy("id").collect()] == ["m00", "m01"]
    assert {r["id"] for r in X.recent_messages(m, 2).where("conversation_id = 'c'").collect()} == {"m04", "m05"}
    spans = spark.createDataFrame([("m00", "a", 0, 3, "Ana", "NAME_PERSON"), ("m03", "b", 0, 3, "ANA", "NAME_PERSON"), ("m03", "c", 4, 8, "said", "OTHER")], "message_id string, span_id string, start int, end int, text string, entity_type string")
    out = dict(rows(X.tokenise_messages(m, spans)))
    assert out["m00"].startswith("[PERSON_1] said") and out["m03"].startswith("[PERSON_1] [OTHER_1]") and out["z"] is None
    assert one(spark, X.append_summary(F.lit("a"), F.lit("b")), X.append_summary(F.lit(None), F.lit("b"))) == ["a\n\n---\n\nb", "b"]


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, n int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 3)], "id int, v string, n int")
    assert sorted(rows(K.upsert(old, new, "id"))) == [(1, "a", 1), (2, "B", 9), (3, "c", 3)]
    assert sorted(rows(K.patch(old, spark.createDataFrame([(1, None)], "id int, v string"), "id"))) == [(1, "a", 1), (2, "b", 2)]
    assert rows(K.delete(old, new, "id")) == [(1, "a", 1)]
    f = spark.createDataFrame([("tp", "X", None), ("WL ", "X", "Y"), ("fp", "X", None), (None, "X", None)], "feedback_type string, merged_type string, feedback_correct_type string")
    assert [r["truth"] for r in K.feedback_truth(f).collect()] == ["X", "Y", "NONE", None]
    now = dt.datetime(2024, 6, 1)
    s = spark.createDataFrame([("pending", dt.datetime(2024, 1, 1)), ("training", dt.datetime(2024, 1, 1)), ("pending", dt.datetime(2024, 5, 30)), (None, dt.datetime(2024, 1, 1))], "status string, created_ts timestamp")
    assert rows(K.archive_split(s, F.lit(now)).select("place", "status")) == [("archive", "expired"), ("active", "training"), ("active", "pending"), ("archive", None)]
    m = spark.createDataFrame([("v1", "active", dt.datetime(2024, 1, 1)), ("v2", "staged", None), ("v0", "rolled_back", dt.datetime(2023, 1, 1))], "version string, status string, promoted_at timestamp")
    p = K.promote(m, "v2", F.lit(now))
    assert K.active_model(p).first()["version"] == "v2" and [r["version"] for r in K.rollback_order(p).collect()] == ["v2", "v1"]
    assert {r["version"] for r in K.retained_models(p, 1).collect()} == {"v2", "v1"}
    assert K.should_train(10)[0] is False and K.should_train(2000, last_f1=0.9, new_f1=0.85)[0] is False and K.should_train(2000, last_f1=0.9, new_f1=0.89) == (True, "ready")
    assert one(spark, *(K.parse_time(F.lit(x)) for x in ("2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "nope"))) == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 2 + [None]


def test_audit_chain_finds_tampering(spark):
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(f"l{k}", i, "view", t0 + dt.timedelta(seconds=i), i, None if i == 2 else "{}") for k in range(3) for i in range(1, 9)], "log string, sequence long, event_type string, at timestamp, user_id long, details string")
    c = A.chain(e).cache()
    assert all(r["valid"] and r["n_events"] == 8 for r in A.verify(c).collect())
    altered = c.withColumn("user_id", F.when((F.col("log") == "l1") & (F.col("sequence") == 4), 99).otherwise(F.col("user_id"))).where("NOT (log = 'l2' AND sequence = 5)")
    got = {r["log"]: (r["valid"], r["first_bad"]) for r in A.verify(altered).collect()}
    assert got == {"l0": (True, None), "l1": (False, 4), "l2": (False, 6)}
    more = A.append(spark, c.where("log = 'l0'"), pd.DataFrame([{"log": "l0", "event_type": "click", "at": "2024-02-01", "user_id": 5, "details": ""}]))
    assert A.verify(more).first()["valid"] and more.count() == 9
    assert [r["sequence"] for r in A.query(c.where("log = 'l0'"), event_type="view", limit=2, offset=1).collect()] == [7, 6]
    assert A.stats(c).first()["n_events"] == 24 and A.query(c, since=t0 + dt.timedelta(seconds=8)).count() == 3


def greedy(pred, gold):
    taken, out = set(), []
    for p in sorted(pred, key=lambda p: (p[1], p[2], p[0])):
        best = None
        for g in sorted(gold, key=lambda g: (g[1], g[0])):
            o = max(0, min(p[2], g[2]) - max(p[1], g[1])) / min(p[2] - p[1], g[2] - g[1])
            if g[0] not in taken and o >= 0.5 and p[3] == g[3] and (best is None or o > best[0]):
                best = (o, g[0])
        if best:
            taken.add(best[1])
            out.append((p[0], best[1]))
    return set(out)


def test_greedy_matching_and_scores(spark):
    import random

    rng = random.Random(1)
    pred = {d: [(f"p{d}{i}", s := rng.randrange(40), s + rng.randrange(3, 9), rng.choice(["SSN", "URL"])) for i in range(rng.randrange(7))] for d in range(25)}
    gold = {d: [(f"g{d}{i}", s := rng.randrange(40), s + rng.randrange(3, 9), rng.choice(["SSN", "URL"])) for i in range(rng.randrange(7))] for d in range(25)}
    frame = lambda x, src: spark.createDataFrame([(d, *s, src) for d, v in x.items() for s in v], "doc int, span_id string, start int, end int, entity_type string, source string")
    p, g = frame(pred, "rule"), frame(gold, "gold")
    m = M.greedy_matches(p, g)
    got = {}
    for r in m.collect():
        got.setdefault(r["doc"], set()).add((r["pred"], r["gold"]))
    assert all(got.get(d, set()) == greedy(pred[d], gold[d]) for d in pred)
    t = M.score_table(M.outcomes(p, g, m)).where("level = 3").first()
    assert t["tp"] + t["fn"] == sum(map(len, gold.values())) and t["tp"] + t["fp"] == sum(map(len, pred.values()))
    s = {r["mode"]: r for r in M.semeval(p, g).collect()}
    assert s["exact"]["correct"] == s["partial"]["correct"] and s["strict"]["correct"] <= s["exact"]["correct"]
    assert all(r["correct"] + r["incorrect"] + r["partial"] + r["missed"] == sum(map(len, gold.values())) for r in s.values())
    none = M.semeval(p.where("doc > 99"), g)
    assert {r["missed"] for r in none.collect()} == {sum(map(len, gold.values()))}


def test_calibration_and_thresholds(spark):
    df = spark.createDataFrame([(0.05, False), (0.95, True), (1.0, True), (0.95, False)], "p double, a boolean")
    e = M.calibration_error(df, "p", "a").first()
    assert e["brier"] == pytest.approx((0.0025 + 0.0025 + 0 + 0.9025) / 4) and e["ece"] == pytest.approx((0.05 + 2 * 0.45) / 4)
    s = M.threshold_sweep(df, "p", "a")
    assert M.recommended_threshold(s).first()["threshold"] == 0.1 and s.count() == 16
    assert one(spark, M.compatible(F.lit("name_person"), F.lit("LASTNAME")), M.compatible(F.lit("SSN"), F.lit("URL")), M.overlap_ratio(F.lit(0), F.lit(4), F.lit(2), F.lit(10)), M.overlap_ratio(F.lit(0), F.lit(4), F.lit(2), F.lit(10), True)) == [True, False, 0.5, 0.25]


def test_bio_spans_and_word_tags(spark):
    tags = spark.createDataFrame([("d", i, t) for i, t in enumerate("O B-N I-N B-N O I-D I-D".split())], "doc string, pos int, tag string")
    assert sorted(rows(M.bio_spans(tags))) == [("d", "D", 5, 6), ("d", "N", 1, 2), ("d", "N", 3, 3)]
    t = spark.createDataFrame([("d", "Ana Abel saw me")], "doc string, doc_text string")
    s = spark.createDataFrame([("d", 0, 8, "NAME", "s")], "doc string, start int, end int, entity_type string, span_id string")
    assert [(r["word"], r["tag"]) for r in L.word_tags(t, s).orderBy("pos").collect()] == [("Ana", "B-NAME"), ("Abel", "I-NAME"), ("saw", "O"), ("me", "O")]


def test_dictionary(spark):
    t = spark.createDataFrame([("a", "Take ASPIRIN, aspirin-C and Vitamin  B; new york!"), ("b", None), ("c", "aspirins C++ c++x")], "doc string, doc_text string")
    terms = spark.createDataFrame([("aspirin", "DRUG"), ("New York", "TOWN"), ("vitamin b", "DRUG"), ("C++", "X"), ("b", "X")], "term string, category string")
    got = sorted((r["id"], r["term"], r["start"]) for r in C.dictionary_hits(t, terms, min_length=3).collect())
    assert got == [("a", "aspirin", 5), ("a", "aspirin", 14), ("a", "new york", 40), ("c", "c++", 9)]
    raw = spark.createDataFrame([("# note",), (" Aspirin ",), ("aspirin",), ("12mg",), ("",)], "line string")
    assert rows(C.load_terms(raw, "line")) == [("aspirin",)]
    keys = spark.createDataFrame([("1234567893",), ("1234567890",)], "npi string")
    reg = spark.createDataFrame([("1234567893", "Ana")], "npi string, name string")
    assert sorted(rows(C.registry_lookup(keys, reg).select("npi", "valid", "name"))) == [("1234567890", False, None), ("1234567893", True, "Ana")]
    assert C.registry_search(reg, "AN", ["name"]).count() == 1


def test_generated_samples_are_reproducible(spark):
    for what, families in G.FAMILIES.items():
        a, b = G.generate(spark, what, 400).collect(), G.generate(spark, what, 400).repartition(3).orderBy("id").collect()
        assert a == b and {r["family"] for r in a} == set(families)
        assert all(r["text"][e["start"] : e["end"]] == e["text"] for r in a for e in r["entities"])
        assert (what == "negatives") == (not any(r["entities"] for r in a))
    r = L.reinject(spark.createDataFrame([("a", "Dear [NAME_1], ___ and 😀 [NAME]"), ("b", "none"), ("c", None)], "doc string, doc_text string"), ["Ana", "Boris"])
    for x in r.collect():
        assert all(x["text"][e["start"] : e["end"]] == e["value"] for e in x["entities"])
    assert r.count() == 2


def test_orphan_references(spark):
    t = lambda *a: dt.datetime(2024, *a)
    parents = spark.createDataFrame([("doc-a", t(1, 1)), ("doc-b", t(6, 1)), ("doc-c", None), ("doc-a", t(1, 1))], "id string, created_at timestamp")
    kids = [("k1", "doc-a", t(2, 1)), ("k2", "URN:DOC_A ", t(2, 1)), ("k3", "doc-b", t(2, 1)), ("k4", "doc-x", t(2, 1)), ("k5", "doc-y", None), ("k6", "", t(2, 1)), ("k7", None, t(2, 1)), ("k8", "doc-c", t(1, 1)), ("k3", "doc-b", t(2, 1))]
    kids += [(f"h{i}", "doc-hot", t(3, 1)) for i in range(3000)]
    child = spark.createDataFrame(kids, "id string, document_id string, created_at timestamp").withColumn("kind", F.lit("clash"))
    gone = spark.createDataFrame([("docs", "doc-y", t(1, 1)), ("docs", "doc-y", t(1, 1)), ("docs", "doc-a", t(1, 1)), ("other", "doc-x", t(1, 1))], "table_name string, record_id string, deleted_at timestamp")
    ref = [R.Reference("kids", "document_id", "docs", "created_at")]
    out = R.orphan_references({"kids": child, "docs": parents}, gone, ref)
    got = {(r["child_id"], r["kind"], r["period"]) for r in out.collect()}
    assert {x for x in got if x[0][0] == "k"} == {("k3", "late", "2024-02"), ("k4", "missing", "2024-02"), ("k5", "deleted", "unknown")}
    assert len(got) == 3003
    assert {(r["kind"], r["period"], r["n_orphans"]) for r in R.orphan_counts(out).collect()} == {("late", "2024-02", 1), ("missing", "2024-02", 1), ("deleted", "unknown", 1), ("missing", "2024-03", 3000)}
    assert R.orphan_references({"kids": child.where("id = 'z'"), "docs": parents}, gone, ref).count() == 0
    assert R.orphan_references({"kids": child.where("id = 'k1'"), "docs": parents.where("id = 'z'")}, gone.where("table_name = 'z'"), ref).first()["kind"] == "missing"


def xlsx():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {n}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {n}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {n}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>')
    return b.getvalue()


def docx():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        n = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {n}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    return b.getvalue()


def test_sources(spark, tmp_path):
    files = {
        "a.txt": "héllo".encode(), "b.txt": b"h\xe9llo", "c.html": b"<style>x</style><p>A &amp; <b>B</b></p>", "d.csv": b'k,v\n1,"x, y"\n,\n', "e.tsv": b"k\tv\n",
        "f.json": json.dumps({"resourceType": "Patient", "id": "7", "name": [{"family": "Abel", "given": ["Ana"]}]}).encode(), "g.hl7": b"MSH|^~\\&|A|B|C|D|2024||ADT^A01\rPID|1||7||Abel^Ana||1980\r",
        "h.xml": b'<ClinicalDocument xmlns="urn:hl7-org:v3"><title>T</title></ClinicalDocument>', "i.xml": b"<a> x <b>y</b></a>", "j.xlsx": xlsx(), "k.docx": docx(), "l.rtf": rb"{\rtf1\ansi Hello\par W\'e9}", "m.pdf": b"%PDF", "n.bin": b"x", "o.docx": b"broken",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in D.extract(D.read_folder(spark, str(tmp_path))).collect()}
    text = {k: v["text"] for k, v in got.items()}
    assert text["a.txt"] == text["b.txt"] == "héllo" and text["c.html"] == "A & B" and text["d.csv"] == "k | v\n1 | x, y" and text["e.tsv"] == "k | v"
    assert text["f.json"] == "Patient: Ana Abel\nID: 7" and text["g.hl7"] == "Message Type: ADT A01\nPatient ID: 7\nPatient Name: Abel Ana\nDOB: 1980"
    assert got["h.xml"]["doc_type"] == "cda" and text["h.xml"].strip() == "T" and text["i.xml"] == "x y"
    assert text["j.xlsx"] == "=== Sheet: S1 ===\nname | 5" and text["k.docx"] == "Hello\na | b" and text["l.rtf"] == "Hello\nWé"
    assert got["m.pdf"]["error"] and got["n.bin"]["error"] == "unsupported type" and got["o.docx"]["error"].startswith("BadZipFile")
    plug = D.extract(D.read_folder(spark, str(tmp_path), "*.pdf"), {"pdf": lambda b: "read"}).first()
    assert plug["text"] == "read" and D.capabilities()["docx"]
    (tmp_path / "in.jsn").write_text(json.dumps({"documents": ["one", {"text": "two", "source": "s"}, {"content": " "}]}))
    assert rows(D.import_json(spark, str(tmp_path / "in.jsn"))) == [("one", None), ("two", "s")]
    t = spark.createDataFrame([("a", "x" * 1950), ("b", "short"), ("c", ""), ("d", None)], "doc string, doc_text string")
    assert sorted((r["id"], r["start"], len(r["chunk"])) for r in D.chunks(t).collect()) == [("a", 0, 1000), ("a", 900, 1000), ("a", 1800, 150), ("b", 0, 5)]
    W.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "b"]
    assert W.markdown("T", spark.createDataFrame([(1, 0.5)], "a int, b double")).endswith("| 1 | 0.5000 |\n")


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1", "mail a@b.example"), ("2", None)], "id string, content string").coalesce(1).write.parquet(src)
    run = lambda: T.detect_stream(T.read_texts(spark, src, "id string, content string"), "id", "content", out, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("3", "mail c@d.example")], "id string, content string").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r["text"] for r in spark.read.parquet(out).where("rule = 'email'").collect()) == ["a@b.example", "c@d.example"]
    spans = str(tmp_path / "spans")
    schema = "conversation_id string, text string, entity_type string"
    for batch in ([("c", "Ana", "NAME_PERSON"), ("c", "Bo", "NAME_PERSON")], [("c", "ana", "NAME_PERSON"), ("d", "Ana", "NAME_PERSON")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(spans)
    q = T.token_stream(T.read_texts(spark, spans, schema, 1)).writeStream.format("memory").queryName("tok").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    tok = {(r["conversation_id"], r["hash"], r["token"]) for r in spark.table("tok").collect()}
    assert len(tok) == 3 and {t for c, _, t in tok if c == "c"} == {"[PERSON_1]", "[PERSON_2]"}


def test_plugins_and_api(spark):
    P.register_detector("caps", P.model_detector(lambda: lambda texts: [[(0, 3, "OTHER", 0.9)] if t[:3].isupper() else [] for t in texts]))
    df = spark.createDataFrame([(1, "ABC and jane@x.example, SSN 123-45-6789"), (2, "none here"), (3, None)], "id long, t string")
    got = {(r["doc"], r["text"], r["entity_type"]) for r in scan(df, "id", "t", Config(plugins=("caps",))).collect()}
    assert {(1, "jane@x.example", "EMAIL"), (1, "123-45-6789", "SSN"), (1, "ABC", "OTHER")} <= got
    assert {r["entity_type"] for r in scan(df, "id", "t", Config(mode="proven")).collect()} == {"SSN"}
    with pytest.raises(ConfigurationError):
        Config(mode="x")
    d, c = P.parse_verdict(F.lit("yes, it is"))
    assert one(spark, d, c, *P.parse_verdict(F.lit("I think NO")), *P.parse_verdict(F.lit(None))) == ["yes", 0.9, "no", 0.75, "uncertain", 0.5]
    s = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.99)], "span_id string, confidence double")
    v = spark.createDataFrame([("a", "no"), ("c", "no")], "span_id string, decision string")
    assert {r["span_id"] for r in P.apply_verdicts(s, v).collect()} == {"b", "c"}
    client = Client(spark, Config(mode="proven"))
    t = "paid 4111 1111 1111 1111 please"
    r = client.redact(t)
    assert r == "paid [CREDIT_CARD_1] please" and client.restore(r) == t
    client.close()
    with pytest.raises(SessionExpired):
        client.scan("x")


def test_entry_points():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80 and "p6_found" in q
