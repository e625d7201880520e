"""Vocabularies, lists, pipelines of messages, review flow, generated notes, SQL functions, command line."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veilwork.functions import registration
from veilwork.operators import curate as L
from veilwork.operators import generate as G
from veilwork.operators import evaluate as M
from veilwork.operators import fuse as E
from veilwork.operators import sessions as X
from veilwork.operators import store as K
from veilwork.sources import vocabularies as V

SPAN = "doc string, span_id string, start int, end int, text string, entity_type string, confidence double, source string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_vocabularies(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"results": [{"brand_name": "Adol", "generic_name": "alpha, 5 mg x", "active_ingredients": [{"name": "BETA"}]}, {}]}))
    assert sorted(rows(V.drug_names(spark, str(tmp_path / "d.json")))) == [("Adol",), ("BETA",), ("alpha",)]
    (tmp_path / "i.txt").write_text("x" * 16 + "Short one".ljust(61) + "Long description" + "\n" + "x" * 16 + "Only the short one".ljust(64) + "\nshort\n")
    assert sorted(rows(V.diagnoses(spark, str(tmp_path / "i.txt")))) == [("Long description",)]
    (tmp_path / "l.csv").write_text("LONG_COMMON_NAME,COMPONENT\nGlucose in blood,Glu\nabc,\n")
    assert sorted(rows(V.lab_tests(spark, str(tmp_path / "l.csv")))) == [("Glu",), ("Glucose in blood",)]
    (tmp_path / "f.csv").write_text("Facility Name\nMERCY HOSPITAL\nSt. Anne\n")
    assert sorted(rows(V.facilities(spark, str(tmp_path / "f.csv")))) == [("Mercy Hospital",), ("St. Anne",)]
    head = ["NPI", "Entity Type Code", "Provider First Name", "Provider Last Name (Legal Name)", "Provider Organization Name (Legal Business Name)", "Provider Credential Text", *V.REGISTRY_FIELDS.values()]
    (tmp_path / "n.csv").write_text(",".join(f'"{h}"' for h in head) + "\n1,1,Ana,Abel,,MD,s,a,c,st,z,p\n2,2,,,Clinic,,s,a,c,st,z,p\n,1,x,y,,,,,,,,\n")
    got = {r["npi"]: r["provider_name"] for r in V.provider_registry(spark, str(tmp_path / "n.csv")).collect()}
    assert got == {"1": "Ana Abel", "2": "Clinic"}
    data = [{"a": i} for i in range(25)]
    assert V.paged(spark, lambda o, s: data[o : o + s], "a int", 10).count() == 25
    (tmp_path / "t.csv").write_text('transcription,medical_specialty,description,sample_name\n"' + "x" * 120 + '\ny",s,d,n\nshort,s,d,n\n')
    assert V.clinical_notes(spark, str(tmp_path / "t.csv")).count() == 1


def test_lists_and_evidence(spark):
    s = spark.createDataFrame([("d", "a", 0, 3, "Foo", "X", 0.5, "rule"), ("d", "b", 4, 7, "bar ", "X", 0.5, "rule"), ("d", "c", 8, 9, "z", "X", 0.5, "rule")], SPAN)
    allow, block = spark.createDataFrame([("foo",)], "term string"), spark.createDataFrame([("BAR", "SSN")], "term string, entity_type string")
    assert {(r["span_id"], r["entity_type"], r["confidence"]) for r in E.apply_lists(s, allow, block).collect()} == {("b", "SSN", 0.99), ("c", "X", 0.5)}
    cols = "rule_detected int, rule_conf double, rule_type string, presidio_detected int, presidio_conf double, presidio_type string, pii_bert_detected int, pii_bert_conf double, pii_bert_type string, phi_bert_detected int, phi_bert_conf double, phi_bert_type string, sources_agree_count int, merged_type string, merged_conf double"
    df = spark.createDataFrame([(1, 0.95, "R", 1, 0.9, "P", 0, 0.0, None, 0, 0.0, None, 2, "M", 0.4), (0, 0.0, None, 1, 0.5, "P", 1, 0.6, "I", 0, None, None, 2, "M", 0.4), (0, 0.0, None, 1, 0.5, "P", 0, 0.0, None, 0, 0.0, None, 1, "M", 0.4), (0, None, None, 0, None, None, 0, None, None, 0, None, None, None, None, None)], cols)
    got = [(r["evidence_ok"], r["evidence_type"], r["evidence_conf"]) for r in E.accept_by_evidence(df).collect()]
    assert got[0] == (True, "R", 0.95) and got[1] == (True, "M", pytest.approx(0.7)) and got[2] == (True, "M", 0.4) and got[3] == (False, "NONE", 0.0)
    assert E.stack_status()["rules"] == 82


def test_message_pipeline(spark):
    t0 = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([("m1", "c", "Ana, born 01/15/2024", t0), ("m2", "c", "ana again", t0 + dt.timedelta(minutes=1))], "id string, conversation_id string, content string, created_at timestamp")
    spans = spark.createDataFrame([("m1", "a", 0, 3, "Ana", "NAME_PERSON"), ("m1", "b", 10, 20, "01/15/2024", "DATE"), ("m2", "c", 0, 3, "ana", "NAME_PERSON")], "message_id string, span_id string, start int, end int, text string, entity_type string")
    out, tokens = X.process_user_messages(m, spans)
    assert dict(rows(out)) == {"m1": "[PERSON_1], born [DATE_1]", "m2": "[PERSON_1] again"}
    kept = {r["token"]: r["original"] for r in tokens.collect()}
    assert kept["[PERSON_1]"].lower() == "ana" and kept["[DATE_1]"] != "01/15/2024"
    answer = spark.createDataFrame([("r", "c", "Hi [PERSON_1] and [PERSON_7]"), ("s", "other", "[PERSON_1]")], "id string, conversation_id string, content string")
    back = dict(rows(X.process_assistant_messages(answer, tokens)))
    assert back["r"].lower() == "hi ana and [person_7]" and back["s"] == "[PERSON_1]"
    assert [r["conversation_id"] for r in X.recent_conversations(m, 1).collect()] == ["c"]
    assert X.expired_conversations(m, F.lit(dt.datetime(2024, 6, 1))).count() == 1


def test_review_flow(spark):
    docs = spark.createDataFrame([("d", "Ana Abel", None), ("e", "x", dt.datetime(2024, 1, 1))], "id string, content string, scanned_at timestamp")
    found, done, tally = K.scan_unscanned(docs, lambda df: df.select("id", F.lit(0.5).alias("confidence")), F.lit(dt.datetime(2024, 2, 1)))
    assert found.count() == 1 and done.where("scanned_at IS NULL").count() == 0 and tuple(tally.first()) == (0, 1)
    ents = spark.createDataFrame([("d", "a", 4, 8, "Abel", "NAME", 0.5, "rule")], SPAN)
    texts = spark.createDataFrame([("d", "Ana Abel came")], "doc string, doc_text string")
    c = K.apply_decisions(ents, spark.createDataFrame([("a", "changed", "SSN")], "span_id string, decision string, correct_type string"), texts, F.lit(dt.datetime(2024, 2, 1))).first()
    assert (c["context_before"], c["context_after"], c["correct_type"], c["entity_start"]) == ("Ana ", " came", "SSN", 4)
    r = K.missed_reports(spark.createDataFrame([("d", "Abel", "NAME"), ("d", "zz", "NAME")], "doc string, missed_text string, correct_type string"), texts)
    assert {(x["missed_text"], x["missed_start"]) for x in r.collect()} == {("Abel", 4), ("zz", None)}
    assert K.capture_uncertain(spark.createDataFrame([(0.5,), (0.99,)], "merged_conf double")).count() == 1


def test_evaluation_helpers(spark):
    one = spark.createDataFrame([("FIRSTNAME",), ("E-MAIL",), ("GPS_COORDINATE",), ("IBAN",), ("???",), (None,)], "t string")
    assert [r[0] for r in one.select(M.category(F.col("t"))).collect()] == ["NAME", "CONTACT", "LOCATION", "IDNUM", "OTHER", "OTHER"]
    assert [r[0] for r in one.select(M.gold_label(F.col("t"))).collect()][:2] == ["NAME_PERSON", "EMAIL"]
    gold = spark.createDataFrame([("d", "g1", 0, 3, "abc", "X", 1.0, "g"), ("d", "g2", 5, 8, "def", "X", 1.0, "g"), ("d", "g3", 10, 12, "hi", "X", 1.0, "g")], SPAN)
    seen = gold.where("span_id = 'g2'")
    got = {r["span_id"]: r["issue"] for r in M.trace_missed(gold, gold.where("span_id = 'g1'"), {"rule": seen, "model": seen.where("false")}).collect()}
    assert got == {"g2": "lost in merge", "g3": "never detected"}
    texts = spark.createDataFrame([("d", "abc  def  hi")], "doc string, doc_text string")
    m = spark.createDataFrame([("d", "g1", "x")], "doc string, pred string, gold string")
    assert {(r["span_id"], r["decision"]) for r in M.errors_as_corrections(gold, m, texts).collect()} == {("g1", "confirmed"), ("g2", "rejected"), ("g3", "rejected")}


def test_generated_notes_and_mix(spark):
    a = G.generate(spark, "notes", 200).drop("entities")
    mix = L.training_mix(a, G.generate(spark, "adversarial", 50).drop("entities"), a)
    assert 250 < mix.count() < 350 and mix.select("_source").distinct().count() == 3


def test_sql_functions(spark):
    assert "ssn_ok" in registration.register(spark)
    r = spark.sql("SELECT luhn_ok('4111-1111 1111 1111'), ssn_ok('123-45-6789'), ssn_ok('000-45-6789'), npi_ok('1234567893'), short_type('NAME_PERSON'), overlap_ratio(0, 4, 2, 10), date_offset('c') BETWEEN 30 AND 364").first()
    assert list(r) == [True, True, False, True, "PERSON", 0.5, True]


def test_command_line(spark, tmp_path, capsys, data):
    from veilwork.__main__ import main

    assert main(["redact", "--mode", "proven", "--text", "paid 4111 1111 1111 1111 now"]) == 0
    assert "paid [CREDIT_CARD_1] now" in capsys.readouterr().out
    assert main(["rules"]) == 0 and main(["status"]) == 0
    assert "ssn_dashed" in capsys.readouterr().out
    assert main(["run", "rule_catalog", data, "--output", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 82
