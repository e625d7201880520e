"""Sessions under a password, rule catalogues, the learning loop, span joins, on small tables with every kind of dirt."""

import pytest
from pyspark.sql import functions as F

from veilwork import ConfigurationError, Session, SessionExpired
from veilwork.functions.spans import overlap_pairs
from veilwork.operators import curate as L
from veilwork.operators import evaluate as M
from veilwork.operators import plugins as P
from veilwork.operators import store as K
from veilwork.operators.detect import Catalog, Rule, detect

def now():
    return F.expr("TIMESTAMP '2026-01-01 00:00:00'")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_session_under_a_password(spark, tmp_path):
    path = f"{tmp_path}/tokens"
    s = Session(spark, "pw", "c1", path, rounds=10)
    one = s.redact("mail dana@example.org, SSN 123-45-6789")
    assert "dana" not in one and "123-45" not in one
    assert s.restore(one.lower()).count("dana@example.org") == 1 and s.stats()["messages"] == 1
    again = Session(spark, "pw", "c1", path, rounds=10)
    assert again.tokens() == s.tokens() and again.redact("to DANA@example.org") in one.replace("mail", "to").split(",")[0]
    stored = spark.read.parquet(path)
    assert all(b"dana" not in bytes(r["original"]) for r in stored.collect())
    with pytest.raises(Exception):
        Session(spark, "other", "c1", path, rounds=10)
    s.close()
    with pytest.raises(SessionExpired):
        s.restore(one)
    with pytest.raises(ConfigurationError):
        Session(spark, "", "c1")


def test_catalog_checks_its_rules(spark, tmp_path):
    c = Catalog([Rule("a", "EMAIL", 0.9, r"\S+@\S+"), Rule("b", "OTHER", 0.5, "(")])
    assert list(c.check(spark)) == ["b"]
    assert c.enable("b", False) and not c.enable("z")
    df = spark.createDataFrame([(1, "x@y z"), (2, None), (3, "")], "id int, t string")
    assert [r["text"] for r in detect(df, "id", "t", c).collect()] == ["x@y"]
    for bad in (Rule("c", "not a type", 0.5, "x"), Rule("c", "OTHER", 2.0, "x"), Rule("c", "OTHER", 0.5, "x", group="nowhere"), Rule("a", "OTHER", 0.5, "x")):
        with pytest.raises(ValueError):
            c.add(bad)
    c.save(f"{tmp_path}/rules.json")
    assert [r.enabled for r in Catalog.load(f"{tmp_path}/rules.json").rules] == [True, False]


def test_learning_loop(spark):
    hits = spark.createDataFrame([("d", "s1", "X", 0.5), ("d", "s1", "X", 0.5), ("d", "s2", "X", 0.99), ("d", "s3", None, 0.1), ("d", "s4", "X", None)], "doc string, span_id string, entity_type string, confidence double")
    have = spark.createDataFrame([("s3", "reviewed")], "id string, status string")
    out = K.learn_from(hits, have, now())[1]
    assert sorted((r["id"], r["status"]) for r in out.collect()) == [("s1", "pending"), ("s3", "reviewed")]
    assert K.due_steps(3, 2000) == ["promote", "train"] and K.due_steps(3, 5) == ["promote"] and K.due_steps(6, 2000) == ["promote", "archive"]
    models = spark.createDataFrame([], "version string, status string, promoted_at timestamp, staged_at timestamp, f1 double")
    m = K.advance_models(K.stage_model(models, "m1", {"f1": 0.5}, now()), now())
    assert [r["status"] for r in m.collect()] == ["shadow"] and rows(K.rollback(m, now()).select("status")) == [("shadow",)]


def test_overlap_pairs_meet_once(spark):
    a = spark.createDataFrame([("d", 0, 1000), ("d", 300, 310), ("e", 0, 5), ("d", 5, 5)], "doc string, start int, end int")
    b = spark.createDataFrame([("d", 0, 2000, "x"), ("d", 310, 320, "y"), ("f", 0, 5, "z")], "doc string, start int, end int, name string")
    got = sorted((r["start"], r["r_name"]) for r in overlap_pairs(a, b).collect())
    assert got == [(0, "x"), (0, "y"), (300, "x")]


def test_matching_dirt(spark):
    kind = "doc string, span_id string, start int, end int, entity_type string"
    pred = spark.createDataFrame([("d", "p1", 0, 5, "X"), ("d", "p1", 0, 5, "X"), ("d", "p2", 0, 5, None), ("d", "p3", 9, 9, "X"), ("e", "p4", 3, 1, "X")], kind)
    gold = spark.createDataFrame([("d", "g1", 0, 5, "X"), ("d", "g2", 4, 8, "X"), ("f", "g3", 0, 1, "X")], kind)
    assert rows(M.greedy_matches(pred, gold)) == [("d", "p1", "g1")]
    strict = M.semeval(pred, gold).where("mode = 'strict'").first()
    assert (strict["correct"], strict["incorrect"], strict["missed"], strict["spurious"]) == (1, 1, 1, 2)
    assert rows(M.greedy_matches(pred.where("false"), gold)) == []


def test_quality_of_nulls(spark):
    df = spark.createDataFrame([("EMAIL", "a@b.c", "k"), ("EMAIL", None, "k"), (None, "abc", "k"), ("PIN", "1234", "your pin is 1234"), ("PHONE", "12", "x")], "entity_type string, text string, q string").withColumnRenamed("q", "around")
    got = [(r["q"]["clean"], r["q"]["reason"]) for r in L.with_quality(df, around="around").collect()]
    assert got == [(True, "Valid email format"), (False, "Missing @ or domain"), (True, "Default accept"), (True, "Password with context"), (False, "Too few digits: 2")]


def test_a_failing_verifier_leaves_doubt(spark):
    def load():
        def ask(prompts):
            raise OSError("down")

        return ask

    P.register_verifier("down", load)
    s = spark.createDataFrame([("d", "s", 0, 3, "abc", "X", 0.5), ("d", "t", 0, 3, "abc", "X", 0.99)], "doc string, span_id string, start int, end int, text string, entity_type string, confidence double")
    t = spark.createDataFrame([("d", "abc def"), ("e", None)], "doc string, doc_text string")
    assert rows(P.verify(s, t, "down")) == [("s", "uncertain", 0.5)] == rows(P.verify(s, t, "none"))
    assert "down" in P.verifiers()


def test_command_line(spark, tmp_path, capsys, data):
    from veilwork.__main__ import main

    rules = f"{tmp_path}/rules.json"
    assert main(["rules", "add", "--file", rules, "--name", "ward", "--pattern", r"Ward \d+", "--type", "FACILITY"]) == 0
    assert main(["rules", "disable", "--file", rules, "--name", "email"]) == 0
    assert main(["scan", "--text", "to dana@example.org, Ward 12", "--rules", rules]) == 0
    assert main(["rules", "test", "--pattern", r"\d+", "--text", "a 12"]) == 0
    assert main(["stats", data]) == 0 and main(["generate", "notes", "5", "--output", f"{tmp_path}/notes"]) == 0
    assert main(["export", data, "--output", f"{tmp_path}/corrections"]) == 0
    out = capsys.readouterr().out
    assert "Ward 12" in out and "12\t2\t4" in out and "n_documents" in out
    assert spark.read.parquet(f"{tmp_path}/notes").count() == 5 and spark.read.json(f"{tmp_path}/corrections").count() > 0
