"""Rules against Python's own matching, validators, detection without overlaps, filters."""

import math
import re

import pytest
from pyspark.sql import functions as F

from veilwork.catalog.rules import CHECKSUM_RULES, RULES, Rule
from veilwork.functions import validators as V
from veilwork.functions.spans import extract
from veilwork.operators import detect as D
from veilwork.operators import suppress as S

# one text per rule on which it fires
POSITIVE = {
    "ssn_dashed": "ID 123-45-6789 on file", "ssn_spaced": "ID 123 45 6789 on file", "ssn_labeled": "Social Security: 123456789", "ein": "Employer 12-3456789", "itin": "Payer 912-70-1234", "uk_nino": "NI AB123456C ok",
    "canada_sin": "SIN 046 454 286", "passport_labeled": "Passport: AB1234567", "passport_us": "Doc C12345678 seen", "drivers_license_labeled": "Driver's License: D1234567", "cc_visa": "Card 4111 1111 1111 1111",
    "cc_mastercard": "Card 5500-0000-0000-0004", "cc_amex": "Card 3782 822463 10005", "cc_discover": "Card 6011111111111117", "cc_generic": "Pay 4111111111111111 now", "credit_card_cvv": "CVV: 123",
    "cc_context": "credit: 1234567890123", "iban": "To GB82WEST12345698765432 today", "swift_bic": "SWIFT: DEUTDEFF500", "routing_number_labeled": "routing: 021000021", "account_labeled": "Account: 12345678",
    "alphanumeric_account_id": "Ref K7654321Z seen", "reference_number_labeled": "Reference: ABC12345", "bitcoin_address": "Send 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "bitcoin_bech32": "Send bc1qar0srrr7xfkvy5L643Lydnw9re59gtzzwf5mdq",
    "ethereum_address": "Send 0x52908400098527886E0F7030069857D2E4169EE7", "phone_us": "Call (555) 123-4567 today", "phone_intl": "Call +44 20 7946 0958", "phone_labeled": "Tel: 555-123-4567", "fax_labeled": "Fax: 555-123-4567",
    "email": "Mail jane.doe+x@example.com now", "ipv4": "Host 192.168.1.100 up", "ipv6": "Host 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ipv6_abbrev": "Host 2001:db8::1 up", "mac_address_colon": "MAC 00:1A:2B:3C:4D:5E",
    "mac_address_dash": "MAC 00-1A-2B-3C-4D-5E", "url": "See https://example.com/a?b=1 now", "username_labeled": "username: jdoe_99", "handle_labeled": "handle: @jdoe99", "social_handle": "ping @jdoe99", "username_dot": "by Martin.Bravo today",
    "username_underscore": "by Lena_Ortiz today", "vin": "Car 1HGCM82633A004352 sold", "vin_labeled": "VIN: 1HGCM82633A004352", "imei": "Dev 490154203237518 on", "imei_labeled": "IMEI: 490154203237518", "serial_number": "Serial: SN12345678",
    "license_plate_us": "Plate ABC-1234 seen", "license_plate_labeled": "plate number: ABC1234", "mrn_labeled": "MRN: 12345678", "dea_number": "DEA: AB1234563", "npi_labeled": "NPI: 1234567893", "npi_unlabeled": "Prov 1234567893 seen",
    "health_plan_id": "Member ID: ABC123456", "date_mdy_slash": "On 03/15/1985 seen", "date_mdy_dash": "On 3-15-85 seen", "date_iso": "On 2024-01-15 seen", "date_written": "On January 15th, 2024 seen", "date_european": "On 15.01.2024 seen",
    "dob_labeled": "DOB: 03/15/1985", "age_years_old": "a 92 years old man", "age_labeled": "age: 92", "age_month_old": "a 6 months old boy", "zip_code_plus4": "NY 10001-1234", "zip_code_5": "CA 94110 ok", "uk_postcode": "at SW1A 1AA ok",
    "canada_postal": "at K1A 0B1 ok", "gps_coordinates": "at 40.7128, -74.0060 ok", "street_name": "near Center Street today", "street_address_numbered": "at 123 Main Street today", "password_labeled": "password: Hunter2!", "pin_labeled": "PIN: 4821",
    "litecoin_address": "Send LVg2kJoFNg45Nbpy53h7Fe1wKyeXVRhMH9", "litecoin_address_bech32": "Send ltc1qw508d6qejxtdg4y5r3zarvary0c5xw7kgmn4n9", "crypto_labeled": "bitcoin address: 1BoatSLRHtKNngkdXEeobR76b53LETtpyT",
    "user_agent_mozilla": "UA is Mozilla/5.0 (X11; Linux) AppleWebKit/537.36 Chrome/1", "user_agent_labeled": "User-Agent: curl/8.0\nnext", "imei_hyphenated": "Dev 12-345678-901234-5 on", "name_with_salutation": "Saw Dr. Jane Smith today",
    "name_after_label": "My name is John Smith", "patient_name_labeled": "Patient: John Smith", "dear_name": "Dear Alice",
}


def test_every_rule_gives_pythons_spans(spark):
    texts = []
    for name, t in POSITIVE.items():
        texts += [(f"{name}/a", t), (f"{name}/b", f"é {t} 😀 {t}")]
    texts += [("none", None), ("empty", ""), ("blank", " \n")]
    df = spark.createDataFrame(texts, "key string, body string").withColumn("id", F.lit("x"))
    got = {}
    for r in extract(df, "key", "body", RULES).collect():
        got.setdefault((r["id"], RULES[r["k"]].name), []).append((r["start"], r["end"], r["text"]))
    for key, t in texts:
        for rule in RULES:
            want = [(m.start(1), m.end(1), m.group(1)) if rule.group else (m.start(), m.end(), m.group()) for m in re.finditer(rule.pattern, t or "", re.I if rule.ignore_case else 0)]
            assert sorted(got.get((key, rule.name), [])) == sorted(want), (key, rule.name)
    for name in POSITIVE:
        assert (f"{name}/a", name) in got and (f"{name}/b", name) in got


@pytest.mark.parametrize(
    "check,good,bad",
    [
        ("luhn", "4111-1111-1111-1111", "4111 1111 1111 1112"),
        ("card", "378282246310005", "411111111111"),
        ("ssn", "123-45-6789", "666-45-6789"),
        ("ssn", "899 01 0001", "900-45-6789"),
        ("ssn", "001-01-0001", "123-00-6789"),
        ("dea", "DEA: AB1234563", "AB1234567"),
        ("npi", "1234567893", "3234567893"),
        ("sin", "046 454 286", "046 454 287"),
        ("iban", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433"),
        ("zip", "94110-1234", "21301"),
    ],
)
def test_validators(spark, check, good, bad):
    df = spark.createDataFrame([(good,), (bad,), ("",)], "c string").select(F.coalesce(V.CHECKS[check](F.col("c")), F.lit(False)))
    assert [r[0] for r in df.collect()] == [True, False, False]


def test_strict_provider_number_digit_and_entropy(spark):
    df = spark.createDataFrame([("1234567893",), ("123-456-7893",), ("aab",)], "c string")
    assert [r[0] for r in df.select(V.npi_strict(F.col("c"))).collect()] == [True, False, False]
    bits = df.select(V.entropy(F.col("c"))).collect()[2][0]
    assert bits == pytest.approx(-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))
    assert spark.createDataFrame([("411111111111111",)], "c string").select(V.luhn_digit(F.col("c"))).first()[0] == "1"


def test_detection_keeps_overlaps_and_checks(spark):
    df = spark.createDataFrame([(1, "Card 4111 1111 1111 1111 and 123-00-6789"), (2, None)], "id long, t string")
    got = {(r["rule"], r["start"], r["end"]) for r in D.detect(df, "id", "t").collect()}
    assert {("cc_visa", 5, 24), ("cc_generic", 5, 24)} <= got and not any(r == "ssn_dashed" for r, _, _ in got)


def fold(hits):
    kept = []
    for h in sorted(hits, key=lambda h: (h[0], -h[2], h[1], h[3])):
        if not kept or h[0] >= kept[-1][1]:
            kept.append(h)
        elif h[2] > kept[-1][2]:
            kept[-1] = h
    return kept


def test_checksum_detection_folds_overlaps(spark):
    t = "card 4111111111111111, SSN: 123-45-6789; NPI 1234567893, AB1234563 and IBAN GB82 WEST 1234 5698 7654 32"
    df = spark.createDataFrame([(1, t), (2, t)], "id long, t string")
    hits = [(r["start"], r["end"], r["confidence"], r["rule"]) for r in D.detect(df.where("id = 1"), "id", "t", D.Catalog(CHECKSUM_RULES)).collect()]
    got = D.detect_checksums(df, "id", "t").where("id = 1").orderBy("start").collect()
    assert [(r["start"], r["end"], r["confidence"]) for r in got] == [h[:3] for h in fold(hits)] and len(got) >= 4


def test_secrets(spark):
    df = spark.createDataFrame([(1, "use xK9$mQ2#vL to login"), (2, "password: xK9$mQ2#vLp"), (3, "test value xK9$mQ2#vLp"), (4, "by Martin.Bravo today"), (5, None)], "id long, t string")
    got = {r["id"]: (r["text"], r["confidence"]) for r in D.detect_secrets(df, "id", "t").collect()}
    assert set(got) == {1} and got[1][1] == 0.9


def test_catalog_is_data(spark, tmp_path):
    c = D.Catalog([])
    c.add_pattern("badge", r"\bB-\d{4}\b", "OTHER", 0.7, check=lambda x: ~x.endswith("0"))
    with pytest.raises(ValueError):
        c.add(Rule("badge", "OTHER", 0.1, "x"))
    df = spark.createDataFrame([(1, "B-1234 B-1230")], "id long, t string")
    assert [r["text"] for r in D.detect(df, "id", "t", c).collect()] == ["B-1234"]
    d = D.Catalog()
    d.save(str(tmp_path / "r.json"))
    assert D.Catalog.load(str(tmp_path / "r.json")).rules == d.rules
    assert d.remove("email") and d.get("email") is None and d.get("url").entity_type == "URL"
    assert d.table(spark).count() == 81
    assert d.try_pattern(spark, r"a+", "baab") == [("aa", 1, 3)]


def test_filters(spark):
    one = lambda *cols: spark.range(1).select(*cols).first()
    assert list(one(*(S.is_allowed(F.lit(x)) for x in (" Today ", "Dr. Pepper", "ICU", "N/A", "Smith")))) == [True, True, True, True, False]
    ctx = lambda kind, c: S.context_excluded(F.lit(kind), F.lit(c))
    assert list(one(ctx("DATE", "was published on "), ctx("PHONE", "Room # "), ctx("ACCOUNT_NUMBER", "Order #: "), ctx("MRN", "ICD-10 code "), ctx("DATE", "born "), ctx("EMAIL", "order #"))) == [True, True, True, True, False, False]
    why = lambda t, k, c=None: S.exclusion_reason(F.lit(t), F.lit(k), F.lit(c) if c else None)
    got = list(one(why("Mozilla/5.0", "NAME_PERSON"), why("Hello", "EMAIL"), why("the patient", "NAME_PERSON"), why("537.36", "MRN"), why("Edgar", "NAME_PERSON"), why("Smith", "NAME_PERSON"), why("wow64", "OTHER", "User-Agent: x wow64")))
    assert got == ["user_agent_mozilla", "exact", "medical_role_generic", "user_agent_version_string", "user_agent_edge", None, "user_agent_context"]
    assert list(one(*(S.term_reason(F.lit(x)) for x in ("", "abc", "Patient", "123456", "[name]", "aspirin")))) == ["empty", "too_short", "blocklisted", "garbage_pattern", "starts_with_non_letter", None]


def test_position_repair_and_validity(spark):
    df = spark.createDataFrame(
        [("a", "d", 0, 4, "Jane"), ("b", "d", 5, 10, "Smith"), ("c", "d", 3, 8, "Smith"), ("e", "d", 0, 99, "x"), ("f", "d", 0, 4, "Absent"), ("g", "d", 4, 10, "Smith")], "span_id string, doc string, start int, end int, text string"
    ).withColumn("doc_text", F.lit("Jane Smith here"))
    got = {r["span_id"]: (r["start"], r["end"], r["text"], r["repair"]) for r in S.repair_positions(df).collect()}
    assert got == {"a": (0, 4, "Jane", "exact"), "b": (5, 10, "Smith", "exact"), "c": (5, 10, "Smith", "moved"), "g": (4, 10, " Smith", "blanks")}
    bad = {r["span_id"]: (r["in_bounds"], r["text_agrees"]) for r in S.span_problems(df).collect()}
    assert bad["a"] == (True, True) and bad["e"] == (False, False) and bad["c"] == (True, False)
    covered = S.drop_covered(df.where("span_id in ('b', 'a')"), df.where("span_id = 'c'"))
    assert covered.count() == 0


def test_rule_suggestions(spark):
    df = spark.createDataFrame([("rejected", "Ward A"), ("rejected", "ward a "), ("rejected", "once"), ("confirmed", "x"), ("rejected", None)], "decision string, entity_text string")
    assert [tuple(r) for r in D.suggest_rules(df).collect()] == [("ward a", 2, r"\bward a\b")]


def test_messages_get_every_rule(spark, tmp_path):
    from veilwork.plans.registry import queries

    text = "Card 4111 1111 1111 1111, see https://example.org/a or mail dana@example.org"
    spark.createDataFrame([("m1", text), ("m2", None)], "id string, content string").write.parquet(f"{tmp_path}/messages.parquet")
    got = queries()["detect_messages"](spark, str(tmp_path)).collect()
    assert {"https://example.org/a", "dana@example.org"} <= {r["text"] for r in got} and any(r["text"].startswith("4111") for r in got)
    assert sorted(queries()["streamed_spans"](spark, str(tmp_path)).drop("has_checksum").collect()) == sorted(got)
