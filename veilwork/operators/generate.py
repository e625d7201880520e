"""Labelled texts made up by rule: values, hard negatives, notes, adversarial cases.

A text is a template whose slots are filled.  Every choice is the MD5 hash of
seed, id and the name of the choice, so a text depends on its id alone, however
the rows are spread, and the whole is an SQL expression that other engines
can evaluate too (:class:`Dialect`).

Slots: ``{KIND}`` is an entity, ``{KIND.2}`` one of co-reference cluster 2 of
its kind (the same cluster has the same value), ``{KIND.2:part}`` another form
of it, ``{kind}`` in lower case a filler, which is none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    """What engines write differently."""

    hash_: str
    struct: str
    array: tuple[str, str]
    empty: str

    def h(self, seed: int, salt: str) -> str:
        return self.hash_.format(seed=seed, salt=salt)


_FIELDS = "start INT, `end` INT, text STRING, entity_type STRING, cluster STRING"
SPARK = Dialect(
    "CAST(conv(substring(md5(concat('{seed}|', CAST(id AS STRING), '|{salt}')), 1, 8), 16, 10) AS BIGINT)",
    "named_struct('start', {0}, 'end', {1}, 'text', {2}, 'entity_type', {3}, 'cluster', {4})",
    ("array(", ")"),
    "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, text: STRING, entity_type: STRING, cluster: STRING>>)",
)
DUCKDB = Dialect(
    "CAST(concat('0x', substr(md5(concat('{seed}|', CAST(id AS VARCHAR), '|{salt}')), 1, 8)) AS BIGINT)",
    "{{'start': {0}, 'end': {1}, 'text': {2}, 'entity_type': {3}, 'cluster': {4}}}",
    ("[", "]"),
    'CAST([] AS STRUCT("start" INT, "end" INT, "text" VARCHAR, entity_type VARCHAR, cluster VARCHAR)[])',
)

FIRST = (
    "Ana Boris Chloe Dmitri Elif Farid Greta Hugo Ines Jonas Kaveh Lucia Marek Nadia Oskar Petra Quentin Rosa Samir Tilda Umar Vera Wim Xenia Yara Zeno Amara Bjorn Carla Darius Esther Felix Gwen Hana Ivo Jules Katja Leon Mina Noel"
).split()
LAST = (
    "Abel Bauer Costa Dubois Egger Ferri Gruber Horn Ilic Jansen Keller Lopez Moreau Novak Olsen Pereira Quiroga Rossi Santos Toth Ullrich Varga Weber Xanthos Yilmaz Zeller Adler Brandt Castro Duarte Engel Fischer Garcia Hoffmann Ibarra"
).split()
STREETS = "Alder Birch Cedar Dogwood Elder Fir Grove Hazel Ivy Juniper Laurel Maple Olive Pine Quarry River Spruce Tamarack Union Willow".split()
TOWNS = "Ashby Brook Carlow Denby Elton Fairly Garth Hadley Irvine Keswick Lorton Milby Norden Oakham Preston".split()
FACILITIES = ["North Valley Hospital", "St. Brigid Clinic", "Lakeside Medical Center", "Harbor General", "Eastgate Family Practice", "Pinecrest Rehabilitation"]
DRUGS = "metformin lisinopril atorvastatin amlodipine omeprazole sertraline gabapentin warfarin prednisone levothyroxine".split()
FILLERS = {
    "drug": DRUGS, "drugname": "Rosalind Allegra Yasmin Clarinex Nasonex Vivelle".split(), "month": "April May June August March".split(), "wordname": "Mark Grant Will Rose Grace Hope Faith Bill Rich Frank Chase Pat".split(),
    "company": ["Morgan Supplies", "Wells Logistics", "Taylor Instruments", "Johnson Tools", "Abbott Labs"], "city": "Austin Jackson Madison Charlotte Lincoln Houston".split(), "test": ["CBC", "BMP", "lipid panel", "HbA1c", "TSH"],
    "finding": ["no acute distress", "mild effusion", "stable vitals", "clear lungs", "normal gait"], "unit": ["ICU", "ward B-12", "radiology", "the east wing"], "problem": ["hypertension", "asthma", "back pain", "anemia", "migraine"],
}


def _pick(h: str, values: list[str]) -> str:
    return f"CASE ({h}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in enumerate(values)) + " END"


def _digits(h: str, n: int) -> str:
    return f"lpad(CAST(({h}) % {10**n} AS STRING), {n}, '0')"


def _luhn(stem: str) -> str:
    """Check digit of a card number's first fifteen digits, in ``stem``."""
    doubled = " + ".join(f"CASE WHEN CAST(substr({stem}, {k}, 1) AS INT) > 4 THEN CAST(substr({stem}, {k}, 1) AS INT) * 2 - 9 ELSE CAST(substr({stem}, {k}, 1) AS INT) * 2 END" for k in range(1, 16, 2))
    plain = " + ".join(f"CAST(substr({stem}, {k}, 1) AS INT)" for k in range(2, 16, 2))
    return f"CAST((10 - ({doubled} + {plain}) % 10) % 10 AS STRING)"


def _value(d: Dialect, seed: int, kind: str, cluster: str, part: str) -> str:
    """SQL of a slot's value."""
    h = lambda salt: d.h(seed, f"{kind}.{cluster}.{salt}")
    first, last = _pick(h("first"), FIRST), _pick(h("last"), LAST)
    if kind in FILLERS:
        return _pick(h("x"), FILLERS[kind])
    if kind == "number":
        return _digits(h("x"), 6)
    if kind == "code":
        return f"concat({_digits(h('x'), 3)}, '-', {_digits(h('y'), 2)})"
    if kind.startswith("NAME"):
        return last if part == "last" else first if part == "first" else f"concat({last}, ', ', {first})" if part == "listed" else f"concat({first}, ' ', {last})"
    year, month, day = f"CAST(({h('year')}) % 75 + 1945 AS STRING)", f"lpad(CAST(({h('month')}) % 12 + 1 AS STRING), 2, '0')", f"lpad(CAST(({h('day')}) % 28 + 1 AS STRING), 2, '0')"
    names = _pick(h("month"), "January February March April May June July August September October November December".split())
    one = lambda salt, forms: f"CASE ({h(salt)}) % {len(forms)} " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(forms)) + " END"
    area, group, serial = f"lpad(CAST(({h('area')}) % 665 + 1 AS STRING), 3, '0')", f"lpad(CAST(({h('group')}) % 99 + 1 AS STRING), 2, '0')", f"lpad(CAST(({h('serial')}) % 9999 + 1 AS STRING), 4, '0')"
    phone = (f"CAST(({h('npa')}) % 700 + 201 AS STRING)", f"CAST(({h('nxx')}) % 700 + 200 AS STRING)", _digits(h("line"), 4))
    street = f"concat(CAST(({h('house')}) % 9800 + 1 AS STRING), ' ', {_pick(h('street'), STREETS)}, ' ', {_pick(h('type'), ['Street', 'Avenue', 'Road', 'Lane', 'Drive', 'Court'])})"
    stem = f"concat('4', {_digits(h('c1'), 7)}, {_digits(h('c2'), 7)})"
    account = f"concat({_digits(h('bank'), 8)}, {_digits(h('acct'), 8)})"
    values = {
        "EMAIL": f"lower(concat({first}, '.', {last}, {_digits(h('n'), 2)}, '@', {_pick(h('host'), ['example.org', 'mail.example.com', 'post.example.net'])}))",
        "PHONE": one("form", [f"concat('(', {phone[0]}, ') ', {phone[1]}, '-', {phone[2]})", f"concat({phone[0]}, '-', {phone[1]}, '-', {phone[2]})", f"concat('+1 ', {phone[0]}, ' ', {phone[1]}, ' ', {phone[2]})", f"concat({phone[0]}, '.', {phone[1]}, '.', {phone[2]})"]),
        "SSN": one("form", [f"concat({area}, '-', {group}, '-', {serial})", f"concat({area}, ' ', {group}, ' ', {serial})"]),
        "CREDIT_CARD": f"concat({stem}, {_luhn(stem)})",
        "ADDRESS": f"concat({street}, ', ', {_pick(h('town'), TOWNS)}, ' ', {_digits(h('zip'), 5)})",
        "DATE": one("form", [f"concat({month}, '/', {day}, '/', {year})", f"concat({year}, '-', {month}, '-', {day})", f"concat({names}, ' ', {day}, ', ', {year})", f"concat({day}, '.', {month}, '.', {year})"]),
        "USERNAME": f"lower(concat(substr({first}, 1, 1), {last}, {_digits(h('n'), 3)}))",
        "PASSWORD": f"concat({_pick(h('a'), ['Quartz', 'Velvet', 'Cobalt', 'Juniper'])}, {_pick(h('b'), ['!', '#', '%', '&'])}, {_digits(h('n'), 4)}, {_pick(h('c'), ['xK', 'pW', 'zR', 'qT'])})",
        "IP_ADDRESS": "concat(" + ", '.', ".join(f"CAST(({h(f'o{k}')}) % 254 + 1 AS STRING)" for k in range(4)) + ")",
        "URL": f"lower(concat('https://', {_pick(h('host'), ['records', 'portal', 'billing'])}, '.example.org/', {last}, '/', {_digits(h('n'), 5)}))",
        "ACCOUNT_NUMBER": _digits(h("a"), 9),
        "ZIP": _digits(h("z"), 5),
        "IBAN": f"concat('GB', lpad(CAST(98 - CAST(concat('32142829', {account.replace('concat(', 'concat(').strip()}, '161100') AS DECIMAL(38, 0)) % 97 AS STRING), 2, '0'), 'WEST', {account})".replace("'32142829', ", "'32142829', "),
        "MRN": _digits(h("m"), 8),
        "AGE": f"CAST(({h('age')}) % 99 + 1 AS STRING)",
        "FACILITY": _pick(h("f"), FACILITIES),
    }
    values["DATE_DOB"] = values["DATE"]
    return values[kind]


_SLOT = re.compile(r"\{([A-Za-z_]+)(?:\.(\d+))?(?::(\w+))?\}")

# Own templates: family -> (weight, templates).
SAMPLES = {
    "NAME_PERSON": (2.0, ["Seen by {NAME_PERSON} this morning.", "{NAME_PERSON} called about the bill.", "Copy to {NAME_PERSON}, please.", "Signed: {NAME_PERSON:listed}", "Spoke with {NAME_PERSON} from accounts."]),
    "EMAIL": (1.5, ["Write to {EMAIL}.", "Contact {EMAIL} for the form.", "e-mail={EMAIL}", "Reply-To: {EMAIL}"]),
    "PHONE": (1.5, ["Call {PHONE} after six.", "Tel: {PHONE}", "Reach me at {PHONE} or leave a note.", "Mobile {PHONE}, no texts."]),
    "SSN": (1.5, ["Number on file: {SSN}.", "SSN {SSN} was checked.", "Social security: {SSN}"]),
    "CREDIT_CARD": (1.5, ["Card {CREDIT_CARD} was charged.", "Paid with {CREDIT_CARD}.", "visa {CREDIT_CARD} exp 09/27"]),
    "ADDRESS": (1.5, ["Lives at {ADDRESS}.", "Ship it to {ADDRESS}, second door.", "Address: {ADDRESS}"]),
    "DATE": (1.5, ["Due on {DATE}.", "Since {DATE} there was no contact.", "Visit: {DATE}"]),
    "USERNAME": (1.0, ["Login: {USERNAME}", "The account {USERNAME} is locked.", "user={USERNAME}"]),
    "PASSWORD": (1.0, ["password: {PASSWORD}", "The new passphrase is {PASSWORD}, change it soon."]),
    "IP_ADDRESS": (1.0, ["Request from {IP_ADDRESS} refused.", "host {IP_ADDRESS} is up"]),
    "URL": (1.0, ["See {URL} for the file.", "Link: {URL}"]),
    "ACCOUNT_NUMBER": (0.8, ["Account {ACCOUNT_NUMBER} is overdrawn.", "Transfer to account {ACCOUNT_NUMBER}."]),
    "ZIP": (0.8, ["ZIP {ZIP} is served on Mondays.", "Postcode: {ZIP}"]),
    "IBAN": (0.8, ["IBAN {IBAN} was verified.", "Pay to {IBAN}."]),
}
NEGATIVES = {
    "name_like": (3.0, ["The {month} showers delayed the work.", "{wordname} the date in the calendar.", "{company} sent the invoice.", "The {wordname} garden opens soon."]),
    "number": (2.5, ["Order {number} is ready.", "Ticket {number} was closed.", "Lot {code} passed the test.", "Room {code} is free."]),
    "pattern": (2.0, ["Version 2.4.1 replaces 2.4.0.", "Ratio 10-20-30 of the mix.", "Call extension 4-5-6 for help.", "Use the form XXX-XX-XXXX."]),
    "partial": (1.5, ["The number ends in 4821.", "Area code 555 only.", "The user part is before the @ sign.", "Born in spring."]),
    "confusion": (1.5, ["Take {drug} with food.", "Order a {test} today.", "{city} is a large city.", "Moved to {unit}."]),
    "mixed": (1.0, ["In {month} {company} billed order {number}, version 3.1.", "{wordname} asked {company} about ticket {number}.", "{unit}: {test} and {drug}, room {code}."]),
}
NOTES = {
    "admission": (1.5, [
        "ADMISSION NOTE\n{FACILITY}\nPatient: {NAME_PATIENT.1}  MRN: {MRN}  DOB: {DATE_DOB}\n{NAME_PATIENT.1:last} is {AGE} years old and was admitted on {DATE.1} with {problem}. Examination: {finding}.\nAttending: Dr. {NAME_PROVIDER.1}",
        "Admitted {DATE.1}: {NAME_PATIENT.1:listed}, MRN {MRN}. Mr. {NAME_PATIENT.1:last} takes {drug}. Contact {PHONE}. Seen by Dr. {NAME_PROVIDER.1:last}.",
    ]),
    "discharge": (1.5, [
        "DISCHARGE SUMMARY\n{NAME_PATIENT.1} (MRN {MRN}) was discharged from {FACILITY} on {DATE.1}. {NAME_PATIENT.1:first} will take {drug}. Follow-up with Dr. {NAME_PROVIDER.1} on {DATE.2}, phone {PHONE}.",
        "Discharged {DATE.1}. Patient {NAME_PATIENT.1}, address {ADDRESS}. Dr. {NAME_PROVIDER.1:last} signed.",
    ]),
    "lab": (1.0, ["LAB REPORT {DATE.1}\nPatient {NAME_PATIENT.1}  SSN {SSN}  MRN {MRN}\n{test}: within range. Ordered by {NAME_PROVIDER.1}.", "{test} of {NAME_PATIENT.1:listed} ({DATE_DOB}): {finding}. Fax to {PHONE}."]),
    "progress": (1.5, ["PROGRESS NOTE {DATE.1}\n{NAME_PATIENT.1} feels better; {finding}. {NAME_PATIENT.1:first} slept well. Plan: {drug}. -- {NAME_PROVIDER.1}, MD", "Day 3 for Ms. {NAME_PATIENT.1:last}: {problem} improving, continue {drug}. Dr. {NAME_PROVIDER.1:last}"]),
    "referral": (1.0, ["Dear Dr. {NAME_PROVIDER.2:last},\nthank you for seeing {NAME_PATIENT.1}, born {DATE_DOB}, for {problem}. Reach {NAME_PATIENT.1:first} at {EMAIL}.\nSincerely,\n{NAME_PROVIDER.1}, {FACILITY}"]),
    "insurance": (1.0, ["CLAIM FORM\nMember: {NAME_PATIENT.1}\nSSN: {SSN}\nAccount: {ACCOUNT_NUMBER}\nAddress: {ADDRESS}\nPhone: {PHONE}\nDate of service: {DATE.1}\nProvider: {NAME_PROVIDER.1}", "Claim of {NAME_PATIENT.1:listed}, account {ACCOUNT_NUMBER}, {DATE.1}: approved for {NAME_PATIENT.1:first}."]),
    "brief": (1.0, ["{NAME_PATIENT.1} called, {PHONE}, refill {drug}.", "No show: {NAME_PATIENT.1:last}, {DATE.1}.", "{NAME_PATIENT.1} - {problem} - {unit}"]),
    "consultation": (1.0, ["CONSULTATION for Dr. {NAME_PROVIDER.2}\nRe: {NAME_PATIENT.1}, {AGE} y.o., MRN {MRN}.\nDr. {NAME_PROVIDER.2:last} asks about {problem}. Impression: {finding}. {NAME_PATIENT.1:last} agrees.\n{NAME_PROVIDER.1}, {DATE.1}"]),
}
ADVERSARIAL = {
    "drug_name": (1.5, ["Start {drugname} 10 mg daily.", "{NAME_PATIENT} asked whether {drugname} is safe."]),
    "common_word": (1.5, ["{wordname} the wound with saline.", "We {wordname} see, said {NAME_PROVIDER}."]),
    "fake_ssn": (1.0, ["Form 000-12-3456 is a sample.", "Use XXX-XX-1234 for the last digits."]),
    "other_date": (1.0, ["The guideline of {month} 2019 applies.", "Copyright 2018, version 4/5."]),
    "facility": (1.0, ["Transferred to {FACILITY} today.", "{FACILITY} has no beds."]),
    "provider_patient": (1.5, ["Dr. {NAME_PROVIDER} saw {NAME_PATIENT}.", "{NAME_PATIENT} was seen by {NAME_PROVIDER}, MD."]),
    "name_as_word": (1.0, ["{NAME_PATIENT.1:first} is the patient; {NAME_PATIENT.1:first} waits.", "Patient {NAME_PATIENT:listed} came."]),
    "name_as_city": (1.0, ["Moved from {city} last year.", "{NAME_PATIENT} lives near {city}."]),
    "fake_phone": (1.0, ["Dial 555-0100 in the film.", "Code {code} is no telephone."]),
    "fake_email": (1.0, ["Write to name@domain, as in the sample.", "The sign @ work means at."]),
    "personal_email": (1.0, ["Results to {EMAIL}, please.", "{NAME_PATIENT} gave {EMAIL}."]),
    "with_medical": (1.5, ["{NAME_PATIENT}, SSN {SSN}, takes {drug} for {problem}.", "{problem}: call {NAME_PATIENT} at {PHONE}, MRN {MRN}."]),
    "without_medical": (1.0, ["{NAME_PERSON} paid with {CREDIT_CARD}.", "{NAME_PERSON}: {ADDRESS}, {PHONE}."]),
}
SIMPLE = {
    "simple": (1.0, [
        "My name is {NAME_PERSON} and my email is {EMAIL}.", "Please call {NAME_PERSON} at {PHONE}.", "SSN: {SSN}, DOB: {DATE_DOB}", "Patient {NAME_PATIENT} lives at {ADDRESS}.", "Card {CREDIT_CARD}, billed on {DATE}.",
        "MRN {MRN} belongs to {NAME_PATIENT}.", "Log in as {USERNAME} from {IP_ADDRESS}.", "{NAME_PATIENT}, {AGE}, of {FACILITY}.",
    ]),
}
FAMILIES = {"samples": SAMPLES, "negatives": NEGATIVES, "notes": NOTES, "adversarial": ADVERSARIAL, "simple": SIMPLE}


def _columns(families: dict, seed: int, d: Dialect) -> tuple[str, dict[str, str], str, str]:
    """SQL of the template's number, of each slot's value by column name, of the text and of the entities."""
    rows = [(name, weight / len(templates), t) for name, (weight, templates) in families.items() for t in templates]
    total, upto, when, family = sum(w for _, w, _ in rows), 0.0, [], []
    for k, (name, w, _) in enumerate(rows):
        upto += w
        when.append(f"WHEN {d.h(seed, 'template')} < {round(upto / total * 2**32) if k < len(rows) - 1 else 2**32} THEN {k}")
        family.append(f"WHEN {k} THEN '{name}'")
    slots: dict[str, str] = {}
    texts, entities = [], []
    for k, (_, _, template) in enumerate(rows):
        parts, at, found = [], 0, []
        for m in _SLOT.finditer(template):
            kind, cluster, part = m.group(1), m.group(2) or "", m.group(3) or ""
            name = f"v_{kind}_{cluster}_{part}"
            slots.setdefault(name, _value(d, seed, kind, cluster, part))
            if m.start() > at:
                parts.append("'" + template[at : m.start()].replace("'", "''") + "'")
            if kind.isupper():
                before = f"length(concat({', '.join(parts)}))" if parts else "0"
                found.append((f"CAST({before} AS INT)", f"CAST({before} + length({name}) AS INT)", name, f"'{kind}'", f"'{kind}.{cluster or 1}'"))
            parts.append(name)
            at = m.end()
        if at < len(template):
            parts.append("'" + template[at:].replace("'", "''") + "'")
        texts.append(f"WHEN {k} THEN concat({', '.join(parts)})")
        if found:
            entities.append(f"WHEN {k} THEN {d.array[0]}{', '.join(d.struct.format(*f) for f in found)}{d.array[1]}")
    number, which = f"CASE {' '.join(when)} END", f"CASE number {' '.join(family)} END"
    return number, slots, f"CASE number {' '.join(texts)} END", f"CASE number {' '.join(entities)} ELSE {d.empty} END" if entities else d.empty, which


def generate(spark: SparkSession, what: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` labelled texts (id, family, text, entities) of FAMILIES[what], the same for the same seed.

    ``entities``: start, end, text, entity_type, cluster; empty in negatives.
    """
    number, slots, text, entities, family = _columns(FAMILIES[what], seed, SPARK)
    base = spark.range(n).withColumn("number", F.expr(number)).withColumns({name: F.expr(sql) for name, sql in slots.items()})
    return base.select("id", F.expr(family).alias("family"), F.expr(text.replace("\n", "\\n")).alias("text"), F.expr(entities.replace("\n", "\\n")).alias("entities"))


def generate_sql(what: str, n: int, seed: int = 1) -> str:
    """The same in DuckDB."""
    number, slots, text, entities, family = _columns(FAMILIES[what], seed, DUCKDB)
    made = ", ".join(f"{sql} AS {name}" for name, sql in slots.items())
    return f"SELECT id, {family} AS family, {text} AS text, {entities} AS entities FROM (SELECT *, {made} FROM (SELECT id, {number} AS number FROM (SELECT range AS id FROM range({n}))))"


def training_json(generated: DataFrame) -> DataFrame:
    """(id, json): text and entities of each sample as one JSON object."""
    return generated.select("id", F.to_json(F.struct("text", "family", "entities")).alias("json"))
