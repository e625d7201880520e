"""Operators for training data, against brute force and on small tables with every kind of dirt."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import consensus, encoding, packing, pii, queries, ranking, rolling, shared_spans, splits
from veilwork.llm.components import components
from veilwork.llm.near_duplicates import NearDuplicates
from veilwork.llm.shared_spans import SharedSpans
from veilwork.runtime import table

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- personal information ----
NAMES = [(x, "GIVEN_NAME") for x in ("Dana", "Nils", "Ingrid", "Mark")] + [(x, "SURNAME") for x in ("Okoro", "Lindgren", "Marsh")] + [("Bexley", "TOWN")]


@pytest.fixture(scope="module")
def sanitiser(spark):
    frames = [f"{t} {g} {s} came in." for t in ("Dr.", "Mrs", "Nurse") for g in ("Dana", "Nils", "Ingrid", "Mark", "Velma") for s in ("Okoro", "Lindgren", "Marsh", "Tavish")] * 4
    frames += ["please mark the left knee again on Monday. Form Seven of the Clinic was sent to Radiology."] * 90 + ["Lives at 4 Elm Road, Bexley 12345, reached at noon."] * 3
    texts = spark.createDataFrame([(t,) for t in frames], "t string")
    names = spark.createDataFrame(NAMES, "term string, category string")
    return pii.Sanitiser(pii.Disclosure(texts, "t", names, support=2))


def found(spark, sanitiser, *texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "i long, t string, id string")
    out = collections.defaultdict(list)
    for i, s, e, k in rows(sanitiser.found(df, "i", "t")):
        out[i].append((texts[i][s:e], k))
    return [sorted(out[k], key=lambda x: texts[k].index(x[0])) for k in range(len(texts))]


def test_pii_structured_kinds(spark, sanitiser):
    texts = [
        "mail dana.o+x@mail.example.org. or dana (at) host (dot) example",
        "call (312) 555-0188 ext. 12, +44 7700 900123 or 01 99 00 12 70; five five five zero one two three",
        "SSN 123-45-6789, ticket 123-45-6780; Passport AB1234567; MRN: 00412345; 2 84 10 43 954 225 26",
        "moved to Flat 2, 12 Elm Road, Bexley 12345. Then 12 rue des Lilas, 75001 Paris; Lindenweg 5a, 10115 Berlin",
        "[NAME_1] and [PHONE_2] stay 🙂 x@y",
    ]
    got = found(spark, sanitiser, *texts)
    assert got[0] == [("dana.o+x@mail.example.org", "EMAIL"), ("dana (at) host (dot) example", "EMAIL")]
    assert [x for x, k in got[1]] == ["(312) 555-0188 ext. 12", "+44 7700 900123", "01 99 00 12 70", "five five five zero one two three"]
    assert got[2] == [("123-45-6789", "ID_NUMBER"), ("AB1234567", "ID_NUMBER"), ("00412345", "ID_NUMBER"), ("2 84 10 43 954 225 26", "ID_NUMBER")]
    assert [x for x, k in got[3]] == ["Flat 2, 12 Elm Road, Bexley 12345", "12 rue des Lilas, 75001 Paris", "Lindenweg 5a, 10115 Berlin"]
    assert got[4] == []


def test_pii_names_learned_from_the_corpus(spark, sanitiser):
    got = found(spark, sanitiser, "Dr. Velma Tavish's note, and Mark Okoro", "please mark the knee", "Tavish, Dana", "T. Lindgren-Okoro", "😀 é Velma")
    assert got[0] == [("Velma Tavish", "NAME"), ("Mark Okoro", "NAME")]
    assert got[1] == []
    assert got[2] == [("Tavish, Dana", "NAME")]
    assert got[3] == [("T. Lindgren-Okoro", "NAME")]
    assert got[4] == [("Velma", "NAME")]


def test_identity_numbers_are_learned_by_what_stands_before_them(spark):
    seen = [f"Kennwert: {100 + i}-45-6789 and Wert: 5551{i:03d}44" for i in range(40)] + [f"Wert: {100 + i}-45-6789" for i in range(3)]
    texts = spark.createDataFrame([(t,) for t in seen], "t string")
    d = pii.Disclosure(texts, "t", spark.createDataFrame([], "term string, category string"))
    for s in (pii.Sanitiser(d), pii.Sanitiser(d, broadcast_frames=0)):
        assert found(spark, s, "Kennwert: 55512344 here", "Wert: 55512344 here", "Kennwert: 12.05.2021") == [[("55512344", "ID_NUMBER")], [], []]


def test_pii_has_no_length_limits(spark, sanitiser):
    local, name = "ab." * 40 + "c", "Q" + "u" * 71
    texts = [
        f"mail {local}@mail.example.org now",
        f"12 {name} Street, Springfield 12345 is it",
        "at 12 Elm Street, Saint Bartholomew On The Very Long Water And Hills, Springfield, IL 62704 she",
        "calle de la Constitución Española Mayor 12, then",
        "Order\n415-555-2671 and Order no.\n415-555-2671",
        "12 Isle of the Very Long Name Road again",
        "five " * 20 + "five",
        "seen in 2019 he went down the long street",
    ]
    got = found(spark, sanitiser, *texts)
    want = [f"{local}@mail.example.org", f"12 {name} Street, Springfield 12345", texts[2][3:-4], texts[3][:-6], None, texts[5][:-6], texts[6], None]
    assert [[x for x, _ in g] for g in got] == [[w] if w else [] for w in want]


def test_pii_words_are_found_alike_in_short_and_long_texts(spark, sanitiser):
    short = "Velmaⅷ Velma Dana² Dana"
    one, two = found(spark, sanitiser, short, short + " x" * 2000)
    assert one == two == [("Velma", "NAME"), ("Dana", "NAME")]
    low = pii.lowered(short + " velma" + " x" * 2000)
    vocab = pii.vocabulary({"velma": ("G", False), "dana": ("G", False)})
    assert [(s, e) for s, e, _ in pii._places(low, vocab)] == [m.span() for m in pii._LETTERS.finditer(low) if m.group() in vocab]


def test_pii_edge_rows(spark, sanitiser):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "Dana Okoro"), (4, "Dana Okoro"), (5, "x " * 50_000 + "Dana Okoro")], "id long, start_idx string")
    assert sorted(rows(sanitiser.found(df, "id", "start_idx"))) == [(4, 0, 10, "NAME"), (5, 100_000, 100_010, "NAME")]
    red = sorted(rows(sanitiser.redacted(df, "id", "start_idx").where("id < 5")), key=str)
    assert red == [(1, None), (2, ""), (3, " \n "), (4, "[NAME]"), (4, "[NAME]")]
    assert rows(sanitiser.found(df.where("id > 9"), "id", "start_idx")) == []


def test_pii_joined_vocabulary_gives_the_same(spark, sanitiser):
    joined = pii.Sanitiser(sanitiser.disclosure, broadcast_terms=0)
    assert joined.joined
    df = spark.createDataFrame([(1, "Dr. Velma Tavish at 4 Elm Road\nBexley"), (2, None), (3, "nothing")], "id long, t string")
    assert sorted(rows(joined.found(df, "id", "t"))) == sorted(rows(sanitiser.found(df, "id", "t"))) != []


def test_pii_without_names(spark):
    empty = spark.createDataFrame([], "t string")
    s = pii.Sanitiser(pii.Disclosure(empty, "t", spark.createDataFrame([], "term string, category string")))
    df = spark.createDataFrame([(1, "Dana a@b.example")], "id long, t string")
    assert rows(s.found(df, "id", "t")) == [(1, 5, 16, "EMAIL")]


def test_rare_frames_count_in_a_large_corpus(spark):
    texts = [(f"Matron {g} came in.",) for g in ("Dana", "Nils")] * 10 + [("please mark the left knee again.",)] * 90 + [("Mark the left knee.",)] + [("Ward " * 25_000,)] * 100
    texts, names = spark.createDataFrame(texts, "t string"), spark.createDataFrame(NAMES, "term string, category string")
    d = pii.Disclosure(texts, "t", names)
    for s in (pii.Sanitiser(d), pii.Sanitiser(d, broadcast_frames=0), pii.Sanitiser(d, broadcast_terms=0, broadcast_frames=0)):
        assert found(spark, s, "Matron Mark came in.", "nothing") == [[("Mark", "NAME")], []]


# ---- near duplicates ----
def grams(t, k):
    w = [x for x in t.lower().replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return w


@pytest.mark.parametrize("k,threshold", [(3, 0.7), (5, 0.8)])
def test_near_duplicates_match_brute_force(spark, k, threshold):
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([6, 40, 120]))]
        docs += [" ".join(edited(rng, base, rng.choice([0, 1, 2, 4, 8]))) for _ in range(6)]
    docs += ["", None, " \n ", "one two", docs[0].upper(), docs[1].replace(" ", "\t\n"), docs[2]]
    ids = [f"d{n:03d}" for n in range(len(docs))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, docs)] + [(ids[0], docs[0], "y")], "key string, text string, id string")
    got = set(rows(NearDuplicates(df, "key", "text", threshold, k).pairs()))
    g = {i: grams(t, k) for i, t in zip(ids, docs) if t and grams(t, k)}
    want = {(a, b) for a, b in itertools.combinations(sorted(g), 2) if len(g[a] & g[b]) >= threshold * len(g[a] | g[b])}
    assert want and got == want
    par = {i: i for i in g}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        par[y] = x
    grouped = {r["id"]: r["group_id"] for r in NearDuplicates(df, "key", "text", threshold, k).groups().collect()}
    assert grouped == {i: find(i) if i in g else i for i in ids}


def test_near_duplicate_groups(spark):
    t = " ".join(WORDS * 3)
    df = spark.createDataFrame([("a", t), ("b", t), ("c", t + " end"), ("d", "quite another text that stands alone"), ("e", None)], "id string, text string")
    assert sorted(rows(NearDuplicates(df, "id", "text").groups())) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 1), ("e", "e", 1)]
    assert rows(NearDuplicates(df.where("id > 'x'"), "id", "text").pairs()) == []


def test_large_bucket_loses_no_pair(spark):
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(300)]
    docs = [" ".join(edited(rng, base, 3)) for _ in range(60)]
    df = spark.createDataFrame([(f"d{n:03d}", t) for n, t in enumerate(docs)], "id string, text string")
    g = [grams(t, 5) for t in docs]
    want = sum(len(a & b) >= 0.8 * len(a | b) for a, b in itertools.combinations(g, 2))
    assert NearDuplicates(df, "id", "text").pairs().count() == want > 1000


@pytest.mark.parametrize("size", [70, 80])
def test_leaves_far_from_their_centre_are_compared(spark, size):
    # all longer texts quote the pair; they have the smaller ids, so they are the centres of its buckets
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    short = [word() for _ in range(26)]
    docs = [" ".join([word() for _ in range(size - 24)] + short) for _ in range(120)]
    docs += [" ".join(short), " ".join([*short[:-1], "other"]), " ".join(["other", *short[1:]])]
    df = spark.createDataFrame([(f"d{n:03d}", t) for n, t in enumerate(docs)], "id string, text string")
    g = {n: grams(docs[n], 3) for n in (120, 121, 122)}
    want = {(f"d{a}", f"d{b}") for a, b in itertools.combinations(g, 2) if len(g[a] & g[b]) >= 0.7 * len(g[a] | g[b])}
    near = NearDuplicates(df, "id", "text", 0.7, 3, bands=8, width=1)
    assert len(want) >= 2 and set(rows(near.pairs())) == want
    assert {r["id"] for r in near.groups().where("n_members > 1").collect()} == {f"d{n}" for n in g}


def test_excerpts_hide_no_versions(spark):
    # many excerpts of a text, with the smaller ids, are the centres of the buckets of its versions
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = []
    for _ in range(1200):
        at = rng.randrange(140)
        docs.append(" ".join(base[at : at + 60]))
    docs += [" ".join(edited(rng, base, rng.choice([0, 2, 4, 8]))) for _ in range(20)]
    df = spark.createDataFrame([(f"d{n:04d}", t) for n, t in enumerate(docs)], "id string, text string")
    g = {n: grams(t, 3) for n, t in enumerate(docs)}
    pairs = set(rows(NearDuplicates(df, "id", "text", 0.7, 3, leaves=50).pairs()))
    want = {(f"d{a:04d}", f"d{b:04d}") for a, b in itertools.combinations(range(1220), 2) if len(g[a] & g[b]) >= 0.7 * len(g[a] | g[b])}
    assert pairs <= want and len(pairs) >= 0.999 * len(want)
    assert {p for p in want if p[0] >= "d1200"} <= pairs


def test_densification_fills_every_bin():
    d, s = np.array([0, 0, 1]), np.sort(np.array([5, 1 << 60, 1 << 62], np.uint64))
    sketch = __import__("veilwork.llm.near_duplicates", fromlist=["x"]).densified(d, s, 3, 128)
    assert (sketch[0] > 0).all() and set(sketch[0].tolist()) == {5, 1 << 60}
    assert (sketch[1] == 1 << 62).all() and (sketch[2] == 0).all()


# ---- consensus ----
def test_consensus_recovers_truth(spark):
    rng = random.Random(3)
    types = ["A", "B", "C"]
    skill = {"d1": 0.95, "d2": 0.85, "d3": 0.55, "d4": 0.5}
    data, truth = [], {}
    for i in range(1500):
        t = rng.choice(types)
        truth[str(i)] = t
        data.append((str(i), *(None if rng.random() < 0.2 else t if rng.random() < p else rng.choice(types) for p in skill.values())))
    df = spark.createDataFrame(data, "id string, d1_type string, d2_type string, d3_type string, d4_type string")
    labels = spark.createDataFrame([(d, f" {t.lower()} ", t) for d in skill for t in types], "detector string, raw_label string, entity_type string")
    c = consensus.fit_consensus(df, labels, list(skill))
    got = {r["item"]: r["entity_type"] for r in c.consensus().collect()}
    assert sum(got[i] == truth[i] for i in got) / len(got) > 0.93
    diag = {r["detector"]: r["probability"] for r in c.reliability().where("entity_type = 'A' AND named_type = 'A'").collect()}
    assert diag["d1"] > diag["d2"] > diag["d3"]
    kappa = {r["scope"]: r["kappa"] for r in c.agreement().collect()}
    assert 0.2 < kappa["all"] < 0.9 and kappa["d1~d2"] > kappa["d3~d4"]


def test_consensus_dirt(spark):
    labels = spark.createDataFrame([("x", "Foo", "F"), ("y", "foo", "F"), ("y", "bar", "B")], "detector string, raw_label string, entity_type string")
    df = spark.createDataFrame([("1", " FOO ", None), ("1", " FOO ", None), ("2", "", "bar"), ("3", None, None), ("4", "unheard", " "), ("5", "foo", "bar")], "id string, x_type string, y_type string")
    c = consensus.fit_consensus(df, labels, ["x", "y"])
    got = {r["item"]: (r["entity_type"], r["n_labels"], r["disputed"]) for r in c.consensus().collect()}
    assert set(got) == {"1", "2", "5"} and got["1"] == ("F", 1, False) and got["2"] == ("B", 1, False) and got["5"][1:] == (2, True)
    with pytest.raises(ValueError, match="most_tuples"):
        consensus.fit_consensus(df, labels, ["x", "y"], most_tuples=1)
    none = consensus.fit_consensus(df.where("id = 'z'"), labels, ["x", "y"])
    assert rows(none.consensus()) == [] and none.agreement().where("kappa IS NOT NULL").count() == 0


# ---- ranking ----
def test_ranking_is_not_ruled_by_range(spark):
    rng = random.Random(1)
    data = [(f"d{i % 7}", f"s{i:03d}", rng.random(), rng.lognormvariate(3, 3), 100 * rng.random()) for i in range(400)]
    df = spark.createDataFrame(data, "doc string, id string, a double, b double, c double")
    scores = [ranking.Score(x) for x in "abc"]
    rank = {x: np.argsort(np.argsort([r[k] for r in data])) / 399 for k, x in ((2, "a"), (3, "b"), (4, "c"))}
    mean = {r[1]: rank["a"][i] + rank["b"][i] + rank["c"][i] for i, r in enumerate(data)}
    got = dict(rows(ranking.best(df, scores, "doc")))
    for d in got:
        own = sorted((r[1] for r in data if r[0] == d), key=lambda x: -mean[x])
        assert mean[got[d]] >= mean[own[0]] - 0.1


def test_ranking_dirt(spark):
    df = spark.createDataFrame(
        [("d1", "a", 0.5, 1, None), ("d1", "b", 0.5, 1, None), ("d1", "c", 0.9, 0, None), ("d1", "c", 0.9, 0, None), ("DOC_1", "e", float("nan"), 1, 2.0), (None, "f", 0.1, 1, 1.0), ("d3", "g", None, None, None)],
        "doc string, id string, s double, on int, t double",
    )
    scores = [ranking.Score("s", "on"), ranking.Score("t")]
    got = dict(rows(ranking.best(df, scores, "doc")))
    assert got == {"d1": "a", "doc-1": "e", "d3": "g"}
    full = ranking.placed(ranking.ranked(df, scores, "doc")).where("grp = 'd1'").orderBy("place").collect()
    assert [r["id"] for r in full] == ["a", "b", "c"] and all(r["rank_value"] > 0 for r in full)
    assert rows(ranking.best(df.where("id = 'z'"), scores, "doc")) == []
    assert rows(ranking.placed(ranking.ranked(df.where("id = 'z'"), scores, "doc"))) == []


def test_places_of_one_large_group(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("d" if i % 3 else f"e{i % 5}", f"s{i:04d}", rng.choice([0.1, 0.5, rng.random()])) for i in range(3000)], "doc string, id string, s double")
    got = ranking.placed(ranking.ranked(df, [ranking.Score("s")], "doc")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["grp"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: (-r["rank_value"], r["id"]))
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))


# ---- splits ----
def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    got = dict(rows(components(spark.createDataFrame(edges, "a string, b string"))))
    assert got == {n: find(n) for n in par}


def test_splits_tear_nothing_and_keep_proportions(spark):
    rng = random.Random(6)
    data = [(f"s{i}", f"doc-{rng.randrange(900):012x}" if rng.random() < 0.95 else None, rng.choice([None, "", "none", f"conv-{rng.randrange(700)}"]), rng.choice("XYZ")) for i in range(6000)]
    data += [(f"h{i}", "URN:doc_aa", None, "X") for i in range(600)] + [("h0", "doc-aa", None, "X")]
    df = spark.createDataFrame(data, "id string, document_id string, conversation_id string, merged_type string").withColumn("group", F.lit(1))
    got = splits.assign_splits(df).collect()
    assert len({r["id"] for r in got}) == len(got) == 6600
    by = collections.defaultdict(set)
    for r in got:
        by[r["group"]].add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    share = collections.Counter(r["split"] for r in got)
    assert abs(share["train"] / 6600 - 0.8) < 0.03 and abs(share["test"] / 6600 - 0.1) < 0.02


def test_same_split_values(spark):
    df = spark.createDataFrame(
        [("doc-a", "c1"), ("DOC-A ", None), ("doc-b", "c1"), ("doc-c", "none"), ("doc-d", "N/A"), ("doc-e", ""), (None, "c9"), ("urn:doc-f", "c2"), ("doc-a", "c1")],
        "document_id string, conversation_id string",
    )
    assert sorted(rows(splits.same_split_values(df))) == [("DOC-A ", "doc-a"), ("DOC-A ", "doc-b"), ("doc-a", "doc-b")]
    assert rows(splits.same_split_values(df.where("document_id = 'z'"))) == []
    assert splits.assign_splits(df.where("document_id = 'z'").selectExpr("'1' id", "*", "'x' merged_type")).count() == 0


# ---- encoding and packing ----
TEXTS = [None, "", " ", "Hello  world\n\n", "it's <|endoftext|> fine", "naïve café 12345  x", "👩🏽‍⚕️ ok�", "x" * 5000, "full１２３ width", "a\r\n\tb  　c", "don't WE'LL 'sx"]


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc long, w string").withColumn("ids", F.lit(1))
    out = encoding.encode_corpus(df, "doc", "w", block_tokens=10)
    got = sorted(rows(out))
    want = sorted((i, t.encode(x or "", add_special_tokens=False).ids) for i, x in [*enumerate(TEXTS), (3, TEXTS[3])])
    assert got == want
    back = dict(rows(encoding.decode_corpus(out)))
    assert all(back[i] == (x or "") for i, x in enumerate(TEXTS))
    assert encoding.encode_corpus(df.where("doc > 99"), "doc", "w").count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_is_sound_and_tight(spark, rule):
    rng = random.Random(8)
    sizes = [int(rng.lognormvariate(5, 1.2)) for _ in range(1500)] + [2048, 4096, 5000, 1]
    df = spark.createDataFrame([*enumerate(sizes), (5000, 0), (5001, None), (0, sizes[0])], "id long, size long").withColumn("n", F.lit(1))
    out = packing.pack(df, "id", "size", rule=rule, group_items=800).collect()
    per, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        per[r["container"]].append(r)
        pieces[r["id"]].append(r)
    for c in per.values():
        c.sort(key=lambda r: r["place"])
        assert [r["place"] for r in c] == list(range(len(c))) and sum(r["n"] for r in c) <= 2048
        assert [r["start_at"] for r in c] == [sum(x["n"] for x in c[:k]) for k in range(len(c))]
    for i, s in enumerate(sizes):
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert sum(r["n"] for r in own) == s and len(own) == -(-s // 2048)
        assert [r["first"] for r in own] == [sum(x["n"] for x in own[:k]) for k in range(len(own))]
    assert sum(sizes) / (len(per) * 2048) > 0.97
    assert packing.pack(df.where("id > 9999"), "id", "size").count() == 0


def test_packing_obeys_every_dimension(spark):
    df = spark.createDataFrame([(i, 100) for i in range(100)], "id long, size long")
    out = packing.pack(df, "id", "size", max_documents=7, attention_capacity=50_000.0)
    n = [r["c"] for r in out.groupBy("container").agg(F.count("*").alias("c")).collect()]
    assert max(n) == 5 and sum(n) == 100


# ---- shared spans ----
def shared_brute(docs, span):
    grams_ = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in docs.items() if t}
    pairs = {(a, b) for a, b in itertools.combinations(sorted(grams_), 2) if grams_[a] & grams_[b]}
    cover = {}
    for i, t in docs.items():
        hit = np.zeros(len(t or ""), bool)
        for k in range(len(hit) - span + 1):
            if any(t[k : k + span] in g for j, g in grams_.items() if j != i):
                hit[k : k + span] = True
        cover[i] = int(hit.sum())
    return pairs, cover


def test_shared_spans_match_brute_force(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    parts = [text(n) for n in (59, 60, 61, 90, 200)]
    docs = {i: "".join(rng.choice([text(rng.randrange(5, 80)), rng.choice(parts), "é😀"]) for _ in range(6)) for i in range(30)}
    docs |= {100: None, 101: "", 102: docs[3], 103: "a" * 400, 104: "b" + "a" * 300 + parts[4], 105: "ab" * 150, 106: "x" + "ab" * 40, 107: text(20), 108: docs[3], 109: "ab" * 90 + parts[3], 110: "ab" * 70 + parts[3]}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()] + [(0, docs[0], "y")], "doc long, body string, id string")
    pairs, cover = shared_brute(docs, 60)
    for options in ({}, {"block_docs": 1}, {"block_docs": 2, "block_chars": 500}):
        got = SharedSpans(df, "doc", "body", span=60, k=40, **options)
        assert set(rows(got.pairs())) == pairs
        assert {i: s for i, _, s in rows(got.coverage())} == cover
    for i, r, s, p, n in rows(got.factor_list()):
        assert n >= 60 and docs[i][s : s + n] == docs[r][p : p + n]
    none = SharedSpans(df.where("doc > 999"), "doc", "body", span=60, k=40)
    assert rows(none.pairs()) == [] and rows(none.coverage()) == []


def test_parse_loses_no_stretch():
    rng = random.Random(3)
    for _ in range(300):
        alphabet = rng.choice(["ab", "abcd", "abcdefghijkl"])
        text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))  # noqa: B023, E731
        parts = [text(rng.randrange(4, 30)) for _ in range(4)] + ["ab" * 12]
        a, b = ("".join(rng.choice([*parts, text(3)]) for _ in range(8)) for _ in range(2))
        span, k = 12, 6
        got = shared_spans.parse(a, rolling.gram_hashes(np.frombuffer(a.encode("utf-32-le"), np.uint32), k), shared_spans.Reference(b, k), span)
        hit, want = np.zeros(len(a), bool), np.zeros(len(a), bool)
        for s, p, n in got:
            assert n >= span and a[s : s + n] == b[p : p + n]
            hit[s : s + n] = True
        for s in range(len(a) - span + 1):
            if a[s : s + span] in b:
                want[s : s + span] = True
        assert (hit == want).all()


def test_a_footer_of_many_texts_costs_blocks_not_pairs(spark):
    footer = "".join(random.Random(1).choice("abcdefgh ") for _ in range(260))
    df = spark.range(200).selectExpr("id", f"concat(repeat(sha(cast(id as string)), 3), '{footer}') AS t")
    s = SharedSpans(df, "id", "t", block_docs=16)
    assert s.pairs().count() == 200 * 199 // 2
    assert s.factors.count() < 5 * 200  # some share a character before the footer too
    _, cover = shared_brute({r["id"]: r["t"] for r in df.collect()}, 200)
    assert {r["id"]: r["shared_chars"] for r in s.coverage().collect()} == cover and min(cover.values()) >= 260


def test_rolling_hash_is_positionless():
    codes = np.array([5, 7, 9, 5, 7, 9, 1], np.uint32)
    h = rolling.gram_hashes(codes, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(rolling.gram_hashes(codes, 8)) == 0


# ---- registered queries ----
def test_queries_have_the_stated_columns(spark, data):
    want = {
        "p1_found": ["source_table", "record_id", "start_idx", "end_idx", "kind"],
        "p2_found": ["id_a", "id_b"],
        "p3_found": ["id", "entity_type"],
        "p4_found": ["document_id", "id"],
        "p5_found": ["document_id_a", "document_id_b"],
        "p7_ids": ["doc_id", "ids"],
        "p9_found": ["doc_id_a", "doc_id_b"],
    }
    q = queries.queries()
    for name, cols in want.items():
        df = q[name](spark, data)
        assert df.columns == cols
        got = rows(df.select(*(F.col(c).cast("string") for c in cols)))
        assert got and len(set(got)) == len(got), name


def test_found_offsets_are_code_points(spark, data):
    f = queries.p1_found(spark, data).where("source_table = 'messages' AND kind = 'EMAIL'")
    m = table(spark, data, "messages").select(F.col("id").alias("record_id"), "content").distinct()
    x = f.join(m, "record_id").select(F.substring("content", F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx")).alias("x"))
    assert all("@" in r["x"] or "at" in r["x"].lower() for r in x.collect())
