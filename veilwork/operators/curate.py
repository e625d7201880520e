"""Quality of labelled data: filters, caps, merging, label formats, generated samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.catalog.rules import Rule
from veilwork.functions.spans import extract, overlap_pairs
from veilwork.operators.fuse import accept_by_evidence

# Words that are no names, and words of street addresses.
COMMON_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must can this that these those i you he she it we they me him her us them my "
    "your his its our their what which who whom when where why how all each every both few more most other some such no not only same so than too very just also now here there then once new old good bad first last long "
    "great little own right big high small large next early young important public national mr mrs ms dr miss sir north south east west january february march april june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday today tomorrow yesterday forward backward internal external senior junior customer client patient user account payment service team sales support trans card "
    "bank credit debit"
).split()
STREET_WORDS = "street st avenue ave road rd boulevard blvd lane ln drive dr way court ct place pl circle highway hwy parkway pkwy terrace suite apt apartment unit floor".split()
# how many samples a balanced set takes of each type
TARGETS = dict.fromkeys("NAME_PERSON EMAIL PHONE SSN CREDIT_CARD ADDRESS DATE".split(), 1200) | dict.fromkeys("USERNAME PASSWORD IP_ADDRESS ACCOUNT_NUMBER URL ZIP LOCATION IBAN".split(), 250)


# Families of types that are judged alike.
QUALITY_KINDS = {
    "email": ["EMAIL"], "phone": ["PHONE", "PHONE_NUMBER", "TELEPHONE"], "ssn": ["SSN", "US_SSN", "SOCIAL_SECURITY"], "card": ["CREDIT_CARD", "CREDITCARDNUMBER"], "secret": ["PASSWORD", "PIN"], "address": ["ADDRESS", "STREET_ADDRESS"],
    "name": ["NAME", "PERSON", "NAME_PERSON", "FIRSTNAME", "LASTNAME", "NAME_PATIENT", "NAME_PROVIDER"], "user": ["USERNAME", "USER_ID"], "date": ["DATE", "DATE_TIME", "DOB"], "ip": ["IP_ADDRESS", "IP", "IPV4", "IPV6"], "url": ["URL"],
    "account": ["ACCOUNT_NUMBER", "IBAN", "BANK_ACCOUNT"],
}
# Verdicts by family, the first that holds counts: condition on the facts, score (0: refused), reason, fact that ends the reason.
QUALITY_RULES = [
    ("email", "f_domain", 0.95, "Valid email format", None),
    ("email", "true", 0.0, "Missing @ or domain", None),
    ("phone", "f_digits >= 10", 0.90, "10+ digit phone", None),
    ("phone", "f_digits >= 7 AND f_marked", 0.80, "7+ digit formatted phone", None),
    ("phone", "true", 0.0, "Too few digits: ", "f_digits"),
    ("ssn", "f_dashed", 0.95, "SSN format XXX-XX-XXXX", None),
    ("ssn", "f_digits = 9", 0.85, "9-digit SSN", None),
    ("ssn", "true", 0.0, "Invalid SSN format", None),
    ("card", "f_digits BETWEEN 13 AND 19", 0.90, "Valid CC length", None),
    ("card", "f_digits IN (3, 4)", 0.0, "CVV only, not full card", None),
    ("card", "true", 0.0, "Invalid CC length: ", "f_digits"),
    ("secret", "f_chars >= 8 AND f_mix >= 3", 0.85, "Complex password", None),
    ("secret", "f_chars >= 10 AND f_mix >= 2", 0.75, "Long mixed password", None),
    ("secret", "f_chars >= 4 AND f_hint", 0.70, "Password with context", None),
    ("secret", "true", 0.0, "No complexity or context", None),
    ("address", "f_street AND (f_number OR f_words >= 2)", 0.85, "Street address", None),
    ("address", "f_number AND f_words >= 2 AND f_chars >= 10", 0.70, "Address-like", None),
    ("address", "f_only_digits AND f_chars <= 5", 0.0, "Just a number", None),
    ("address", "true", 0.0, "No street indicators", None),
    ("name", "f_common", 0.0, "Common word: ", "f_low"),
    ("name", "f_capital AND f_letter AND f_chars >= 2", 0.80, "Capitalized name", None),
    ("name", "true", 0.0, "Not name-like", None),
    ("user", "f_user", 0.85, "Valid username pattern", None),
    ("user", "f_handle", 0.90, "Handle format", None),
    ("user", "true", 0.0, "Invalid username", None),
    ("date", "f_date", 0.85, "Date pattern", None),
    ("date", "f_only_digits AND f_chars <= 2", 0.0, "Too short for date", None),
    ("date", "true", 0.0, "No date pattern", None),
    ("ip", "f_ipv4", 0.95, "IPv4 format", None),
    ("ip", "f_colon AND f_chars >= 6", 0.80, "IPv6-like", None),
    ("ip", "true", 0.0, "Not IP format", None),
    ("url", "f_web", 0.95, "URL format", None),
    ("url", "f_dot AND f_slash", 0.75, "URL-like", None),
    ("url", "true", 0.0, "Not URL format", None),
    ("account", "f_chars >= 8", 0.75, "Account number length", None),
    ("account", "true", 0.0, "Too short", None),
    ("other", "f_chars >= 3", 0.50, "Default accept", None),
    ("other", "true", 0.0, "Too short", None),
]
# Shapes that are facts of a value.
QUALITY_SHAPES = {
    "f_marked": r"[-().+ ]", "f_dashed": r"^\d{3}-\d{2}-\d{4}$", "f_number": "[0-9]", "f_only_digits": "^[0-9]+$", "f_capital": r"^\p{Lu}", "f_letter": r"\p{L}", "f_user": r"^[A-Za-z][A-Za-z0-9._-]{2,30}$", "f_handle": "^@",
    "f_date": r"(?i)\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
    "f_ipv4": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "f_colon": ":", "f_web": "^(?:https?://|www[.])", "f_dot": "[.]", "f_slash": "/", "f_domain": "@[^@]*[.][^@]*$",
}
QUALITY_MIX = [r"\p{Lu}", r"\p{Ll}", "[0-9]", r"[^\p{L}\p{N}]"]
QUALITY_HINTS = ["password", "pwd", "pin", "passcode", "secret"]


def quality_case(what: str) -> str:
    """SQL over the facts and ``f_kind``, for any engine: the reason or the score of the first rule that holds."""

    def value(score: float, reason: str, fact: str | None) -> str:
        if what == "score":
            return f"CAST({score} AS DOUBLE)"
        return f"'{reason}'" if fact is None else f"concat('{reason}', CAST({fact} AS STRING))"

    return "CASE " + " ".join(f"WHEN f_kind = '{kind}' AND {test} THEN {value(score, reason, fact)}" for kind, test, score, reason, fact in QUALITY_RULES) + " END"


def with_quality(spans: DataFrame, entity_type: str = "entity_type", text: str = "text", around: str | None = None) -> DataFrame:
    """``spans`` with ``q``, a struct (clean, reason, score) of the labelled value, by QUALITY_RULES; ``around`` is a column of the text it stands in."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    kind = F.lit("other")
    for name, types in QUALITY_KINDS.items():
        kind = F.when(F.upper(entity_type).isin(types), name).otherwise(kind)
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    low = F.lower(F.col(around)) if around else F.lit("")
    hint = F.lit(False)
    for w in QUALITY_HINTS:
        hint = hint | F.contains(low, F.lit(w))
    facts = {
        "f_kind": kind, "f_low": F.lower(t), "f_digits": F.length(F.regexp_replace(t, "[^0-9]", "")), "f_chars": F.length(t), "f_words": F.size(words), "f_street": F.exists(words, lambda w: w.isin(STREET_WORDS)),
        "f_common": F.lower(t).isin(COMMON_WORDS), "f_mix": sum(t.rlike(p).cast("int") for p in QUALITY_MIX), "f_hint": F.coalesce(hint, F.lit(False)),
    } | {name: t.rlike(p) for name, p in QUALITY_SHAPES.items()}
    # the facts are one value that the rules look at, so that no optimizer copies them into every rule
    reason, score = (re.sub(r"\bf_", "f.f_", quality_case(what)) for what in ("reason", "score"))
    judged = f"transform(transform(array(_facts), f -> named_struct('reason', {reason}, 'score', {score})), x -> named_struct('clean', x.score > 0, 'reason', x.reason, 'score', x.score))[0]"
    return spans.withColumn("_facts", F.struct(*(v.alias(k) for k, v in facts.items()))).withColumn("q", F.expr(judged)).drop("_facts")


def curate(spans: DataFrame, least: float = 0.7, doc: str = "doc", around: str | None = None) -> DataFrame:
    """Per document with a clean span: how many, their mean quality, how many were refused."""
    q = with_quality(spans, around=around)
    ok = F.col("q.clean") & (F.col("q.score") >= least)
    g = q.groupBy(doc).agg(F.count_if(ok).alias("n_clean"), F.avg(F.when(ok, F.col("q.score"))).alias("quality"), F.count_if(~ok).alias("n_refused"))
    return g.where("n_clean > 0")


def curation_tallies(spans: DataFrame, around: str | None = None) -> DataFrame:
    """(entity_type, reason, clean, n): why values were taken or refused, with the fact at a reason's end left out."""
    q = with_quality(spans, around=around)
    return q.groupBy("entity_type", F.regexp_replace("q.reason", ": .*$", "").alias("reason"), F.col("q.clean").alias("clean")).agg(F.count(F.lit(1)).alias("n"))


def golden_documents(spans: DataFrame, least: int = 1) -> DataFrame:
    """Documents all of whose usable spans go into a golden set: (doc, n_entities, quality).

    ``spans`` have their document's text, ``doc_text``.  A span is usable if it
    is clean and its text is what stands at its place, outer blanks aside, or
    one holds the other.
    """
    blank = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    here = blank(F.substring(F.col("doc_text"), F.col("start") + 1, F.col("end") - F.col("start")))
    said = blank(F.col("text"))
    fits = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.length(here) > 0) & (F.contains(here, said) | F.contains(said, here))
    q = with_quality(spans, around="doc_text").where(fits & F.col("q.clean"))
    return q.groupBy("doc").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("q.score").alias("quality")).where(F.col("n_entities") >= least)


def first_per_type(spans: DataFrame, targets: dict[str, int] | None = None, scale: float = 1.0) -> DataFrame:
    """The best ``target`` values of each type: a balanced sample, which is the feature."""
    targets = targets or TARGETS
    cap = F.element_at(F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, int(v * scale))]), F.col("entity_type"))
    q = with_quality(spans).where("q.clean").withColumn("cap", cap).where("cap IS NOT NULL")
    w = Window.partitionBy("entity_type").orderBy(F.desc("q.score"), "span_id")
    return q.withColumn("rn", F.row_number().over(w)).where("rn <= cap").drop("cap", "rn", "q")


def merge_sources(parts: dict[str, DataFrame], seed: int = 42) -> DataFrame:
    """Union of data sets, each row tagged with ``_source``, and ``_order``, a random key that depends on the row alone."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("_source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.withColumn("_order", F.xxhash64(F.lit(seed), *(F.col(c) for c in out.columns)))


def training_samples(corrections: DataFrame) -> DataFrame:
    """Per document: entities that reviewers confirmed or changed; documents with rejections only are negatives."""
    kept = F.col("decision").isin("confirmed", "changed")
    one = F.struct(F.col("entity_start").alias("start"), F.col("entity_end").alias("end"), F.when(F.col("decision") == "changed", F.col("correct_type")).otherwise(F.col("detected_type")).alias("entity_type"))
    g = corrections.groupBy("doc").agg(F.array_sort(F.collect_set(F.when(kept, one))).alias("entities"))
    return g.withColumn("negative", F.size("entities") == 0)


def word_tags(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, pos, word, tag): white-space words with B-/I-/O tags by overlap with spans; a word takes the span that covers most of it."""
    w = extract(texts, "doc", "doc_text", [Rule("word", "WORD", 1.0, r"\S+", need=())]).select(F.col("id").alias("doc"), "start", "end", F.col("text").alias("word"))
    pairs = overlap_pairs(w.select("doc", "start", "end"), spans.select("doc", "start", "end", "entity_type", "span_id"))
    cover = F.least("end", "r_end") - F.greatest("start", "r_start")
    best = pairs.groupBy("doc", "start").agg(F.max(F.struct(cover.alias("o"), F.col("r_start").alias("s"), F.col("r_entity_type").alias("t"), F.col("r_span_id").alias("i"))).alias("b"))
    tagged = w.join(best, ["doc", "start"], "left")
    first = F.row_number().over(Window.partitionBy("doc", F.col("b.i")).orderBy("start")) == 1
    tag = F.when(F.col("b.i").isNull(), "O").when(first, F.concat(F.lit("B-"), "b.t")).otherwise(F.concat(F.lit("I-"), "b.t"))
    pos = F.row_number().over(Window.partitionBy("doc").orderBy("start")) - 1
    return tagged.select("doc", pos.alias("pos"), "word", tag.alias("tag"))


def align_pieces(words: DataFrame, pieces: DataFrame, length: int = 512, pad: int = 0, ignore: int = -100) -> DataFrame:
    """(doc, input_ids, labels, mask): word tags spread over sub-word pieces, cut or padded to ``length``.

    ``words``: doc, pos, label (a number); ``pieces``: doc, pos, piece_ids, the
    ids of each word's pieces.  The first piece of a word has its label, the
    others are ignored.  A document's rows are its own words.
    """
    x = words.join(pieces, ["doc", "pos"])
    one = F.transform("piece_ids", lambda p, i: F.struct(p.cast("int").alias("p"), F.when(i == 0, F.col("label")).otherwise(F.lit(ignore)).cast("int").alias("l")))
    g = x.select("doc", "pos", one.alias("x")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("w"))
    flat = F.slice(F.flatten(F.transform("w", lambda y: y["x"])), 1, length)
    g = g.select("doc", flat.alias("f"))
    fill = lambda values, with_: F.concat(values, F.array_repeat(F.lit(with_), F.lit(length) - F.size("f")))
    return g.select("doc", fill(F.transform("f", lambda y: y["p"]), pad).alias("input_ids"), fill(F.transform("f", lambda y: y["l"]), ignore).alias("labels"), fill(F.transform("f", lambda y: F.lit(1)), 0).alias("mask"))


PLACEHOLDERS = r"\[(?:NAME|DATE|PHONE|MRN|SSN|ADDRESS)(?:_\d+)?\]|_{3,}|\*{3,}"


def reinject(texts: DataFrame, values: list[str], id_col: str = "doc", text_col: str = "doc_text") -> DataFrame:
    """Placeholders become values (by id and number, reproducible); (id, text, entities) with the new places."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(PLACEHOLDERS), F.lit(0))
    gaps = F.split(F.col(text_col), PLACEHOLDERS, -1)
    number = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    pick = lambda i: F.element_at(F.array(*map(F.lit, values)), (number(i) % len(values) + 1).cast("int"))
    filled = F.transform(found, lambda x, i: pick(i))
    start = F.struct(gaps[0].alias("t"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("e"))

    def step(acc: Column, p: Column) -> Column:
        s = F.length(acc["t"])
        return F.struct(
            F.concat(acc["t"], p["v"], p["g"]).alias("t"),
            F.concat(acc["e"], F.array(F.struct(s.alias("start"), (s + F.length(p["v"])).alias("end"), p["v"].alias("value")))).alias("e"),
        )

    pairs = F.zip_with(filled, F.slice(gaps, 2, F.size(found)), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
    out = F.aggregate(pairs, start, step)
    return texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), out.alias("o")).select("id", F.col("o.t").alias("text"), F.col("o.e").alias("entities"))


FEATURES = ["phi_bert_conf", "pii_bert_conf", "presidio_conf", "rule_conf", "llm_conf", "phi_bert_detected", "pii_bert_detected", "presidio_detected", "rule_detected", "rule_has_checksum", "sources_agree_count", "span_length", "has_digits", "has_letters", "all_caps", "all_digits", "mixed_case"]


def feature_vectors(spans: DataFrame) -> DataFrame:
    """(id, features): the numbers a classifier sees; absent ones are 0."""
    return spans.select("id", F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in FEATURES)).alias("features"))


def _numbers(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in FEATURES]


def held_out(labelled: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``labelled`` with ``held``: a share of each label's rows, in the order of a hash of the id, whatever the partitions."""
    w = Window.partitionBy("label", "_cell").orderBy("_h", "id")
    h = labelled.withColumn("_h", F.xxhash64(F.lit(seed), "id")).withColumn("_cell", F.pmod("_h", F.lit(1024)))
    n = F.count(F.lit(1)).over(Window.partitionBy("label", "_cell"))
    # by cell of the hash, so that no task orders all rows of a label; what a cell cannot share out evenly goes by the hash
    up = n * share + (F.pmod(F.xxhash64("label", "_cell"), F.lit(1000)) / 1000)
    return h.withColumn("held", F.row_number().over(w) <= F.floor(up)).drop("_h", "_cell")


def train_acceptor(labelled: DataFrame, trees: int = 50, depth: int = 6, seed: int = 42, boosted: bool = False):
    """(model, metrics, importances) of a forest, or of boosted trees, that accepts or refuses spans; ``labelled``: id, FEATURES and ``label`` (0, 1).

    A fifth of each label's rows is held out for the metrics.  ``importances``
    are (feature, importance) pairs, falling.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = held_out(labelled.select("id", "label", *_numbers(labelled)), seed=seed)
    if rows.where("NOT held").isEmpty():
        raise ValueError("there are no labelled rows to train on")
    tree = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed) if boosted else RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), tree]).fit(rows.where("NOT held"))
    p = model.transform(rows.where("held"))
    m = p.agg(F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)).alias("tp"), F.count_if((F.col("prediction") == 1) & (F.col("label") == 0)).alias("fp"), F.count_if((F.col("prediction") == 0) & (F.col("label") == 1)).alias("fn"))
    weights = sorted(zip(FEATURES, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])
    return model, m, weights


def save_model(model, path: str, metadata: dict) -> None:
    """The model at ``path``/model and one row of metadata, as JSON, beside it."""
    import json

    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str):
    """(model, metadata) as saved."""
    import json

    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def accept_by_model(signals: DataFrame, model=None, threshold: float = 0.5) -> DataFrame:
    """``signals`` with accepted, accept_conf and accept_type: by the trained model where there is one, else by the evidence ladder."""
    if model is None:
        s = accept_by_evidence(signals)
        return s.select(*signals.columns, F.col("evidence_ok").alias("accepted"), F.col("evidence_conf").alias("accept_conf"), F.col("evidence_type").alias("accept_type"))
    from pyspark.ml.functions import vector_to_array

    kept = F.struct(*signals.columns).alias("_row")
    p = model.transform(signals.select(kept, *_numbers(signals)))
    prob = vector_to_array("probability")[1]
    out = p.select("_row.*", prob.alias("accept_conf"))
    ok = F.col("accept_conf") > threshold
    return out.withColumn("accepted", ok).withColumn("accept_type", F.when(ok, F.col("merged_type")).otherwise("NONE"))


def fit_platt(rows: DataFrame, score: str, actual: str) -> tuple[float, float]:
    """(a, b) of sigmoid(a x + b), by logistic regression with an L2 penalty of strength 1 on a (as a sum over rows)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    r = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.select(F.col(score).cast("double").alias("x"), F.col(actual).cast("double").alias("label")).dropna())
    m = LogisticRegression(maxIter=100, regParam=1.0 / max(1, r.count()), standardization=False).fit(r)
    return float(m.coefficients[0]), float(m.intercept)

def training_mix(production: DataFrame, adversarial: DataFrame, synthetic: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """All production and adversarial rows and a share of the synthetic ones (a sampling operator), tagged by origin."""
    kept = F.pmod(F.xxhash64(F.lit(seed), *(F.col(c) for c in synthetic.columns)), F.lit(10_000)) < round(share * 10_000)
    tag = lambda df, name: df.withColumn("_source", F.lit(name))
    return tag(production, "production").unionByName(tag(adversarial, "adversarial"), allowMissingColumns=True).unionByName(tag(synthetic.where(kept), "synthetic"), allowMissingColumns=True)
