"""Span matching, precision and recall, SemEval modes, calibration quality, error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.catalog.lists import EVALUATION_CATEGORIES, EXCLUDED_LABELS, GOLD_LABELS, REPORT_TYPES, TYPE_GROUPS
from veilwork.functions.folds import first_come


def norm_type(c: Column) -> Column:
    return F.translate(F.upper(c), "_- ", "")


def _by_members(n: Column, groups: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        out = F.when(n.isin([m.replace("_", "").replace("-", "") for m in members]), F.lit(name)).otherwise(out)
    return out


def type_group(c: Column) -> Column:
    """Group of compatible types, or the normalised type itself."""
    return F.coalesce(_by_members(norm_type(c), TYPE_GROUPS), norm_type(c))


def report_type(c: Column) -> Column:
    """The name a type is reported under."""
    return F.coalesce(_by_members(F.translate(F.upper(c), "_", ""), REPORT_TYPES), F.upper(c))


def evaluation_category(c: Column) -> Column:
    """Category in the four-mode evaluation; null: the type is left out of it."""
    return _by_members(norm_type(c), EVALUATION_CATEGORIES)


def gold_label(label: Column) -> Column:
    """The type that a data set's label means (B- and I- marks and punctuation aside); null: nothing personal; unknown labels stay."""
    bare = F.upper(F.regexp_replace(F.trim(label), "^[BbIi]-", ""))
    excluded = norm_type(bare).isin([x.replace("_", "") for x in EXCLUDED_LABELS])
    return F.when(~excluded, F.coalesce(_by_members(norm_type(bare), GOLD_LABELS), bare))


def compatible(a: Column, b: Column) -> Column:
    return type_group(a) == type_group(b)


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column, longer: bool = False) -> Column:
    """Shared length against the shorter span (or the longer)."""
    shared = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    base = (F.greatest if longer else F.least)(e1 - s1, e2 - s2)
    return F.when(base > 0, shared / base).otherwise(0.0)


_SIDE = "array<struct<start:int,end:int,span_id:string,entity_type:string,tg:string>>"
_PAIR = "array<struct<pred:string,gold:string,same:boolean>>"


def _islands(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc, preds, golds): the spans of each stretch of overlapping ones, in order.

    What a span is matched with lies in its own stretch, so only the spans of
    one stretch are brought together, never those of a document.
    """
    cols = ["doc", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("span_id").cast("string").alias("span_id"), "entity_type", type_group(F.col("entity_type")).alias("tg")]
    both = pred.select(*cols, F.lit(True).alias("p")).distinct().unionByName(gold.select(*cols, F.lit(False).alias("p")).distinct())
    w = Window.partitionBy("doc").orderBy("start", "end", "p", "span_id")
    again = (F.lag("start").over(w) == F.col("start")) & (F.lag("end").over(w) == F.col("end"))
    fresh = (F.col("start") >= F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(1 << 31)))) & ~F.coalesce(again, F.lit(False))
    cut = both.withColumn("fresh", fresh.cast("long")).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("start", "end", "span_id", "entity_type", "tg")
    side = lambda is_p: F.array_sort(F.collect_list(F.when(F.col("p") == is_p, one))).cast(_SIDE)
    return cut.groupBy("doc", "island").agg(side(F.lit(True)).alias("preds"), side(F.lit(False)).alias("golds"))


def _shared(p: Column, g: Column) -> Column:
    return F.greatest(F.least(p["end"], g["end"]) - F.greatest(p["start"], g["start"]), F.lit(0))


def greedy_matches(pred: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc, pred, gold): predictions in order of place, each to the free gold span of a compatible type with the largest overlap.

    ``pred`` and ``gold``: doc, span_id, start, end, entity_type.
    """

    def of(p: Column) -> Column:
        ratio = lambda g: F.try_divide(_shared(p, g), F.least(p["end"] - p["start"], g["end"] - g["start"]))
        near = F.filter("golds", lambda g: (g["tg"] == p["tg"]) & (_shared(p, g) > 0) & (ratio(g) >= threshold))
        best = F.array_sort(F.transform(near, lambda g: F.struct((-ratio(g)).alias("r"), g["start"].alias("s"), g["span_id"].alias("gold"))))
        return F.transform(best, lambda x: F.struct(p["span_id"].alias("pred"), x["gold"].alias("gold"), F.lit(True).alias("same")))

    m = first_come(F.flatten(F.transform("preds", of)), _PAIR, "pred", "gold")
    return _islands(pred, gold).select("doc", F.explode(m).alias("x")).select("doc", "x.pred", "x.gold")


def outcomes(pred: DataFrame, gold: DataFrame, matches: DataFrame) -> DataFrame:
    """(outcome, entity_type, component): tp by gold type, fp by predicted type, fn by gold type."""
    gold = gold.select("doc", "span_id", "entity_type")
    tp = gold.join(matches.select("doc", F.col("gold").alias("span_id"), "pred"), ["doc", "span_id"]).join(pred.select("doc", F.col("span_id").alias("pred"), "source"), ["doc", "pred"])
    fp = pred.join(matches.select("doc", F.col("pred").alias("span_id")), ["doc", "span_id"], "left_anti")
    fn = gold.join(matches.select("doc", F.col("gold").alias("span_id")), ["doc", "span_id"], "left_anti")
    return (
        tp.select(F.lit("tp").alias("outcome"), "entity_type", F.col("source").alias("component"))
        .unionByName(fp.select(F.lit("fp").alias("outcome"), "entity_type", F.col("source").alias("component")))
        .unionByName(fn.select(F.lit("fn").alias("outcome"), "entity_type", F.lit("none").alias("component")))
    )


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; 0 where undefined."""
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = counts.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_table(result: DataFrame) -> DataFrame:
    """Overall, per type and per component, by grouping sets."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    g = result.groupingSets([[], ["entity_type"], ["component"]], "entity_type", "component").agg(n("tp"), n("fp"), n("fn"), F.grouping_id().alias("level"))
    return scores(g)


def semeval_pairs(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc, pairing, same_type, n): gold spans in order take a free prediction of equal borders, those left the first free overlapping one; the rest is missed or spurious."""

    def pairs(golds: Column, preds: Column, test) -> Column:
        of = lambda g: F.transform(F.filter(preds, lambda p: test(g, p)), lambda p: F.struct(p["span_id"].alias("pred"), g["span_id"].alias("gold"), F.equal_null(p["entity_type"], g["entity_type"]).alias("same")))
        return first_come(F.flatten(F.transform(golds, of)), _PAIR, "pred", "gold")

    x = _islands(pred, gold).withColumn("eq", pairs(F.col("golds"), F.col("preds"), lambda g, p: (g["start"] == p["start"]) & (g["end"] == p["end"])))
    left = lambda side, key: F.filter(side, lambda y: ~F.exists("eq", lambda k: k[key] == y["span_id"]))
    x = x.withColumns({"golds": left("golds", "gold"), "preds": left("preds", "pred")})
    x = x.withColumn("ov", pairs(F.col("golds"), F.col("preds"), lambda g, p: (g["start"] < p["end"]) & (p["start"] < g["end"])))
    count = lambda c, same: F.size(F.filter(c, lambda k: k["same"] == same))
    row = lambda pairing, same, n: F.struct(F.lit(pairing).alias("pairing"), F.lit(same).alias("same_type"), n.cast("long").alias("n"))
    rows = [row(name, same, count(col, same)) for name, col in (("equal", "eq"), ("overlap", "ov")) for same in (True, False)]
    rows += [row("missed", False, F.size("golds") - F.size("ov")), row("spurious", False, F.size("preds") - F.size("ov"))]
    return x.select("doc", F.explode(F.array(*rows)).alias("x")).select("doc", "x.pairing", "x.same_type", "x.n").where("n > 0")


def semeval(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Counters and scores of the modes strict, exact, partial and type."""
    pairs = semeval_pairs(pred, gold)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    eq, ov, ty = F.col("pairing") == "equal", F.col("pairing") == "overlap", F.col("same_type")
    parts = {
        "strict": (n(eq & ty), n((eq & ~ty) | ov), F.lit(0)),
        "exact": (n(eq), n(ov), F.lit(0)),
        "partial": (n(eq), F.lit(0), n(ov)),
        "type": (n(eq & ty), n((eq | ov) & ~ty), n(ov & ty)),
    }
    missed, spurious = n(F.col("pairing") == "missed"), n(F.col("pairing") == "spurious")
    one = pairs.agg(F.array(*(F.struct(F.lit(m).alias("mode"), c.cast("long").alias("correct"), i.cast("long").alias("incorrect"), p.cast("long").alias("partial"), missed.alias("missed"), spurious.alias("spurious")) for m, (c, i, p) in parts.items())).alias("m"))
    out = one.select(F.explode("m").alias("x")).select("x.*")
    credit = F.col("correct") + F.when(F.col("mode") == "partial", 0.5 * F.col("partial")).otherwise(0.0)
    possible = F.col("correct") + F.col("incorrect") + F.col("partial") + F.col("missed")
    actual = F.col("correct") + F.col("incorrect") + F.col("partial") + F.col("spurious")
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"possible": possible, "actual": actual, "precision": div(credit, actual), "recall": div(credit, possible)})
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def from_corrections(corrections: DataFrame) -> DataFrame:
    """tp, fp per type from review decisions; what nobody detected is not measurable."""
    c = corrections.select("decision", "detected_type", F.coalesce("correct_type", "detected_type").alias("right"))
    rows = F.when(F.col("decision") == "confirmed", F.array(F.struct(F.lit("tp").alias("o"), F.col("detected_type").alias("t"))))
    rows = rows.when(F.col("decision") == "rejected", F.array(F.struct(F.lit("fp").alias("o"), F.col("detected_type").alias("t"))))
    rows = rows.when(F.col("decision") == "changed", F.array(F.struct(F.lit("fp").alias("o"), F.col("detected_type").alias("t")), F.struct(F.lit("tp").alias("o"), F.col("right").alias("t"))))
    x = c.select(F.explode(rows).alias("x"))
    n = x.groupBy(F.col("x.t").alias("entity_type")).agg(F.count_if(F.col("x.o") == "tp").alias("tp"), F.count_if(F.col("x.o") == "fp").alias("fp"))
    return n.withColumn("precision", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0)))


def confusion(pairs: DataFrame, truth: str, named: str) -> DataFrame:
    return pairs.groupBy(F.col(truth).alias("truth"), F.col(named).alias("named")).agg(F.count(F.lit(1)).alias("n"))


def calibration(rows: DataFrame, p: str, actual: str, bins: int = 10) -> DataFrame:
    """Per equal bin [lo, hi): size, mean probability, share of positives; p = 1 falls into none."""
    b = rows.where(F.col(p).isNotNull() & (F.col(p) < 1)).withColumn("bin", F.floor(F.col(p) * bins).cast("int"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(actual).cast("double")).alias("share"))


def calibration_error(rows: DataFrame, p: str, actual: str, bins: int = 10) -> DataFrame:
    """One row: Brier score and expected calibration error."""
    brier = rows.agg(F.avg(F.pow(F.col(p) - F.col(actual).cast("double"), 2)).alias("brier"), F.count(F.lit(1)).alias("total"))
    ece = calibration(rows, p, actual, bins).agg(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))).alias("gap"))
    return brier.crossJoin(ece).select("brier", F.coalesce(F.col("gap") / F.col("total"), F.lit(0.0)).alias("ece"))  # single rows


def threshold_sweep(rows: DataFrame, p: str, actual: str, low: int = 10, high: int = 85, step: int = 5) -> DataFrame:
    """Precision, recall and F1 at each threshold of a fixed grid."""
    grid = F.array(*[F.lit(t / 100) for t in range(low, high + 1, step)])
    x = rows.select(F.col(p).alias("p"), F.col(actual).alias("a"), F.explode(grid).alias("threshold"))
    hit = F.coalesce(F.col("p") >= F.col("threshold"), F.lit(False))
    g = x.groupBy("threshold").agg(F.count_if(hit & F.col("a")).alias("tp"), F.count_if(hit & ~F.col("a")).alias("fp"), F.count_if(~hit & F.col("a")).alias("fn"))
    return scores(g)


def recommended_threshold(sweep: DataFrame, recall: float = 0.95) -> DataFrame:
    """The lowest threshold of the grid that reaches the recall, else 0.3."""
    return sweep.agg(F.coalesce(F.min(F.when(F.col("recall") >= recall, F.col("threshold"))), F.lit(0.3)).alias("threshold"))


def error_reason(text: Column, entity_type: Column) -> Column:
    n_words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    return (
        F.when(F.length(text) <= 2, "too_short")
        .when(text.rlike("^[0-9]+$") & (F.length(text) < 5), "short_number")
        .when(F.lower(text).isin("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"), "common_word")
        .when(entity_type.isin("ADDRESS", "LOCATION") & (n_words == 1), "single_word_address")
        .when(entity_type.isin("NAME_PERSON", "NAME_PATIENT") & (n_words == 1), "single_word_name")
        .when(text.rlike("[0-9]") & text.rlike(r"\p{L}"), "mixed_alphanumeric")
        .otherwise("unknown")
    )


def exact_counts(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Per type: equal spans of equal type, of another type, only predicted, only gold."""
    key = ["doc", "start", "end"]
    p = pred.groupBy(*key).agg(F.min("entity_type").alias("p"))
    g = gold.groupBy(*key).agg(F.min("entity_type").alias("g"))
    x = p.join(g, key, "full_outer")
    return x.groupBy(F.coalesce("g", "p").alias("entity_type")).agg(
        F.count_if(F.col("p") == F.col("g")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"), F.count_if(F.col("p") != F.col("g")).alias("type_errors")
    )


def bio_spans(tags: DataFrame) -> DataFrame:
    """(doc, entity_type, first, last) from rows (doc, pos, tag) of B-/I-/O tags."""
    w = Window.partitionBy("doc").orderBy("pos")
    t = tags.withColumn("kind", F.when(F.col("tag") != "O", F.regexp_replace("tag", "^[BI]-", "")))
    prev = F.lag("kind").over(w)
    fresh = F.col("kind").isNotNull() & (F.col("tag").startswith("B-") | prev.isNull() | (prev != F.col("kind")))
    t = t.withColumn("run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind IS NOT NULL")
    return t.groupBy("doc", "run", F.col("kind").alias("entity_type")).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("run")


def label_by_gold(spans: DataFrame, gold: DataFrame, tolerance: int = 2, longer: bool = True) -> DataFrame:
    """(doc, span_id, truth): the gold type of a span equal within ``tolerance``, else of one overlapping by more than half, else NONE."""
    g = gold.select("doc", F.col("start").alias("g_s"), F.col("end").alias("g_e"), F.col("entity_type").alias("g_t"))
    near = (F.abs(F.col("start") - F.col("g_s")) <= tolerance) & (F.abs(F.col("end") - F.col("g_e")) <= tolerance)
    ratio = overlap_ratio(F.col("start"), F.col("end"), F.col("g_s"), F.col("g_e"), longer)
    x = spans.join(g, "doc", "left").withColumns({"near": near, "ratio": ratio})
    best = F.max(F.when(F.col("near") | (F.col("ratio") > 0.5), F.struct(F.col("near"), F.col("ratio"), F.col("g_t"))))
    return x.groupBy("doc", "span_id").agg(F.coalesce(best["g_t"], F.lit("NONE")).alias("truth"))


def run_trend(runs: DataFrame) -> DataFrame:
    """Runs (dataset, run_id, at, f1) with the change of F1 against the one before, and whether it is the newest."""
    w = Window.partitionBy("dataset").orderBy("at", "run_id")
    newest = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("at"), F.desc("run_id"))) == 1
    return runs.withColumns({"delta_f1": F.round(F.col("f1") - F.lag("f1").over(w), 9), "is_latest": newest})


def run_summary(runs: DataFrame, recent: int = 5, last: int = 100) -> DataFrame:
    """Per data set, over its ``last`` newest runs: their number, F1 on average, best, worst, of the ``recent`` newest, and where it goes."""
    w = Window.partitionBy("dataset").orderBy(F.desc("at"), F.desc("run_id"))
    r = runs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)
    new = F.col("k") <= recent
    g = r.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("f1").alias("avg_f1"), F.max("f1").alias("best_f1"), F.min("f1").alias("worst_f1"), F.avg(F.when(new, F.col("f1"))).alias("recent_f1"),
        F.max_by("f1", F.when(new, -F.col("k"))).alias("_new"), F.max_by("f1", F.when(new, F.col("k"))).alias("_old"),
    )
    trend = F.when(F.col("n_runs") < 2, "insufficient_data").when(F.col("_new") > F.col("_old"), "improving").when(F.col("_new") < F.col("_old"), "declining").otherwise("stable")
    return g.withColumn("trend", trend).drop("_new", "_old")


def error_examples(pairs: DataFrame, truth: str, named: str, example: str, most: int = 5) -> DataFrame:
    """Confusions with their number and the first ``most`` examples of each (a top-k report)."""
    wrong = pairs.where(~F.equal_null(F.col(truth), F.col(named)))
    each = wrong.groupBy(F.col(truth).alias("truth"), F.col(named).alias("named"), F.col(example).alias("example")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("truth", "named").orderBy("example")
    top = each.withColumn("k", F.row_number().over(w)).groupBy("truth", "named").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("example")))).alias("examples"))
    return top


def calibration_samples(spans: DataFrame, gold: DataFrame, detectors: list[str], least: float = 0.5) -> DataFrame:
    """(doc, span_id, detector, score, actual): what each detector's raw score was, and whether a gold span of a compatible type overlaps by ``least`` or more."""
    g = gold.select("doc", F.col("start").alias("g_s"), F.col("end").alias("g_e"), F.col("entity_type").alias("g_t"))
    x = spans.join(g, "doc", "left")
    hit = compatible(F.col("entity_type"), F.col("g_t")) & (overlap_ratio(F.col("start"), F.col("end"), F.col("g_s"), F.col("g_e")) >= least)
    marked = x.groupBy("doc", "span_id", *detectors).agg(F.max(F.coalesce(hit, F.lit(False))).alias("actual"))
    scores_ = F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).cast("double").alias("score")) for d in detectors))
    return marked.select("doc", "span_id", "actual", F.explode(scores_).alias("x")).where("x.score IS NOT NULL AND NOT isnan(x.score)").select("doc", "span_id", "x.detector", "x.score", "actual")


# Parts of type names that tell a category, in order.
CATEGORY_PARTS = [
    ("NAME", "NAME FIRST LAST MIDDLE"), ("CONTACT", "EMAIL PHONE FAX URL TEL"), ("LOCATION", "ADDRESS STREET CITY STATE ZIP COUNTRY GPS COORDINATE LOCATION"), ("DATE", "DATE DOB BIRTH TIME"),
    ("IDNUM", "SSN PASSPORT LICENSE ACCOUNT IBAN MRN RECORD"), ("FINANCIAL", "CREDIT CARD CVV PIN BANK"), ("DIGITAL", "IP MAC USER PASSWORD AGENT"), ("CRYPTO", "BITCOIN ETHEREUM LITECOIN CRYPTO"),
    ("VEHICLE", "VIN VEHICLE DEVICE IMEI SERIAL"), ("ORG", "COMPANY ORG FACILITY HOSPITAL EMPLOYER"),
]


def category(entity_type: Column) -> Column:
    """Broad category of a type name, by its parts; OTHER without any."""
    t = norm_type(entity_type)
    out = F.when(entity_type.isNull() | (t == ""), "OTHER")
    for name, parts in CATEGORY_PARTS:
        out = out.when(t.rlike("|".join(parts.split())), name)
    return out.otherwise("OTHER")


def errors_as_corrections(pred: DataFrame, matches: DataFrame, texts: DataFrame, window: int = 50) -> DataFrame:
    """Predictions of an evaluation as review decisions: matched ones confirmed, others rejected, with the words around them."""
    hit = matches.select("doc", F.col("pred").alias("span_id"), F.lit(True).alias("hit"))
    x = pred.join(hit, ["doc", "span_id"], "left").join(texts, "doc")
    s = F.greatest(F.col("start") - window, F.lit(0))
    return x.select(
        "doc", "span_id", F.col("text").alias("entity_text"), F.col("entity_type").alias("detected_type"), F.when(F.col("hit"), "confirmed").otherwise("rejected").alias("decision"),
        F.substring(F.col("doc_text"), s + 1, F.col("start") - s).alias("context_before"), F.substring(F.col("doc_text"), F.col("end") + 1, F.lit(window)).alias("context_after"),
    )


def trace_missed(gold: DataFrame, final: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Gold spans that the final result misses, with the stages that had seen them; ``lost in merge`` if any had."""
    edge = lambda df: df.select(F.col("doc").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    touch = (F.col("doc") == F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    out = gold.join(edge(final), touch, "left_anti")
    for name, df in stages.items():
        ids = out.join(edge(df), touch, "left_semi").select("span_id").distinct().withColumn(f"seen_{name}", F.lit(True))
        out = out.join(ids, "span_id", "left").fillna(False, [f"seen_{name}"])
    some = F.lit(False)
    for name in stages:
        some = some | F.col(f"seen_{name}")
    return out.withColumn("issue", F.when(some, "lost in merge").otherwise("never detected"))
