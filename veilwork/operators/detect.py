"""Rule, checksum and secret detection over a column of texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.catalog import rules as R
from veilwork.catalog.rules import CHECKSUM_RULES, RULES, Rule
from veilwork.functions import validators as V
from veilwork.functions.spans import extract
from veilwork.runtime import stage


def _sound(rule: Rule) -> None:
    """Raises unless type, confidence and group can be."""
    if not re.fullmatch(r"[A-Z][A-Z_]*", rule.entity_type):
        raise ValueError(f"type {rule.entity_type!r}")
    if not 0 <= rule.confidence <= 1:
        raise ValueError(f"confidence {rule.confidence}")
    if rule.group not in (None, "lead", "trail", "inner"):
        raise ValueError(f"group {rule.group!r}")


class Catalog:
    """A list of rules that can be extended; rules are data, checks are column functions."""

    def __init__(self, rules: list[Rule] | None = None, checks: dict[str, Callable[[Column], Column]] | None = None):
        self.rules = list(RULES if rules is None else rules)
        self.checks = dict(V.CHECKS if checks is None else checks)

    def add(self, rule: Rule, check: Callable[[Column], Column] | None = None) -> Catalog:
        if any(r.name == rule.name for r in self.rules):
            raise ValueError(f"there is a rule {rule.name} already")
        _sound(rule)
        if check is not None:
            self.checks[rule.name] = check
            rule = replace(rule, check=rule.name)
        self.rules.append(rule)
        return self

    def add_pattern(self, name: str, pattern: str, entity_type: str, confidence: float = 0.8, check=None) -> Catalog:
        return self.add(Rule(name, entity_type, confidence, pattern), check)

    def enable(self, name: str, on: bool = True) -> bool:
        """Switch a rule on or off; whether there is such a rule."""
        there = self.get(name) is not None
        self.rules = [replace(r, enabled=on) if r.name == name else r for r in self.rules]
        return there

    def remove(self, name: str) -> bool:
        before = len(self.rules)
        self.rules = [r for r in self.rules if r.name != name]
        return len(self.rules) < before

    def get(self, name: str) -> Rule | None:
        return next((r for r in self.rules if r.name == name), None)

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as rows."""
        rows = [(r.name, r.entity_type, r.confidence, r.regex, r.check, r.group is not None) for r in self.rules]
        return spark.createDataFrame(rows, "rule string, entity_type string, confidence double, pattern string, validator string, emits_group boolean")

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"rules": [asdict(r) for r in self.rules]}, f)

    @classmethod
    def load(cls, path: str) -> Catalog:
        with open(path, encoding="utf-8") as f:
            rules = [Rule(**(r | {"need": tuple(r["need"])})) for r in json.load(f)["rules"]]
        if len({r.name for r in rules}) < len(rules):
            raise ValueError("two rules have one name")
        for r in rules:
            _sound(r)
        return cls(rules)

    def check(self, spark: SparkSession) -> dict[str, str]:
        """Rules whose pattern the engine cannot compile, with what it says."""
        bad = {}
        for r in self.rules:
            try:
                spark.sql("SELECT rlike('', :p)", args={"p": r.regex}).collect()
            except Exception as e:
                bad[r.name] = str(e).split("\n")[0]
        return bad

    def try_pattern(self, spark: SparkSession, pattern: str, text: str) -> list[tuple[str, int, int]]:
        """(text, start, end) of each match of a pattern; raises if it does not compile."""
        one = spark.createDataFrame([(0, text)], "id int, t string")
        return [(r["text"], r["start"], r["end"]) for r in extract(one, "id", "t", [Rule("try", "OTHER", 1.0, pattern)]).orderBy("start").collect()]


def detect(df: DataFrame, id_col: str, text_col: str, catalog: Catalog | None = None) -> DataFrame:
    """(id, rule, entity_type, start, end, text, confidence, has_checksum): every hit of every rule; overlaps are kept.

    Null and empty texts have no hits; one row per hit, also for repeated rows.
    """
    catalog = catalog or Catalog()
    rules = [r for r in catalog.rules if r.enabled]
    return _typed(extract(df, id_col, text_col, rules), rules, catalog.checks).drop("k")


def _typed(raw: DataFrame, rules: list[Rule], checks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Hits that pass the check of their rule, with what the rule says; other columns of ``raw`` stay."""
    ok = F.lit(True)
    for name in sorted({r.check for r in rules if r.check}):
        here = [k for k, r in enumerate(rules) if r.check == name]
        ok = ok & F.when(F.col("k").isin(here), checks[name](F.col("text"))).otherwise(True)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    more = [c for c in raw.columns if c not in ("id", "k", "start", "end", "text")]
    return raw.where(ok).select(
        "id",
        "k",
        pick([r.name for r in rules]).alias("rule"),
        pick([r.entity_type for r in rules]).alias("entity_type"),
        "start",
        "end",
        "text",
        pick([float(r.confidence) for r in rules]).alias("confidence"),
        pick([r.check is not None for r in rules]).alias("has_checksum"),
        *more,
    )


SECRET_RULE = Rule("secret", "PASSWORD", 0.6, R.SECRET_SHAPE)


def all_hits(df: DataFrame, id_col: str, text_col: str, catalog: Catalog | None = None, window: int = 60) -> DataFrame:
    """Hits of the catalogue's rules, the proven ones and the shape of secrets in one scan of the texts, staged.

    ``family`` (rule, proven, secret) tells them apart; ``context`` is what
    stands before a hit, ``before`` and ``around`` are what secrets are judged by.
    """
    catalog = catalog or Catalog()
    own = [r for r in catalog.rules if r.enabled]
    rules = [*own, *CHECKSUM_RULES, SECRET_RULE]
    t = _typed(extract(df, id_col, text_col, rules, keep_text=True), rules, V.CHECKS | catalog.checks)
    family = F.when(F.col("k") < len(own), "rule").when(F.col("k") < len(rules) - 1, "proven").otherwise("secret")
    context = F.expr(f"substring(t, greatest(start - {window}, 0) + 1, least(start, {window}))")
    secret = {"before": F.when(F.col("family") == "secret", _before()), "around": F.when(F.col("family") == "secret", _around())}
    return stage(t.withColumns({"family": family, "context": context}).withColumns(secret).drop("k", "t"))


def detect_checksums(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hits of the proven rules without overlaps.

    A document's hits are folded in order of start and falling confidence: a
    hit is kept if it starts behind the last kept one, and takes its place if
    it overlaps with a strictly higher confidence.
    """
    return fold_proven(detect(df, id_col, text_col, Catalog(CHECKSUM_RULES)))


def fold_proven(hits: DataFrame) -> DataFrame:
    """The hits of proven rules, of every document folded as above."""
    one = F.struct("start", (-F.col("confidence")).alias("neg"), "end", "rule", "entity_type", "text")
    kind = "struct<start:int,neg:double,end:int,rule:string,entity_type:string,text:string>"

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        return (
            F.when((F.size(kept) == 0) | (x["start"] >= last["end"]), F.concat(kept, F.array(x)))
            .when(x["neg"] < last["neg"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x)))
            .otherwise(kept)
        )

    folded = hits.groupBy("id").agg(F.array_sort(F.collect_set(one)).alias("h")).select("id", F.aggregate("h", F.array().cast(f"array<{kind}>"), step).alias("h"))
    return folded.select("id", F.explode("h").alias("x")).select("id", "x.rule", "x.entity_type", "x.start", "x.end", "x.text", (-F.col("x.neg")).alias("confidence"))


def _any_in(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def detect_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, end, text, confidence, entropy) of strings that look like passwords or keys."""
    # the words around a candidate are cut out where it is found
    c = extract(df, id_col, text_col, [SECRET_RULE], keep_text=True)
    return judge_secrets(c.withColumns({"before": _before(), "around": _around()}))


def _before() -> Column:
    return F.lower(F.expr("substring(t, greatest(start - 20, 0) + 1, least(start, 20))"))


def _around() -> Column:
    return F.lower(F.expr("substring(t, greatest(start - 100, 0) + 1, least(start, 100) + length(text) + 100)"))


def judge_secrets(c: DataFrame) -> DataFrame:
    """Candidates (id, start, end, text, before, around) that are no labels, names or samples, with confidence and entropy."""
    before, around = F.col("before"), F.col("around")
    labelled = _any_in(before, R.SECRET_LABELS) & before.rlike(r"[:=]\s*$")
    letters, digit, special = F.col("text").rlike(r"\p{L}"), F.col("text").rlike(r"\p{Nd}"), F.col("text").rlike(r"[^\p{L}\p{N}]")
    mixed = F.col("text").rlike(r"\p{Lu}") & F.col("text").rlike(r"\p{Ll}")
    ok = (
        ~labelled
        & ~_any_in(F.lower("text"), R.SECRET_SELF)
        & ~F.col("text").rlike(r"^[A-Z][a-z]+[._][A-Z][a-z]+$")
        & (letters.cast("int") + digit.cast("int") + special.cast("int") >= 2)
        & (mixed | special)
        & ~_any_in(around, R.SECRET_NEGATIVES)
    )
    scored = c.where(ok).withColumn("hint", _any_in(around, R.SECRET_HINTS)).withColumn("entropy", V.entropy(F.col("text")))
    conf = F.when(F.col("entropy") < 2.8, None).when(F.col("hint"), 0.90).when(F.col("entropy") >= 3.5, 0.75).when(F.col("entropy") >= 3.0, 0.60)
    return scored.withColumn("confidence", conf).where("confidence IS NOT NULL").select("id", "start", "end", "text", "confidence", "entropy")


def suggest_rules(corrections: DataFrame, top: int = 10, least: int = 2) -> DataFrame:
    """The texts that reviewers reject most, as exclusion patterns."""
    n = corrections.where("decision = 'rejected' AND entity_text IS NOT NULL").groupBy(F.lower(F.trim("entity_text")).alias("text")).agg(F.count(F.lit(1)).alias("n_rejected"))
    best = n.where(F.col("n_rejected") >= least).orderBy(F.desc("n_rejected"), "text").limit(top)
    return best.withColumn("pattern", F.concat(F.lit("\\b"), F.regexp_replace("text", r"([^\w\s])", r"\\$1"), F.lit("\\b")))


def hits_by_rule(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule", "entity_type").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("id").alias("n_docs"))


def best_per_place(hits: DataFrame) -> DataFrame:
    """The most certain hit of each (id, start, end)."""
    w = Window.partitionBy("id", "start", "end").orderBy(F.desc("confidence"), "rule")
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
