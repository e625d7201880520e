"""Dictionary search and registry look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.validators import npi_strict
from veilwork.operators.suppress import term_reason
from veilwork.runtime import spread, stage

PRIORITY = ["HEALTH_PLAN", "DRUG", "DIAGNOSIS", "LAB_TEST", "FACILITY"]


def load_terms(rows: DataFrame, col: str, min_length: int = 4) -> DataFrame:
    """Usable terms of a one-term-per-line source, lower case, once each; ``#`` begins a comment."""
    t = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    return rows.select(t.alias("term")).where(~F.col("term").startswith("#") & term_reason(F.col("term"), min_length).isNull()).select(F.lower("term").alias("term")).distinct()


_WORD = r"[\p{L}\p{N}]+"


def _starts(low: Column, term: Column) -> Column:
    """Places of ``term`` in ``low`` that stand between other than letters and digits; overlapping ones too."""
    pieces = F.split(low, F.concat(F.lit(r"(?=\Q"), term, F.lit(r"\E)")), -1)
    none = F.array().cast("array<int>")
    ends = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("s")), lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["s"], F.array(acc["at"])).alias("s")), lambda acc: acc["s"])
    n = F.length(term)
    # substring counts a place before the first character as the first
    left = lambda p: (p == 0) | ~F.substring(low, p, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    right = lambda p: ~F.substring(low, p + n + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    return F.filter(ends, lambda p: (F.substring(low, p + 1, n) == term) & left(p) & right(p))


def dictionary_hits(texts: DataFrame, terms: DataFrame, id_col: str = "doc", text_col: str = "doc_text", min_length: int = 4) -> DataFrame:
    """(id, term, category, start, end): every place at which a term stands between non-word characters.

    The distinct runs of one to n words of each text (n: the words of the
    longest term) are joined to the terms by equality, which leaves the few
    terms that a text can hold; only those are looked for in it.  Terms
    without any letter or digit match nothing.
    """
    usable = terms.select(F.lower(F.trim("term")).alias("term"), "category").where(F.length("term") >= min_length).distinct()
    words = F.regexp_extract_all(F.col("term"), F.lit(_WORD), F.lit(0))
    sized = stage(usable.withColumns({"n": F.size(words), "key": F.array_join(words, " ")}).where("n > 0"))
    sizes = sorted(r["n"] for r in sized.select("n").distinct().collect())  # a few numbers
    src = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low")).where("low IS NOT NULL").dropDuplicates(["id"])
    cut = spread(src).select("id", F.regexp_extract_all("low", F.lit(_WORD), F.lit(0)).alias("w"))

    def runs(n: int) -> Column:
        listed = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, listed).otherwise(F.array().cast("array<string>"))

    keys = F.array_distinct(F.concat(*map(runs, sizes))) if sizes else F.array().cast("array<string>")
    held = cut.select("id", F.explode(keys).alias("key")).join(sized.select("key", "term", "category"), "key").select("id", "term", "category")
    found = src.join(held, "id").select("id", "term", "category", F.explode(_starts(F.col("low"), F.col("term"))).alias("start"))
    return found.withColumn("end", F.col("start") + F.length("term"))


def contains_terms(texts: DataFrame, terms: DataFrame, id_col: str = "doc", text_col: str = "doc_text", min_length: int = 4) -> DataFrame:
    """(id, category): the categories of which a text holds a term, at any of its places."""
    return dictionary_hits(texts, terms, id_col, text_col, min_length).select("id", "category").distinct()


def lookup(keys: DataFrame, terms: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """(term, category): the first category by priority that holds the term."""
    order = priority or PRIORITY
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("category")), F.lit(0))
    best = terms.select(F.lower(F.trim("term")).alias("key"), "category").withColumn("r", F.when(rank == 0, len(order) + 1).otherwise(rank))
    best = best.groupBy("key").agg(F.min(F.struct("r", "category")).alias("b"))
    return keys.join(best, F.lower(F.trim(keys["term"])) == best["key"], "left").select(keys["term"], F.col("b.category").alias("category"))


def capped(terms: DataFrame, most: int = 10_000) -> DataFrame:
    """The longest ``most`` terms of each category (a top-k report)."""
    w = Window.partitionBy("category").orderBy(F.desc(F.length("term")), "term")
    return terms.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def status(terms: DataFrame) -> DataFrame:
    """Per category: terms, usable ones, and whether over half are rejected."""
    r = term_reason(F.col("term"))
    g = terms.groupBy("category").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(r.isNull()).alias("n_valid"))
    return g.withColumn("issue", F.col("n_valid") * 2 < F.col("n_terms"))


def rejected_terms(terms: DataFrame, samples: int = 5) -> DataFrame:
    """(category, reason, n, samples): why terms are not usable, with the first ``samples`` of each reason (a top-k report)."""
    bad = terms.withColumn("reason", term_reason(F.col("term"))).where("reason IS NOT NULL")
    w = Window.partitionBy("category", "reason").orderBy("term")
    k = bad.withColumn("k", F.row_number().over(w))
    return k.groupBy("category", "reason").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.coalesce("term", F.lit(""))))).alias("samples"))


def registry_lookup(keys: DataFrame, registry: DataFrame, key: str = "npi") -> DataFrame:
    """Registry rows of valid provider numbers; invalid and unknown ones get nulls."""
    ok = npi_strict(F.col(key))
    rest = [c for c in registry.columns if c != key]
    r = registry.select(F.col(key).alias("_k"), *rest)
    marked = keys.withColumn("valid", F.coalesce(ok, F.lit(False)))
    return marked.join(r, (marked[key] == r["_k"]) & marked["valid"], "left").drop("_k")


def registry_search(registry: DataFrame, part: str, columns: list[str], limit: int = 20) -> DataFrame:
    """Registry rows with ``part`` in any of the columns, case aside, in order of the columns (a top-k report)."""
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(part.lower()))
    return registry.where(test).orderBy(*columns, *(c for c in registry.columns if c not in columns)).limit(limit)
