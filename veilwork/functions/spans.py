"""Typed character spans out of text, in the JVM.

For a pattern, ``regexp_extract_all`` gives the matches and ``split`` what
stands between them; running lengths give code-point offsets.  No Python code
touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.catalog.rules import Rule
from veilwork.runtime import spread

SPAN = "struct<start:int,end:int,text:string>"


def _offsets(m: Column, gaps: Column) -> Column:
    """Spans of matches ``m`` between ``gaps``."""
    pairs = F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda x, g: F.struct(x.alias("x"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["g"]
        e = s + F.length(p["x"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), p["x"].alias("text")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def spans(text: Column, m: Column, rule: Rule, inner: Column | None = None) -> Column:
    """Spans of one rule; ``m`` are its whole matches, ``inner`` its groups."""
    whole = F.when(F.size(m) > 0, _offsets(m, F.split(text, rule.search, -1))).otherwise(F.array().cast(f"array<{SPAN}>"))
    if inner is None:
        return whole

    def cut(w: Column, g: Column) -> Column:
        n = F.length(g)
        if rule.group == "lead":
            s = w["start"]
        elif rule.group == "trail":
            s = w["end"] - n
        else:
            s = w["start"] + F.call_function("instr", w["text"], g) - 1
        return F.struct(s.alias("start"), (s + n).alias("end"), g.alias("text"))

    return F.zip_with(whole, inner, cut)


def gate(low: Column, digit: Column, rule: Rule) -> Column | None:
    """Necessary condition of a rule on the lower-case text, or None."""
    out = None
    for n in rule.need:
        test = digit if n == "#" else F.contains(low, F.lit(n))
        out = test if out is None else out | test
    return out


def extract(df: DataFrame, id_col: str, text_col: str, rules: list[Rule], keep_text: bool = False) -> DataFrame:
    """(id, k, start, end, text) of all rules in one scan, before validation; with ``keep_text`` also the whole text, ``t``.

    Null and empty texts give no rows.  The matches are not filtered before
    the explode, which would evaluate every pattern twice.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    base = spread(base.where("t IS NOT NULL")).withColumns({"low": F.lower("t"), "digit": F.col("t").rlike("[0-9]")})
    found = []
    for k, r in enumerate(rules):
        g = gate(F.col("low"), F.col("digit"), r)
        for suffix, group in (("m", 0), ("g", 1)):
            if group and not r.group:
                continue
            x = F.regexp_extract_all("t", F.lit(r.search), F.lit(group))
            found.append((F.when(g, x).otherwise(F.array().cast("array<string>")) if g is not None else x).alias(f"{suffix}{k}"))
    stepped = base.select("id", "t", *found)
    def numbered(k: int):
        return lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))

    each = [F.transform(spans(F.col("t"), F.col(f"m{k}"), r, F.col(f"g{k}") if r.group else None), numbered(k)) for k, r in enumerate(rules)]
    packed = F.flatten(F.array(*each))
    kept = ["t"] if keep_text else []
    return stepped.select("id", *kept, F.explode(packed).alias("s")).select("id", "s.k", "s.start", "s.end", "s.text", *kept)


def overlap_pairs(left: DataFrame, right: DataFrame, cell: int = 256) -> DataFrame:
    """Every two spans of a document that share a character, once: the columns of ``left``, and those of ``right`` with ``r_``.

    Both have doc, start, end.  Spans meet by document and cell of the text,
    so the spans of a very long document are spread over its cells.
    """
    cells = lambda s, e: F.sequence(F.floor(s / cell), F.floor((e - 1) / cell))
    a = left.where("start < end").withColumn("_c", F.explode(cells(F.col("start"), F.col("end"))))
    r = right.where("start < end").select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    r = r.withColumn("_r", F.explode(cells(F.col("r_start"), F.col("r_end"))))
    both = (F.col("doc") == F.col("r_doc")) & (F.col("_c") == F.col("_r")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    once = F.col("_c") == F.floor(F.greatest("start", "r_start") / cell)
    return a.join(r, both & once).drop("_c", "_r", "r_doc")
