"""Date shifting, generalisation, tokens, redaction and restoration."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.catalog.rules import SMALL_ZIP_PREFIXES

# (parse, print) formats of dates, tried in this order (fixed values)
DATE_FORMATS = [("M/d/yyyy", "MM/dd/yyyy"), ("M-d-yyyy", "MM-dd-yyyy"), ("M/d/yy", "MM/dd/yy"), ("M-d-yy", "MM-dd-yy"), ("yyyy-M-d", "yyyy-MM-dd"), ("yyyy/M/d", "yyyy/MM/dd"), ("MMMM d, yyyy", "MMMM dd, yyyy"), ("MMM d, yyyy", "MMM dd, yyyy"), ("d MMMM yyyy", "dd MMMM yyyy"), ("d MMM yyyy", "dd MMM yyyy")]
_SHAPES = [r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}/\d{1,2}/\d{2}", r"\d{1,2}-\d{1,2}-\d{2}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{4}/\d{1,2}/\d{1,2}", r"(?:May|[A-Z][a-z]{3,8}) \d{1,2}, \d{4}", r"[A-Z][a-z]{2} \d{1,2}, \d{4}", r"\d{1,2} (?:May|[A-Z][a-z]{3,8}) \d{4}", r"\d{1,2} [A-Z][a-z]{2} \d{4}"]
DATE_KINDS = ["DATE", "DATE_DOB", "DOB", "DATE_OF_BIRTH"]


def lookup_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def date_offset(conversation: Column, least: int = 30, most: int = 365) -> Column:
    """Days by which a conversation's dates move, the same every time: least .. most - 1."""
    n = F.conv(F.substring(F.sha2(conversation, 256), 1, 8), 16, 10).cast("long")
    return (n % (most - least) + least).cast("int")


def _parsed(text: Column) -> list[Column]:
    out = []
    for (parse, _), shape in zip(DATE_FORMATS, _SHAPES, strict=True):
        d = F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(parse)).cast("date"))
        if parse.endswith("yy") and not parse.endswith("yyyy"):
            d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
        out.append(d)
    return out


def shift_date(text: Column, offset: Column) -> Column:
    """The date moved by ``offset`` days in its own format; what is no date stays."""
    t = F.trim(text)
    moved = [F.date_format(F.date_add(d, offset), show) for d, (_, show) in zip(_parsed(t), DATE_FORMATS, strict=True)]
    return F.coalesce(*moved, text)


def shift_year(text: Column, offset: Column) -> Column:
    """Only the year of the moved date; else a year in the text, moved by whole years; else the text."""
    t = F.trim(text)
    years = [F.year(F.date_add(d, offset)).cast("string") for d in _parsed(t)]
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(*years, F.when(year != "", (year.try_cast("int") + F.floor(offset / 365)).cast("string")), text)


def generalise_age(text: Column, limit: int = 89) -> Column:
    """All digits of the text as an age; above ``limit`` it is ``90+``."""
    d = F.regexp_replace(text, "[^0-9]", "")
    return F.when(d == "", text).when(d.try_cast("long") > limit, F.lit("90+")).otherwise(d.try_cast("long").cast("string"))


def generalise_ages_in(text: Column) -> Column:
    """Ages above 89 inside a text become 90+."""
    old = r"0*(?:9[0-9]|[1-9][0-9]{2})"
    out = F.regexp_replace(text, rf"(?i)\b{old}\s*-?\s*(?:year|yr|y)[-\s]*(?:old|o)\b", "90+ year old")
    out = F.regexp_replace(out, rf"(?i)\b(?:aged|age)[:\s]*{old}\b", "age 90+")
    return F.regexp_replace(out, rf"(?i)\b{old}\s*y\.?o\.?\b", "90+ y.o.")


def generalise_zip(text: Column) -> Column:
    d = F.regexp_replace(text, "[^0-9]", "")
    p = F.substring(d, 1, 3)
    return F.when(F.length(d) < 5, text).when(p.isin(SMALL_ZIP_PREFIXES), F.lit("000XX")).otherwise(F.concat(p, F.lit("XX")))


def generalise_zips_in(text: Column) -> Column:
    small = F.regexp_replace(text, rf"\b(?:{'|'.join(SMALL_ZIP_PREFIXES)})\d{{2}}(?:-\d{{4}})?\b", "000XX")
    return F.regexp_replace(small, r"\b(\d{3})\d{2}(?:-\d{4})?\b", "$1XX")


def generalise(text: Column, entity_type: Column, conversation: Column) -> Column:
    """The value that may be kept of a date, age or postcode; other kinds unchanged."""
    kind = F.upper(entity_type)
    return (
        F.when(kind.isin(DATE_KINDS), shift_date(text, date_offset(conversation)))
        .when(kind == "AGE", generalise_age(text))
        .when(kind.isin("ZIP", "ZIP_CODE", "ZIPCODE", "POSTAL_CODE"), generalise_zip(text))
        .otherwise(text)
    )


def short_type(entity_type: Column) -> Column:
    return F.regexp_replace(entity_type, "^(?:NAME_|DATE_|ID_)", "")


def assign_tokens(spans: DataFrame, doc: str = "doc", seq: str | None = None) -> DataFrame:
    """``spans`` with ``token`` ``[KIND_n]``: one per document and text (case and outer blanks aside).

    Numbers run per document and short type in order of first use: by
    ``seq``, and within one from the right.  The first use decides the kind.
    """
    order = ([F.col(seq)] if seq else []) + [-F.col("start"), F.col("span_id")]
    use = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("entity_type").alias("kind"))
    first = spans.withColumn("hash", lookup_hash(F.col("text"))).groupBy(doc, "hash").agg(F.min(use).alias("u"))
    first = first.withColumn("short", short_type(F.col("u.kind")))
    n = F.row_number().over(Window.partitionBy(doc, "short").orderBy("u", "hash"))
    tokens = first.select(doc, "hash", F.concat(F.lit("["), "short", F.lit("_"), n.cast("string"), F.lit("]")).alias("token"))
    return spans.withColumn("hash", lookup_hash(F.col("text"))).join(tokens, [doc, "hash"])


def splice(text: Column, spans: Column) -> Column:
    """``text`` with every span {start, end, token} of the array replaced, from the right; overlapped and out-of-bounds ones are skipped."""
    ordered = F.reverse(F.array_sort(spans))
    first = F.struct(text.alias("t"), F.length(text).alias("edge"))

    def step(acc: Column, s: Column) -> Column:
        ok = (s["end"] <= acc["edge"]) & (s["start"] >= 0) & (s["start"] < s["end"])
        new = F.concat(F.substring(acc["t"], 1, s["start"]), s["token"], F.substring(acc["t"], s["end"] + 1, F.length(acc["t"])))
        return F.struct(F.when(ok, new).otherwise(acc["t"]).alias("t"), F.when(ok, s["start"]).otherwise(acc["edge"]).alias("edge"))

    return F.aggregate(ordered, first, step, lambda acc: acc["t"])


def splice_log(text: Column, spans: Column) -> Column:
    """struct(text, log): as :func:`splice`, and what it replaced: start, end (places in the new text), token, original."""
    ordered = F.array_sort(F.array_distinct(spans))
    # from the right, as in splice: a span that reaches into a kept one is skipped
    begin = F.struct(F.length(text).alias("edge"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("kept"))

    def choose(acc: Column, s: Column) -> Column:
        ok = (s["end"] <= acc["edge"]) & (s["start"] >= 0) & (s["start"] < s["end"])
        return F.struct(F.when(ok, s["start"]).otherwise(acc["edge"]).alias("edge"), F.when(ok, F.concat(F.array(s), acc["kept"])).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate(F.reverse(ordered), begin, choose, lambda acc: acc["kept"])
    log_type = "array<struct<start:int,end:int,token:string,original:string>>"
    first = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"), F.array().cast(log_type).alias("log"))

    def write(acc: Column, s: Column) -> Column:
        head = F.concat(acc["t"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        one = F.struct(F.length(head).alias("start"), (F.length(head) + F.length(s["token"])).alias("end"), s["token"].alias("token"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("original"))
        return F.struct(F.concat(head, s["token"]).alias("t"), s["end"].alias("at"), F.concat(acc["log"], F.array(one)).alias("log"))

    return F.aggregate(kept, first, write, lambda acc: F.struct(F.concat(acc["t"], F.substring(text, acc["at"] + 1, F.length(text))).alias("text"), acc["log"].alias("log")))


def restore_log(text: Column, log: Column) -> Column:
    """The very text that :func:`splice_log` was given, from its result."""
    back = F.transform(log, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["original"].alias("token")))
    return splice(text, back)


SAFE_KINDS = [*DATE_KINDS, "AGE", "ZIP", "ZIP_CODE", "ZIPCODE", "POSTAL_CODE"]


def safe_harbor(texts: DataFrame, spans: DataFrame, doc: str = "doc", text: str = "doc_text", conversation: str | None = None) -> DataFrame:
    """(doc, text, changes): every text with its dates, ages and postcodes generalised.

    ``changes``: original, transformed, type, start, end (places in the
    original) of each value that was changed.  Spans whose text is not at their
    place are skipped, and so are those that reach into one further right.
    Dates move by the offset of ``conversation`` (a column of ``spans``; the
    document unless given).
    """
    conv = F.col(conversation or doc).cast("string")
    s = spans.where(F.upper("entity_type").isin(SAFE_KINDS)).withColumn("_new", generalise(F.col("text"), F.col("entity_type"), conv)).where("_new <> text")
    s = s.join(texts.select(doc, F.col(text).alias("_t")), doc).where((F.col("start") >= 0) & (F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")))
    w = Window.partitionBy(doc).orderBy(F.desc("start"), F.desc("end"), F.desc("_new"))
    # from the right, a span is kept if it ends before the last kept one begins; of equal places one counts
    one = F.struct("start", "end", F.col("_new").alias("token"), F.col("text").alias("original"), "entity_type")
    kind = "array<struct<start:int,end:int,token:string,original:string,entity_type:string>>"
    begin = F.struct(F.lit(1 << 30).alias("edge"), F.array().cast(kind).alias("kept"))

    def choose(acc: Column, x: Column) -> Column:
        ok = x["end"] <= acc["edge"]
        return F.struct(F.when(ok, x["start"]).otherwise(acc["edge"]).alias("edge"), F.when(ok, F.concat(F.array(x), acc["kept"])).otherwise(acc["kept"]).alias("kept"))

    per = s.withColumn("_k", F.row_number().over(w)).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_k", one.alias("x")))).alias("s"))
    per = per.select(doc, F.aggregate(F.transform("s", lambda y: y["x"]).cast(kind), begin, choose, lambda acc: acc["kept"]).alias("kept"))
    out = texts.join(per, doc, "left")
    none = F.array().cast(kind)
    cut = F.transform(F.coalesce("kept", none), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token")))
    log = F.transform(F.coalesce("kept", none), lambda x: F.struct(x["original"].alias("original"), x["token"].alias("transformed"), x["entity_type"].alias("type"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(doc, F.when(F.col("kept").isNull(), F.col(text)).otherwise(splice(F.col(text), cut)).alias("text"), log.alias("changes"))


def redact(texts: DataFrame, spans: DataFrame, doc: str = "doc", text: str = "doc_text") -> DataFrame:
    """(doc, redacted, token_map, log): every tokenised span replaced.

    The map leads a token back to one of its originals (they differ at most in
    case and outer blanks); the log, with places in the redacted text, leads
    back to the very text (:func:`restore_log`).
    """
    # one original per token: the first in order of the text
    spans = spans.withColumn("original", F.min("text").over(Window.partitionBy(doc, "token")))
    per = spans.groupBy(doc).agg(
        F.collect_set(F.struct(F.col("start"), F.col("end"), F.col("token"))).alias("s"),
        F.collect_set(F.struct("token", "original")).alias("m"),
    )
    out = texts.join(per, doc, "left")
    out = out.withColumn("_o", splice_log(F.col(text), F.coalesce("s", F.array().cast("array<struct<start:int,end:int,token:string>>"))))
    return out.select(doc, F.col("_o.text").alias("redacted"), F.col("_o.log").alias("log"), F.map_from_entries(F.coalesce("m", F.array().cast("array<struct<token:string,original:string>>"))).alias("token_map"))


TOKEN = r"\[[A-Z_]+_\d+\]"


def restore(text: Column, token_map: Column) -> Column:
    """Known tokens become their originals, unknown ones stay."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)
    back = F.transform(found, lambda t: F.coalesce(F.element_at(token_map, t), t))
    return F.concat(gaps[0], F.array_join(F.zip_with(back, F.slice(gaps, 2, F.size(found)), lambda b, g: F.concat(b, g)), ""))


def find_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def derive_key(password: str, salt: bytes, rounds: int = 600_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds)


def _keyed(df: DataFrame, key: bytes) -> DataFrame:
    """``df`` with the key as a column of a one-row table, so that no plan, and no log of plans, shows it."""
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(bytearray(key),)], "_key binary")))


def encrypt(df: DataFrame, column: str, key: bytes) -> DataFrame:
    """``df`` with a text column under AES-256-GCM: nonce, cipher text and tag in one value."""
    return _keyed(df, key).withColumn(column, F.aes_encrypt(F.col(column), F.col("_key"), F.lit("GCM"))).drop("_key")


def decrypt(df: DataFrame, column: str, key: bytes) -> DataFrame:
    return _keyed(df, key).withColumn(column, F.aes_decrypt(F.col(column), F.col("_key"), F.lit("GCM")).cast("string")).drop("_key")
