"""One-call entry points over DataFrames, and over single texts for convenience."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.operators import deidentify as S
from veilwork.operators import fuse as E
from veilwork.operators.detect import Catalog, all_hits, fold_proven, judge_secrets
from veilwork.operators.plugins import detectors, run_detector
from veilwork.operators.suppress import context_excluded, drop_other, exclusion_reason, is_allowed


class VeilworkError(Exception):
    """Base of all errors."""


class ConfigurationError(VeilworkError):
    """A setting that cannot be used."""


class DetectionError(VeilworkError):
    """A text that could not be scanned."""


class SessionExpired(VeilworkError):
    """A session that was closed."""


@dataclass(frozen=True)
class Config:
    """Settings; ``mode`` is ``staged`` (all rules) or ``proven`` (checksum rules only)."""

    mode: str = "staged"
    review_below: float = 0.95
    secrets: bool = True
    other: bool = True  # whether findings of type OTHER stay
    plugins: tuple[str, ...] = ()
    catalog: Catalog = field(default_factory=Catalog)

    def __post_init__(self):
        if self.mode not in ("staged", "proven"):
            raise ConfigurationError(f"mode {self.mode!r}")
        for p in self.plugins:
            if p not in detectors():
                raise ConfigurationError(f"no detector {p!r}")


def scan(df: DataFrame, id_col: str, text_col: str, config: Config | None = None) -> DataFrame:
    """(doc, start, end, text, entity_type, confidence, needs_review): findings, merged and filtered."""
    config = config or Config()
    cols = ["id", "start", "end", "text", "entity_type", "confidence", "source"]
    found = all_hits(df, id_col, text_col, config.catalog)
    family = lambda name: found.where(F.col("family") == name)
    hits = fold_proven(family("proven")).withColumn("source", F.lit("rule")).select(*cols)
    if config.mode == "staged":
        hits = hits.unionByName(family("rule").withColumn("source", F.lit("rule")).select(*cols))
        if config.secrets:
            secrets = judge_secrets(family("secret")).withColumns({"entity_type": F.lit("PASSWORD"), "source": F.lit("rule")})
            hits = hits.unionByName(secrets.select(*cols))
    for p in config.plugins:
        hits = hits.unionByName(run_detector(p, df, id_col, text_col).select(*cols))
    hits = hits.withColumn("doc", F.col("id")).withColumn("span_id", F.concat_ws("-", F.col("id").cast("string"), "start", "end", "entity_type", "source"))
    merged = E.tiered_merge(hits.drop("id").distinct())
    # what stands before a place is known from the scan; a plug-in's own places have nothing there
    contexts = found.groupBy(F.col("id").alias("doc"), "start").agg(F.min("context").alias("context"))
    kept = merged.join(contexts, ["doc", "start"], "left")
    excluded = context_excluded(F.col("entity_type"), F.coalesce("context", F.lit("")))
    kept = kept.where(~is_allowed(F.col("text")) & exclusion_reason(F.col("text"), F.col("entity_type"), F.col("context")).isNull() & ~excluded)
    kept = kept if config.other else drop_other(kept)
    return kept.select("doc", "start", "end", "text", "entity_type", "confidence", (F.col("confidence") < config.review_below).alias("needs_review"))


def redact(df: DataFrame, id_col: str, text_col: str, config: Config | None = None) -> DataFrame:
    """(doc, redacted, token_map) of every text."""
    spans = scan(df, id_col, text_col, config).withColumn("span_id", F.concat_ws("-", "start", "end"))
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("doc_text"))
    return S.redact(texts, S.assign_tokens(spans))


def restore(df: DataFrame, text_col: str, map_col: str) -> DataFrame:
    return df.withColumn("restored", S.restore(F.col(text_col), F.col(map_col)))


class Client:
    """Single texts, for trying things out; collections go through the functions above."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config, self.maps, self.open = spark, config or Config(), {}, True

    def _one(self, text: str) -> DataFrame:
        if not self.open:
            raise SessionExpired("the session was closed")
        if not isinstance(text, str):
            raise DetectionError("a text must be a str")
        return self.spark.createDataFrame([(0, text)], "id long, t string")

    def scan(self, text: str) -> list[dict]:
        return [r.asDict() for r in scan(self._one(text), "id", "t", self.config).orderBy("start").drop("doc").collect()]

    def redact(self, text: str) -> str:
        row = redact(self._one(text), "id", "t", self.config).first()
        self.maps |= row["token_map"]
        return row["redacted"]

    def restore(self, text: str) -> str:
        if not self.open:
            raise SessionExpired("the session was closed")
        for token in sorted(self.maps, key=len, reverse=True):
            text = text.replace(token, self.maps[token])
        return text

    def close(self) -> None:
        self.open, self.maps = False, {}


class Session:
    """One conversation under a password: texts are redacted with tokens that stay the same over its messages.

    Originals are kept under a key derived from the password (PBKDF2), in a
    Parquet table at ``path``, or in this object's memory without one.  A
    session opened again with the same password, conversation and path knows
    its tokens; with another password they cannot be read.  Made for the
    messages of one conversation; collections go through
    :mod:`veilwork.operators.sessions`.
    """

    SCHEMA = "doc string, token string, hash string, original binary"

    def __init__(self, spark: SparkSession, password: str, conversation: str, path: str | None = None, rounds: int = 600_000, config: Config | None = None):
        if not password:
            raise ConfigurationError("a session needs a password")
        self._client = Client(spark, config)
        self.spark, self.conversation, self.path, self.messages = spark, conversation, path, 0
        self._key: bytes | None = S.derive_key(password, conversation.encode(), rounds)
        self._memory: dict[str, tuple[str, str]] = {}  # hash -> token, original
        if path is not None and self._there():
            stored = spark.read.schema(self.SCHEMA).parquet(path).where(F.col("doc") == conversation)
            self._memory = {r["hash"]: (r["token"], r["original"]) for r in S.decrypt(stored, "original", self._key).collect()}

    def _there(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _alive(self) -> None:
        if self._key is None:
            raise SessionExpired("the session was closed")

    def redact(self, text: str) -> str:
        """The text with a token for each finding; the same value has the same token in every message."""
        self._alive()
        self.messages += 1
        new, out, edge = {}, text, len(text)
        for s in sorted(self._client.scan(text), key=lambda s: -s["start"]):
            if s["end"] > edge:
                continue
            key = hashlib.sha256(s["text"].strip(" ").lower().encode()).hexdigest()
            if key not in self._memory:
                short = re.sub("^(?:NAME_|DATE_|ID_)", "", s["entity_type"])
                n = sum(t.startswith(f"[{short}_") and t[len(short) + 2 : -1].isdigit() for t, _ in self._memory.values()) + 1
                self._memory[key] = new[key] = (f"[{short}_{n}]", s["text"])
            out, edge = out[: s["start"]] + self._memory[key][0] + out[s["end"] :], s["start"]
        if new and self.path is not None:
            rows = self.spark.createDataFrame([(self.conversation, t, h, o) for h, (t, o) in new.items()], "doc string, token string, hash string, original string")
            S.encrypt(rows, "original", self._key).write.mode("append").parquet(self.path)
        return out

    def restore(self, text: str) -> str:
        """Known tokens become their originals, whatever their case; unknown ones stay."""
        self._alive()
        known = {t.lower(): o for t, o in self._memory.values()}
        return re.sub(r"\[[A-Za-z_]+_\d+\]", lambda m: known.get(m.group().lower(), m.group()), text)

    def tokens(self) -> dict[str, str]:
        self._alive()
        return dict(self._memory.values())

    def stats(self) -> dict[str, int]:
        self._alive()
        return {"messages": self.messages, "tokens": len(self._memory)}

    def close(self) -> None:
        self._key, self._memory = None, {}
        self._client.close()
