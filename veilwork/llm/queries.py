"""Registered queries of the training-data operators; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import consensus, encoding, packing, pii, ranking, splits
from veilwork.llm.near_duplicates import NearDuplicates
from veilwork.llm.shared_spans import SharedSpans
from veilwork.llm.sql import oracle_sql  # noqa: F401
from veilwork.runtime import clean_key, stage, table


def _sanitiser(spark: SparkSession, sf_dir: str) -> pii.Sanitiser:
    texts = table(spark, sf_dir, "scan_documents").select("content").unionByName(table(spark, sf_dir, "messages").select("content"))
    return pii.Sanitiser(pii.Disclosure(texts, "content", table(spark, sf_dir, "dictionary_terms")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = _sanitiser(spark, sf_dir), None
    for name in ("scan_documents", "messages"):
        part = s.found(table(spark, sf_dir, name), "id", "content")
        part = part.select(F.lit(name).alias("source_table"), F.col("id").alias("record_id"), "start_idx", "end_idx", "kind")
        out = part if out is None else out.unionByName(part)
    return out


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = _sanitiser(spark, sf_dir), None
    for name in ("scan_documents", "messages"):
        part = s.redacted(table(spark, sf_dir, name), "id", "content").select(F.lit(name).alias("source_table"), F.col("id").alias("record_id"), "redacted")
        out = part if out is None else out.unionByName(part)
    return out


def p2_near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "scan_documents"), "id", "content", threshold=0.7, words_per=3)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_near(spark, sf_dir).pairs().select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_near(spark, sf_dir).groups()


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    return consensus.fit_consensus(table(spark, sf_dir, "span_signals"), table(spark, sf_dir, "detector_labels"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).consensus().where("disputed").select(F.col("item").alias("id"), "entity_type")


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).consensus()


def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).reliability()


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).agreement()


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "review_batches").select("document_id", clean_key(F.col("document_id")).alias("grp")).where("grp IS NOT NULL").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = _reviewed(spark, sf_dir)
    first = ranking.best(table(spark, sf_dir, "span_signals"), ranking.SPAN_SCORES, "document_id", only=reviewed)
    return first.join(reviewed, "grp").select("document_id", "id")


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.placed(ranking.ranked(table(spark, sf_dir, "span_signals"), ranking.SPAN_SCORES, "document_id", only=_reviewed(spark, sf_dir)))
    return rows.select(F.col("grp").alias("document_id"), "id", "rank_value", "place")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.same_split_values(table(spark, sf_dir, "signals"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "signals"))


def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and groups, groups that are torn (none may be), and the splits' shares in tenths."""
    rows = stage(p5_splits(spark, sf_dir))
    torn = rows.groupBy("group").agg(F.count_distinct("split").alias("c")).agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(F.col("c") > 1, 1)).alias("n_torn"))
    share = lambda name: F.round(10 * F.count(F.when(F.col("split") == name, 1)) / F.count(F.lit(1))).cast("int").alias(f"{name}_tenths")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *map(share, ("train", "validation", "test"))).crossJoin(F.broadcast(torn))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoding.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.col("tokens").alias("ids"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", F.size("tokens").alias("size"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir), "id", "size").withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_packing(spark, sf_dir))


def p8_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full containers get when documents and attention are scarce."""
    limits = {"max_documents": 16, "attention_capacity": 2048.0**2 / 2}
    return packing.fill_report(packing.pack(_sized(spark, sf_dir), "id", "size", **limits), **limits)


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, and containers that break a limit (none may): tokens, documents, attention, gaps between places."""
    packed = stage(p8_packing(spark, sf_dir))
    per = packed.groupBy("container").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"), F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"), F.max(F.col("start_at") + F.col("n")).alias("end"))
    whole = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("size"))
    cut = whole.where((F.col("pieces") > 1) & (F.col("size") <= 2048)).agg(F.count(F.lit(1)).alias("cut_needlessly"))
    over = per.agg(
        F.count(F.when(F.col("n") > 2048, 1)).alias("over_tokens"),
        F.count(F.when(F.col("items") > 32, 1)).alias("over_documents"),
        F.count(F.when((F.col("cost") > 0.75 * 2048**2) & (F.col("items") > 1), 1)).alias("over_attention"),
        F.count(F.when(F.col("end") != F.col("n"), 1)).alias("with_gaps"),
    )
    return whole.agg(F.count(F.lit(1)).alias("n_documents")).crossJoin(F.broadcast(over)).crossJoin(F.broadcast(cut))


def p9_spans(spark: SparkSession, sf_dir: str) -> SharedSpans:
    return SharedSpans(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).pairs().select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).coverage().withColumnRenamed("id", "doc_id")


def p9_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor list of each document: where it and a reference document have 200 code points or more in common."""
    return p9_spans(spark, sf_dir).factor_list().withColumnsRenamed({"id": "doc_id", "ref_id": "ref_doc_id"})


def queries():
    names = "p1_found p1_redacted p2_found p2_groups p3_found p3_consensus p3_reliability p3_agreement p4_found p4_ranking p5_found p5_splits p5_balance p7_ids p8_packing p8_fill p8_tight p8_limits p9_found p9_coverage p9_factors"
    return {n: globals()[n] for n in names.split()}
