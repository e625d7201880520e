"""Splits that keep related records together (problem 5).

Records and the entities they name (document, conversation) form a bipartite
graph.  Minimum labels are propagated over its distinct edges until nothing
moves; the label is the group.  Groups are then assigned to splits so that the
label counts of each split come near its share of all.  The few groups that
are large against the table go one by one, each to the split where the sum of
squared misses over all labels is least afterwards.  All others are placed by
their position in a random order within their stratum (their most frequent
label), which is cut at the proportions that the large groups leave open *for
this label*, so what those have put out of balance is made up for.

Labels are counted in ``label_classes`` classes of their hash, so what the
driver holds is bounded; with fewer labels than that each has its own, but for
chance.  Positions are sums over 1,024 bands of the random order and within a
band, so no task orders a whole stratum.

Defined results
---------------
* null document: the row is linked by its conversation only;
* conversation null, blank, ``none``, ``n/a`` ... (``MISSING``): links nothing;
* row with neither: a group of its own, by its id;
* document written in another way: the same document;
* repeated rows of an id: assigned once, counted once;
* empty table: no rows;
* further columns of the input are not touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.components import components
from veilwork.runtime import clean_key, stage

#: How a missing conversation may be written, after trimming and in lower case (fixed values).
MISSING = ["", "none", "n/a", "na", "null", "nan", "-", "unknown"]


def _conversation(col):
    bare = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(~bare.isin(MISSING), bare)


def groups(rows: DataFrame, document_col: str = "document_id", conversation_col: str = "conversation_id") -> DataFrame:
    """(node, label): the group of every document (``d:`` key) and conversation (``c:`` key)."""
    d = F.concat(F.lit("d:"), clean_key(F.col(document_col)))
    c = F.concat(F.lit("c:"), _conversation(F.col(conversation_col)))
    pairs = rows.select(d.alias("a"), c.alias("b")).distinct()
    # a node without a partner is linked to itself
    return components(pairs.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a IS NOT NULL"))


def _members(rows: DataFrame, document_col: str, conversation_col: str) -> DataFrame:
    own = rows.withColumns({"_d": F.concat(F.lit("d:"), clean_key(F.col(document_col))), "_c": F.concat(F.lit("c:"), _conversation(F.col(conversation_col)))})
    return own.withColumn("_node", F.coalesce("_d", "_c"))


def same_split_values(rows: DataFrame, document_col: str = "document_id", conversation_col: str = "conversation_id") -> DataFrame:
    """Pairs (document_id_a, document_id_b) of stored document values that are in one group."""
    values = rows.select(F.col(document_col).alias("value")).where("value IS NOT NULL").distinct()
    own = values.withColumn("node", F.concat(F.lit("d:"), clean_key(F.col("value")))).join(groups(rows, document_col, conversation_col), "node").select("value", "label")
    own = stage(own)
    a, b = own.select("label", F.col("value").alias("document_id_a")), own.select("label", F.col("value").alias("document_id_b"))
    return a.join(b, "label").where("document_id_a < document_id_b").select("document_id_a", "document_id_b")


def assign_splits(
    rows: DataFrame,
    proportions: dict[str, float] | None = None,
    id_col: str = "id",
    document_col: str = "document_id",
    conversation_col: str = "conversation_id",
    label_col: str = "merged_type",
    large_share: int = 500,
    label_classes: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """(id, group, split), one row per id.

    A group is large if it holds more than one in ``large_share`` of the rows,
    so at most ``large_share`` groups are assigned on the driver.
    """
    proportions = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    names, whole = list(proportions), sum(proportions.values())
    target = [proportions[n] / whole for n in names]
    own = _members(
        rows.select(F.col(id_col).cast("string").alias("id"), F.col(document_col).alias("doc"), F.col(conversation_col).alias("conv"), F.pmod(F.xxhash64(F.coalesce(F.col(label_col), F.lit(""))), F.lit(label_classes)).cast("int").alias("label_of")),
        "doc",
        "conv",
    ).groupBy("id").agg(F.min("_node").alias("node"), F.min("label_of").alias("label_of"))
    found = groups(rows, document_col, conversation_col)
    own = stage(own.join(found, "node", "left").select("id", F.coalesce("label", F.concat(F.lit("r:"), F.col("id"))).alias("grp"), "label_of"))
    sizes = stage(
        own.groupBy("grp", "label_of").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("grp").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label_of")).alias("m"))
        .select("grp", "n", F.col("m.label_of").alias("stratum"))
    )
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("n") > F.lit(total / large_share)).select("grp", "n").orderBy(F.desc("n"), "grp").collect()
    overall = np.zeros(label_classes)
    for r in own.groupBy("label_of").agg(F.count(F.lit(1)).alias("n")).collect():
        overall[r["label_of"]] = r["n"]
    counts: dict[str, np.ndarray] = {r["grp"]: np.zeros(label_classes) for r in large}
    if large:
        chosen_groups = F.broadcast(sizes.where(F.col("n") > F.lit(total / large_share)).select("grp"))
        for r in own.join(chosen_groups, "grp").groupBy("grp", "label_of").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["grp"]][r["label_of"]] = r["n"]
    share, weight = np.array(target), 1 / np.maximum(overall, 1)
    have, chosen = np.zeros((len(names), label_classes)), []
    for r in large:
        # squared misses of all labels in units of their frequency, and of the size; what exceeds a share counts, what is still open does not
        after = have + counts[r["grp"]]
        over = np.maximum(after - share[:, None] * overall, 0) ** 2 - np.maximum(have - share[:, None] * overall, 0) ** 2
        size = np.maximum(after.sum(1) - share * total, 0) ** 2 - np.maximum(have.sum(1) - share * total, 0) ** 2
        filled = after.sum(1) / np.maximum(share * total, 1)
        cost = over @ weight + size / max(total, 1)
        k = min(range(len(names)), key=lambda k: (round(float(cost[k]), 6), round(float(filled[k]), 6), k))  # noqa: B023
        have[k] += counts[r["grp"]]
        chosen.append((r["grp"], names[k]))
    # what is open of each label, and the shares at which its stratum is cut
    open_ = np.maximum(share[:, None] * overall - have, 0)
    spare = np.maximum(share * total - have.sum(1), 0)
    open_ = np.where(open_.sum(0) > 0, open_, spare[:, None])
    upto = np.cumsum(open_, 0) / np.maximum(open_.sum(0), 1e-9)
    spark = rows.sparkSession
    fixed = F.broadcast(spark.createDataFrame(chosen, "grp string, fixed string"))
    cuts = F.broadcast(spark.createDataFrame([(k, upto[:-1, k].tolist()) for k in np.flatnonzero(overall).tolist()], "stratum int, cuts array<double>"))
    h = F.xxhash64(F.lit(seed), "grp")
    small = sizes.join(fixed, "grp", "left_anti").withColumn("band", F.shiftright(h, 54))
    bands = small.groupBy("stratum", "band").agg(F.sum("n").alias("in_band"))
    w = Window.partitionBy("stratum").orderBy("band")
    bands = bands.select("stratum", "band", (F.sum("in_band").over(w) - F.col("in_band")).alias("before"), F.sum("in_band").over(Window.partitionBy("stratum")).alias("all"))
    within = F.sum("n").over(Window.partitionBy("stratum", "band").orderBy(h, "grp")) - F.col("n") / 2
    placed = small.withColumn("within", within).join(bands, ["stratum", "band"]).join(cuts, "stratum")
    at = F.size(F.filter("cuts", lambda c: c <= (F.col("before") + F.col("within")) / F.col("all")))
    placed = placed.select("grp", F.element_at(F.array(*map(F.lit, names)), at + 1).alias("split")).unionByName(fixed.select("grp", F.col("fixed").alias("split")))
    return own.join(placed, "grp").select("id", F.col("grp").alias("group"), "split")
