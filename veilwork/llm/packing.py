"""Filling fixed-capacity containers with items (problem 8).

Vector best-fit: a container has room in three dimensions, tokens, documents
and attention cost (the sum of squared lengths).  Items come in order of
falling size; each goes to the open container that can take it in every
dimension and for which the weighted product of item and room, both as shares
of the capacity, is largest (``rule='dot'``), or for which the weighted norm
of what stays free is smallest (``rule='norm'``).

An item longer than the capacity is cut into full containers and a rest; no
other item is cut.  Items are spread over groups of about ``group_items`` by a
hash, each packed alone by one task, so a group's state is bounded; a group
wastes at most its few last containers.

Defined results
---------------
* size null or 0: takes no space, no row;
* item over the attention capacity by itself: a container of its own;
* repeated ids: one item, the largest size;
* ties: the smaller id first, the older container first;
* empty table: no rows;
* further columns of the input are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.runtime import stage


def best_fit(sizes: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> list[list[int]]:
    """Indices of the items of each container; ``sizes`` must fall."""
    cap, w = np.array(capacity, float), np.array(weights, float)
    need = np.stack([sizes / cap[0], np.full(len(sizes), 1 / cap[1]), sizes.astype(float) ** 2 / cap[2]], 1)
    room = np.ones((64, 3))
    live = np.zeros(0, int)  # open containers, oldest first
    bins: list[list[int]] = []
    least = need[-1] if len(need) else None
    for i, x in enumerate(need):
        pick = -1
        if len(live):
            r = room[live]
            fits = (r >= x - 1e-12).all(1)
            if fits.any():
                value = ((r - x) ** 2) @ w if rule == "norm" else -((r * x) @ w)
                value[~fits] = np.inf
                pick = int(live[int(value.argmin())])
        if pick < 0:
            pick = len(bins)
            bins.append([])
            if pick >= len(room):
                room = np.concatenate([room, np.ones_like(room)])
            live = np.append(live, pick)
        bins[pick].append(i)
        room[pick] -= x
        if (room[pick] < least - 1e-12).any():  # nothing fits any more
            live = live[live != pick]
    return bins


def _pack(capacity, weights, rule):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        n = pdf["n"].to_numpy()
        where, place, offset = np.zeros(len(n), int), np.zeros(len(n), int), np.zeros(len(n), int)
        for k, items in enumerate(best_fit(n, capacity, weights, rule)):
            where[items], place[items] = k, np.arange(len(items))
            offset[items] = np.concatenate([[0], np.cumsum(n[items])[:-1]])
        return pdf.assign(container=[f"g{key[0]}-{k}" for k in where], place=place.astype("int32"), start_at=offset.astype("int32")).drop(columns="grp")

    return run


def pack(
    items: DataFrame,
    id_col: str,
    size_col: str,
    capacity: int = 2048,
    max_documents: int = 32,
    attention_capacity: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1),
    rule: str = "norm",
    group_items: int = 8_000,
) -> DataFrame:
    """(id, piece, first, n, container, place, start_at).

    ``attention_capacity`` is three quarters of ``capacity`` squared unless given.

    ``first`` is where the piece begins in its item, ``place`` its number in
    the container, ``start_at`` the first of its positions there.
    """
    kind = items.schema[id_col].dataType.simpleString()
    own = stage(
        items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size"))
        .where("size > 0 AND id IS NOT NULL").groupBy("id").agg(F.max("size").alias("size"))
    )
    rests = own.where(F.col("size") % capacity != 0).select(
        "id", F.floor(F.col("size") / capacity).cast("int").alias("piece"), (F.col("size") - F.col("size") % capacity).alias("first"), (F.col("size") % capacity).cast("int").alias("n")
    )
    full = own.where(F.col("size") >= capacity).select("id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("size") / capacity) - 1).cast("int"))).alias("piece"))
    full = full.select(
        "id", "piece", (F.col("piece").cast("long") * capacity).alias("first"), F.lit(capacity).alias("n"),
        F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), F.lit(0).alias("place"), F.lit(0).alias("start_at"),
    )
    groups = max(1, math.ceil(own.count() / group_items))
    limits = (float(capacity), float(max_documents), float(attention_capacity or 0.75 * capacity**2))
    packed = rests.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups))).groupBy("grp").applyInPandas(
        _pack(limits, weights, rule), f"id {kind}, piece int, first long, n int, container string, place int, start_at int"
    )
    return packed.unionByName(full)


def fill_report(packed: DataFrame, capacity: int = 2048, max_documents: int = 32, attention_capacity: float | None = None) -> DataFrame:
    """containers, pieces, tokens, the share of each capacity that is used, and how many containers are full in which dimension (none can take one more piece of the mean size)."""
    cost = F.col("n").cast("double") * F.col("n")
    limit = float(attention_capacity or 0.75 * capacity**2)
    per = packed.groupBy("container").agg(F.sum("n").alias("used"), F.count(F.lit(1)).alias("items"), F.sum(cost).alias("cost"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("items").alias("pieces"),
        F.sum("used").alias("tokens"),
        (F.sum("used") / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("filled"),
        (F.sum("items") / (F.count(F.lit(1)) * F.lit(float(max_documents)))).alias("documents_filled"),
        (F.sum("cost") / (F.count(F.lit(1)) * F.lit(limit))).alias("attention_filled"),
        F.count(F.when(F.col("items") >= max_documents, 1)).alias("full_by_documents"),
        F.count(F.when(F.col("cost") >= 0.95 * limit, 1)).alias("full_by_attention"),
    )
