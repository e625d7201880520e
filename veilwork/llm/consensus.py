"""Consensus from several annotators' labels (problem 3).

Labels of each annotator are mapped to common types, then every item is a
tuple of one type (or none) per annotator.  Items with the same tuple have the
same posterior, so the corpus is aggregated to distinct tuples first; with K
types and D annotators there are at most (K + 1) ** D of them however many
items there are; they are counted before they are fetched, and more than
``most_tuples`` are refused.  On these counts expectation-maximisation estimates one
confusion matrix per annotator and a type distribution per tuple, with
additive smoothing.  Chance-corrected agreement (Fleiss' kappa for a varying
number of annotators) is reported separately and does not steer the estimate.

Defined results
---------------
* null, empty or blank label: the annotator did not label the item;
* label that the mapping does not hold: the same (it names no known type);
* repeated item: counts once (the smallest type per annotator, should they differ);
* item without any known label: no consensus row;
* tie of posteriors: the alphabetically first type;
* empty table: no rows; empty mapping: no rows;
* further columns of the inputs are not touched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.runtime import stage


def labelled_items(spans: DataFrame, labels: DataFrame, detectors: list[str], id_col: str = "id") -> DataFrame:
    """One row per item: ``item`` and, per detector, the common type it named (or null)."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    known = labels.select(
        clean(F.col("detector")).alias("_d"), clean(F.col("raw_label")).alias("_l"), F.col("entity_type").alias("_t")
    ).dropna()
    out = spans.select(F.col(id_col).alias("item"), *(clean(F.col(f"{d}_type")).alias(d) for d in detectors))
    for d in detectors:
        # no hint: Spark broadcasts the mapping only if it is small enough
        own = known.where(F.col("_d") == d.lower()).groupBy("_l").agg(F.min("_t").alias("_t"))
        out = out.join(own, out[d] == own["_l"], "left").drop("_l", d).withColumnRenamed("_t", d)
    return out.groupBy("item").agg(*(F.min(d).alias(d) for d in detectors))


class Consensus:
    """Fitted confusion matrices, posteriors per label tuple, and agreement."""

    def __init__(self, items: DataFrame, detectors: list[str], smoothing: float = 0.5, rounds: int = 200, tolerance: float = 1e-7, most_tuples: int = 1_000_000):
        self.items, self.detectors = items, detectors
        tuples = stage(items.where(F.coalesce(*map(F.col, detectors)).isNotNull()).groupBy(*detectors).agg(F.count(F.lit(1)).alias("n")))
        if (found := tuples.count()) > most_tuples:
            raise ValueError(f"{found} distinct label tuples, more than most_tuples = {most_tuples}: map the labels to fewer types")
        rows = tuples.orderBy(*detectors).collect()
        self.types = sorted({r[d] for r in rows for d in detectors if r[d] is not None})
        at = {t: i for i, t in enumerate(self.types)}
        self.votes = np.array([[at.get(r[d], -1) for d in detectors] for r in rows], int).reshape(len(rows), len(detectors))
        self.weight = np.array([r["n"] for r in rows], float)
        self._fit(smoothing, rounds, tolerance)

    def _fit(self, smoothing: float, rounds: int, tolerance: float) -> None:
        k, (n, d) = len(self.types), self.votes.shape
        given = [np.flatnonzero(self.votes[:, j] >= 0) for j in range(d)]
        post = np.full((n, k), 1e-9)
        for j, rows in enumerate(given):  # start from the vote shares
            np.add.at(post, (rows, self.votes[rows, j]), 1)
        post /= post.sum(1, keepdims=True) if n else 1
        for self.rounds in range(1, rounds + 1):
            mass = post * self.weight[:, None]
            prior = mass.sum(0) + smoothing
            self.prior = prior / prior.sum() if k else prior
            self.confusion = np.full((d, k, k), smoothing / max(k, 1))
            score = np.tile(np.log(self.prior), (n, 1))
            for j, rows in enumerate(given):
                np.add.at(self.confusion[j].T, self.votes[rows, j], mass[rows])
                self.confusion[j] /= self.confusion[j].sum(1, keepdims=True)
                score[rows] += np.log(self.confusion[j][:, self.votes[rows, j]]).T
            new = np.exp(score - score.max(1, keepdims=True)) if n else score
            new /= new.sum(1, keepdims=True) if n else 1
            moved, post = float(np.abs(new - post).max(initial=0)), new
            if moved < tolerance:
                break
        self.post = post

    def _fleiss(self) -> float | None:
        """Kappa over items with two or more labels."""
        k = len(self.types)
        counts = np.stack([(self.votes == t).sum(1) for t in range(k)], 1) if k else np.zeros((0, 0))
        m = counts.sum(1) if k else np.zeros(0)
        use = m >= 2
        if not use.any():
            return None
        c, m, w = counts[use], m[use], self.weight[use]
        seen = float((w * (c * (c - 1)).sum(1) / (m * (m - 1))).sum() / w.sum())
        share = (w[:, None] * c).sum(0) / (w * m).sum()
        chance = float((share**2).sum())
        return 1.0 if chance == 1 else (seen - chance) / (1 - chance)

    def consensus(self) -> DataFrame:
        """item, entity_type, posterior, agreement (share of the given labels equal to the consensus), n_labels, disputed."""
        schema = T.StructType(
            [T.StructField(d, T.StringType()) for d in self.detectors]
            + [
                T.StructField("entity_type", T.StringType()),
                T.StructField("posterior", T.DoubleType()),
                T.StructField("agreement", T.DoubleType()),
                T.StructField("n_labels", T.IntegerType()),
                T.StructField("disputed", T.BooleanType()),
            ]
        )
        rows = []
        for v, p in zip(self.votes, self.post):
            best, own = int(p.argmax()), v[v >= 0]
            rows.append((*(self.types[x] if x >= 0 else None for x in v), self.types[best], float(p[best]), float((own == best).mean()), len(own), len(set(own)) > 1))
        fitted = self.items.sparkSession.createDataFrame(rows, schema)
        on = None
        a, b = self.items.alias("a"), fitted.alias("b")
        for d in self.detectors:
            same = F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}"))
            on = same if on is None else on & same
        return a.join(b, on).select("a.item", "b.entity_type", "b.posterior", "b.agreement", "b.n_labels", "b.disputed")

    def reliability(self) -> DataFrame:
        """detector, entity_type, named_type, probability: the fitted confusion matrices."""
        rows = [
            (d, t, u, float(self.confusion[j, a, b]))
            for j, d in enumerate(self.detectors)
            for a, t in enumerate(self.types)
            for b, u in enumerate(self.types)
        ]
        return self.items.sparkSession.createDataFrame(rows, "detector string, entity_type string, named_type string, probability double")

    def agreement(self) -> DataFrame:
        """scope, kappa: Fleiss over all detectors and Cohen for each pair; null where nothing overlaps."""
        rows = [("all", self._fleiss())]
        for i, j in combinations(range(len(self.detectors)), 2):
            use = (self.votes[:, i] >= 0) & (self.votes[:, j] >= 0)
            w, x, y = self.weight[use], self.votes[use, i], self.votes[use, j]
            if not w.sum():
                rows.append((f"{self.detectors[i]}~{self.detectors[j]}", None))
                continue
            k = len(self.types)
            seen = float(w[x == y].sum() / w.sum())
            chance = float((np.bincount(x, w, k) * np.bincount(y, w, k)).sum() / w.sum() ** 2)
            rows.append((f"{self.detectors[i]}~{self.detectors[j]}", 1.0 if chance == 1 else (seen - chance) / (1 - chance)))
        return self.items.sparkSession.createDataFrame(rows, "scope string, kappa double")


DETECTORS = ["phi_bert", "pii_bert", "presidio", "rule"]


def fit_consensus(spans: DataFrame, labels: DataFrame, detectors: list[str] | None = None, **options) -> Consensus:
    """Map, aggregate and fit; the items are staged because they are read twice."""
    detectors = detectors or DETECTORS
    return Consensus(stage(labelled_items(spans, labels, detectors)), detectors, **options)
