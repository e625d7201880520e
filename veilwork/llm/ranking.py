"""One ranking from several differently-scaled scores (problem 4).

Each score is first replaced by its standing among all values of that score in
the table (its empirical distribution function, read off a mergeable quantile
sketch and interpolated, so that no score is favoured by its range or shape).
The standings are centred at their median, divided by their median absolute
deviation, squashed by the logistic function and combined by a weighted
geometric mean.  A missing score takes standing 0, below every present one.

The sketch holds ``grid`` quantiles per score whatever the number of rows;
it covers every row.  A standing read off it is at most 1 / ``accuracy`` +
1 / ``grid`` (0.00055) from the exact one.

Defined results
---------------
* score null, NaN, or its detector did not fire: missing;
* all scores missing: the lowest possible rank value, not null;
* equal rank values: the smaller id comes first;
* repeated rows: one row per (group, id), the largest value of each score;
* group without rows: no row; empty tables: no rows;
* a score with a single value: every present row stands at 0.5;
* further columns of the inputs are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.runtime import clean_key, stage


@dataclass(frozen=True)
class Score:
    """A score column, the flag that says whether it is present, and its weight."""

    column: str
    flag: str | None = None
    weight: float = 1.0


SPAN_SCORES = [
    Score("phi_bert_conf", "phi_bert_detected"),
    Score("presidio_conf", "presidio_detected"),
    Score("rule_conf", "rule_detected"),
    Score("llm_conf", "llm_verified"),
]


def _present(s: Score):
    value = F.col(s.column).cast("double")
    ok = value.isNotNull() & ~F.isnan(value)
    if s.flag:
        ok = ok & (F.coalesce(F.col(s.flag).cast("int"), F.lit(0)) == 1)
    return F.when(ok, value)


def _standing(quantiles: list[float] | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Value and standing of each sketch point, and median and MAD of the standings."""
    q = np.array(quantiles or [0.0])
    u = np.linspace(0, 1, len(q)) if len(q) > 1 else np.array([0.5])
    values, first, n = np.unique(q, return_index=True, return_counts=True)
    mid = (u[first] + u[first + n - 1]) / 2  # equal values share one standing
    spread = np.repeat(mid, n)
    centre = float(np.median(spread))
    mad = 1.4826 * float(np.median(np.abs(spread - centre))) or 1.0
    return values, mid, centre, mad


def _combine(curves, weights):
    def run(batches):
        for b in batches:
            total = np.zeros(b.num_rows)
            for k, (values, mid, centre, mad) in enumerate(curves):
                x = b.column(k + 2).to_numpy(zero_copy_only=False).astype(float)
                u = np.where(np.isnan(x), 0.0, np.interp(x, values, mid))
                # present values never stand below missing ones
                total += weights[k] * -np.logaddexp(0, -(u - centre) / mad)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.exp(total / sum(weights)))], ["grp", "id", "rank_value"])

    return run


def ranked(rows: DataFrame, scores: list[Score], group_col: str, id_col: str = "id", only: DataFrame | None = None, grid: int = 2000, accuracy: int = 20_000) -> DataFrame:
    """grp, id, rank_value of the rows, or of the groups in ``only`` (column ``grp``).

    ``only`` limits which groups are returned; the standings always come from all rows.
    """
    names = [f"s{k}" for k in range(len(scores))]
    base = rows.select(clean_key(F.col(group_col)).alias("grp"), F.col(id_col).cast("string").alias("id"), *(_present(s).alias(n) for n, s in zip(names, scores, strict=True)))

    def once(df: DataFrame) -> DataFrame:  # repeated rows of one id would weigh twice
        return df.groupBy("grp", "id").agg(*(F.max(n).alias(n) for n in names))

    probs = [float(x) for x in np.linspace(0, 1, grid + 1)]
    sketch = once(base).agg(*(F.percentile_approx(n, F.array(*map(F.lit, probs)), accuracy).alias(n) for n in names)).first()
    curves = [_standing(sketch[n]) for n in names]
    own = base.where("grp IS NOT NULL AND id IS NOT NULL")
    if only is not None:
        own = own.join(only.select("grp").distinct(), "grp", "left_semi")
    own = once(own)
    out = own.select("grp", "id", *names).mapInArrow(_combine(curves, [s.weight for s in scores]), "grp string, id string, rank_value double")
    return out


def placed(ranks: DataFrame, cuts: int = 64) -> DataFrame:
    """Adds ``place`` (1 is best) within each group.

    Values are cut at ``cuts`` quantiles of all of them; a row's place is the
    number of its group's rows in higher bands plus its place in its own band,
    so that no task sorts a whole large group.
    """
    ranks = stage(ranks)
    probs = F.array(*[F.lit(k / cuts) for k in range(1, cuts)])
    edges = ranks.agg(F.percentile_approx("rank_value", probs, 10_000).alias("e")).first()["e"] or []
    band = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e <= F.col("rank_value"))) if edges else F.lit(0)
    banded = ranks.withColumn("band", band)
    sizes = banded.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("n"))
    above = sizes.select("grp", "band", (F.sum("n").over(Window.partitionBy("grp").orderBy(F.desc("band"))) - F.col("n")).alias("above"))
    own = F.row_number().over(Window.partitionBy("grp", "band").orderBy(F.desc("rank_value"), "id"))
    out = banded.withColumn("own", own).join(above, ["grp", "band"])
    return out.select("grp", "id", "rank_value", (F.col("above") + F.col("own")).cast("int").alias("place"))


def best(rows: DataFrame, scores: list[Score], group_col: str, id_col: str = "id", only: DataFrame | None = None, **options) -> DataFrame:
    """grp, id of the first row of each group; one row of state per group, so no group is too large."""
    out = ranked(rows, scores, group_col, id_col, only, **options)
    first = out.groupBy("grp").agg(F.min(F.struct((-F.col("rank_value")).alias("v"), F.col("id"))).alias("m"))
    return first.select("grp", F.col("m.id").alias("id"))
