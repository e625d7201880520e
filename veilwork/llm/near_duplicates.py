"""Near-duplicate records with small edits (problem 2).

One-permutation hashing: a text's distinct word shingles are hashed once; the
top bits choose one of ``bins`` bins, whose smallest hash is kept.  Empty bins
borrow from full ones by optimal densification (bin and attempt, hashed, name
the lender).  The bins are cut into bands; texts that agree in a whole band
fall into one bucket.  A bucket is a star: every member is a candidate of the
bucket's smallest member, so a bucket of m members gives m - 1 edges, which are
checked exactly.  Members that are near a centre are done with that bucket; the
others stay and form stars around the next smallest of them, round by round
with eight times as many centres, until each has a near centre or is alone.

No link between leaves is lost: the distance 1 - similarity obeys the triangle
inequality, so when a leaf is done by its centre, each leaf that is similar to
it is at most 1 - threshold further from that centre.  Leaves up to there are
candidates of the near ones and checked exactly too.  The leaves of a large
star are cut into parts of about ``leaves``, so no task holds all its pairs.

Texts with equal shingle sets are one class, whose smallest id stands for it.

With 32 bands of 4 bins a pair of similarity 0.7 shares a bucket with a
probability of 0.9998, one of 0.8 of 0.9999999.

Defined results
---------------
* null, empty, blank text and text with fewer words than a shingle: no part in any pair or group of more than one;
* repeated rows: one record; an id with several texts: each text may link it;
* texts that differ in case or blanks only: similarity 1;
* empty table: no rows;
* further columns of the input are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.components import components
from veilwork.llm.rolling import mix
from veilwork.runtime import join_sized, stage

_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def shingles(texts: pa.Array, words_per: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct and sorted; words are what blanks, tabs, CR and LF separate."""
    lists = pc.split_pattern_regex(pc.utf8_trim(texts.cast(pa.large_string()), characters=" \t\r\n"), pattern="[ \t\r\n]+")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    values = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = values[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    if len(h) < words_per:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = np.zeros(len(h) - words_per + 1, np.uint64)
    for k in range(words_per):
        s += mix(h[k : len(h) - words_per + 1 + k] * np.uint64(_FACTORS[k % 7]) + np.uint64(k))
    whole = doc[: len(s)] == doc[words_per - 1 :]
    s, d = mix(s[whole]), doc[: len(s)][whole]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return d[first], s[first]


def densified(doc: np.ndarray, s: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One-permutation sketch, (n, bins); rows of texts without shingles stay zero."""
    shift = np.uint64(64 - (bins - 1).bit_length())
    at = (s >> shift).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    sketch, full = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    sketch[doc[first], at[first]] = s[first]  # sorted, so the first of a bin is its smallest
    full[doc[first], at[first]] = True
    rows, cols = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        lender = (mix(cols.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = full[rows, lender]
        sketch[rows[ok], cols[ok]] = sketch[rows[ok], lender[ok]]
        rows, cols = rows[~ok], cols[~ok]
    return sketch


def _sketches(words_per: int, bands: int, width: int):
    def run(batches):
        for b in batches:
            d, s = shingles(b.column(1), words_per)
            sketch = densified(d, s, b.num_rows, bands * width)
            key = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], b.num_rows, 0)
            for k in range(width):
                key = mix(key * np.uint64(_FACTORS[k % 7]) + sketch[:, k::width])
            size = np.bincount(d, minlength=b.num_rows)
            use = pa.array(np.flatnonzero(size))
            m = mix(s)
            sums = [np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)]
            np.add.at(sums[0], d, m)
            np.bitwise_xor.at(sums[1], d, mix(m + np.uint64(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * b.num_rows + 1, bands, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))
            cols = [b.column(0), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(size.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays([c.take(use) for c in cols], ["id", "k1", "k2", "n", "bands"])

    return run


def _sets(words_per: int):
    def run(batches):
        for b in batches:
            d, s = shingles(b.column(1), words_per)
            cuts = np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(s.view(np.int64)))], ["id", "set"])

    return run


class NearDuplicates:
    """``members`` (id, rep, n, cls) of each class of equal shingle sets, ``links`` between classes, ``groups``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, words_per: int = 5, bands: int = 32, width: int = 4, near: float = 0.35, leaves: int = 1000):
        if bands * width & (bands * width - 1):
            raise ValueError("bands * width must be a power of two")
        kind = docs.schema[id_col].dataType.simpleString()
        self._ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
        own = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
        rows = stage(own.mapInArrow(_sketches(words_per, bands, width), f"id {kind}, k1 long, k2 long, n int, bands array<long>"))
        heads = rows.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
        self.members = stage(rows.select("id", "k1", "k2", "n").distinct().join(heads, ["k1", "k2", "n"]).select("id", "rep", "n", F.xxhash64("k1", "k2").alias("cls")))
        leads = stage(self.members.where("id = rep").select("id", "cls", "n"))
        sketch = rows.withColumn("cls", F.xxhash64("k1", "k2")).join(leads.select("id", "cls"), ["id", "cls"], "left_semi").dropDuplicates(["id", "cls"])
        held = sketch.select("id", "cls", "n", F.explode("bands").alias("band"))
        # only buckets of two or more texts matter; to find them the band alone is shuffled
        shared = stage(held.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band"))
        inside = stage(join_sized(held, shared, "band", "left_semi"))
        wanted = stage(inside.select("id").distinct())
        sets = join_sized(own, wanted, "id", "left_semi").mapInArrow(_sets(words_per), f"id {kind}, set array<long>")
        # an id with several texts has several sets: the class is told by its sums, as above
        self._sets = stage(sets.join(leads.select("id", "cls", "n"), "id").where(F.size("set") == F.col("n")).dropDuplicates(["id", "cls"]).select("cls", "set"))
        self.threshold, self.near, self.leaves = threshold, near, leaves
        self._star, self._reached = self._stars(inside)
        self._near = self._reached.where(F.col("similarity") >= min(near, threshold))
        self._links: DataFrame | None = None

    def _stars(self, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The star edges of all rounds, and those of them that reach as far as a leaf similar to a near one."""
        # what is similar to a near leaf has at least this share of the centre's size, and this similarity to it
        least, reach = self.near * self.threshold - 1e-9, max(self.near + self.threshold - 1, 0.0) - 1e-9
        star = reached = None
        centres = 1
        while star is None or not inside.isEmpty():
            place = F.row_number().over(Window.partitionBy("band").orderBy("id", "cls"))
            heads = inside.withColumn("place", place).where(F.col("place") <= centres).select("band", F.struct("id", "cls").alias("m"), F.col("n").alias("na"))
            held = inside.join(heads, "band").where(F.struct("id", "cls") > F.col("m"))
            held = held.select("band", F.col("m.id").alias("a"), F.col("m.cls").alias("ca"), "na", F.col("id").alias("b"), F.col("cls").alias("cb"), F.col("n").alias("nb"))
            held = stage(held.where(F.least("na", "nb") >= least * F.greatest("na", "nb")))
            new = held.drop("band").distinct()
            new = stage(new if star is None else new.join(star, ["ca", "cb"], "left_anti").select(star.columns))
            similar = stage(self._similar(new, reach))
            star, reached = (new, similar) if star is None else (star.unionByName(new), reached.unionByName(similar))
            ended = held.join(reached.where(F.col("similarity") >= self.near).select("ca", "cb"), ["ca", "cb"]).select("band", F.col("cb").alias("cls"))
            left = inside.join(heads.select("band", F.col("m.cls").alias("cls")).unionByName(ended), ["band", "cls"], "left_anti")
            inside = stage(left.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("c > 1").select(inside.columns))
            centres *= 8
        return star, reached

    @property
    def links(self) -> DataFrame:
        """(a, ca, b, cb, similarity) of every two similar classes."""
        if self._links is None:
            strong = self._near.where(F.col("similarity") >= self.threshold).select("a", "ca", "b", "cb", "similarity")
            self._links = stage(strong.unionByName(self._leaf_links(F.lit(True))))
        return self._links

    def _leaf_links(self, wanted: Column) -> DataFrame:
        """Similar leaves of one centre; ``wanted`` may use their similarities to it, s2 and s3."""
        x, y = (d.select("ca", F.struct(F.col("cb").alias("c"), F.col("b").alias("id"), F.col("nb").alias("n")).alias(f"l{k}"), F.col("similarity").alias(f"s{k}")) for k, d in ((2, self._near), (3, self._reached)))
        # a centre of many leaves is cut into parts: each leaf of one side meets all parts of the other
        parts = stage(y.groupBy("ca").agg(F.ceil(F.count(F.lit(1)) / self.leaves).cast("int").alias("parts")))
        x = x.join(parts, "ca").withColumn("part", F.pmod(F.xxhash64("l2.c"), "parts").cast("int")).drop("parts")
        y = y.join(parts, "ca").select("ca", "l3", "s3", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        both = x.join(y, ["ca", "part"]).where((F.col("l2.c") < F.col("l3.c")) | (F.col("s3") < min(self.near, self.threshold)))
        # no two similar leaves differ by more than 1 - threshold in their similarity to a third
        both = both.where(wanted & (F.abs(F.col("s2") - F.col("s3")) <= 1 - self.threshold + 1e-9) & (F.least("l2.n", "l3.n") >= F.lit(self.threshold) * F.greatest("l2.n", "l3.n")))
        both = both.select(F.least("l2", "l3").alias("p"), F.greatest("l2", "l3").alias("q"))
        both = both.select(F.col("p.id").alias("a"), F.col("p.c").alias("ca"), F.col("p.n").alias("na"), F.col("q.id").alias("b"), F.col("q.c").alias("cb"), F.col("q.n").alias("nb")).distinct()
        done = self._star.select("ca", "cb").unionByName(self._star.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        return self._similar(both.join(done, ["ca", "cb"], "left_anti"), self.threshold).select("a", "ca", "b", "cb", "similarity")

    def _similar(self, pairs: DataFrame, least: float) -> DataFrame:
        """The pairs whose shingle sets have a similarity of ``least`` or more."""
        s = self._sets
        out = pairs.join(s.select(F.col("cls").alias("ca"), F.col("set").alias("sa")), "ca").join(s.select(F.col("cls").alias("cb"), F.col("set").alias("sb")), "cb")
        common = F.size(F.array_intersect("sa", "sb"))
        out = out.withColumn("common", common).withColumn("similarity", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
        return out.where(F.col("similarity") >= least).drop("sa", "sb", "common")

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every two ids that are similar enough, equal ones included."""
        m = self.members.select("id", "cls").distinct()
        a, b = m.select(F.col("cls").alias("ca"), F.col("id").alias("u")), m.select(F.col("cls").alias("cb"), F.col("id").alias("v"))
        linked = self.links.select("ca", "cb").join(a, "ca").join(b, "cb").select("u", "v")
        equal = a.join(b.withColumnRenamed("cb", "ca"), "ca").select("u", "v")
        both = linked.unionByName(equal).where("u <> v")
        return both.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    def groups(self) -> DataFrame:
        """(id, group_id, n_members): one row per record; group_id is the smallest id of its group.

        Leaves that are both similar to their centre are in one group by it,
        so only the other leaves are compared; a large group costs a star.
        """
        strong = self._near.where(F.col("similarity") >= self.threshold).select("a", "b")
        rest = self._leaf_links((F.col("s2") < self.threshold) | (F.col("s3") < self.threshold)).select("a", "b")
        by = stage(components(strong.unionByName(rest).unionByName(self.members.select(F.col("rep").alias("a"), F.col("id").alias("b")))))
        by = by.unionByName(self._ids.join(by.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.col("id").alias("label")))
        size = by.groupBy("label").agg(F.count(F.lit(1)).alias("n_members"))
        return by.join(size, "label").select(F.col("node").alias("id"), F.col("label").alias("group_id"), "n_members")
