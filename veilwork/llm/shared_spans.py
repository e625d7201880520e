"""Long exact spans shared between records (problem 9).

Relative Lempel-Ziv parsing.  A document is factored from left to right
against a reference text: at each place the longest match in the reference is
taken as a factor and the parse goes on behind it.  Factors of ``span`` or more
are duplicate spans.  A shared stretch that begins inside one factor and ends
inside the next is found at the boundary between them: there every occurrence
of the ``span // 2`` code points on either side is drawn out both ways.  So each
maximal shared stretch of ``span`` or more is either within one factor or
checked at a boundary, and none is lost.

Which reference texts a document is factored against is read off an index of
the whole collection.  In every stretch of ``span`` code points the k-gram of
smallest hash is an anchor.  Around anchors that two texts hold, the hashes of
all windows of ``span`` are indexed; texts that hold the same set of windows
form a class.  So only texts that do share a stretch meet.

A class is cut into reference blocks of about ``block_docs`` texts (fewer if
they are long) and its documents into chunks; a text moves once per block or
chunk, never per pair.  The pairs need all blocks of a class; the coverage
needs its first two texts only, so a passage that very many documents hold
costs one parse each.

Exact copies of a text are one class; only its smallest id takes part in the
parsing, the others get its result.

Defined results
---------------
* null text, text shorter than ``span``: shares nothing, its coverage is 0;
* repeated rows of an id: one document (equal texts) or the union of its texts;
* periodic text (one character over and over): parsed as any other;
* empty table: no rows;
* further columns of the input are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm import rolling
from veilwork.runtime import join_sized, stage

_CHUNK = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _anchor_rows(span: int, k: int):
    """(id, text, digest) -> (id, digest, n, distinct anchor hashes)."""

    def run(batches):
        for b in batches:
            texts, n = b.column(1).to_pylist(), b.num_rows
            lens = np.fromiter(map(len, texts), np.int64, n)
            start = 0
            while start < n:
                stop = max(start + 1, int(np.searchsorted(np.cumsum(lens[start:]), _CHUNK, "right")) + start)
                ends = np.cumsum(lens[start:stop])
                at, h = rolling.anchors(_codes("".join(texts[start:stop])), ends, span, k)
                doc = np.searchsorted(ends, at, "right")
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[first], h[first]
                cuts = pa.array(np.searchsorted(doc, np.arange(stop - start + 1)).astype(np.int32))
                cols = [b.column(0).slice(start, stop - start), b.column(2).slice(start, stop - start), pa.array(lens[start:stop].astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "digest", "n", "hashes"])
                start = stop

    return run


def _window_rows(span: int, k: int):
    """(key, text, shared anchors) -> (key, hashes of the windows around them)."""

    def run(batches):
        for b in batches:
            out = []
            for text, shared in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                codes = _codes(text)
                at, h = rolling.anchors(codes, np.array([len(codes)]), span, k)
                at = at[np.isin(h.view(np.int64), np.array(shared, np.int64))]
                inside = np.zeros(len(codes) - span + 2, np.int32)
                np.add.at(inside, np.maximum(at - (span - k), 0), 1)
                np.add.at(inside, np.minimum(at + 1, len(inside) - 1), -1)
                starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                out.append(np.unique(rolling.gram_hashes(codes, span)[starts]).view(np.int64))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32))
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(cuts, pa.array(flat))], ["key", "windows"])

    return run


def _agree(a: str, i: int, b: str, j: int) -> int:
    """Length of the common start of a[i:] and b[j:]."""
    n = min(len(a) - i, len(b) - j)
    low, step = 0, 256
    while low < n:
        step = min(step, n - low)
        if a[i + low : i + low + step] == b[j + low : j + low + step]:
            low, step = low + step, step * 4
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return low


def _agree_back(a: str, i: int, b: str, j: int) -> int:
    """Length of the common end of a[:i] and b[:j]."""
    n = min(i, j)
    low, step = 0, 256
    while low < n:
        step = min(step, n - low)
        if a[i - low - step : i - low] == b[j - low - step : j - low]:
            low, step = low + step, step * 4
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return low


class Reference:
    """A reference text with an index of its ``k``-grams."""

    def __init__(self, text: str, k: int):
        self.text, self.k, self._prefixes = text, k, None
        h = rolling.gram_hashes(_codes(text), k)
        self.order = np.argsort(h, kind="stable")
        self.sorted = h[self.order]

    @property
    def prefixes(self) -> rolling.Prefixes:
        if self._prefixes is None:
            self._prefixes = rolling.Prefixes(_codes(self.text))
        return self._prefixes


def _agree_many(a: rolling.Prefixes, i: int, b: rolling.Prefixes, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common starts of a[i:] and b[j:], and of the common ends of a[:i] and b[:j], for many places j."""
    out = []
    for most, same in (
        (np.minimum(len(a) - i, len(b) - js), lambda n: a.of(np.full(len(js), i), n) == b.of(js, n)),
        (np.minimum(i, js), lambda n: a.of(i - n, n) == b.of(js - n, n)),
    ):
        low, high = np.zeros(len(js), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = same(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        out.append(low)
    return out[0], out[1]


def parse(text: str, hashes: np.ndarray, ref: Reference, span: int) -> list[tuple[int, int, int]]:
    """Greedy relative Lempel-Ziv parse: (start, start in the reference, n) of the duplicate spans.

    ``hashes``: those of the k-grams of ``text``, k being at most ``span // 2``.
    """
    k = ref.k
    lo, hi = np.searchsorted(ref.sorted, hashes, "left"), np.searchsorted(ref.sorted, hashes, "right")
    there = np.flatnonzero(hi > lo)
    out: dict[tuple[int, int], int] = {}
    own: list[rolling.Prefixes] = []

    def factor(i: int) -> int:
        """The longest match from ``i``; every occurrence is drawn out, back too."""
        places = ref.order[lo[i] : hi[i]]
        if len(places) > 8:  # periodic text: all occurrences at once, and those that no other one covers
            own.extend([] if own else [rolling.Prefixes(_codes(text))])
            ns, backs = _agree_many(own[0], i, ref.prefixes, places)
            order = np.lexsort((-ns, -backs))
            far = np.concatenate([[-1], np.maximum.accumulate(ns[order])[:-1]])
            places = places[order[ns[order] > far]]
        best = 0
        for c in places.tolist():
            n = _agree(text, i, ref.text, c)
            best = max(best, n)
            back = _agree_back(text, i, ref.text, c)
            if back + n >= span:
                out[(i - back, c - back)] = back + n
        return best

    at = 0
    while at < len(there):
        i = int(there[at])
        n = factor(i)
        if n < k:  # another text of the same hash
            at += 1
            continue
        end = i + n
        if end - k > i:  # what begins in this factor and ends behind it
            factor(end - k)
        at = int(np.searchsorted(there, end))
    return [(s, r, n) for (s, r), n in out.items()]


def _parse_units(span: int, every: bool):
    """Work units (texts of a block, texts of a chunk) -> factors of ``span`` or more."""
    k = span // 2

    def run(batches):
        for b in batches:
            doc, ref, start, at, size = [], [], [], [], []
            for texts in b.column(0).to_pylist():
                refs = {x["id"]: Reference(x["text"], k) for x in texts if x["ref"]}
                first = min(refs) if refs else None
                for x in texts:
                    if not x["doc"]:
                        continue
                    hashes = None
                    for r, reference in refs.items():
                        # pairs: each once; coverage: the smallest text is factored against the next, all others against it
                        if r == x["id"] or every and r > x["id"] or not every and r != first and x["id"] != first:
                            continue
                        if hashes is None:
                            hashes = rolling.gram_hashes(_codes(x["text"]), k)
                        for s, p, n in parse(x["text"], hashes, reference, span):
                            doc.append(x["id"])
                            ref.append(r)
                            start.append(s)
                            at.append(p)
                            size.append(n)
            kind = b.schema.field(0).type.value_type.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(ref, kind), *(pa.array(c, pa.int32()) for c in (start, at, size))], ["key", "ref", "start", "ref_start", "n"])

    return run


class SharedSpans:
    """Classes of exact copies (``members``), factor lists, pairs and coverage of a collection."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, span: int = 200, k: int = 128, block_docs: int = 64, block_chars: int = 4_000_000):
        kind = docs.schema[id_col].dataType.simpleString()
        self.every = docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n")).where("id IS NOT NULL")
        own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").where(F.length("text") >= span)
        own = own.withColumn("digest", F.md5("text"))
        rows = stage(own.select("id", "text", "digest").mapInArrow(_anchor_rows(span, k), f"id {kind}, digest string, n int, hashes array<long>"))
        classes = rows.groupBy("digest").agg(F.min("id").alias("rep"))
        self.members = stage(rows.select("id", "digest", "n").distinct().join(classes, "digest").select("id", "digest", "n", "rep"))
        heads = stage(self.members.where("id = rep").select("id", "digest"))
        # one text per class; an anchor counts once in a text
        held = join_sized(rows, heads, ["id", "digest"], "left_semi").dropDuplicates(["digest"]).select("digest", F.explode("hashes").alias("h"))
        shared = stage(held.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
        wanted = stage(join_sized(held, shared, "h", "left_semi").groupBy("digest").agg(F.collect_list("h").alias("anchors")))
        # the texts that hold shared anchors are read once more and kept by their digest
        mine = join_sized(own, heads, ["id", "digest"], "left_semi")
        mine = stage(join_sized(mine, wanted, "digest").dropDuplicates(["digest"]))
        windows = mine.select("digest", "text", "anchors").mapInArrow(_window_rows(span, k), "key string, windows array<long>")
        windows = stage(windows.select("key", F.explode("windows").alias("w")))
        # windows of the same texts are one class
        by = F.xxhash64("key")
        sets = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.sum(F.shiftright(by, 32)).alias("k1"), F.bit_xor(F.xxhash64(by, F.lit(1))).alias("k2")).where("c > 1")
        cls = windows.join(sets, "w").select("key", F.xxhash64("c", "k1", "k2").alias("cls"), "c").distinct()
        self.classes = stage(cls.join(mine.select(F.col("digest").alias("key"), F.length("text").alias("n")), "key"))
        self.texts = mine.select(F.col("digest").alias("key"), "text")
        self.span, self.block_docs, self.block_chars = span, block_docs, block_chars
        self._pairs: DataFrame | None = None
        self._factors: DataFrame | None = None

    def _parsed(self, every: bool) -> DataFrame:
        """(key, ref, start, ref_start, n): factors of each text of a class against all smaller ones, or against its smallest."""
        c = self.classes
        first = c.groupBy("cls").agg(F.min("key").alias("first"), F.sum("n").alias("chars"), F.first("c").alias("of"))
        second = c.join(first.select("cls", "first"), "cls").where("key > first").groupBy("cls").agg(F.min("key").alias("second"))
        sizes = first.join(second, "cls")
        parts = lambda docs: F.greatest(F.ceil(F.col("of") / docs), F.ceil(F.col("chars") / self.block_chars)).cast("int")
        sized = c.join(stage(sizes.select("cls", "first", "second", (parts(self.block_docs) if every else F.lit(1)).alias("blocks"), parts(4 * self.block_docs).alias("chunks"))), "cls")
        of = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
        numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        doc = sized.select("cls", "key", F.explode(numbers("blocks")).alias("block"), of(1, "chunks").alias("chunk"), F.lit(False).alias("ref"), F.lit(True).alias("doc"))
        own = sized if every else sized.where("key = first OR key = second")
        ref = own.select("cls", "key", (of(2, "blocks") if every else F.lit(0)).alias("block"), F.explode(numbers("chunks")).alias("chunk"), F.lit(True).alias("ref"), F.lit(False).alias("doc"))
        # a text that is both in its unit moves once
        roles = doc.unionByName(ref).groupBy("cls", "block", "chunk", "key").agg(F.max("ref").alias("ref"), F.max("doc").alias("doc"))
        units = roles.join(self.texts, "key").groupBy("cls", "block", "chunk").agg(F.collect_list(F.struct(F.col("key").alias("id"), "ref", "doc", "text")).alias("texts"))
        return stage(units.select("texts").mapInArrow(_parse_units(self.span, every), "key string, ref string, start int, ref_start int, n int"))

    @property
    def factors(self) -> DataFrame:
        """(key, ref, start, ref_start, n) between texts, named by their digest: one reference or two for each class."""
        if self._factors is None:
            self._factors = self._parsed(every=False)
        return self._factors

    @property
    def links(self) -> DataFrame:
        """(key, ref): every two different texts that share a span."""
        if self._pairs is None:
            self._pairs = self._parsed(every=True).select("key", "ref").distinct()
        return self._pairs

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every two documents that share a span, copies included."""
        m = self.members.select("id", "digest").distinct()
        a, b = m.select(F.col("digest").alias("key"), F.col("id").alias("u")), m.select(F.col("digest").alias("ref"), F.col("id").alias("v"))
        linked = self.links.join(a, "key").join(b, "ref").select("u", "v")
        copies = a.join(b.withColumnRenamed("ref", "key"), "key").select("u", "v")
        both = linked.unionByName(copies).where("u <> v")
        return both.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    def factor_list(self) -> DataFrame:
        """(id, ref_id, start, ref_start, n): the factors of each document; those of copies are named after the first of them."""
        heads = self.members.where("id = rep").select("id", "digest").distinct()
        out = self.factors.join(heads.select(F.col("digest").alias("key"), "id"), "key").join(heads.select(F.col("digest").alias("ref"), F.col("id").alias("ref_id")), "ref")
        return out.select("id", "ref_id", "start", "ref_start", "n").distinct()

    def passages(self) -> DataFrame:
        """(id, start, end): maximal stretches of a document that also stand in another one."""
        own = self.factors.select(F.col("key").alias("digest"), F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")).distinct()
        own = self.members.select("id", "digest").distinct().join(own, "digest").select("id", "s", "e")
        copied = self.members.groupBy("digest").agg(F.count_distinct("id").alias("c"), F.max("n").alias("n")).where("c > 1").select("digest", "n")
        whole = self.members.select("id", "digest").distinct().join(copied, "digest").select("id", F.lit(0).alias("s"), F.col("n").alias("e"))
        w = Window.partitionBy("id").orderBy("s", "e")
        spans = own.unionByName(whole)
        seen = spans.withColumn("upto", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        island = seen.withColumn("island", F.sum(F.when(F.col("s") <= F.col("upto"), 0).otherwise(1)).over(w))
        return island.groupBy("id", "island").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("island")

    def coverage(self) -> DataFrame:
        """(id, n_chars, shared_chars) of every document."""
        got = self.passages().groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("shared"))
        return self.every.groupBy("id").agg(F.max("n").alias("n_chars")).join(got, "id", "left").select("id", "n_chars", F.coalesce("shared", F.lit(0)).alias("shared_chars"))
