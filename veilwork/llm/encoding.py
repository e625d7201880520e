"""Encoding of a whole corpus with a public tokenizer (problem 7).

Method: a global shuffle of distinct words.

1. The JVM cuts every text into pre-tokens.  Blocks of neighbouring documents
   are dictionary-encoded column-wise, so a block keeps each distinct
   pre-token once, and the positions as small integers.
2. The blocks' distinct pre-tokens are counted by pre-token (combined on the
   map side) and each is encoded once.
3. The ids are joined back to the blocks, where the positions put them in
   order.  A pre-token that is in more than one of ``hot_share`` block rows is
   hot; there are at most ``hot_share`` such, so their ids are broadcast.  All
   others are joined by a shuffle, in which no key has more than that share.

Only dictionaries travel: no document is shuffled token by token.

Defined results
---------------
* null and empty text: an empty list; blank text: the ids of its blanks;
* strings of special tokens in a text: ordinary text;
* repeated rows: one result row per input row;
* very long texts: whole, a block of their own;
* empty table: no rows;
* further columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.workers import kept
from veilwork.runtime import stage

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: White space as Unicode defines it; Java's own class knows ASCII only (fixed values).
_BLANK = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The published pre-token pattern of the byte-level BPE family, in Java's syntax.
PRETOKENS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"


def _load(path: str):
    """(ranks' encoder, id -> bytes) of a ``.tiktoken`` file, or of a tokenizers ``.json`` file."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda words: [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return lambda words: [core.encode_ordinary(w) for w in words]


def _blocks(block_tokens: int, block_docs: int):
    """Arrow batches of (id, pre-tokens) -> one row per block."""

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            ends = lists.offsets.to_numpy()
            flat, start = lists.values, 0
            while start < b.num_rows:
                stop = int(np.searchsorted(ends, ends[start] + block_tokens, "right")) - 1
                stop = min(max(stop, start + 1), start + block_docs, b.num_rows)
                words = flat.slice(int(ends[start]), int(ends[stop] - ends[start])).dictionary_encode()
                at = words.indices.to_numpy(zero_copy_only=False)
                small = np.uint16 if len(words.dictionary) < 65536 else np.uint32
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([serial], pa.int64()),
                        pa.array([ids.slice(start, stop - start).to_pylist()], pa.list_(ids.type)),
                        pa.array([np.diff(ends[start : stop + 1]).astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([at.astype(small).tobytes()], pa.binary()),
                        pa.array([small == np.uint16], pa.bool_()),
                        pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary.cast(pa.string())),
                    ],
                    ["block", "ids", "lens", "at", "narrow", "words"],
                )
                serial, start = serial + 1, stop

    return run


def _encode(path: str):
    """(word, n) of distinct words -> (word, n, ids)."""

    def run(batches):
        encode = kept(("bpe", path), lambda: _load(path))
        for b in batches:
            ids = pa.array(encode(b.column(0).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], ["word", "n", "ids"])

    return run


def _assemble(batches):
    """(ids, lens, at, narrow, pieces) of a block -> (id, tokens) of its documents."""
    for b in batches:
        for r in range(b.num_rows):
            pieces = b.column(4).slice(r, 1).flatten()
            order = np.argsort(pieces.field("k").to_numpy())
            at = np.frombuffer(b.column(2)[r].as_py(), np.uint16 if b.column(3)[r].as_py() else np.uint32)
            tokens = pieces.field("ids").take(pa.array(order)).take(pa.array(at)) if len(at) else None
            doc_ends = np.concatenate([[0], np.cumsum(b.column(1).slice(r, 1).flatten().to_numpy())])
            ends = tokens.offsets.to_numpy() if len(at) else np.zeros(1, np.int32)
            values = tokens.values if len(at) else pa.array([], pa.int32())
            ends = ends[doc_ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1).flatten(), pa.ListArray.from_arrays(pa.array(ends), values)], ["id", "tokens"])


def encode_corpus(
    df: DataFrame, id_col: str, text_col: str, tokenizer: str = DEFAULT_TOKENIZER, block_tokens: int = 400_000, block_docs: int = 5_000, hot_share: int = 20_000
) -> DataFrame:
    """(id, tokens array<int>) for every row of ``df``; ``tokenizer`` is a path that executors can read."""
    kind = df.schema[id_col].dataType.simpleString()
    cut = df.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(PRETOKENS), F.lit(0)).alias("w"))
    blocks = stage(cut.mapInArrow(_blocks(block_tokens, block_docs), f"block long, ids array<{kind}>, lens array<int>, at binary, narrow boolean, words array<string>"))
    words = blocks.select("block", F.posexplode("words").alias("k", "word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = stage(counted.mapInArrow(_encode(tokenizer), "word string, n long, ids array<int>"))
    total = each.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > F.lit(total / hot_share)
    hot = each.where(is_hot).select("word", F.col("ids").alias("hot"))
    marked = words.join(F.broadcast(hot), "word", "left")
    rest = marked.where("hot IS NULL").drop("hot").join(each.where(~is_hot).select("word", "ids"), "word").select("block", "k", "ids")
    encoded = rest.unionByName(marked.where("hot IS NOT NULL").select("block", "k", F.col("hot").alias("ids")))
    pieces = encoded.groupBy("block").agg(F.collect_list(F.struct("k", "ids")).alias("pieces"))
    whole = blocks.select("block", "ids", "lens", "at", "narrow").join(pieces, "block", "left")
    whole = whole.select("ids", "lens", "at", "narrow", F.coalesce("pieces", F.array().cast("array<struct<k:int,ids:array<int>>>")).alias("pieces"))
    return whole.mapInArrow(_assemble, f"id {kind}, tokens array<int>")


def _bytes_of(path: str):
    with open(path) as f:
        return {int(b): base64.b64decode(a) for a, b in map(str.split, f)}


def _decode(path: str):
    def run(batches):
        table = kept(("bytes", path), lambda: _bytes_of(path))
        for b in batches:
            texts = [b"".join(table[t] for t in ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode_corpus(encoded: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, text) back from (id, tokens), by the token-byte table of a ``.tiktoken`` file."""
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens")).mapInArrow(_decode(tokenizer), f"id {kind}, text string")
