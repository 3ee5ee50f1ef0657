"""Byte-level BPE: encoding with a priority queue of merge ranks over a doubly
linked list of symbols, decoding by concatenating vocabulary strings."""

from __future__ import annotations

import hashlib
from array import array
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import kept, schema_with, text_batches
from tidewatch.llm.vocabulary import TwoGenerations, Vocabulary, default_path, vocabulary

#: Entries of one generation of a worker's cache of encoded pre-tokens.
CACHE_ENTRIES = 600_000


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply the merges of lowest rank first, leftmost first among equals.

    The symbols form a doubly linked list; the queue holds rank and position in
    one integer. An entry is stale, and skipped, if the pair at its position has
    changed since it was pushed, which shows in the rank kept for that position."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    pair = [get((a << 20) | b, -1) for a, b in zip(symbols, symbols[1:])]
    queue = [(r << shift) | i for i, r in enumerate(pair) if r >= 0]
    heapify(queue)
    pair.append(-1)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while queue:
        top = heappop(queue)
        i = top & mask
        rank = top >> shift
        if pair[i] != rank:
            continue
        j = after[i]
        k = after[j]
        new = merged[rank]
        symbols[i] = new
        symbols[j] = pair[j] = pair[i] = -1
        after[i] = k
        if k < n:
            before[k] = i
            r = get((new << 20) | symbols[k])
            if r is not None:
                pair[i] = r
                heappush(queue, (r << shift) | i)
        h = before[i]
        if h >= 0:
            r = pair[h] = get((symbols[h] << 20) | new, -1)
            if r >= 0:
                heappush(queue, (r << shift) | h)
    return [s for s in symbols if s >= 0]


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, vocab: Vocabulary, limit: int = CACHE_ENTRIES):
        self.vocab = vocab
        self.known = TwoGenerations(self._encode, limit)

    def _encode(self, pre_token: str) -> bytes:
        of_byte = self.vocab.byte_ids
        return array("I", merge([of_byte[b] for b in pre_token.encode()], self.vocab.ranks, self.vocab.merged)).tobytes()

    def encode(self, text: str) -> bytes:
        out = []
        for segment in self.vocab.segments(text):
            if segment in self.vocab.specials:
                out.append(array("I", [self.vocab.specials[segment]]).tobytes())
            else:
                out.extend(map(self.known.__getitem__, self.vocab.pre_tokens(segment)))
        return b"".join(out)

    def decode(self, ids) -> str:
        """Concatenate the vocabulary strings of an integer array of ids."""
        import numpy as np

        flat, starts, lengths = self.vocab.flat_strings
        ids = np.asarray(ids, np.int64)
        n = lengths[ids]
        if len(n) == 0:
            return ""
        shift = starts[ids]
        shift[1:] -= np.cumsum(n[:-1])
        return flat[np.repeat(shift, n) + np.arange(n.sum())].tobytes().decode("utf-8", "replace")


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, then token_ids, an array of int: the ids of each whole
    text (null as empty: an empty array) without added tokens. One row for each
    row of df, repeated rows too; an empty table gives an empty one."""
    path = path or default_path()
    keep = kept(df, keep, [text_col], ["token_ids"])
    text_batches(df.sparkSession)
    schema = schema_with(df.select(*keep), "token_ids array<int>")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(vocabulary(path))
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t or ""), "<i4") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "token_ids", path: str | None = None, out_col: str = "text") -> DataFrame:
    """df with ids_col replaced by the decoded text in out_col (a null array gives
    an empty text). An id outside the vocabulary is an error."""
    path = path or default_path()
    rest = [c for c in df.columns if c not in (ids_col, out_col)]
    text_batches(df.sparkSession)
    schema = schema_with(df.select(*rest), f"`{out_col}` string")

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(vocabulary(path))
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return df.select(*rest, ids_col).mapInArrow(run, schema)


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass, returning digests in place of the ids: the
    columns `keep`, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers) and decoded_sha256 (of the decoded text in UTF-8). Null texts
    count as empty; texts are taken whole; repeated rows give repeated results."""
    path = path or default_path()
    keep = kept(df, keep, [text_col], ["n_tokens", "ids_sha256", "decoded_sha256"])
    text_batches(df.sparkSession)
    schema = schema_with(df.select(*keep), "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(vocabulary(path))
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids = encoder.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                decoded = encoder.decode(np.frombuffer(ids, "<u4"))
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=schema.names)

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, keep=["doc_id"])
