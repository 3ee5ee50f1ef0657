"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast hash table with the token counts of the most frequent
pre-tokens of a bounded sample of texts; tier two is a cache in each worker that
encodes what tier one lacks. Pre-tokens are never shuffled.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import kept, schema_with, text_batches
from tidewatch.llm.vocabulary import TwoGenerations, default_path, vocabulary

#: Entries of the broadcast table and the bytes of a pre-token in it: at most 2 MB of
#: strings and as many numbers, whatever the corpus. Longer pre-tokens are left to the caches.
TABLE_ENTRIES, ENTRY_BYTES = 32_768, 64
#: Different texts, about and at most, that the table is made from, and the tasks that count them. It holds
#: what is frequent in them; that decides how fast counting is, never a count.
SAMPLE_TEXTS, SAMPLE_TASKS = 4_096, 8
#: Distinct strings a task counts before it forgets its rarest; bounds memory only.
LOCAL_DISTINCT = 200_000
#: Entries of one generation of a worker's cache.
CACHE_ENTRIES = 300_000


def frequent_pre_tokens(df: DataFrame, text_col: str, path: str, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a hash sample of about
    SAMPLE_TEXTS different texts, at most `entries`. Copies of a text count once, so that
    a text of many rows does not fill the sample. A few tasks count them and send their own
    most frequent ones to the driver, at most `entries` each."""

    def propose(batches):
        import pyarrow as pa

        vocab, words = vocabulary(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(w for w in vocab.pre_tokens(text) if len(w) <= ENTRY_BYTES and len(w.encode("utf-8", "surrogatepass")) <= ENTRY_BYTES)
            if len(words) > LOCAL_DISTINCT:
                words = Counter(dict(words.most_common(LOCAL_DISTINCT // 4)))
        top = words.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    every = max(1, df.count() // SAMPLE_TEXTS)
    sample = df.select(F.col(text_col)).where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).distinct().repartition(SAMPLE_TASKS)
    total: Counter = Counter()
    for row in sample.mapInArrow(propose, "word string, n long").collect():
        total[row["word"]] += row["n"]
    vocab = vocabulary(path)
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]
    return {word: len(vocab.library.model.tokenize(vocab.spelled(word))) for word, _ in top}


def count_tokens(df: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None, limit: int = 1024, entries: int = TABLE_ENTRIES) -> DataFrame:
    """One row for each row of df: the columns `keep`, then n_bytes, n_tokens and
    over_limit (n_tokens > limit).

    Counts are those of the tokenizer library for the file at `path`, without
    added begin or end tokens; special strings inside a text count as the library
    counts them. Null and empty texts have 0 bytes and 0 tokens. Texts are read
    whole, however long; repeated rows give repeated results; an empty table
    gives an empty one. Without `keep`, all other columns pass through but those
    named like a result column.
    """
    path = path or default_path()
    keep = kept(df, keep, [text_col], ["n_bytes", "n_tokens", "over_limit"])
    text_batches(df.sparkSession)
    table = df.sparkSession.sparkContext.broadcast(frequent_pre_tokens(df, text_col, path, entries))
    schema = schema_with(df.select(*keep), "n_bytes long, n_tokens long, over_limit boolean")

    def count(batches):
        import pyarrow as pa

        vocab, frequent = vocabulary(path), table.value
        known = TwoGenerations(lambda w: len(vocab.library.model.tokenize(vocab.spelled(w))), CACHE_ENTRIES, frequent)

        def of_text(text: str) -> int:
            total = 0
            for segment in vocab.segments(text):
                total += 1 if segment in vocab.specials else sum(map(known.__getitem__, vocab.pre_tokens(segment)))
            return total

        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            tokens = [of_text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=schema.names,
            )

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(count, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, keep=["doc_id"])
