"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks of bytes that cover all of it. Learned
filters run over each chunk and are max-pooled; the chunks' maxima are pooled over the
document (largest, mean, least) and a small dense layer makes one probability of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import kept, schema_with, text_batches

#: Bytes of a chunk and from one chunk's start to the next.
CHUNK, STEP = 512, 448
#: Numbers that stand for a byte; bytes of a filter and from one place to the next; filters; hidden units.
EMBED, WIDTH, HOP, FILTERS, HIDDEN = 8, 8, 2, 32, 16
#: Labelled rows of each class that the network learns from, with all their chunks, and the bytes of these chunks: the bound of what the driver collects.
SAMPLE_ROWS, SAMPLE_BYTES = 900, 12_000_000
#: Longer texts, in bytes of chunks, are learnt from after all others only, so that none of them takes the place of many.
LONG_BYTES = SAMPLE_BYTES // 20
STEPS, BATCH, RATE = 800, 32, 4e-3
#: Chunks whose windows are laid out at once (8 MB).
SLAB = 128


def chunked(data: bytes):
    """The chunks of a text's bytes; the last one is filled up with zeros."""
    import numpy as np

    n = 1 + max(0, math.ceil((len(data) - CHUNK) / STEP))
    flat = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (STEP, 1))


def _windows(embedding, chunks):
    import numpy as np

    x = embedding[chunks].reshape(len(chunks), CHUNK * EMBED)
    places = (CHUNK - WIDTH) // HOP + 1
    return np.lib.stride_tricks.as_strided(x, (len(chunks), places, WIDTH * EMBED), (x.strides[0], HOP * EMBED * 4, 4))


def _maxima(net: dict, chunks):
    """Each filter's largest answer in each chunk."""
    import numpy as np

    out = np.empty((len(chunks), FILTERS), np.float32)
    for at in range(0, len(chunks), SLAB):
        windows = np.ascontiguousarray(_windows(net["embedding"], chunks[at : at + SLAB]))
        answers = windows.reshape(-1, WIDTH * EMBED) @ net["filters"]
        out[at : at + SLAB] = answers.reshape(len(windows), -1, FILTERS).max(1)
    return np.maximum(out + net["filter_bias"], 0)


def _pooled(maxima, starts):
    import numpy as np

    counts = np.diff([*starts, len(maxima)])[:, None]
    return np.hstack([np.maximum.reduceat(maxima, starts), np.add.reduceat(maxima, starts) / counts, np.minimum.reduceat(maxima, starts)]).astype(np.float32)


def _logits(net: dict, pooled):
    import numpy as np

    return np.maximum(pooled @ net["dense"] + net["dense_bias"], 0) @ net["out"] + net["out_bias"]


def score(net: dict, texts: list[bytes]):
    """The probability of each text. Texts are taken up to some size at a time, so
    memory does not grow with their lengths but for the longest."""
    import numpy as np

    scores, waiting, held = [], [], 0

    def flush():
        nonlocal waiting, held
        if waiting:
            starts = np.cumsum([0, *map(len, waiting[:-1])])
            logits = _logits(net, _pooled(np.concatenate(waiting), starts)).astype(float)
            scores.extend((1 / (1 + np.exp(-np.clip(logits, -60, 60)))).tolist())
        waiting, held = [], 0

    some: list = []
    lengths: list[int] = []

    def convolve():
        nonlocal held
        if some:
            maxima = _maxima(net, np.concatenate(some) if len(some) > 1 else some[0])
            waiting.extend(np.split(maxima, np.cumsum(lengths)[:-1]))
            some.clear()
            lengths.clear()

    for text in texts:
        chunks = chunked(text)
        some.append(chunks)
        lengths.append(len(chunks))
        held += len(chunks)
        if held >= 8 * SLAB:
            convolve()
            flush()
    convolve()
    flush()
    return scores


def fit(rows: list[tuple[bytes, int]], prior: float, seed: int = 11) -> dict:
    """Learn from (whole chunks of a text, joined; label). Classes weigh alike while
    learning; `prior`, the share of label 1 among all labels, then sets the odds."""
    import numpy as np

    rng = np.random.default_rng(seed)
    near = lambda *shape: rng.normal(0, math.sqrt(2 / shape[0]), shape).astype(np.float32)
    net = {
        "embedding": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filters": near(WIDTH * EMBED, FILTERS), "filter_bias": np.zeros(FILTERS, np.float32),
        "dense": near(3 * FILTERS, HIDDEN), "dense_bias": np.zeros(HIDDEN, np.float32), "out": near(HIDDEN), "out_bias": np.zeros(1, np.float32),
    }
    odds = math.log(min(max(prior, 1e-3), 1 - 1e-3) / (1 - min(max(prior, 1e-3), 1 - 1e-3)))
    labels = np.array([y for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        net["out"][:] = 0
        net["out_bias"][:] = odds
        return net
    docs = [np.frombuffer(x, np.uint8).reshape(-1, CHUNK) for x, _ in rows]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    epochs = math.ceil(STEPS / math.ceil(len(docs) / BATCH))
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            of = order[at : at + BATCH]
            chunks = np.concatenate([docs[i] for i in of])
            starts = np.cumsum([0, *(len(docs[i]) for i in of[:-1])])
            own = np.repeat(np.arange(len(of)), np.diff([*starts, len(chunks)]))
            where, best = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS), np.float32)
            for a in range(0, len(chunks), SLAB):
                windows = np.ascontiguousarray(_windows(net["embedding"], chunks[a : a + SLAB]))
                answers = (windows.reshape(-1, WIDTH * EMBED) @ net["filters"]).reshape(len(windows), -1, FILTERS)
                where[a : a + SLAB] = answers.argmax(1)
                best[a : a + SLAB] = answers.max(1)
            raw = best + net["filter_bias"]
            maxima = np.maximum(raw, 0)
            pooled = _pooled(maxima, starts)
            hidden = pooled @ net["dense"] + net["dense_bias"]
            active = np.maximum(hidden, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ net["out"] + net["out_bias"], -30, 30)))
            d_out = ((p - labels[of]) * weight[of] / len(of)).astype(np.float32)
            d_hidden = np.outer(d_out, net["out"]) * (hidden > 0)
            d_pooled = d_hidden @ net["dense"].T
            largest, mean, least = pooled[:, :FILTERS], d_pooled[:, FILTERS : 2 * FILTERS], pooled[:, 2 * FILTERS :]
            counts = np.bincount(own, minlength=len(of)).astype(np.float32)[:, None]
            d_max = (mean / counts)[own] + d_pooled[own, :FILTERS] * (maxima == largest[own]) + d_pooled[own, 2 * FILTERS :] * (maxima == least[own])
            d_max *= raw > 0
            # only the windows that were largest in their chunk learn
            byte = chunks[np.arange(len(chunks))[:, None, None], where[:, :, None] * HOP + np.arange(WIDTH)]
            seen = net["embedding"][byte].reshape(len(chunks), FILTERS, WIDTH * EMBED)
            d_byte = (d_max[:, :, None] * net["filters"].T[None]).reshape(-1, EMBED)
            d_embedding = np.column_stack([np.bincount(byte.ravel(), d_byte[:, e], 256) for e in range(EMBED)])
            grads = {
                "embedding": d_embedding, "filters": np.einsum("nf,nfw->wf", d_max, seen, optimize=True), "filter_bias": d_max.sum(0),
                "dense": pooled.T @ d_hidden, "dense_bias": d_hidden.sum(0), "out": active.T @ d_out, "out_bias": d_out.sum(keepdims=True),
            }
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] -= (rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + 1e-4 * net[k])).astype(np.float32)
    net["out_bias"] += odds
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Learn from the labels that are not held out: of each class the `sample_rows`
    rows first in an order by hash, as far as they fit SAMPLE_BYTES; texts above LONG_BYTES
    stand behind the others, so they are what is left out. Texts are learnt from whole, as
    they are scored. Ids may be of any type. Of several texts or labels of one doc_id the least
    text, then the least label counts; a null text is an empty one; labels without a
    doc_id, and such as are neither 0 nor 1, count for nothing. Without labels all texts
    score a half; with those of one class, near that class; empty documents are no labels."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda q: rows.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    wanted = pick(0).unionByName(pick(1))
    found = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(wanted), "doc_id")  # at most 2 * sample_rows rows

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            data = [chunked((t or "").encode()).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), batch.column(2)], names=["doc_id", "data", "quality"])

    chunks = 1 + F.greatest(F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) - CHUNK) / STEP), F.lit(0))
    order = Window.partitionBy("quality").orderBy(chunks * CHUNK > LONG_BYTES, F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = found.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("x")).select("doc_id", "x.text", "x.quality")
    found = found.where(chunks * CHUNK <= SAMPLE_BYTES).withColumn("taken", F.sum(chunks * CHUNK).over(order)).where(F.col("taken") <= SAMPLE_BYTES)
    cuts = found.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(cut, schema_with(found.select("doc_id"), "data binary, quality int"))
    sample = sorted((r["doc_id"], bytes(r["data"]), r["quality"]) for r in cuts.collect())
    total = sum(counts.values())
    return fit([(x, y) for _, x, y in sample], counts.get(1, 0) / total if total else 0.5)


def classify(docs: DataFrame, net: dict, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """The columns `keep` (else all but those named like a result), score (0 to 1,
    higher for better texts) and predicted (1 if score >= threshold, else 0), a row
    for each row. Whole texts are scored, and nothing but texts. Null and empty texts
    are one chunk of zeros; repeated rows give repeated results; an empty table gives
    an empty one."""
    keep = kept(docs, keep, [], ["score", "predicted"])
    text_batches(docs.sparkSession)
    schema = schema_with(docs.select(*keep), "score double, predicted int")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = score(net, [(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs, learn(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
