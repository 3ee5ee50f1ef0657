"""Near-duplicates by consistent weighted sampling over TF-IDF word shingles.

Equal texts are grouped first. Of each distinct text, improved consistent weighted
sampling draws hash values whose chance to agree between two texts is their weighted
Jaccard similarity; they are banded, and texts that meet in a band's bucket are
verified by their exact weighted similarity. In a bucket all texts are compared with
a head, a few times over, and a head is then done with. Texts that are still apart in
a bucket meet by an exact prefix filter: only if they share one of the rarest shingles
without which a text cannot reach the similarity. So no link is lost, and no group
yields all its pairs, whatever line or passage its texts share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import release, settle, settle_by, text_batches
from tidewatch.llm.components import merged

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Bands and hash values of each: at similarity 0.8, all bands miss with 0.0002.
BANDS, ROWS = 16, 4
#: Counters of document frequencies. Shingles share counters by hash; what strangers
#: add to a counter is about shingles a text / COUNTERS of all texts, at every size.
COUNTERS = 1 << 18
#: Texts' share from which a shingle weighs less, and the weight of a rare shingle
#: against one that all texts have. As the ratio is bounded, a group of near copies
#: stays together however many texts it holds.
COMMON, RARE_WEIGHT = 0.002, 1.5
#: Rounds in which the texts of a bucket meet a head, before the prefix filter.
HEAD_ROUNDS = 2
#: What sums of weights may differ by, against their size.
ROUNDING = 1e-5

_MIX = 0x9E3779B97F4A7C15


class Shingles:
    """Texts to hashes of their five-word shingles, some texts' bytes at a time.

    With a fixed random number for each byte and the powers of an odd number, sums
    up to each place give every word's hash in a few passes over the bytes: the sum over
    the word, divided by the power at its start. Words end at ASCII white space."""

    SLAB = 1 << 20

    def __init__(self):
        import numpy as np

        self.of_byte = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.up, self.down = self._powers(self.SLAB + 1)

    @staticmethod
    def _powers(n: int):
        import numpy as np

        odd = 0x5851F42D4C957F2D
        up, down = np.full(n, odd, np.uint64), np.full(n, pow(odd, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def _slab(self, texts: list[bytes]):
        import numpy as np

        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        up, down = (self.up, self.down) if len(data) <= len(self.up) else self._powers(len(data))
        blank = self.blank[data]
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * up[: len(data)], out=upto[1:])
        starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        ends = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
        words = (upto[ends] - upto[starts]) * down[starts]
        words ^= words >> np.uint64(32)
        words *= np.uint64(_MIX)
        first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        for a, b in zip(first[:-1], first[1:]):
            n = min(SHINGLE_WORDS, b - a)
            if n == 0:
                yield words[:0], np.empty(0, np.int64)
                continue
            h = np.zeros(b - a - n + 1, np.uint64)
            for k in range(n):
                h *= np.uint64(0x100000001B3D4F5)
                h += words[a + k : a + k + len(h)]
                h ^= h >> np.uint64(31)
            h *= np.uint64(_MIX)
            h ^= h >> np.uint64(29)
            h.sort()
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            yield h[new], np.diff(new, append=len(h))

    def each(self, texts: list[str]):
        """(sorted distinct shingle hashes, how often each occurs) of each text."""
        some, held = [], 0
        for text in texts:
            data = text.lower().encode()
            if some and held + len(data) + 1 > self.SLAB:
                yield from self._slab(some)
                some, held = [], 0
            some.append(data)
            held += len(data) + 1
        if some:
            yield from self._slab(some)


def slot(shingles):
    import numpy as np

    return (shingles >> np.uint64(64 - 18)).astype(np.int64)


def _frequencies(batches):
    """(tid, text) to (slot, n): how many texts have a shingle of the slot."""
    import numpy as np
    import pyarrow as pa

    counts, shingles = np.zeros(COUNTERS, np.int64), Shingles()
    for batch in batches:
        for found, _ in shingles.each(batch.column(1).to_pylist()):
            np.add.at(counts, slot(found), 1)
    at = np.flatnonzero(counts)
    for a in range(0, len(at), 65_536):
        some = at[a : a + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "n"])


def idf_table(texts: DataFrame):
    """Weights by slot: a table of COUNTERS numbers, whatever the corpus."""
    import numpy as np

    n = texts.count()
    rows = texts.mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS)
    counts[rows["slot"].to_numpy(int)] = rows["n"].to_numpy(float)
    share = np.clip((counts - counts.sum() / COUNTERS) / max(n, 1), COMMON, 1)
    return (1 + (RARE_WEIGHT - 1) * np.log(1 / share) / math.log(1 / COMMON)).astype(np.float32)


def weights(shingles, counts, idf):
    """TF-IDF: one and the logarithm of the count, times the shingle's table weight."""
    import numpy as np

    return (1 + np.log(counts)) * idf[slot(shingles)]


class Sampler:
    """Improved consistent weighted sampling. For each hash value and shingle, r and c
    come from Gamma(2, 1) and beta from (0, 1), as a hash of both tells. With weight w,
    t = floor(ln w / r + beta) and ln a = ln c - r * (t - beta + 1); the shingle of
    least a is drawn, together with its t. As r, c and beta are fixed for a shingle, the
    value of a itself tells both, so the least a is the hash value."""

    def __init__(self, n: int):
        import numpy as np

        x = np.linspace(1e-4, 40, 1_000_000)
        cdf = 1 - (1 + x) * np.exp(-x)
        quantile = lambda bits: np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), cdf, x)
        self.r = quantile(14).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.ln_c = np.log(quantile(20)).astype(np.float32)
        self.odd = np.random.default_rng(3).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def least(self, shingles, ln_weights, starts, slab: int = 512):
        """The least ln a of each text and hash value; texts' shingles begin at
        starts. A slab of shingles at a time stays in the processor's cache."""
        import numpy as np

        n = len(self.odd)
        out = np.full((len(starts), n), np.inf, np.float32)
        bounds = np.append(starts, len(shingles))
        all_z, all_y = np.empty((slab, n), np.uint64), np.empty((slab, n), np.uint64)
        all_t, all_v = np.empty((slab, n), np.float32), np.empty((slab, n), np.float32)
        for a in range(0, len(shingles), slab):
            m = min(slab, len(shingles) - a)
            z, y, t, value = all_z[:m], all_y[:m], all_t[:m], all_v[:m]
            np.multiply(shingles[a : a + m, None], self.odd, out=z)
            np.right_shift(z, np.uint64(32), out=y)
            z ^= y
            z *= np.uint64(0xD6E8FEB86659FD93)
            at_r = np.right_shift(z, np.uint64(50), out=y).view(np.int64)
            np.take(self.inverse, at_r, out=t, mode="clip")
            np.take(self.r, at_r, out=value, mode="clip")
            beta = np.left_shift(z.view(np.uint32)[:, 0::2], np.uint32(2)).astype(np.float32)
            beta *= np.float32(2.0**-32)
            t *= ln_weights[a : a + m, None]
            t += beta
            np.floor(t, out=t)
            t -= beta
            t += 1
            t *= value
            np.right_shift(z, np.uint64(30), out=y)
            y &= np.uint64(0xFFFFF)
            np.take(self.ln_c, y.view(np.int64), out=value, mode="clip")
            value -= t
            first = np.searchsorted(bounds, a, "right") - 1
            last = np.searchsorted(bounds, a + m, "left")
            cuts = np.maximum(bounds[first:last] - a, 0)
            np.minimum(out[first:last], np.minimum.reduceat(value, cuts, axis=0), out=out[first:last])
        return out


def _bands(idf, bands: int, rows: int):
    """(tid, text) to (bucket, tid, size): a bucket for each band, the total weight."""
    table = idf

    def run(batches):
        import numpy as np
        import pyarrow as pa

        idf, shingles, sampler = table.value, Shingles(), Sampler(bands * rows)
        odd = np.random.default_rng(5).integers(1, 1 << 62, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def emit(ids, sets):
            starts = np.cumsum([0, *(len(s) for s, _ in sets[:-1])])
            w = np.concatenate([x for _, x in sets])
            least = sampler.least(np.concatenate([s for s, _ in sets]), np.log(w).astype(np.float32), starts)
            bits = least.view(np.uint32).astype(np.uint64).reshape(len(sets), bands, rows)
            h = (bits * odd).sum(2, dtype=np.uint64)
            h ^= h >> np.uint64(31)
            h = h * np.uint64(_MIX) + odd[:, 0]
            size = np.repeat(np.add.reduceat(w, starts), bands)
            return pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(np.array(ids, object), bands), pa.binary()), pa.array(size.astype(np.float32))], names=["bucket", "tid", "size"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for tid, (s, n) in zip(batch.column(0).to_pylist(), shingles.each(batch.column(1).to_pylist())):
                ids.append(tid)
                sets.append((s, weights(s, n, idf)))
                held += len(s)
                if held > 200_000:
                    yield emit(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield emit(ids, sets)

    return run


def weighted_similarity(a, b) -> float:
    """Weighted Jaccard of two (shingles, weights), sorted by shingle."""
    import numpy as np

    _, i, j = np.intersect1d(a[0], b[0], True, True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def _verify(table, similarity: float):
    """(a, b, text_a, text_b) to the pairs (a, b) that are similar."""

    def run(batches):
        import pyarrow as pa

        idf, shingles = table.value, Shingles()

        def weighted(column):
            return ((s, weights(s, n, idf)) for s, n in shingles.each(column.to_pylist()))

        for batch in batches:
            good = [weighted_similarity(x, y) >= similarity for x, y in zip(weighted(batch.column(2)), weighted(batch.column(3)))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _weighted(table):
    """(tid, text) to (tid, shingle, w): the weighted shingles of each text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        idf, shingles = table.value, Shingles()
        for batch in batches:
            for tid, (s, n) in zip(batch.column(0).to_pylist(), shingles.each(batch.column(1).to_pylist())):
                w = np.asarray(weights(s, n, idf), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([tid] * len(s), pa.binary()), pa.array(s.view(np.int64)), pa.array(w)], names=["tid", "shingle", "w"])

    return run


def text_key(text: Column) -> Column:
    """128 bits that equal texts share; null for texts without a word."""
    return F.when(text.rlike(r"[^\t-\r ]"), F.unhex(F.md5(text)))


def alike_in_size(a: str, b: str, similarity: float) -> Column:
    """Whether total weights leave room for the similarity, which is at most their ratio."""
    return F.least(a, b) >= F.greatest(a, b) * (similarity - ROUNDING)


def prefix_pairs(weighted: DataFrame, of_text: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of other labels that may be near: all that are, and of the
    others those that share a rare shingle. weighted: (tid, shingle, w); of_text: (tid, label).

    Shingles are put in order by how many of these texts have them, rarest first. Two
    texts that are near share weight of at least s / (1 + s) of both sizes; all that
    they share stands from their first common shingle on, in both. So that shingle
    stands, in the larger text, where the rest still weighs s of its size, and in the
    smaller one where it weighs 2 s / (1 + s); only these heads of the lists meet."""
    s = similarity - ROUNDING
    weighted = settle(weighted, "nd-weighted")
    sizes = settle(weighted.groupBy("tid").agg(F.sum("w").alias("size")).join(of_text, "tid"), "nd-sizes")
    counts = settle(weighted.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "nd-counts")
    shared = settle(weighted.join(counts, "shingle"), "nd-shared-shingles")
    rest = F.sum("w").over(Window.partitionBy("tid").orderBy(F.desc("texts"), F.desc("shingle")))
    rare = shared.select("tid", "shingle", rest.alias("rest")).join(sizes, "tid").where(F.col("rest") >= F.col("size") * s)
    probe = settle(rare, "nd-probe")
    index = settle(probe.where(F.col("rest") >= F.col("size") * (2 * s / (1 + s))), "nd-index")
    other = index.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("tid", "label", "size", "rest")])
    enough = (F.col("label") != F.col("label2")) & (F.col("size2") <= F.col("size") * (1 + ROUNDING)) & alike_in_size("size", "size2", similarity)
    enough = enough & (F.least("rest", "rest2") >= (F.col("size") + F.col("size2")) * (s / (1 + s)))
    pairs = probe.join(other, "shingle").where(enough).select(F.col("tid").alias("a"), F.col("tid2").alias("b"))
    out = settle(pairs.distinct(), "nd-pairs")
    release(weighted, sizes, counts, shared, probe, index)
    return out


def classes(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(tid, label) for the distinct texts that are near another: the smallest tid of
    the class. Texts are near if the weighted Jaccard similarity of their five-word
    shingles is `similarity` or more (a text of fewer words is one shingle); a class is
    a connected component of such links. No texts give an empty table."""
    spark = docs.sparkSession
    text_batches(spark)
    keyed = docs.select(text_key(F.col(text_col)).alias("tid"), F.col(text_col).alias("text")).where(F.col("tid").isNotNull())
    every = settle_by(keyed.groupBy("tid").agg(F.first("text").alias("text")), "tid", "nd-texts")
    table = spark.sparkContext.broadcast(idf_table(every))
    buckets = settle(every.mapInArrow(_bands(table, bands, rows), "bucket long, tid binary, size float"), "nd-buckets")
    met = settle(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "nd-met")
    found = settle(buckets.join(met, "bucket"), "nd-found")
    central = settle(found.groupBy("tid").agg(F.sum("texts").alias("central")), "nd-central")
    members = settle(found.join(central, "tid").select("bucket", "tid", "size", "central"), "nd-members")
    texts = settle_by(every.join(central, "tid", "left_semi"), "tid", "nd-candidates")
    plain = spark.read.schema(texts.schema).parquet(texts.settled_at)
    release(every, buckets, met, found, central)

    def verified(pairs: DataFrame) -> DataFrame:
        # b may be the head of a large group: that side is dealt anew, so that it can be split
        left = pairs.join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a")
        full = left.join(plain.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        links = settle(full.mapInArrow(_verify(table, similarity), "a binary, b binary"), "nd-links")
        release(pairs)
        return links

    labels = None
    for turn in range(HEAD_ROUNDS + 1):
        if labels is None:
            now = members.withColumn("label", F.col("tid"))
        else:
            now = settle(members.join(labels.toDF("tid", "label"), "tid", "left").select("bucket", "tid", "size", "central", F.coalesce("label", "tid").alias("label")), "nd-labelled")
            release(members)
        order = F.struct(-F.col("central"), "tid", "label", "size")
        apart = now.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min(order).alias("head")).where("least <> most")
        apart = settle(apart.select("bucket", *[F.col(f"head.{c}").alias(f"head_{c}") for c in ("tid", "label", "size")]), "nd-apart")
        old, left = now if labels is not None else members, now.join(apart, "bucket")
        if turn == HEAD_ROUNDS:
            left = settle(left.select("tid", "label").distinct(), "nd-left")
            break
        left = settle(left.where("tid <> head_tid"), "nd-left")
        release(old, apart)
        pairs = left.where((F.col("label") != F.col("head_label")) & alike_in_size("size", "head_size", similarity))
        pairs = settle(pairs.select(F.col("tid").alias("a"), F.col("head_tid").alias("b")).distinct(), "nd-pairs")
        links = verified(pairs)
        labels = merged(labels, links)
        members = left.select("bucket", "tid", "size", "central")
        members.settled_at = left.settled_at
        release(links)
    weighted = texts.join(left.select("tid"), "tid").mapInArrow(_weighted(table), "tid binary, shingle long, w double")
    links = verified(prefix_pairs(weighted, left, similarity))
    labels = merged(labels, links)
    release(links, left, old, apart, texts)
    return labels.toDF("tid", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id of the
    class) and class_rows (rows of the class).

    Equal texts are of one class, and so are texts linked by `classes` (which heeds
    neither case nor white space). A text without words, and a null one, is a class of its own; so the
    rows of one text-less doc_id count together. Rows without a doc_id belong to their
    text's class, whose class_id is null if no row of it has a doc_id. Repeated rows
    are of one class. Other columns are ignored. An empty table gives an empty one."""
    label = classes(docs, text_col, similarity).withColumnRenamed("tid", "__tid")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tid"))
    alone = rows.where(F.col("tid").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"))
    rows = settle(rows.where(F.col("tid").isNotNull()), "nd-rows")
    per_text = settle(rows.groupBy("tid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nd-counts")
    of_text = settle(per_text.join(label, F.col("tid") == F.col("__tid"), "left").select("tid", "least", "n", F.coalesce("label", "tid").alias("label")), "nd-of-text")
    of_class = settle(of_text.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_rows")), "nd-classes")
    of_text = settle(of_text.join(of_class, "label").select("tid", "class_id", "class_rows"), "nd-class-of")
    return rows.join(of_text, "tid").select("doc_id", "class_id", "class_rows").unionByName(alone)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, less near-duplicates: of each class the row of
    smallest doc_id stays (null last; among equal ids the one of least hash; of fully
    equal rows one). Rows whose text has no word, or null, all stay. Columns may have
    any names. An empty table gives an empty one."""
    label = classes(docs, text_col).withColumnRenamed("tid", "other")
    identity = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("hash"))
    own = docs.select(text_key(F.col(text_col)).alias("tid"), identity.alias("own"), F.struct(*docs.columns).alias("row"))
    per_text = settle(own.where(F.col("tid").isNotNull()).groupBy("tid").agg(F.min("own").alias("own")), "nd-first")
    per_text = settle(per_text.join(label, F.col("tid") == F.col("other"), "left").select("tid", "own", F.coalesce("label", "tid").alias("label")), "nd-of-text")
    first = per_text.groupBy("label").agg(F.min(F.struct("own", "tid")).alias("first"))
    first = settle(first.select(F.col("first.tid").alias("first_tid"), F.col("first.own").alias("first_own")), "nd-stay")
    without = own.where(F.col("tid").isNull()).select("row.*")
    stay = own.where(F.col("tid").isNotNull()).join(first, (F.col("tid") == F.col("first_tid")) & (F.col("own") == F.col("first_own")))
    return stay.dropDuplicates(["tid"]).select("row.*").unionByName(without)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
