"""Phrase collocation mining with exact counts.

Equal pieces of text are brought together first and counted once with their number.
Their n-grams are dealt to hash buckets, and DuckDB adds up each bucket, out of core.
A phrase is counted only if all its shorter phrases may be frequent; Bloom filters of
fixed size tell which may be, so pruning never loses a phrase and what is broadcast
does not grow with the corpus. The counts of a phrase's two parts are found by requests
that are shuffled to where these counts stand.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import quoted, release, settle, text_batches, with_positions

LONGEST, LEAST_COUNT, FIRST = 5, 100, 2_000
#: Memory of DuckDB in one bucket; beyond it spills to the task's own temporary folder.
BUCKET_MEMORY = "256MB"
#: Bits of the pruning filters, as powers of two: least and most (8 MB, the bound of what is broadcast).
FEWEST_BITS, MOST_BITS = 20, 26
#: n-grams a task adds up before it sends them on, and bytes it looks at together.
GATHERED, SLAB = 1 << 19, 1 << 20

_ODD, _MIX = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15
PHRASES = "lang string, phrase string, m long"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): every piece with its words between single blanks, and how often
    it stands in the language's texts. Pieces without a word are left out; a null language
    is `und`, a null text empty."""
    text = F.translate(F.coalesce(quoted(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz ")
    each = docs.select(F.coalesce(quoted(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]+")).alias("piece"))
    each = each.select("lang", F.trim(F.regexp_replace("piece", " {2,}", " ")).alias("piece"))
    return each.where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


class Words:
    """The words of a batch (lang, piece, m): where they start and end in the bytes, the
    piece of each, and a hash that depends on the language too."""

    def __init__(self, langs, texts):
        import numpy as np

        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = (offsets - offsets[0]).astype(np.int64)
        blanks = np.flatnonzero(self.data == 32)
        self.starts = np.sort(np.concatenate([offsets[:-1], blanks + 1]))
        self.ends = np.sort(np.concatenate([offsets[1:], blanks]))
        self.piece = np.searchsorted(offsets, self.starts, side="right") - 1
        self.hash = self._hashes() ^ self._of_langs(langs)[self.piece]

    def _hashes(self):
        """A hash of each word: its bytes' sum with rising powers of an odd number, divided by the power at its start."""
        import numpy as np

        n = len(self.data)
        up, down = np.full(n + 1, _ODD, np.uint64), np.full(n + 1, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX) * np.cumprod(up, dtype=np.uint64)[:n], out=upto[1:])
        h = (upto[self.ends] - upto[self.starts]) * np.cumprod(down, dtype=np.uint64)[self.starts]
        h ^= h >> np.uint64(31)
        return h * np.uint64(_MIX)

    @staticmethod
    def _of_langs(langs):
        import hashlib

        import numpy as np

        coded = langs.dictionary_encode()
        of = [int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in coded.dictionary.to_pylist()]
        return np.array(of, np.uint64)[coded.indices.to_numpy()]

    def pairs(self):
        """A hash of each word with the next, and whether both are in one piece."""
        import numpy as np

        h = (self.hash[:-1] * np.uint64(_ODD)) ^ (self.hash[1:] >> np.uint64(7)) ^ (self.hash[1:] << np.uint64(57))
        h *= np.uint64(_MIX)
        return h ^ (h >> np.uint64(32)), self.piece[:-1] == self.piece[1:]

    def slices(self, first, n: int):
        """The phrases of n words from the words `first` on, as an Arrow array: bytes as they stand."""
        import numpy as np
        import pyarrow as pa

        starts, lengths = self.starts[first], self.ends[first + n - 1] - self.starts[first]
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[at])])


def _bits(hashes, size: int):
    """The two bits of each hash in a filter of 2 ** size bits."""
    import numpy as np

    return [((hashes >> np.uint64(k)) & np.uint64((1 << size) - 1)).astype(np.int64) for k in (0, 64 - size)]


def _held(hashes, bits):
    import numpy as np

    size = int(len(bits) * 8).bit_length() - 1
    a, b = _bits(hashes, size)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _slabs(batch):
    """Parts of a batch whose texts have up to SLAB bytes, but for single longer ones."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLAB, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _ngrams(lengths: range, words, pairs):
    """A function of batches (lang, piece, m) to (lang, phrase, m), added up as far as a
    task sees: phrases of the given numbers of words whose words (or neighbouring pairs
    of words) the filter `words` (or `pairs`, broadcasts) does not rule out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        waiting, held = [], 0

        def added():
            table = pa.concat_tables(waiting).group_by(["lang", "phrase"]).aggregate([("m", "sum")])
            return pa.table({"lang": table["lang"], "phrase": table["phrase"], "m": table["m_sum"]}).combine_chunks().to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for part in _slabs(batch):
                langs, texts, m = part.columns
                of = Words(langs, texts)
                rows = []
                if 1 in lengths:
                    rows.append((np.arange(len(of.starts)), 1))
                elif len(of.starts) > 1:
                    hashes, near = of.pairs()
                    if words is not None:
                        usual = _held(of.hash, words.value)
                        near &= usual[:-1] & usual[1:]
                    if pairs is not None:
                        near[near] = _held(hashes[near], pairs.value)
                    run_of = near.copy()
                    for n in range(2, lengths.stop):
                        if n > 2:
                            run_of = run_of[:-1] & near[n - 2 :]
                        if n in lengths:
                            rows.append((np.flatnonzero(run_of), n))
                counts = m.to_numpy()
                for first, n in rows:
                    if len(first):
                        waiting.append(pa.table({"lang": langs.take(pa.array(of.piece[first])), "phrase": of.slices(first, n), "m": pa.array(counts[of.piece[first]])}))
                        held += len(first)
                if held >= GATHERED:
                    yield from added()
                    waiting, held = [], 0
        if waiting:
            yield from added()

    return run


def _bucket(least: int):
    """A function of one hash bucket's batches (lang, phrase, m) to its phrases that occur
    `least` times and more. DuckDB reads the batches as they come and spills what
    does not fit to a folder of this task alone, which goes with it; a lost task is run
    again from its input."""

    def run(batches):
        import duckdb
        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int64())])
        given = (pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema) for b in batches)
        with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": folder}) as base:
            base.register("part", pa.RecordBatchReader.from_batches(schema, given))
            found = base.sql(f"SELECT lang, phrase, CAST(sum(m) AS BIGINT) AS m FROM part GROUP BY ALL HAVING sum(m) >= {least}")
            yield from found.to_arrow_reader(1 << 16)

    return run


def counted(found: DataFrame, lengths: range, least: int, words=None, pairs=None) -> DataFrame:
    """(lang, phrase, m): the phrases of so many words that occur at least `least` times in
    `found`, from `pieces`. Rows are added up before they go to their buckets, so a
    frequent phrase is no hot key."""
    sent = found.mapInArrow(_ngrams(lengths, words, pairs), PHRASES)
    return sent.repartition("lang", "phrase").mapInArrow(_bucket(least), PHRASES)


def pruner(phrases: DataFrame, n_words: int):
    """A broadcast Bloom filter of the phrases (lang, phrase) of one or two words. Tasks set
    the bits; the driver gets at most 2 ** MOST_BITS of them, 64 to a row."""
    import numpy as np

    size = min(MOST_BITS, max(FEWEST_BITS, (16 * phrases.count()).bit_length()))

    def cells(batches):
        import pyarrow as pa

        bits = None
        for batch in batches:
            bits = np.zeros(1 << size - 6, np.uint64) if bits is None else bits
            for part in _slabs(batch):
                of = Words(*part.columns)
                for at in _bits(of.hash if n_words == 1 else of.pairs()[0][of.pairs()[1]], size):
                    np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        if bits is not None:
            cell = np.flatnonzero(bits)
            for a in range(0, len(cell), 1 << 16):
                own = cell[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(bits[own].view(np.int64))], names=["cell", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(cells, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(1 << size - 6, np.int64)
    whole[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(whole.view(np.uint8))


def frequent(found: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, m, words): all phrases of 1 to `longest` words that occur `least`
    times and more, with exact counts, as a settled table."""
    single = settle(counted(found, range(1, 2), least), "collocation-words")
    words = pruner(single, 1)
    double = settle(counted(found, range(2, 3), least, words), "collocation-pairs")
    pairs = pruner(double, 2)
    longer = counted(found, range(3, longest + 1), least, words, pairs)
    n_words = F.size(F.split("phrase", " ")).alias("words")
    out = settle(single.unionByName(double).unionByName(longer).select("*", n_words), "collocation-counts")
    release(single, double)
    return out


def scored(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among `counts`, from `frequent`,
    each at the cut where it scores least. sizes: (lang, n).

    A request for each part of each cut is shuffled to the part's count; the answers meet
    again by phrase. Parts of a frequent phrase are frequent, so none stays without one.
    Products are decimals of 38 digits; they hold 1000 a n up to 10^38."""
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = counts.where("words > 1").select("lang", "phrase", F.col("m").alias("a"), cut)
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("first"))
    parts = F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("first").alias("part")), F.struct(F.lit(False).alias("left"), F.expr("substr(phrase, char_length(first) + 2)").alias("part"))))
    requests = cuts.select("lang", "phrase", "a", "k", parts.alias("x")).select("lang", "phrase", "a", "k", "x.*")
    known = counts.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of_phrase"), F.col("m").alias("f"))
    answers = requests.join(known, (F.col("lang") == F.col("of_lang")) & (F.col("part") == F.col("of_phrase")))
    met = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("(1000 * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    met = met.join(sizes, "lang").select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    least = met.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def maximal(counts: DataFrame) -> DataFrame:
    """(lang, phrase) of the candidates that stand in no longer candidate which occurs as
    often. What stands between them occurs as often too, so only candidates of one word
    more need a look: each tells its count to its two phrases of one word less."""
    tell = F.explode(F.array(F.expr("substr(phrase, char_length(substring_index(phrase, ' ', 1)) + 2)"), F.expr("substring_index(phrase, ' ', words - 1)")))
    told = counts.where("words > 2").select("lang", tell.alias("phrase"), F.col("m").alias("above")).groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    return counts.where("words > 1").join(told, ["lang", "phrase"], "left").where("above IS NULL OR above < m").select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` best phrases of 2 to
    LONGEST words by score, then count, then phrase in byte order.

    Texts are lower-cased in A-Z and cut at `.,;:!?` and line ends; words are what stands
    between blanks and tabs. Null and empty texts have no words, a null language is
    `und`; repeated rows count as often as they stand there; other columns are not read;
    an empty table gives an empty one. Ranks come from positions in a range-partitioned
    order, so no task sees a whole language."""
    text_batches(docs.sparkSession)
    found = settle(pieces(docs, text_col, lang_col), "collocation-pieces", "zstd")
    n_words = F.char_length("piece") - F.char_length(F.translate("piece", " ", "")) + 1
    sizes = settle(found.groupBy("lang").agg(F.sum(F.col("m") * n_words).alias("n")), "collocation-sizes")
    counts = frequent(found, least)
    best = scored(counts, sizes).join(maximal(counts), ["lang", "phrase"], "left_semi")
    ordered = best.select("*", (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_count"))
    placed = with_positions(ordered, ["lang", "by_score", "by_count", "phrase"], "collocation-ranks", group="lang")
    release(found, sizes)
    return placed.where(F.col("position") < first).select("lang", (F.col("position") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
s AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS words),
g AS (SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase FROM w, k WHERE len(w) >= words),
f AS (SELECT lang, words, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE words > 1),
x AS (SELECT c.*, unnest(range(1, words)) AS cut FROM c),
y AS (SELECT x.lang, x.phrase, x.words, x.a, x.cut, lf.f AS l, rf.f AS r, s.n, (1000 * x.a * s.n) // (lf.f * rf.f) AS score
  FROM x JOIN f lf ON lf.lang = x.lang AND lf.phrase = array_to_string(x.p[1:x.cut], ' ')
  JOIN f rf ON rf.lang = x.lang AND rf.phrase = array_to_string(x.p[x.cut + 1:x.words], ' ') JOIN s ON s.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
b AS (SELECT lang, a, unnest(list_transform(range(2, words), lambda n: list_transform(range(1, words - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' ')))) AS subs FROM c WHERE words > 2),
d AS (SELECT DISTINCT u.lang, u.sub FROM (SELECT lang, a, unnest(subs) AS sub FROM b) u JOIN c ON c.lang = u.lang AND c.phrase = u.sub WHERE 100 * u.a >= 100 * c.a),
t AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, z.a DESC, z.phrase) AS rank FROM z ANTI JOIN d ON d.lang = z.lang AND d.sub = z.phrase)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000
"""
