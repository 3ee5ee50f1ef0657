"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of its usual n-grams. The filters stand side by side:
one row of bits for each slot, one bit for each language. A look-up reads the rows of
an n-gram's slots and joins them with AND, which gives all languages that hold the
n-gram at once. The bits are counted over a text, language by language, and what
a filter answers falsely is taken off before the counts are compared.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import in_batches, kept, quoted, release, schema_with, settle, text_batches

#: Characters of the longest n-gram; all shorter ones count too.
LONGEST = 4
#: Slots of the filters, as a power of two, and the slots an n-gram sets.
SLOT_BITS, SLOTS_EACH = 18, 3
#: A language's filter holds the n-grams that are at least one in USUAL of its n-grams:
#: these can be USUAL at most, so the filters need no other bound.
USUAL = 1 << 15
#: Learning rows of each language, about: those of the least hash.
SAMPLE_ROWS = 1_000
#: Characters looked at together; longer texts are taken in pieces that overlap.
SLAB = 1 << 16

UNKNOWN = "und"
_ODD, _MIX = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15


@cache
def _kinds():
    """For each code point whether it is a letter, and whether it stands in words (a letter or a mark)."""
    import numpy as np

    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    word = letter.copy()
    word[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "M"]] = True
    return letter, word


def _pieces(texts: list[str]):
    """(index of the text, its next characters, how many n-grams may start in them)."""
    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        for at in range(0, len(text), SLAB):
            yield i, text[at : at + SLAB + LONGEST - 1], min(SLAB, len(text) - at)


def _slabs(texts: list[str]):
    some: list[tuple[int, str, int]] = []
    held = 0
    for piece in _pieces(texts):
        if some and held + len(piece[1]) > SLAB:
            yield some
            some, held = [], 0
        some.append(piece)
        held += len(piece[1])
    if some:
        yield some


def ngrams(texts: list[str]):
    """Slab by slab: (hashes of n-grams, index of the text of each, indices of the texts
    with a letter). An n-gram is up to LONGEST characters in a row, lower case, of one
    word and the limits of it; all that is no letter or mark is a limit."""
    import numpy as np

    letter, word = _kinds()
    for some in _slabs(texts):
        codes = np.frombuffer("".join(t for _, t, _ in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for _, t, _ in some])
        owner = np.repeat(np.array([i for i, _, _ in some]), lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        may_start = np.arange(len(codes)) < np.repeat(np.cumsum(lengths) - lengths + np.array([n for _, _, n in some]), lengths)
        inside = word[codes]
        known = np.where(inside, codes, 0).astype(np.uint64) + np.uint64(1)
        rolled, hashes, owners = known, [], []
        for n in range(1, LONGEST + 1):
            size = len(codes) - n + 1
            if size <= 0:
                break
            if n > 1:
                rolled = rolled[:size] * np.uint64(_ODD) + known[n - 1 :]
            good = may_start[:size] & (np.arange(n, size + n) <= ends[:size])
            if n <= 2:
                good &= inside[:size] | inside[n - 1 :]
            for k in range(1, n - 1):
                good &= inside[k : size + k]
            h = rolled[good] * np.uint64(_MIX)
            h ^= h >> np.uint64(29)
            h *= np.uint64(_ODD)
            h ^= h >> np.uint64(32)
            hashes.append(h)
            owners.append(owner[:size][good])
        owners = np.concatenate(owners)
        if len(owners):
            yield np.concatenate(hashes), owners, np.unique(owner[letter[codes]])


def slots(hashes):
    """The slots of each n-gram, one array for each of its SLOTS_EACH."""
    import numpy as np

    return [((hashes >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(SLOTS_EACH)]


def answers(filters, hashes):
    """The languages that hold each n-gram, as words of 64 bits: (word, n-gram)."""
    import numpy as np

    first, *more = slots(hashes)
    found = np.take(filters, first, axis=1)
    for slot in more:
        found &= np.take(filters, slot, axis=1)
    return found


def _counted(batches):
    """(lang_id, text) to (lang_id, ngram, n): how often the task's texts have each n-gram."""
    import numpy as np
    import pyarrow as pa

    held: dict[int, list] = {}

    def together(parts: list) -> list:
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64))]

    for batch in batches:
        ids = np.array(batch.column(0).to_pylist(), np.int64)
        for hashes, owners, _ in ngrams(batch.column(1).to_pylist()):
            of = ids[owners]
            for lang in np.unique(of):
                parts = held.setdefault(int(lang), [])
                parts.append(np.unique(hashes[of == lang], return_counts=True))
                if len(parts) >= 16:
                    held[int(lang)] = together(parts)
    for lang, parts in held.items():
        keys, n = together(parts)[0]
        for at in range(0, len(keys), 1 << 16):
            own = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), lang, np.int32)), pa.array(own.view(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["lang_id", "ngram", "n"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The filters of the languages in `lang_col`: `langs` in code-point order, `rows`
    (documents of each), `filters` (word of 64 languages, slot), `false` (the share of
    strange n-grams that a filter says it holds) and `reach` (the share of a language's
    own n-grams that its filter holds).

    Learns from documents with a text, a language and an id that are not held out: of
    each language all, or where it has more than `sample_rows` that share of them, by a
    hash of id and text. Texts are learnt from whole, inside tasks; the driver gets the
    filters' rows, 2 ** SLOT_BITS for each 64 languages at most. Repeated rows count as
    often as they stand there. An empty table gives no language."""
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    found = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    words = max(1, -(-len(found) // 64))
    model = {"langs": [x for x, _ in found], "rows": np.array([n for _, n in found], np.int64), "filters": np.zeros((words, 1 << SLOT_BITS), np.uint64), "reach": np.ones(len(found))}
    if found:
        shares = [(lang, i, min(1 << 30, sample_rows * (1 << 30) // n)) for i, (lang, n) in enumerate(found)]
        shares = spark.createDataFrame(shares, "lang string, lang_id int, below long")  # a row for each language
        some = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("below"))
        text_batches(spark)
        counts = some.select("lang_id", "text").repartition(max(8, 2 * len(found))).mapInArrow(_counted, "lang_id int, ngram long, n long")
        counts = settle(counts.groupBy("lang_id", "ngram").agg(F.sum("n").alias("n")), "language-ngrams")
        totals = counts.groupBy("lang_id").agg(F.sum("n").alias("total"))
        usual = counts.join(F.broadcast(totals), "lang_id").where(F.col("n") * USUAL >= F.col("total"))
        for r in usual.groupBy("lang_id").agg((F.sum("n") / F.first("total")).alias("reach")).collect():
            model["reach"][r["lang_id"]] = r["reach"]
        slot = [F.shiftrightunsigned("ngram", k * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot") for k in range(SLOTS_EACH)]
        bits = usual.select(F.explode(F.array(*slot)).alias("slot"), F.expr("lang_id div 64").alias("word"), F.expr("shiftleft(1L, lang_id % 64)").alias("mask"))
        bits = bits.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        model["filters"][bits["word"].to_numpy(), bits["slot"].to_numpy()] = bits["mask"].to_numpy().view(np.uint64)
        release(counts)
    fill = [float(((model["filters"][i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(found))]
    model["false"] = np.array(fill) ** SLOTS_EACH
    return model


def decide(model: dict, texts: list[str | None]) -> list[tuple[str, float]]:
    """The language and its score for each text: counts of held n-grams, corrected for
    false answers and for what a language's filter reaches of its own n-grams; the
    largest wins, then the language with more documents, then the first by code point.
    The score is its share of all languages' corrected counts. A null text, or one
    without a letter, is UNKNOWN with score 0; so is every text if no language is known."""
    import numpy as np

    n_langs = len(model["langs"])
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    held, seen, lettered = np.zeros((len(texts), n_langs)), np.zeros(len(texts)), set()
    if n_langs:
        for hashes, owners, with_letter in ngrams([t or "" for t in texts]):
            lettered.update(with_letter.tolist())
            seen += np.bincount(owners, minlength=len(texts))
            found = answers(model["filters"], hashes)
            low, high = int(owners.min()), int(owners.max()) + 1
            for i in range(0, n_langs, 8):  # the bits of eight languages at a time
                eight = ((found[i // 64] >> np.uint64(i % 64)) & np.uint64(255)).astype(np.int64)
                patterns = np.bincount((owners - low) * 256 + eight, minlength=(high - low) * 256).reshape(-1, 256)
                held[low:high, i : i + 8] += (patterns @ bits)[:, : n_langs - i]
    false = model["false"]
    counts = np.maximum(held - seen[:, None] * false, 0) / np.maximum((1 - false) * model["reach"], 1e-9)
    out = []
    for i in range(len(texts)):
        if i not in lettered:
            out.append((UNKNOWN, 0.0))
            continue
        best = max(range(n_langs), key=lambda k: (counts[i, k], model["rows"][k], -k))
        total = counts[i].sum()
        out.append((model["langs"][best], float(counts[i, best] / total) if total > 0 else 0.0))
    return out


def identify(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (else all but those named like a result), lang_pred and score
    (0 to 1), a row for each row of docs, from the whole text and nothing else. Null
    texts and those without a letter are `und` with score 0; repeated rows give repeated
    results; an empty table gives an empty one. Columns may have any names."""
    keep = kept(docs, keep, [], ["lang_pred", "score"])
    columns = [quoted(c) for c in keep]
    text_batches(docs.sparkSession)
    schema = schema_with(docs.select(*columns), "lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for each 64 languages

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = decide(shared.value, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names)

    return in_batches(docs.select(*columns, quoted(text_col)), run, schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
