"""Character n-grams of texts, weighted by TF-IDF, and the leading directions of the matrix.

The matrix has a row for each text and a column for each of a bounded number of n-grams. Its
rows stay spread over the cluster; a range finder multiplies them, task by task, with a few
columns, and only sums of the size of the vocabulary travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators.filtering import ITEMS_SQL, items
from tidewatch.sources.scratch import discard, written

#: Characters of an n-gram; texts it must stand in; columns of the matrix.
SHORTEST, LONGEST, LEAST_TEXTS, MOST_TERMS = 2, 4, 3, 18_000
#: Directions, further ones that the search carries along, and its rounds.
COMPONENTS, SPARE, ROUNDS, SEED = 32, 10, 5, 42
#: Distinct n-grams that a task counts before it sends them on, and new ones that wait to be
#: sorted in; characters that it tells apart at once; texts multiplied at once; terms whose
#: sums travel in one row.
HELD, WAITING, MOST_CHARACTERS, TEXTS_AT_ONCE, BLOCK = 400_000, 100_000, 0xFFFF, 256, 1_000


def grams(text: str) -> dict[str, int]:
    """How often each n-gram of SHORTEST to LONGEST characters stands in a text."""
    from collections import Counter

    found: Counter = Counter()
    for n in range(SHORTEST, LONGEST + 1):
        found.update(map("".join, zip(*(text[k:] for k in range(n)))))
    return found


def _keys(points, numbers):
    """The n-grams of a text's code points, and how often each stands in it: an n-gram is its
    characters' numbers, 16 bits each (LONGEST is 4 at most, and no number is 0)."""
    import numpy as np

    own = numbers[points].astype(np.uint64)
    runs, found = own, []
    for n in range(1, LONGEST + 1):
        if n > 1:
            runs = runs[:-1] << np.uint64(16) | own[n - 1 :]
        if n >= SHORTEST:
            found.append(runs)
    return np.unique(np.concatenate(found), return_counts=True)


def _points(text: str | None):
    import numpy as np

    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def _spelt(keys, characters) -> list[str]:
    """The n-grams of keys; characters: the code point of each number."""
    import numpy as np

    parts = np.stack([(keys >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in reversed(range(LONGEST))], axis=1)
    lengths = (parts > 0).sum(axis=1).tolist()
    whole = np.asarray(characters, np.uint32)[parts].tobytes().decode("utf-32-le")
    return [whole[end - n : end] for n, end in zip(lengths, range(LONGEST, len(whole) + 1, LONGEST))]


def _found(keys, own):
    """Where own stand in the sorted keys, and which of them do."""
    import numpy as np

    if not len(keys):
        return np.zeros(len(own), np.int64), np.zeros(len(own), bool)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return at, keys[at] == own


def _told(terms, texts, n):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(texts, pa.int64()), pa.array(n, pa.int64())], names=["term", "texts", "n"])


def _counted(batches):
    """(id, text) to (term, texts, n): in how many of the task's texts, and how often.

    Characters are numbered as they come, n-grams are numbers made of those, and the counts of
    those met before are arrays; new n-grams wait until there are enough to be sorted in."""
    import numpy as np

    numbers, characters = np.zeros(0x110000, np.uint16), [0]
    keys, texts, n = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
    new, waiting = [], 0

    def merged():
        every = np.concatenate([keys, *(k for k, _ in new)])
        order = np.argsort(every, kind="stable")
        every = every[order]
        starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        both = [np.concatenate([texts, np.ones(waiting, np.int64)]), np.concatenate([n, *(c for _, c in new)])]
        return every[starts], *(np.add.reduceat(x[order], starts) if len(starts) else x for x in both)

    for batch in batches:
        for text in batch.column(1).to_pylist():
            points = _points(text)
            unknown = np.unique(points[numbers[points] == 0])
            if len(characters) + len(unknown) > MOST_CHARACTERS:  # begin anew
                keys, texts, n = merged()
                yield _told(_spelt(keys, characters), texts, n)
                keys, texts, n, new, waiting = keys[:0], texts[:0], n[:0], [], 0
                numbers[:], characters = 0, [0]
                unknown = np.unique(points)
                if len(unknown) >= MOST_CHARACTERS:  # in one text
                    own = grams(text)
                    yield _told(list(own), [1] * len(own), list(own.values()))
                    continue
            numbers[unknown] = np.arange(len(characters), len(characters) + len(unknown))
            characters.extend(unknown.tolist())
            own, often = _keys(points, numbers)
            at, met = _found(keys, own)
            texts[at[met]] += 1
            n[at[met]] += often[met]
            if not met.all():
                new.append((own[~met], often[~met]))
                waiting += len(new[-1][0])
            if waiting > WAITING:
                keys, texts, n = merged()
                new, waiting = [], 0
                if len(keys) > HELD:
                    yield _told(_spelt(keys, characters), texts, n)
                    keys, texts, n = keys[:0], texts[:0], n[:0]
    keys, texts, n = merged()
    if len(keys):
        yield _told(_spelt(keys, characters), texts, n)


def vocabulary(texts: DataFrame, most: int = MOST_TERMS, least: int = LEAST_TEXTS) -> DataFrame:
    """(term, texts, n): the `most` most frequent n-grams that stand in `least` texts or more
    of texts (id, text), ties to the smaller term. Counted where the texts are; only counts
    are shuffled."""
    counts = texts.mapInArrow(_counted, "term string, texts long, n long").groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"))
    return counts.where(F.col("texts") >= least).orderBy(F.desc("n"), "term").limit(most)


def idf(texts: str, total: str) -> str:
    return f"ln((1.0 + {total}) / (1.0 + {texts})) + 1"


def tfidf(texts: DataFrame, terms: dict[str, tuple[int, float]], packed: bool = False) -> DataFrame:
    """(id, at, weight): each text's n-grams by their place in `terms` (term to place and
    inverse frequency; MOST_TERMS at most), weighing 1 + ln(n) times that, scaled to length 1.
    A text without any, or a null one, has none. If packed, bytes stand for both, about two an
    n-gram: the gaps between places, and the counts n, of which `_dense` makes the weights."""
    known = texts.sparkSession.sparkContext.broadcast(terms)
    id_type = texts.schema[0].dataType.simpleString()

    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        of = known.value
        characters = sorted({c for term in of for c in term})
        plain = len(characters) >= MOST_CHARACTERS
        numbers = np.full(0x110000, 0xFFFF, np.uint16)  # a character of no term
        if not plain:
            numbers[_points("".join(characters))] = np.arange(1, len(characters) + 1)
        keys = np.array([0 if plain else sum(int(numbers[ord(c)]) << 16 * k for k, c in enumerate(reversed(term))) for term in of], np.uint64)
        order = np.argsort(keys)
        keys, places, rarity = keys[order], np.array([p for p, _ in of.values()], np.int32)[order], np.array([i for _, i in of.values()], np.float64)[order]
        for batch in batches:
            at, weights = ([], []) if packed else ([np.zeros(0, np.int32)], [np.zeros(0)])
            for text in batch.column(1).to_pylist():
                if plain:
                    own = sorted((of[t][0], of[t][1], n) for t, n in grams(text or "").items() if t in of)
                    place, i, n = np.array([p for p, _, _ in own], np.int32), np.array([i for _, i, _ in own]), np.array([n for _, _, n in own])
                else:
                    own, n = _keys(_points(text), numbers)
                    there, met = _found(keys, own)
                    there, n = there[met], n[met]
                    by = np.argsort(places[there])
                    place, i, n = places[there][by], rarity[there][by], n[by]
                if packed:
                    at.append(_packed(np.diff(place, prepend=-1) - 1))
                    weights.append(_packed(n))
                    continue
                w = (1 + np.log(n)) * i
                at.append(place)
                weights.append(w / np.sqrt((w * w).sum()) if len(w) else w)
            ends = np.cumsum([len(x) for x in at], dtype=np.int32)
            lists = [pa.array(x, pa.binary()) if packed else pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in (at, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "at", "weight"])

    return texts.mapInArrow(weigh, f"id {id_type}, " + ("at binary, weight binary" if packed else "at array<int>, weight array<double>"))


def _packed(values) -> bytes:
    """Whole numbers from 0 as bytes, most of them in one: 255 as often as it goes, then the rest."""
    import numpy as np

    times, rest = np.divmod(values, 255)
    if not times.any():
        return rest.astype(np.uint8).tobytes()
    found = np.full(len(rest) + int(times.sum()), 255, np.uint8)
    found[np.cumsum(times + 1) - 1] = rest
    return found.tobytes()


def _unpacked(rows: list[bytes]):
    """(row, value) of the numbers of some packed rows."""
    import numpy as np

    found = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.flatnonzero(found < 255)
    return np.repeat(np.arange(len(rows)), [len(x) for x in rows])[ends], np.diff(np.cumsum(found, dtype=np.int64)[ends], prepend=0)


def _dense(batch, rarity):
    """Parts of a batch (.., at, weight) of packed rows as dense rows, some texts at a time.
    rarity: the terms' inverse frequencies."""
    import numpy as np

    for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
        part = batch.slice(start, TEXTS_AT_ONCE)
        rows = np.zeros((part.num_rows, len(rarity)))
        owner, gaps = _unpacked(part.column("at").to_pylist())
        _, n = _unpacked(part.column("weight").to_pylist())
        before = np.append(0, np.cumsum(gaps + 1))
        place = before[1:] - before[np.searchsorted(owner, np.arange(part.num_rows))][owner] - 1
        w = (1 + np.log(n)) * rarity[place]
        rows[owner, place] = w / np.sqrt(np.bincount(owner, w * w, minlength=part.num_rows))[owner]
        yield rows


def _summed(batches):
    """(block, sums) added up by block, whatever the number of rows."""
    import numpy as np
    import pyarrow as pa

    total: dict[int, object] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.asarray(sums.values)
            total[block] = total[block] + own if block in total else own.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["block", "sums"])


def _added(parts: DataFrame, columns: int):
    """Tasks' sums (block, sums) of matrices with so many columns, added up in parallel."""
    import numpy as np

    found = {r["block"]: r["sums"] for r in parts.repartition("block").mapInArrow(_summed, parts.schema).collect()}
    return np.concatenate([np.zeros(0), *(found[k] for k in sorted(found))]).reshape(-1, columns)


def _product(rows: DataFrame, rarity, columns):
    """With A the matrix of packed rows and Q the columns: A'(AQ), summed over tasks. Each task
    tells its sum in blocks; blocks are added up in parallel."""
    import numpy as np

    width = columns.shape[0]
    shared = rows.sparkSession.sparkContext.broadcast((columns, rarity))  # MOST_TERMS x (COMPONENTS + SPARE) numbers: 6 MB at most

    def multiply(batches):
        import pyarrow as pa

        q, rare = shared.value
        total = np.zeros((q.shape[1], width))
        for batch in batches:
            for dense in _dense(batch, rare):
                total += (dense @ q).T @ dense
        starts = range(0, width, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([total[:, s : s + BLOCK].T.ravel() for s in starts], pa.list_(pa.float64()))], names=["block", "sums"])

    out = _added(rows.select("at", "weight").mapInArrow(multiply, "block int, sums array<double>"), columns.shape[1])
    shared.unpersist()
    return out


def projected(rows: DataFrame, rarity, columns) -> DataFrame:
    """(id, features): each text's packed row times the columns."""
    shared = rows.sparkSession.sparkContext.broadcast((columns, rarity))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        q, rare = shared.value
        for batch in batches:
            found = [dense @ q for dense in _dense(batch, rare)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.concatenate(found)) if found else [], pa.list_(pa.float64()))], names=["id", "features"])

    return rows.mapInArrow(run, f"id {id_type}, features array<double>")


def turned(images: DataFrame, turns) -> DataFrame:
    """(id, features) times a small matrix."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = batch.column(1).flatten().to_numpy().reshape(-1, turns.shape[0]) @ turns
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["id", "features"])

    return images.mapInArrow(run, images.schema)


def _gram(images: DataFrame, columns: int):
    """Y'Y of the matrix of images (id, features)."""

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((columns, columns))
        for batch in batches:
            own = batch.column(0).flatten().to_numpy().reshape(-1, columns)
            total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["block", "sums"])

    return _added(images.select("features").mapInArrow(multiply, "block int, sums array<double>"), columns)


def along_directions(rows: DataFrame, rarity, n_texts: int, components: int = COMPONENTS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, features): each text's packed row, given the terms' inverse frequencies, along the
    right singular vectors of the matrix of all, for the k = min(components, texts - 1, width - 1) largest values. A random start
    is multiplied by A'A and made orthogonal `rounds` times; the Gram matrix of its image then
    tells how the image, which is kept, is turned. Each vector's entry of largest size is
    positive."""
    import numpy as np

    width = len(rarity)
    k = max(0, min(components, n_texts - 1, width - 1))
    if k == 0:
        return rows.select("id", F.array().cast("array<double>").alias("features"))
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + SPARE))))
    for _ in range(rounds):
        q, _ = np.linalg.qr(_product(rows, rarity, q))
    images = written(projected(rows, rarity, q))
    discard(rows)
    values, turns = np.linalg.eigh(_gram(images, q.shape[1]))
    turns = turns[:, np.argsort(-values)[:k]]
    v = q @ turns
    signs = np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    return turned(images, turns * np.where(signs == 0, 1, signs))


def text_features(texts: DataFrame, most: int = MOST_TERMS, components: int = COMPONENTS) -> DataFrame:
    """(id, features) of texts (id, text): up to `components` numbers each, from the leading
    directions of the TF-IDF matrix of their character n-grams. Texts without any known
    n-gram have zeros; where there is nothing to learn, features are empty. Repeated rows
    count as texts of their own."""
    import math

    import numpy as np

    texts = written(texts)  # read twice
    total = texts.count()
    found = vocabulary(texts, most).collect()  # `most` rows at most
    terms = {r["term"]: (i, math.log((1 + total) / (1 + r["texts"])) + 1) for i, r in enumerate(found)}
    rows = written(tfidf(texts, terms, packed=True))  # read once a round, and once more
    discard(texts)
    return along_directions(rows, np.array([rarity for _, rarity in terms.values()], float), total, components)


def _texts(spark, sf_dir) -> DataFrame:
    return items(spark, sf_dir).select(F.col("raw_id").alias("id"), T.normalized(F.concat_ws(" ", "title", "summary")).alias("text"))


def char_tfidf_terms(spark, sf_dir):
    """The character n-grams that become columns: texts they stand in, how often, and their
    inverse frequency."""
    texts = _texts(spark, sf_dir)
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    return vocabulary(texts).crossJoin(F.broadcast(total)).select("term", "texts", "n", F.round(F.expr(idf("texts", "total")), 9).alias("idf"))  # one row


def char_tfidf_svd(spark, sf_dir):
    """Each item's 32 features: its weighted character n-grams along the leading directions
    of all items."""
    return text_features(_texts(spark, sf_dir)).select(F.col("id").alias("raw_id"), "features")


QUERIES = {f.__name__: f for f in (char_tfidf_terms, char_tfidf_svd)}
ORACLE_SQL = {
    "char_tfidf_terms": f"""WITH {ITEMS_SQL}, t AS (SELECT raw_id, {T.normalized_sql("concat_ws(' ', title, summary)")} AS text FROM items), k AS (SELECT unnest(range({SHORTEST}, {LONGEST + 1})) AS k),
      g AS (SELECT raw_id, unnest(list_transform(range(1, length(text) - k + 2), lambda i: text[i:i + k - 1])) AS term FROM t, k WHERE length(text) >= k), h AS (SELECT raw_id, term, count(*) AS own FROM g GROUP BY ALL), f AS (SELECT term, count(*) AS texts, CAST(sum(own) AS BIGINT) AS n FROM h GROUP BY term HAVING count(*) >= {LEAST_TEXTS} ORDER BY n DESC, term LIMIT {MOST_TERMS})
      SELECT term, texts, n, round({idf('texts', '(SELECT count(*) FROM t)')}, 9) AS idf FROM f""",
}
