"""Terms found in texts: any number of words and any script, by an automaton over all terms.

A term of Latin letters, digits and a few signs must stand between other characters than
letters and digits; any other term, Hangul for one, counts wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T

#: Bytes of the terms that are broadcast at once; more terms are taken in several groups.
TERM_BYTES = 4 << 20
#: A term that needs limits around it (fixed value).
LATIN = "^[a-z0-9 .&+-]+$"
_LIMITED = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def prepared_terms(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term): different terms of two characters or more, normalised as texts are."""
    return terms.select(T.normalized(F.col(term_col)).alias("term")).where("char_length(term) >= 2").distinct()


def _automaton(terms: list[str]):
    import re

    import ahocorasick

    found, latin = ahocorasick.Automaton(), re.compile(LATIN)
    for t in terms:
        found.add_word(t, (t, latin.match(t) is not None))
    found.make_automaton()
    return found


def held_terms(automaton, text: str) -> set[str]:
    """The terms of an automaton that a normalised text holds."""
    held = set()
    for end, (term, limited) in automaton.iter(text):
        if term not in held:
            start = end - len(term) + 1
            if not limited or ((start == 0 or text[start - 1] not in _LIMITED) and (end + 1 == len(text) or text[end + 1] not in _LIMITED)):
                held.add(term)
    return held


def texts_holding(texts: DataFrame, terms: DataFrame, most_bytes: int = TERM_BYTES) -> DataFrame:
    """(id, term): each term of `terms` (term, from `prepared_terms`) that a text of texts (id,
    norm) holds, once for each row of texts. Texts are read where they lie, none is shuffled: as
    long as all terms fit `most_bytes` once, else once for each group of terms that does, so
    that what is broadcast stays bounded however many terms there are. A single term
    is never cut. Null texts and an empty table of terms hold nothing."""
    spark = texts.sparkSession
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    groups = max(1, -(-size // max(1, most_bytes // 2)))  # half full on average, so that few groups are too large
    id_type = texts.schema["id"].dataType.simpleString()
    dealt = terms.withColumn("_group", F.pmod(F.xxhash64("term"), F.lit(groups)))
    out = None
    for group in range(groups):
        own = [r["term"] for r in dealt.where(F.col("_group") == group).select("term").collect()]
        if not own:
            continue
        shared = spark.sparkContext.broadcast(own)

        def find(batches, shared=shared):
            import pyarrow as pa

            automaton = _automaton(shared.value)
            for batch in batches:
                ids, found = [], []
                for place, text in enumerate(batch.column(1).to_pylist()):
                    held = held_terms(automaton, text) if text else ()
                    ids.extend([place] * len(held))
                    found.extend(held)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], names=["id", "term"])

        one = texts.select("id", "norm").mapInArrow(find, f"id {id_type}, term string")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"id {id_type}, term string")
