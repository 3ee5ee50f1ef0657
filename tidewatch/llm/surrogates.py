"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are found by patterns; the words of a name that a text has after a title are
looked for in all of that text. Each distinct entity gets a surrogate drawn by a keyed
hash: of its kind, gender, script and format. A surrogate that another entity has, or
that is itself an entity of the corpus, is drawn again. So equal entities get equal
surrogates wherever they stand, and different ones different surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import kept, settle

# Titles before a name, by gender (fixed values).
MALE = "Mr|Mister|Herr|Monsieur|Señor|господин|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|госпожа|κυρία"

# Titles that do not tell a gender (fixed values).
NEUTRAL = "Dr|Doctor|Prof|Professor|Mx"
#: Titles as they are written, and in capitals where that is no other word.
_TITLES = {"m": MALE, "f": FEMALE, "x": NEUTRAL}
_TITLES = {k: "|".join([v, *(w.upper() for w in v.split("|") if len(w) > 2)] + (["MR"] if k == "m" else ["DR"] if k == "x" else [])) for k, v in _TITLES.items()}
_TITLE = "|".join(_TITLES.values())

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORD = r"\p{Lu}[\p{L}'’-]+"
#: A mention's kind is that of the first pattern that matches the whole of it.
PATTERNS = {
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_WORD}(?: {_WORD})?",
    "keyed": r"(?<![\p{L}\p{N}])(?i:token|password|passwd|pwd|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_.~-]{7,}[A-Za-z0-9+/_~-]",
    "access": r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)",
    "email": r"(?<![\p{L}\p{N}_.+%-])[\p{L}\p{N}_.+%-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ip6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?!\w)",
}
ENTITY = "|".join(PATTERNS.values())
#: Every entity has one of these; looking for them is several times cheaper.
SIGN = rf"[0-9@=:]|AKIA|ASIA|(?:^|[^\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}"
#: What stands before the entity proper in a mention.
LEAD = {"name": rf"^(?:{_TITLE})\.? ", "keyed": r"^(?i:token|password|passwd|pwd|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?"}

_HEX, _DIGITS, _LOWER, _UPPER = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâäçèéêëìíîïñòóôöùúûü", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"]
# Syllables of drawn names, and endings of male, female and family names, by script.
_SYLLABLES = {
    "latin": ["ba be da do fa fe ga ka la le lo ma me mi na ne ni pa ra re ri ro sa se si ta te ti va ve vi za", "n r s l k m t d", "a ia ina ela ara ena ita ora", "son man berg ner well ard ton ley"],
    "cyrillic": ["ба бе да до фа фе га ка ла ле ло ма ме ми на не ни па ра ре ри ро са се си та те ти ва ве ви за", "н р с л к м т д", "а ия ина ела ара ена ита ора", "ко ский ник чук дзе ян тов рин"],
    "greek": ["βα βε δα δο φα φε γα κα λα λε λο μα με μι να νε νι πα ρα ρε ρι ρο σα σε σι τα τε τι ζα ζε ζι θα", "ος ης ας ων ις ιος αης ωρ", "α ια ινα ελα αρα ενα ιτα ορα", "ιδης ακης ας ογλου ου εας ατος ιου"],
}
#: Draws after which an address may change the lengths of its numbers.
STRICT_DRAWS = 6


def kind_of(mention: Column) -> Column:
    found = F.lit("bare")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def _one(kind, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def _name_parts(mention: Column) -> Column:
    """The (kind, value) of a name after a title: a given name of the title's gender
    and a family name, or a family name alone. Capitals make no difference."""
    words = F.split(F.regexp_replace(mention, LEAD["name"], ""), " ")
    titled = lambda g: mention.rlike(rf"^(?:{_TITLES[g]})\.? ")
    gender = F.when(titled("m"), "given_m").when(titled("f"), "given_f").otherwise("given_x")
    word = lambda i: F.initcap(words.getItem(i))
    return F.when(F.size(words) > 1, F.array(_one(gender, word(0)), _one("family", word(1)))).otherwise(F.array(_one("family", word(0))))


def _parts(kind: Column, mention: Column, known: Column) -> Column:
    """The entities of a mention: (kind, value). Names have one or two; letters' case
    in names and addresses, and blanks and signs between digits, make no difference. An
    address is its mailbox and its domain, so that addresses of a domain stay together.
    `known` are the names of the mention's text: they tell what a bare word is, and
    the gender of a name after a title without one."""
    settled = lambda p: F.coalesce(F.filter(known, lambda k: (k["value"] == p["value"]) & (k["kind"] != "given_x") & (k["kind"].startswith("given") == p["kind"].startswith("given"))).getItem(0), p)
    bare = F.initcap(mention)
    of_bare = F.filter(known, lambda k: k["value"] == bare)
    of_bare = F.coalesce(F.filter(of_bare, lambda k: k["kind"] != "given_x").getItem(0), of_bare.getItem(0))
    address = F.lower(mention)
    return (
        F.when(kind == "name", F.transform(_name_parts(mention), settled))
        .when(kind == "bare", F.array(of_bare))
        .when(kind == "keyed", F.array(_one(kind, F.regexp_replace(mention, LEAD["keyed"], ""))))
        .when(kind == "email", F.array(_one("mailbox", address), _one("domain", F.substring_index(address, "@", -1))))
        .when(kind == "ip6", F.array(_one(kind, F.lower(mention))))
        .when(kind.isin("phone", "ssn", "card"), F.array(_one(kind, F.regexp_replace(mention, "[^+0-9]", ""))))
        .when(kind == "iban", F.array(_one(kind, F.replace(mention, F.lit(" "), F.lit("")))))
        .otherwise(F.array(_one(kind, mention)))
    )


def _bytes(digest: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a string of 128 of them in hex."""
    return F.conv(F.substr(digest, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, b: Column) -> Column:
    return F.substr(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _alike(value: Column, digest: Column, stay: Column) -> Column:
    """Characters of the same class in place of all but the first `stay`."""
    in_hex = value.rlike("^[0-9a-f:]+$") & value.rlike("[a-f]")

    def one(c, i):
        b = _bytes(digest, i)
        new = F.when(i < stay, c).when(in_hex & F.contains(F.lit(_HEX), c), _pick(_HEX, b))
        for alphabet in (_DIGITS, _LOWER, _UPPER, *_OTHER):
            new = new.when(F.contains(F.lit(alphabet), c), _pick(alphabet, b))
        return new.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _check_sum(digits: Column) -> Column:
    """The sum of a card number's digits, every second one from the right doubled."""
    doubled = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _account_rest(account: Column) -> Column:
    """An account number's remainder by 97, letters as 10 to 35, its first four
    characters moved to the end: 1 if its check digits are right."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    of = lambda c: F.position(c, F.lit(_DIGITS + _UPPER)) - 1
    step = lambda rest, c: (rest * F.when(of(c) > 9, 100).otherwise(10) + of(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _account(account: Column, alike: Column) -> Column:
    """`alike` with check digits that are right, if those of `account` are."""
    blank = F.concat(F.substr(alike, F.lit(1), F.lit(2)), F.lit("00"), F.substr(alike, F.lit(5)))
    right = F.concat(F.substr(alike, F.lit(1), F.lit(2)), F.lpad((98 - _account_rest(blank)).cast("string"), 2, "0"), F.substr(alike, F.lit(5)))
    return F.when(_account_rest(account) == 1, right).otherwise(alike)


def _number(text: Column, b: Column, draw: Column) -> Column:
    """One of four numbers of an address, as many digits long."""
    n = F.when(draw >= STRICT_DRAWS, F.lit(4)).otherwise(F.char_length(text))
    return F.when(n == 1, b % 9 + 1).when(n == 2, b % 90 + 10).when(n == 3, b % 155 + 100).otherwise(b % 254 + 1).cast("string")


def _name(kind: Column, value: Column, digest: Column, draw: Column) -> Column:
    def of(script: str) -> Column:
        first, male, female, family = [F.split(F.lit(x), " ") for x in _SYLLABLES[script]]
        pick = lambda words, i: F.element_at(words, _bytes(digest, i) % F.size(words) + 1)
        start = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + (draw / 2).cast("int")), lambda i: pick(first, i)), "")
        either = F.when(_bytes(digest, F.lit(1)) % 2 == 0, pick(male, F.lit(0))).otherwise(pick(female, F.lit(0)))
        end = F.when(kind == "given_m", pick(male, F.lit(0))).when(kind == "given_f", pick(female, F.lit(0))).when(kind == "given_x", either).otherwise(pick(family, F.lit(0)))
        return F.initcap(F.concat(start, end))

    return F.when(value.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).when(value.rlike(r"^\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surrogate(kind: Column, value: Column, draw: Column, key: str) -> Column:
    """The surrogate of a value in its n-th draw."""
    hashed = lambda n: F.sha2(F.concat_ws("|", F.lit(key), F.lit(n), kind, draw.cast("string"), value), 256)
    digest = F.concat(*[hashed(n) for n in "0123"])
    stay = F.when(kind.isin("access"), 4).when(kind == "iban", 2).when(value.startswith("+"), 2).when(kind == "card", 1).otherwise(0)
    alike = _alike(value, digest, stay)
    fixed = F.concat(F.substr(alike, F.lit(1), F.char_length(alike) - 1), F.pmod(F.substr(alike, F.char_length(alike), F.lit(1)).cast("int") + _check_sum(value) - _check_sum(alike), F.lit(10)).cast("string"))
    local = _alike(F.substring_index(value, "@", 1), digest, F.lit(0))
    mailbox = F.concat(local, F.when(draw >= STRICT_DRAWS, _bytes(digest, F.lit(123)).cast("string")).otherwise(""))
    number = _bytes(digest, F.lit(124)) * 65_536 + _bytes(digest, F.lit(125)) * 256 + _bytes(digest, F.lit(127))
    domain = F.concat(F.lit("host"), number.cast("string"), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "org", "net"))), _bytes(digest, F.lit(126)) % 3 + 1))
    address = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: _number(o, _bytes(digest, i), draw)), ".")
    found = F.when(kind == "card", fixed).when(kind == "iban", _account(value, alike)).when(kind == "mailbox", mailbox).when(kind == "domain", domain).when(kind == "ip", address)
    return found.when(kind.isin("given_m", "given_f", "given_x", "family"), _name(kind, value, digest, draw)).otherwise(alike)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two of a kind have one
    surrogate, and none is a value of that kind. Of those that draw the same, the
    first value keeps it; the others draw again until all have one."""
    done, waiting, draw = None, entities.withColumn("draw", F.lit(0)), 0
    while True:
        drawn = waiting.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("draw"), key))
        first = Window.partitionBy("kind", "surrogate").orderBy("value")
        taken = entities.select("kind", F.col("value").alias("surrogate"))
        taken = taken if done is None else taken.unionByName(done.select("kind", "surrogate"))
        taken = taken.distinct().withColumn("taken", F.lit(True))
        drawn = drawn.withColumn("at", F.row_number().over(first)).join(taken, ["kind", "surrogate"], "left")
        drawn = settle(drawn.select("kind", "value", "draw", "surrogate", (F.col("taken").isNull() & (F.col("at") == 1)).alias("good")), f"pii-draw-{draw}")
        good = drawn.where("good").select("kind", "value", "surrogate")
        done = good if done is None else done.unionByName(good)
        waiting = drawn.where("not good").select("kind", "value", (F.col("draw") + 1).alias("draw"))
        if waiting.isEmpty():
            return done
        draw += 1


def _rendered(kind: Column, mention: Column, found: Column) -> Column:
    """A mention with its entities' surrogates in its own spelling: signs and blanks
    between digits stay where they are, names in capitals get such."""
    name = kind.isin("name", "bare")
    lead = F.when(kind == "name", F.regexp_extract(mention, LEAD["name"], 0)).when(kind == "keyed", F.regexp_extract(mention, LEAD["keyed"], 0)).otherwise("")
    words = F.split(F.substr(mention, F.char_length(lead) + 1), " ")
    cased = F.transform(found, lambda f, i: F.when(name & (F.upper(words.getItem(i)) == words.getItem(i)) & (F.char_length(words.getItem(i)) > 1), F.upper(f)).otherwise(f))
    signs = F.regexp_replace(found.getItem(0), "[^0-9A-Za-z]", "")
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    put = lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["text"], F.substr(signs, a["at"], F.lit(1))).alias("text"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["text"], c).alias("text"), a["at"].alias("at")))
    spaced = F.aggregate(F.split(mention, ""), start, put, lambda a: a["text"])
    return F.when(kind.isin("phone", "ssn", "card", "iban"), spaced).when(kind == "email", F.array_join(found, "@")).otherwise(F.concat(lead, F.array_join(cased, " ")))


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = "surrogate-key", keep: list[str] | None = None) -> DataFrame:
    """docs with surrogates in place of the personal data in text_col: the columns
    `keep` (else all but text_col and n_entities), text_col, and n_entities, the
    number of mentions replaced.

    Found are names after a title, the words of these wherever else they stand in that
    text (with a capital, or in capitals), access keys and secrets after their names,
    e-mail and network addresses, and telephone, social security, account and card
    numbers. A given name gets one of the title's gender and the name's script, card
    and account numbers one that is as valid; addresses of a domain get one domain;
    names and addresses count as equal without regard to case, numbers without regard
    to blanks and signs. Text outside the mentions stays as it is, and so do null and
    empty texts (0 entities). Whole texts are read. Repeated rows give repeated
    results; an empty table gives an empty one. Columns may have any names.

    Only texts with an entity are settled and shuffled, once; what is shuffled for the
    entities are the mentions of each distinct text."""
    keep = kept(docs, keep, [text_col], [text_col, "n_entities"])
    text = F.col(text_col)
    has = F.coalesce(text.rlike(SIGN) & text.rlike(ENTITY), F.lit(False))
    clean = docs.where(~has).select(*keep, text_col, F.lit(0).cast("long").alias("n_entities"))
    marked = docs.where(has).select(F.struct(*[F.col(c) for c in keep]).alias("row") if keep else F.lit(None).alias("row"), text.alias("text"))
    marked = marked.withColumn("titled", F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERNS["name"]), F.lit(0))))
    marked = marked.withColumn("known", F.array_distinct(F.flatten(F.transform("titled", _name_parts))))
    words = F.flatten(F.transform("titled", lambda m: F.split(F.regexp_replace(m, LEAD["name"], ""), " ")))
    words = F.array_join(F.array_distinct(F.concat(words, F.transform(words, lambda w: F.initcap(w)), F.transform(words, lambda w: F.upper(w)))), "|")
    bare = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))
    marked = marked.withColumn("pattern", F.when(F.size("known") > 0, bare).otherwise(F.lit(ENTITY)))
    marked = marked.withColumn("found", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    marked = settle(marked.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")}), "pii-texts")
    texts = settle(marked.groupBy("k1", "k2").agg(F.first("known").alias("known"), F.first("found").alias("found")), "pii-found")
    each = texts.select("k1", "k2", F.posexplode("found").alias("at", "mention"), "known").withColumn("whole", kind_of(F.col("mention")))
    each = each.withColumn("parts", _parts(F.col("whole"), F.col("mention"), F.col("known"))).select("k1", "k2", "at", "mention", "whole", "parts")
    each = settle(each, "pii-mentions")
    mentions = settle(each.select("mention", "whole", "parts").distinct().withColumn("id", F.xxhash64("mention", "parts")), "pii-distinct")
    parts = settle(mentions.select("id", "mention", "whole", F.posexplode("parts").alias("nth", "part")).select("id", "mention", "whole", "nth", "part.kind", "part.value"), "pii-parts")
    assigned = assign(parts.select("kind", "value").distinct(), key)
    named = parts.join(assigned, ["kind", "value"]).groupBy("id", "mention", "whole").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "surrogate"))), lambda x: x["surrogate"]).alias("new"))
    named = named.select("id", F.col("mention").alias("of"), _rendered(F.col("whole"), F.col("mention"), F.col("new")).alias("new"))
    each = each.withColumn("id", F.xxhash64("mention", "parts"))
    joined = settle(each.join(settle(named, "pii-named"), "id").where("mention = of").select("k1", "k2", "at", "new"), "pii-renamed")
    lists = joined.groupBy("k1", "k2").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"))
    merged = marked.join(lists, ["k1", "k2"])
    pieces = F.zip_with(F.split("text", F.col("pattern"), -1), F.col("new"), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    replaced = merged.select(*(["row.*"] if keep else []), F.array_join(pieces, "").alias(text_col), F.size("found").cast("long").alias("n_entities"))
    return clean.unionByName(replaced)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace_entities(docs, keep=["doc_id"])
