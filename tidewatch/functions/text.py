"""Text and URL rules as Column expressions, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visit, for comparing URLs (fixed values).
TRACKING_KEYS = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "source"]
# The same for URLs that are kept as they came (fixed values).
COLLECTOR_KEYS = ["fbclid", "gclid", "ref", "source"]
# Character references that occur in feeds (fixed values); the last must stay last.
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
BLANKS = "[ \\t\\n\\r\\f\\x{A0}]+"
TOKEN = "[0-9A-Za-z가-힣]{2,}"
STORY_TOKEN = "[0-9A-Za-z가-힣]+"
# Suffixes of public bodies (fixed values).
PUBLIC_SUFFIXES = [".go.kr", ".gov", ".gov.kr"]


def normalized(text: Column) -> Column:
    """Text for comparing: tags become a blank, character references their character,
    runs of blanks one blank, letters lower case (sharp s as ss). Null is empty.
    Compatibility forms of Unicode stay; `normalized_nfkc` folds them too."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.replace(F.lower(out), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def normalized_sql(text: str) -> str:
    out = f"regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')"
    for name, char in REFERENCES:
        char = "''" if char == "'" else char
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace(replace(lower({out}), 'ß', 'ss'), '{BLANKS}', ' ', 'g'))"


def normalized_nfkc(text: Column) -> Column:
    """`normalized` with all character references, Unicode's compatibility forms and full
    case folding, for which there is no function in the engine: Arrow batches in Python."""

    @F.pandas_udf("string")
    def fold(batch):
        import html
        import re
        import unicodedata

        tags, blanks = re.compile("<[^>]+>"), re.compile(r"\s+")
        one = lambda t: blanks.sub(" ", unicodedata.normalize("NFKC", html.unescape(tags.sub(" ", t or "")))).strip().casefold()
        return batch.map(one)

    return fold(text)


def tokens(norm: Column, pattern: str = TOKEN) -> Column:
    """The different tokens of a normalised text, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(pattern), F.lit(0)))


def tokens_sql(norm: str, pattern: str = TOKEN) -> str:
    return f"list_distinct(regexp_extract_all({norm}, '{pattern}'))"


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if one of them is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {both} / (len({a}) + len({b}) - {both}) ELSE 0.0::DOUBLE END"


def containment(a: Column, b: Column) -> Column:
    """Shared members over those of the smaller set; 0 if one of them is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def containment_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0::DOUBLE END"


def dice(a: Column, b: Column) -> Column:
    """Twice the shared members over the sum of both; 0 if one of them is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) * 2.0 / (F.size(a) + F.size(b))).otherwise(0.0)


def dice_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) * 2.0::DOUBLE / (len({a}) + len({b})) ELSE 0.0::DOUBLE END"


def trigrams(compact: Column) -> Column:
    """The different runs of three characters; a shorter text is one run, an empty none."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(compact) - 2, F.lit(1)))
    return F.when(compact == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.substr(compact, i, F.lit(3)))))


def trigrams_sql(compact: str) -> str:
    return f"CASE WHEN {compact} = '' THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(length({compact}) - 2, 1) + 1), lambda i: substr({compact}, CAST(i AS INT), 3))) END"


def holds_term(norm: Column, term: str) -> Column:
    """Whether a normalised text has a term: between other than letters and digits, if
    the term is Latin; anywhere else. Terms of one character are never held."""
    import re

    if len(term) < 2:
        return F.lit(False)
    if re.fullmatch(r"[a-z0-9 .&+-]+", term):
        return norm.rlike(rf"(?:^|[^a-z0-9]){re.escape(term)}(?:$|[^a-z0-9])")
    return F.contains(norm, F.lit(term))


def holds_term_sql(norm: str, term: str) -> str:
    import re

    if len(term) < 2:
        return "FALSE"
    if re.fullmatch(r"[a-z0-9 .&+-]+", term):
        return f"regexp_matches({norm}, '(?:^|[^a-z0-9]){re.escape(term)}(?:$|[^a-z0-9])')"
    return f"contains({norm}, '{term}')"


_SCHEME, _HOST, _PATH, _QUERY = "^([A-Za-z][A-Za-z0-9+.-]*):", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", "^[^?#]*\\?([^#]*)"


def _parameters(url: Column, keys: list[str]) -> Column:
    """The query's key=value strings without those that only track a visit."""
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    pairs = F.filter(F.split(F.regexp_extract(url, _QUERY, 1), "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(keys))
    return F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))


def _parameters_sql(url: str, keys: list[str]) -> str:
    key = "lower(split_part(p, '=', 1))"
    known = ", ".join(f"'{k}'" for k in keys)
    return f"list_transform(list_filter(string_split(regexp_extract({url}, '{_QUERY}', 1), '&'), lambda p: p <> '' AND NOT starts_with({key}, 'utm_') AND {key} NOT IN ({known})), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"


def normalized_url(url: Column) -> Column:
    """A URL for comparing: scheme and host in lower case, no final slash (but a root),
    no tracking parameters whatever their case, the others in order, no fragment.
    Null is empty; escapes stay as they are written."""
    url = F.trim(F.coalesce(url, F.lit("")))
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", "")
    query = F.array_join(F.array_sort(_parameters(url, TRACKING_KEYS)), "&")
    parts = F.concat(F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lit("://"), F.lower(F.regexp_extract(url, _HOST, 1)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url == "", "").otherwise(parts)


def normalized_url_sql(url: str) -> str:
    url = f"trim(coalesce({url}, ''))"
    path = f"regexp_replace(regexp_extract({url}, '{_PATH}', 1), '/+$', '')"
    query = f"array_to_string(list_sort({_parameters_sql(url, TRACKING_KEYS)}), '&')"
    return f"CASE WHEN {url} = '' THEN '' ELSE lower(regexp_extract({url}, '{_SCHEME}', 1)) || '://' || lower(regexp_extract({url}, '{_HOST}', 1)) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"


def canonical_url(url: Column) -> Column:
    """A URL as it is kept: order of parameters and final slash stay, and fewer
    parameters count as tracking."""
    url = F.trim(F.coalesce(url, F.lit("")))
    query = F.array_join(_parameters(url, COLLECTOR_KEYS), "&")
    return F.concat(F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lit("://"), F.lower(F.regexp_extract(url, _HOST, 1)), F.regexp_extract(url, _PATH, 1), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def canonical_url_sql(url: str) -> str:
    url = f"trim(coalesce({url}, ''))"
    query = f"array_to_string({_parameters_sql(url, COLLECTOR_KEYS)}, '&')"
    return f"lower(regexp_extract({url}, '{_SCHEME}', 1)) || '://' || lower(regexp_extract({url}, '{_HOST}', 1)) || regexp_extract({url}, '{_PATH}', 1) || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def bare_url(url: Column) -> Column:
    """A URL without scheme, www. and final slashes, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^https?://", ""), r"^www\.", ""), "/+$", "")


def bare_url_sql(url: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({url}, ''))), '^https?://', ''), '^www\\.', ''), '/+$', '')"


def host(url: Column) -> Column:
    """Scheme-less network place in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def host_sql(url: str) -> str:
    return f"lower(regexp_extract(coalesce({url}, ''), '{_HOST}', 1))"


def source_domain(url: Column) -> Column:
    """Host name in lower case without port, user and a leading www.; else unknown."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host(url), "^[^@]*@", ""), ":[0-9]*$", ""), r"^www\.", "")
    return F.when(name == "", "unknown").otherwise(name)


def source_domain_sql(url: str) -> str:
    name = f"regexp_replace(regexp_replace(regexp_replace({host_sql(url)}, '^[^@]*@', ''), ':[0-9]*$', ''), '^www\\.', '')"
    return f"CASE WHEN {name} = '' THEN 'unknown' ELSE {name} END"


def credibility(domain: Column) -> Column:
    """How far a source is to be believed, by the kind of its domain."""
    public = F.lit(False)
    for s in PUBLIC_SUFFIXES:
        public = public | domain.endswith(s)
    blog = F.contains(domain, F.lit("blog.")) | domain.endswith("blogspot.com")
    return F.when(domain == "unknown", 0.35).when(public | domain.isin("go.kr", "gov.kr"), 0.95).when(domain.isin("youtube.com", "youtu.be"), 0.35).when(blog, 0.40).otherwise(0.65)


def credibility_sql(domain: str) -> str:
    public = " OR ".join(f"ends_with({domain}, '{s}')" for s in PUBLIC_SUFFIXES)
    return f"CASE WHEN {domain} = 'unknown' THEN 0.35::DOUBLE WHEN {public} OR {domain} IN ('go.kr', 'gov.kr') THEN 0.95::DOUBLE WHEN {domain} IN ('youtube.com', 'youtu.be') THEN 0.35::DOUBLE WHEN contains({domain}, 'blog.') OR ends_with({domain}, 'blogspot.com') THEN 0.40::DOUBLE ELSE 0.65::DOUBLE END"
