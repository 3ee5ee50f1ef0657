"""Main text of HTML pages by nearest-URL page differencing.

The blocks of a page are its lines. Pages of a host are ordered by URL path, and each
is paired with the pages nearest by URL, NEIGHBOURS to either side. A longest common
subsequence aligns the lines of each pair; lines in it are the site's, not the page's,
and go: menus, notices, adverts and footers. What stands in an article or main element
is the page's own even if a neighbour has it too (a licence or a passage may be quoted,
a page mirrored). Only then does markup decide: lines that no neighbour shares go if
they stand in an element that names its purpose.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, deque
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.common import TEXT_ROWS_PER_BATCH, kept, settle, text_batches, with_positions

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|textarea|template|iframe|svg|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu button dialog".split())
_OWN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no name takes away, and those on which an id is an anchor only.
_NEVER = frozenset("html body".split()) | _OWN | _HEADINGS
_FRAME = frozenset("html head body main".split()) | _HEADINGS
_ANCHORS = frozenset("section p li dt dd td th tr blockquote figure pre".split())
#: Elements whose end tag is optional; those that a start tag ends, and what bounds the search.
_OPTIONAL = frozenset("p li dt dd tr td th thead tbody tfoot option caption".split())
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, set())}
_IMPLIED |= dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})) | {"tr": ({"tr"}, {"table"})} | dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"}, {"table"}))
_PURPOSE = re.compile(
    r"ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget",
    re.I,
)
#: Reader comments and adverts, as the first word of a name (comment-list, ad-slot); they
#: go from articles too. Parts of a layout, as its last word (site-header, cookie-banner),
#: unless the first says that the element only has or lacks one.
_FOREIGN = re.compile(r"ad|ads|advert\w*|adsense|comments?|disqus", re.I)
_LAYOUT = re.compile(r"banner|breadcrumbs?|footer|header|menu|nav|navbar|newsletter|sidebar|toolbar", re.I)
_HAVING = frozenset("has no with without".split())
_WORDS = re.compile(r"[-_]+")


def _extents(tags: list) -> dict[int, tuple[int, bool]]:
    """Of each block's start tag the index of the tag that ends it (the number of tags,
    if none does), and whether that is its own end tag. A start tag ends an open p and
    what _IMPLIED says, a parent's end tag all that is open in it."""
    found: dict[int, tuple[int, bool]] = {}
    opened: list[tuple[str, int]] = []
    count: Counter = Counter()

    def end(depth: int, at: int, own: bool) -> None:
        while len(opened) > depth:
            name, start = opened.pop()
            count[name] -= 1
            found[start] = (at, own and len(opened) == depth)

    for i, m in enumerate(tags):
        if not m[3]:
            continue
        name = m[3].lower()
        if (name not in _BLOCKS and name != "button") or name in _VOID:
            continue
        names, bounds = ({name}, set() if name in ("table", "body", "html", "td", "th", "tr") else {"td", "th", "table"}) if m[2] else _IMPLIED.get(name, (set(), set()))
        if not m[2] and opened and opened[-1][0] == "p" and name != "button":
            end(len(opened) - 1, i, False)
        for depth in range(len(opened) - 1, -1, -1) if any(count[n] for n in names) else ():
            if opened[depth][0] in names:
                end(depth, i, bool(m[2]))
                break
            if opened[depth][0] in bounds:
                break
        if not m[2] and not m[4].endswith("/"):
            opened.append((name, i))
            count[name] += 1
    end(0, len(tags), False)
    return found


def _named(name: str, attributes: str, own: int) -> bool:
    """Whether a whole class, id, role or label says that an element is no text. An id
    may be an anchor; a header in an article holds its title."""
    if name in _NEVER or not attributes:
        return False
    for kind, value in _NAMED.findall(attributes):
        if kind.lower() != "id" or name not in _ANCHORS:
            for token in value.strip("\"'").split():
                if _PURPOSE.fullmatch(token) and not (own and token.lower() == "header"):
                    return True
                words = _WORDS.split(token)
                if not own and len(words) > 1 and _LAYOUT.fullmatch(words[-1]) and words[0].lower() not in _HAVING:
                    return True
    return False


def _foreign(name: str, attributes: str) -> bool:
    """Whether a class, id, role or label says that an element holds reader comments or
    adverts. The id of a paragraph or list item may be an anchor."""
    if not attributes or name in _FRAME:
        return False
    for kind, value in _NAMED.findall(attributes):
        if kind.lower() != "id" or name not in _ANCHORS or name == "section":
            if any(_FOREIGN.fullmatch(_WORDS.split(token)[0]) for token in value.strip("\"'").split()):
                return True
    return False


def _article(tags: list, ends_at: dict, bodies: list[int], foreign: set[int]) -> int:
    """The tag of the page's own article: the longest article or main element that is no
    comment or advert and stands in none; if there is no such, the longest of all; else -1."""

    def length(i: int) -> int:
        end = ends_at[i][0] if i in ends_at else i
        return (tags[end].start() if end < len(tags) else tags[-1].end()) - tags[i].end()

    inside, covered = set(), -1
    for i in sorted({*bodies, *foreign}):
        if i in foreign:
            covered = max(covered, ends_at[i][0])
        if i < covered:
            inside.add(i)
    return max([i for i in bodies if i not in inside] or bodies, key=length, default=-1)


#: What blocks tells of a line: in an article or main element, elsewhere, in a named part.
OWN, PLAIN, NAMED = 0, 1, 2


def blocks(page: str) -> list[tuple[str, int]]:
    """The visible lines of a page in order and where each stands (OWN, PLAIN or NAMED).
    No name takes away an article, a main element or what holds one, and a part that
    is never closed ends before them; only comments and adverts go although they are or
    hold an article, if it is not the page's own."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    tags = list(_TOKEN.finditer(page))
    ends_at = _extents(tags)
    mains = [i for i, m in enumerate(tags) if m[3] and not m[2] and m[3].lower() == "main"]
    bodies = [i for i, m in enumerate(tags) if m[3] and not m[2] and m[3].lower() in _OWN]
    foreign = {i for i in ends_at if _foreign(tags[i][3].lower(), tags[i][4])}
    article = _article(tags, ends_at, bodies, foreign) if foreign else -1
    own, outside, named, silent, at = 0, 0, -1, -1, 0

    def close(i: int) -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, NAMED if i <= named else OWN if own else PLAIN))

    def following(starts: list[int], i: int, end: int) -> int:
        at = bisect_left(starts, i)
        return starts[at] if at < len(starts) else end

    def left_out(i: int, name: str, attributes: str) -> int:
        """The tag up to which the element is no text, or -1."""
        if i in foreign and (ends_at[i][1] or name in _OPTIONAL) and not i <= article < ends_at[i][0]:
            return ends_at[i][0]
        aside = name in _ASIDE or (name == "header" and not own)
        if i not in ends_at or not (aside or _named(name, attributes, own)):
            return -1
        end, closed = ends_at[i]
        first = following(bodies, i, end)
        if first >= end:
            return end
        if not closed and name not in _OPTIONAL or name in ("form", "header"):
            return first
        if aside:
            return min(end, following(mains, i, end))
        return -1

    for i, m in enumerate(tags):
        if i > silent and m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if i == named:
            close(i)
            own, named = outside, -1
        if i < silent or not m[3]:
            continue
        name, ends = m[3].lower(), m[2] == "/"
        if name == "br":
            text.append(" ")
        elif name in _BLOCKS:
            close(i)
            if not ends and named < 0 and (to := left_out(i, name, m[4])) >= 0:
                named, outside = to, own + (1 if name in _OWN and ends_at[i][1] else 0)
            elif name in _OWN:
                own = max(0, own + (-1 if ends else 1))
        elif name == "button" and not ends:
            silent = left_out(i, name, m[4])
    if silent < len(tags):
        text.append(page[at:])
    close(len(tags))
    return out


def _places(lines: list) -> dict:
    where: dict = {}
    for j, line in enumerate(lines):
        where.setdefault(line, []).append(j)
    return where


def common_lines(a: list, b: list) -> list[int]:
    """Indices in a of a longest common subsequence of a and b."""
    return _aligned(a, _places(b))


def _aligned(a: list, where: dict) -> list[int]:
    """`common_lines` with the places of b's lines. The sequence grows from matching
    positions only, by binary search in the ends of those found."""
    ends: list[int] = []
    last: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            elif j < ends[k]:
                ends[k], last[k] = j, link
    found, link = [], last[-1] if last else None
    while link:
        found.append(link[0])
        link = link[1]
    return found[::-1]


def shared_with(lines: list, path: str, near: list[tuple[str, dict]]) -> list[int]:
    """Indices of lines that alignments with the pages near (path, places) have in common,
    the nearest path first. A page whose lines in common are all found adds none."""
    import os

    found: set[int] = set()
    for _, where in sorted(near, key=lambda page: -len(os.path.commonprefix([path, page[0]]))):
        if any(line in where and i not in found for i, line in enumerate(lines)):
            found.update(_aligned(lines, where))
    return sorted(found)


def _hashes(lines: list[tuple[str, int]]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in lines]


def _line_hashes(batches):
    import pyarrow as pa

    for batch in batches:
        lines = [_hashes(blocks(p or "")) for p in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "lines"])


def neighbourhoods(rows, group, k: int):
    """Each row with the rows up to k before and after it in its group. Rows come in
    order; 2 k + 1 of them are held at a time."""
    held: deque = deque()
    given, now = 0, None

    def near(i: int) -> list:
        return [held[j] for j in range(max(0, i - k), min(len(held), i + k + 1)) if j != i]

    for row in chain(rows, [None]):
        if row is None or (held and group(row) != now):
            while given < len(held):
                yield held[given], near(given)
                given += 1
            held.clear()
            given = 0
        if row is None:
            return
        now = group(row)
        held.append(row)
        if len(held) - given > k:
            yield held[given], near(given)
            given += 1
            if given > k:
                held.popleft()
                given -= 1


def _sharing(neighbours: int):
    """(run, own, host, path, k1, k2, lines) in order of run and URL to (k1, k2, shared)."""

    def shared(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                for run, own, host, path, k1, k2, lines in zip(*(c.to_pylist() for c in batch.columns)):
                    yield (run, host), own, path, k1, k2, lines, _places(lines)

        found: list[tuple] = []
        columns = [("k1", pa.int64()), ("k2", pa.int64()), ("shared", pa.list_(pa.int32()))]

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(columns)], names=[n for n, _ in columns])
            found.clear()
            return out

        for (_, own, path, k1, k2, lines, _), near in neighbourhoods(rows(), lambda r: r[0], neighbours):
            if own and near and (some := shared_with(lines, path, [(r[2], r[6]) for r in near])):
                found.append((k1, k2, some))
                if len(found) == TEXT_ROWS_PER_BATCH:
                    yield flushed()
        yield flushed()

    return shared


#: Pages that are aligned in one run, in order of URL, and with how many on either side each is.
RUN_ROWS, NEIGHBOURS = 1_024, 16


def shared_lines(pages: DataFrame, url_col: str, html_col: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(k1, k2, shared): of each distinct list of lines on a host, named by two hashes, the
    indices of lines that pages near it have too, if any. Runs take along the pages next
    to them, so a page meets all its neighbours in one task, which holds 2 x neighbours
    + 1 pages' lines at a time."""
    if not 1 <= neighbours <= RUN_ROWS:
        raise ValueError(f"neighbours must be from 1 to {RUN_ROWS}")
    path = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[^:/?#]*:?//[^/?#]*)?([^?#]*)", 1)
    split = pages.select(_host(url_col).alias("host"), F.regexp_replace(path, r"/+$", "").alias("path"), F.col(html_col).alias("__html"))
    lines = split.mapInArrow(_line_hashes, "host string, path string, lines array<bigint>").where(F.size("lines") > 0)
    lines = lines.withColumns({"k1": F.xxhash64("host", "lines"), "k2": F.xxhash64(F.lit("second"), "host", "lines")})
    once = lines.groupBy("k1", "k2").agg(F.first("host").alias("host"), F.min("path").alias("path"), F.first("lines").alias("lines"))
    placed = with_positions(once.select("host", "path", "k1", "k2", "lines"), ["host", "path", "k1", "k2"], "pages")
    run, at = F.floor(F.col("position") / RUN_ROWS), F.col("position") % RUN_ROWS
    runs = F.array_compact(F.array(run, F.when(at < neighbours, run - 1), F.when(at >= RUN_ROWS - neighbours, run + 1)))
    dealt = placed.withColumn("run", F.explode(runs)).withColumn("own", F.col("run") == run)
    ordered = dealt.repartition("run").sortWithinPartitions("run", "position")
    return ordered.select("run", "own", "host", "path", "k1", "k2", "lines").mapInArrow(_sharing(neighbours), "k1 bigint, k2 bigint, shared array<int>")


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:/?#]*:?//([^/?#]*)", 1))


def _packed(batches):
    """(row, host, html) to (row, host, hashes, lines, places): lines compressed, as
    they travel once; places has a byte a line."""
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        found = [blocks(p or "") for p in batch.column(2).to_pylist()]
        lines = [press.compress("\n".join(t for t, _ in lines).encode("utf-8", "surrogatepass")) for lines in found]
        places = [bytes(p for _, p in lines) for lines in found]
        hashes = pa.array([_hashes(lines) for lines in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes, pa.array(lines, pa.binary()), pa.array(places, pa.binary())], names=["row", "host", "hashes", "lines", "places"])


def _chosen(batches):
    """(row, lines, places, shared) to (row, text, n_shared, n_named)."""
    import pyarrow as pa
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, n_shared, n_named = [], [], []
        for lines, places, shared in zip(*(c.to_pylist() for c in batch.columns[1:])):
            lines = unpress.decompress(lines).decode("utf-8", "surrogatepass").split("\n") if places else []
            gone = {i for i in shared or () if places[i] != OWN}
            named = {i for i, p in enumerate(places) if p == NAMED} - gone
            texts.append("\n\n".join(t for i, t in enumerate(lines) if i not in gone and i not in named))
            n_shared.append(len(gone))
            n_named.append(len(named))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_shared, pa.int32()), pa.array(n_named, pa.int32())], names=["row", "text", "n_shared", "n_named"])


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row for each row of pages: the columns `keep` (else all but html_col and
    those named like a result), then text, n_chars (code points), n_shared and n_named
    (lines left out as pages near by have them too, and by what their element is).

    A text is the page's lines without those that it shares with the pages nearest by
    URL on its host, `neighbours` to either side, unless they stand in an article or main
    element; then without those of forms, menus and elements whose class, id or role says
    what they are. Scripts and styles are no
    lines. Character references are decoded, white space inside a line becomes one
    space, lines are joined by an empty line. Null and empty pages have an empty text;
    pages without url form one host; repeated rows give repeated results, and pages
    with equal lines are no evidence against each other. Pages are read whole.
    Columns may have any names. An empty table gives an empty one."""
    keep = kept(pages, keep, [html_col], ["text", "n_chars", "n_shared", "n_named"])
    text_batches(pages.sparkSession)
    deleted = settle(shared_lines(pages, url_col, html_col, neighbours), "pages-shared")
    rows = pages.select(F.struct(*keep).alias("row"), _host(url_col).alias("host"), F.col(html_col).alias("html"))
    row = StructType([rows.schema["row"]])
    packed = rows.mapInArrow(_packed, StructType([*row.fields, *StructType.fromDDL("host string, hashes array<bigint>, lines binary, places binary").fields]))
    packed = packed.select("row", "lines", "places", F.xxhash64("host", "hashes").alias("p1"), F.xxhash64(F.lit("second"), "host", "hashes").alias("p2"))
    met = packed.join(deleted, (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2")), "left").select("row", "lines", "places", "shared")
    text = met.mapInArrow(_chosen, StructType([*row.fields, *StructType.fromDDL("text string, n_shared int, n_named int").fields]))
    return text.select("row.*", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "n_named")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, keep=["page_id", "url"])
