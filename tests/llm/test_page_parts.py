"""Parts of a page that a loose name or a missing end tag must not take away."""

import pytest

from tidewatch.llm import page_text


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<article class='post has-sidebar'><p>a</p></article>", ["a"]), ("<main class='sidebar'><p>a</p></main>", ["a"]),
        ("<article><div class='entry-header'><h1>t</h1></div><p>a</p></article>", ["t", "a"]), ("<article><div class='header'><h1>t</h1></div></article>", ["t"]),
        ("<article><h2 id='related'>r</h2><section id='search'><p>s</p></section></article>", ["r", "s"]),
        ("<div class='widget'><p>i</p><article><p>a</p></article></div>", ["i", "a"]), ("<form><p>no</p><article><p>a</p></article></form>", ["a"]),
        ("<article><p class='share'>no<p>a</p><p>b</p></article><p>c", ["a", "b", "c"]), ("<div><p class='share'>no</div>a<p>b", ["a", "b"]),
        ("<ul><li class='ad'>no<li>a<ul><li>b</ul></ul><p>c", ["a", "b", "c"]), ("<table><tr><td class='ad'>no<td>a<tr><td>b</table>c", ["a", "b", "c"]),
        ("<nav>no<article><p>a</p></article><p>b", ["a", "b"]), ("<div><nav>no</div><p>a", ["a"]), ("<aside>no<article>no</article></aside><p>a", ["a"]),
        ("<div class='ad'>no<div>no</div>no</div>a", ["a"]), ("<div class='x ad'/><p>a", ["a"]), ("<p>a <button>no</button> b</p>", ["a b"]),
    ],
)
def test_parts(page, lines):
    assert [line for line, place in page_text.blocks(page) if place != page_text.NAMED] == lines


def naive_common(a, b):
    """Length of a longest common subsequence, by the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_differencing_against_brute_force(spark):
    """On pages without any telling name, what goes are longest common subsequences
    with the nearest pages of the host; article lines stay."""
    import random

    draw = random.Random(5)
    site = {h: [f"{h} menu {k}" for k in range(6)] for h in ("h0", "h1")}
    pages = []
    for i in range(60):
        host = f"h{i % 2}"
        top, end = draw.sample(site[host], 4), draw.sample(site[host], 2)
        own = [f"own {i} {k}" for k in range(3)] + ["a licence that articles quote"]
        inside = i % 3 == 0
        body = "".join(f"<p>{x}</p>" for x in own)
        html = "".join(f"<div>{x}</div>" for x in top) + (f"<article>{body}</article>" if inside else body) + "".join(f"<div>{x}</div>" for x in end)
        pages.append((i, f"https://{host}/{draw.choice('abc')}/{i:03d}?q=1", html, top, own if inside else [], own, end))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_text.main_text(df, neighbours=3).collect()}
    for host in ("h0", "h1"):
        of = sorted((p[1].split("?")[0].split(host, 1)[1], p) for p in pages if f"//{host}/" in p[1])
        for at, (_, p) in enumerate(of):
            near = [of[at + k][1] for k in range(-3, 4) if k and 0 <= at + k < len(of)]
            lines = p[3] + p[5] + p[6]
            others = [n[3] + n[5] + n[6] for n in near]
            kept = got[p[0]]["text"].split("\n\n") if got[p[0]]["text"] else []
            gone = [x for x in lines if x not in kept]
            assert set(p[4]) <= set(kept) and all(any(x in o for o in others) for x in gone)
            exempt = [sum(1 for x in p[4] if x in o) for o in others]
            assert max(naive_common(lines, o) - e for o, e in zip(others, exempt)) <= len(gone) <= sum(naive_common(lines, o) for o in others)
            assert got[p[0]]["n_shared"] == len(lines) - len(kept) and got[p[0]]["n_named"] == 0


def test_pages_with_columns_named_like_ours(spark):
    names = "page_id long, url string, html string, shared int, row int, lines int, k1 int, p1 int, host string, text string"
    df = spark.createDataFrame([(1, "http://h/a", "<p>x", 1, 2, 3, 4, 5, "h", "t"), (None, None, None, None, None, None, None, None, None, None)], names)
    got = page_text.main_text(df)
    assert got.columns == ["page_id", "url", "shared", "row", "lines", "k1", "p1", "host", "text", "n_chars", "n_shared", "n_named"]
    assert sorted((r["shared"] or 0, r["text"]) for r in got.collect()) == [(0, ""), (1, "x")]
    assert page_text.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<article><p>a</p></article><div class='comments'><article class='comment'><p>no</p></article></div>b", ["a", "b"]),
        ("<main><article><p>a</p></article><section id='comments'><p>no</p></section><p>b</p></main>", ["a", "b"]),
        ("<article><p>a</p><ol class='comment-list'><li class='comment-body'>no<li class='comment-body'>no</ol><p>b</p></article>", ["a", "b"]),
        ("<article class='ad promo'><p>no</p></article><article><p>a long one</p></article>", ["a long one"]),
        ("<main><article class='ad promo'><p>no</p></article><p>a</p></main><p>b", ["a", "b"]), ("<article><p>a</p><div class='ad-slot'>no</div><p>b</p></article>", ["a", "b"]),
        ("<div class='cookie-banner'>no</div><div class='site-header'>no</div><div id='left-sidebar'>no</div><p>a", ["a"]), ("<div class='has-sidebar'><p>a</p></div>", ["a"]),
        ("<article><p>a</p></article><div class='comments'><article><p>no, though longer than what it is about</p></article></div>", ["a"]),
        ("<div class='ad-free'><article><p>a</p></article></div>", ["a"]), ("<article class='comment'><p>a</p></article>", ["a"]), ("<div class='comments'>no<article><p>a", ["a"]),
        ("<article><p id='comment-3'>a</p><h2 class='comments'>h</h2></article>", ["a", "h"]),
    ],
)
def test_comments_and_adverts_go(page, lines):
    assert [line for line, place in page_text.blocks(page) if place != page_text.NAMED] == lines


@pytest.mark.parametrize("k", [1, 3, 16])
def test_neighbourhoods(k):
    rows = [(g, i) for g, n in (("a", 1), ("b", 50), ("c", 2), ("d", k + 1)) for i in range(n)]
    got = list(page_text.neighbourhoods(iter(rows), lambda r: r[0], k))
    assert got == [(r, [o for o in rows if o[0] == r[0] and 0 < abs(o[1] - r[1]) <= k]) for r in rows]
    assert list(page_text.neighbourhoods(iter([]), lambda r: r, k)) == []


@pytest.mark.parametrize("k", [1, 4, 16])
def test_several_neighbours_against_brute_force(spark, monkeypatch, k):
    """Site lines come in one order, so what goes is what any of the nearest pages has,
    over the borders of runs too."""
    import random

    monkeypatch.setattr(page_text, "RUN_ROWS", 20)
    draw = random.Random(k)
    site = [f"menu {i:02d}" for i in range(40)]
    pages = []
    for i in range(90):
        top = sorted(draw.sample(site, 5))
        html = "".join(f"<div>{x}</div>" for x in top) + f"<p>own {i}</p><article><p>quoted by all</p></article>"
        pages.append((i, f"https://h{i % 2}/{i // 2:03d}", html, top))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_text.main_text(df, neighbours=k).collect()}
    for i, _, _, top in pages:
        near = {x for j, _, _, other in pages if j % 2 == i % 2 and 0 < abs(j - i) // 2 <= k for x in other}
        want = [x for x in top if x not in near] + [f"own {i}", "quoted by all"]
        assert got[i]["text"].split("\n\n") == want and got[i]["n_shared"] == len(top) + 2 - len(want)
