import html as H
import random
import time

import pytest

from verbatlas.llm import extraction
from verbatlas.llm.extraction import Page, Paths, agreed_paths, generalised, main_texts, marked, path_votes

PROSE = "It was a long and winding road that led them through the hills, past the mill and over the river to the old town."


def text_of(page):
    found = Page(page, Paths())
    return found.extract(found.containers()[0])


CASES = {
    "plain": (f"<p>{PROSE}</p><p>Second.</p>", f"{PROSE}\n\nSecond."),
    "inline marks": (f"<article><p>One <b>bold</b><i>er</i> w<em>o</em>rd<br>next\n\t line &amp; more.<p>{PROSE}</article>", f"One bolder word next line & more.\n\n{PROSE}"),
    "furniture": (
        f"<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><main><article><header><h1>Title</h1></header><p>{PROSE}</p><form><input>Mail <button>Go</button></form><footer>By me.</footer></article>"
        f"<aside>{PROSE}</aside><section id=comments><article class=comment><p>{PROSE} I say.</p></article></section></main><footer>&copy;</footer></body>",
        f"Title\n\n{PROSE}",
    ),
    "names": (
        f"<div class='site-header'>Top</div><div id=content><h1>T</h1><div class=ad-slot>Buy.</div><div class='cookie-notice'><p>{PROSE}</p></div><div class=text><p>{PROSE}</p></div><div class=relatedPosts>More</div>"
        f"<div role=search>Find</div><p hidden>No</p><p style='display: none'>No</p></div><div class='sidebar widget'><p>{PROSE}</p></div><div class=commentlist>{PROSE}</div>",
        f"T\n\n{PROSE}",
    ),
    "wrappers keep": (f"<body class=has-sidebar><div class='wrapper sidebar-right'><form id=aspnet><article><h1>T</h1><p>{PROSE}</p></article></form></div></body>", f"T\n\n{PROSE}"),
    "a form around all": (f"<form><div><h1>T</h1><p>{PROSE}</p></div><input></form>", f"T\n\n{PROSE}"),
    "raw and skipped": (f"<article><p>a<script>x='</p>'</script>b<svg><path/><text>no</text></svg> <svg/>c<noscript><p>no</p></noscript>.<style>p{{}}</style> <select><option>no<option>no</select>d</p><p>{PROSE}</article><title>no</title>", f"ab c. d\n\n{PROSE}"),
    "unfinished": (f"<article><p>{PROSE}</p><p>Cut he<", f"{PROSE}\n\nCut he<"),
    "unfinished tag": (f"<article><p>{PROSE}</p><p>Cut <a hre", f"{PROSE}\n\nCut"),
    "unfinished comment": (f"<article><p>{PROSE}</p><!-- no", PROSE),
    "comments": (f"<!DOCTYPE html><?xml ?><article><!-- <p>no</p> --><p>{PROSE}<!--> yes --></p></article>", f"{PROSE} yes -->"),
    "signs": (f"<article><p title='a>b' data-x=\"</p>\">1 < 2 &lt; 3 > 2 &#233; &eacute; &nbsp; &bogus; &amp</p><p>{PROSE}</p></article>", f"1 < 2 < 3 > 2 é é &bogus; &\n\n{PROSE}"),
    "lists and tables": (f"<article><ul><li>One<li>Two<ul><li>In</ul></ul><table><tr><td>a<td>b<tr><th>c</table><p>{PROSE}</article>", f"One\n\nTwo\n\nIn\n\na\n\nb\n\nc\n\n{PROSE}"),
    "sections": (f"<div class=post><section><p>{PROSE}</p></section><section><p>{PROSE}</p></section><section>{PROSE}</section></div>", "\n\n".join([PROSE] * 3)),
    "lead": (f"<article><p>A lead.</p><div class=content><p>{PROSE}</p><p>{PROSE}</p></div></article>", f"A lead.\n\n{PROSE}\n\n{PROSE}"),
    "nothing": ("<nav>Menu</nav><script>x</script>", ""),
    "no letters": ("", ""),
    "link in text": (f"<article><p>{PROSE}</p><p><a href=x>A paragraph that is a link.</a></p></article>", f"{PROSE}\n\nA paragraph that is a link."),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert text_of(page) == want


def test_names_of_classes():
    assert generalised("div", {"class": "b post-12 a css-1x2y3z"}) == "div.a.b.post-#" and generalised("div", {"id": "p7"}) == "div#p#" and generalised("body", {"class": "x"}) == "body"
    assert marked({"class": "article-comments"}) and marked({"id": "adSlot"}) and marked({"class": "x share_bar"}) and not marked({"class": "no-sidebar"}) and not marked({"class": "download shadow page-with-menu-wrapper"})


@pytest.mark.parametrize("piece", ["<a ", '<a href="x', "<script>", "<!--", "<div>", "<p>x", "<ul><li>", "<b>x</b></p></div>", "</a", "< ", "='", "<table><tr><td><div>", "<title>x</titl", "<form>a", "<svg>", "<label>", "&am", "<a>x"])
def test_time_grows_with_the_page(piece):
    def took(n):
        start = time.perf_counter()
        text_of(piece * n)
        return time.perf_counter() - start

    took(100)
    assert took(40_000) < 40 * max(0.02, took(4_000))


def site(rng, n, host):
    """Pages of one template; some have an article that is short beside a long unmarked box, which their own scores would choose."""
    pages = []
    for i in range(n):
        body = [f"{PROSE} {rng.random()}." for _ in range(rng.randrange(4, 9))]
        short = i % 10 == 3
        story = body[:1] if short else body
        box = f"<div class=box><p>{' '.join(body * 3)}</p></div>" if short else "<div class=box><p>Hello.</p></div>"
        page = f"<html><body><div class=top>Top</div><div class='x{i}y story-{i}'>" + "".join(f"<p>{H.escape(p)}</p>" for p in story) + f"</div>{box}</body></html>"
        pages.append((f"http://{host}/p/{i}", page, "\n\n".join(story)))
    return pages


def test_hosts_agree(spark, monkeypatch):
    rng = random.Random(6)
    pages = site(rng, 60, "Big.example:80") + site(rng, 12, "other.example")
    odd = [("http://big.example/x", None, ""), ("http://big.example/y", "", ""), (None, f"<div><p>{PROSE}</p></div>", PROSE), ("not a url", f"<td>{PROSE}", PROSE), ("http://alone.example/", f"<section><p>{PROSE}</p></section>", PROSE)]
    rows = [(i, u, h, "x") for i, (u, h, _) in enumerate(pages + odd)] + [(None, *pages[0][:2], "x"), (0, *pages[0][:2], "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    own = sum(text_of(h) == want for _, h, want in pages)
    assert own < len(pages)  # page by page some are wrong
    results = []
    for bound in (1000, 0):  # agreed paths travel, or pages are dealt out by host
        monkeypatch.setattr(extraction, "BROADCAST_PATHS", bound)
        results.append(sorted(map(tuple, main_texts(frame).collect()), key=str))
    assert results[0] == results[1]
    got = {r[0]: r for r in results[0] if r[0] is not None}
    assert len(results[0]) == len(rows)
    for i, (_, _, want) in enumerate(pages + odd):
        assert got[i][2] == want and got[i][3] == len(want)
    assert all(got[i][5] for i in range(len(pages))) and not got[len(pages) + 4][5]


def test_votes_equal_counting_by_hand(spark):
    pages = site(random.Random(7), 30, "a.example")
    frame = spark.createDataFrame([(u, h) for u, h, _ in pages], "url string, html string")
    votes, present = {}, {}
    for _, h, _ in pages:
        best, held = Page(h, Paths()).containers()
        votes[best] = votes.get(best, 0) + 1
        for p in held:
            present[p] = present.get(p, 0) + 1
    got = {r.path: (r.votes, r.present) for r in path_votes(frame).collect()}
    assert got == {p: (votes.get(p, 0), n) for p, n in present.items()}
    agreed = {r.path for r in agreed_paths(path_votes(frame)).collect()}
    assert agreed == {p for p, n in votes.items() if n >= 2 and n * 1000 >= sum(votes.values())}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_texts(frame).count() == 0
