"""License scans, URL rules, sharding, extraction."""

import html
import re
from collections import Counter

import pytest
from oracle import compare, duck

from signalweir.llm import html_extract, queries, url_filter
from signalweir.llm.common import words_of
from signalweir.llm.licenses import PHRASES, TEMPLATES, Automaton, license_report
from signalweir.llm.sharding import interleave

SF = "/root/testdata/sf0.01"


def places(text, phrase):
    w, p = words_of(text.encode()), phrase.encode().split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def test_license_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_license_scan(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_base for r in got) > 10
    for r in got:
        found = {p: places(texts[r.doc_id], p) for p in PHRASES}
        every = sorted(x for v in found.values() for x in v)
        labels = sorted({PHRASES[p] for p, v in found.items() if v})
        assert (r.n_words, r.n_base, r.base_labels) == (len(words_of(texts[r.doc_id].encode())), len(every), ",".join(labels))
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_matching_statistics():
    a = Automaton({"x y": "p"}, {"t": "a b c a b d", "u": "b c x y a"})
    runs = {tuple(t[i:j]) for t in (["a", "b", "c", "a", "b", "d"], ["b", "c", "x", "y", "a"], ["x", "y"]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    text = "c a b d a b c x y a b c a b c x y y a".split()
    ids = [a.numbers[w.encode()] for w in text]
    for i, (_, n) in enumerate(a.statistics(ids)):
        want = max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in runs), default=0)
        assert n == want


def test_every_copy_of_a_license_has_its_span(spark):
    mit, isc, two, three = (TEMPLATES[x] for x in ("mit", "isc", "bsd-2", "bsd-3"))
    rows = [(1, f"{mit} stop {mit}"), (2, f"{mit} and some words of another kind {isc} then {mit}"), (3, f"x {two} y"), (4, f"x {three} y"), (5, f"{two} between them {three}")]
    got = {r.id: r for r in license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    counted = {k: sorted((s.first, s.label) for s in r.spans if s.counts) for k, r in got.items()}
    words = {x: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", TEMPLATES[x])) for x in ("mit", "isc", "bsd-2")}
    assert counted[1] == [(0, "mit"), (words["mit"] + 1, "mit")]
    assert counted[2] == [(0, "mit"), (words["mit"] + 6, "isc"), (words["mit"] + words["isc"] + 7, "mit")]
    assert counted[3] == [(1, "bsd-2")] and counted[4] == [(1, "bsd-3")]
    assert counted[5] == [(0, "bsd-2"), (words["bsd-2"] + 2, "bsd-3")]
    assert all(r.score == 1.0 for r in got.values())


def test_license_chains(spark, awkward, nothing):
    mit = TEMPLATES["mit"]
    edited = mit.replace("documentation", "docs").replace("publish, ", "")
    rows = [(1, "x " * 50 + mit + " y"), (2, edited.upper()), (3, " ".join(mit.split()[:9])), (4, "the of and to"), (5, None), (6, "Released under the MIT License. CC BY-NC cc by nc"),
            (7, TEMPLATES["cc-by-sa"] + " - " + TEMPLATES["lgpl"]), (8, TEMPLATES["cc-by-sa"] + " and later " + TEMPLATES["cc-by"])]
    got = {r.id: r for r in license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == ["mit"] and got[1].score == 1 and (got[1].spans[0].first, got[1].spans[0].last) == (50, 49 + len(words_of(mit.encode())))
    assert got[2].labels == ["mit"] and 0.8 < got[2].score < 1
    assert got[3].labels == [] and 0 < got[3].score < 0.3
    assert got[4].score == 0 and got[5].n_words == 0 and got[5].labels == []
    assert got[6].labels == ["cc-by-nc", "mit"] and len(got[6].phrases) == 3
    assert got[7].labels == ["cc-by-sa", "lgpl"] and got[8].labels == ["cc-by", "cc-by-sa"]
    assert license_report(awkward).count() == awkward.count() and license_report(nothing).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_url_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert compare(queries.op9_url_filter(spark, d), duck(d), queries.ORACLES["op9_url_filter"]) is None


URLS = [
    (1, "http://A.Net/x"), (2, "http://a.example.net/en/"), (3, "http://a.example.net/en"), (4, "http://net"), (5, "http://net?x=/"), (6, None),
    (7, ""), (8, "nothing here"), (9, "http://notexample.com/de/1"), (10, "https://x.example.com/de/a#b?c"), (11, "x://org/fr/"), (12, "http://b.org/FR/"),
    (13, "http://www.bad.com/page.html?utm=1"), (14, "http://bad.com/page"), (15, "http://bad.com/page2"), (15, "http://bad.com/page2"), (None, "http://q.net/"), (16, "http://a.com/\nnet/"),
]


@pytest.mark.parametrize("blocks", [1 << 16, 1])
def test_url_rules(spark, blocks):
    pages = spark.createDataFrame([(*u, "h") for u in URLS], "page_id long, url string, host string")
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("bad.com", "/page"), ("bad.com", "/page"), (None, "/")] + [(f"h{i}.com", f"/{i}") for i in range(200)], "host string, path string")
    got = url_filter.judge_urls(pages, rules, listed, max_blocks=blocks).collect()
    assert len(got) == len(URLS)
    verdicts = {r.id: (r.host, r.path, r.rule, r.verdict) for r in got}
    for key, url in URLS:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if key in (13, 14) else "allow")
        assert verdicts[key] == (host, path, rule, verdict)
    assert url_filter.judge_urls(pages, rules.limit(0), listed.limit(0), max_blocks=blocks).where("verdict = 'allow'").count() == len(URLS)
    assert url_filter.judge_urls(pages.limit(0), rules, listed, max_blocks=blocks).count() == 0


def test_sharding_law_and_mixture(spark, documents):
    rows = interleave(documents, 24).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    sizes = Counter(r.stratum for r in rows)
    for s in counts:
        own = Counter(r.stratum for r in rows if r.shard == s)
        assert all(abs(own[k] - n / 24) <= 2 for k, n in sizes.items())


def test_sharding_awkward(spark, awkward, nothing):
    rows = interleave(awkward, 24).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(i, 0) for i in range(awkward.count())]
    assert {r.size for r in rows if r.id == 3} == {8}
    assert interleave(nothing, 24).collect() == []
    again = interleave(awkward.repartition(5), 3).collect()
    assert sorted((str(r.id), r.shard) for r in again if r.id != 1) == sorted((str(r.id), r.shard) for r in interleave(awkward, 3).collect() if r.id != 1)


def plain_article(page):
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_extraction_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op10_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain_article(pages[r.page_id]) and r.n_chars == len(r.text)


LONG = "Plain words of the story go on and on here so that it is long enough to count as content."
PAGE = f"""<html><head><title>No title</title><style>p{{}}</style></head><body><header class=masthead><p>Site name and a slogan</p></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site for many reasons indeed</p></div>
<div id="content"><h2>Head &amp; line</h2><p>{LONG} One<br>two  three<p>{LONG}<ul><li>first <i>item</i><li>second</ul><div class="ad">Buy things now</div>
<script>var x = "</p><p>not text";</script><!-- no --><p>{LONG} &lt;end&gt;</p></div><aside>Read these other stories as well</aside>
<form><label>Name</label><textarea>type here</textarea></form><section id="comments"><p>{LONG} says a reader</p></section><footer>(c) all of us</footer></body></html>"""


def test_extraction_without_article():
    text = html_extract.main_text(PAGE, html_extract.weights({}))
    assert text.split("\n") == ["Head & line", f"{LONG} One two three", LONG, "first item", "second", f"{LONG} <end>"]


@pytest.mark.parametrize("advert", ['<div class="ad">{}</div>', "<aside><p>{}</p></aside>", '<div class="share"><ul><li><a href=/>{}</a></ul></div>'])
def test_extraction_bridges_an_advert_in_the_article(spark, advert):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one, two = "first words of it " * 3, "and so the story ends " * 10
    page = f"<body><nav><a href=/>Home</a></nav><article><p>{one}</p>{advert.format('buy these things today ' * 20)}<p>{two}</p></article><footer>all of us</footer></body>"
    for weight in (html_extract.weights({}), html_extract.fit(pages)):
        assert html_extract.main_text(page, weight).split("\n") == [one.strip(), two.strip()]


@pytest.mark.parametrize("wrapper", ['div class="layout with-sidebar"', "div class=no-comments", 'div id="fixed-header"', "div class=sidebar", "form action=/"])
@pytest.mark.parametrize("main", ["article", "main", "main><article"])
def test_extraction_inside_a_marked_wrapper(wrapper, main):
    page = f"<body><{wrapper}><{main}><p>{LONG}</p></article></main><div class=sidebar><p>Read these other stories</p></div></div></body>"
    assert html_extract.main_text(page, html_extract.weights({})).split("\n")[0] == LONG


def test_extraction_states_and_closed_drawings():
    weight = html_extract.weights({})
    for wrapper in ("layout with-sidebar", "has-sidebar", "no-comments", "fixed-header"):
        page = f'<body><div class="{wrapper}"><p>{LONG}</p><svg class="icon"/><p>{LONG}</p><div class="cookie-notice">{LONG}</div></div></body>'
        assert html_extract.main_text(page, weight).split("\n") == [LONG, LONG]
    assert html_extract.main_text(f"<p>{LONG}</p><svg><text>drawn</text></svg><p>{LONG}</p>", weight).split("\n") == [LONG, LONG]


LINKED = "<a href=/x>" + "a reference that the text itself names " * 4 + "</a>"
WHOLE = [
    f"<article><p>{LONG}</p><p>So says {LINKED}</p></article>",
    f"<article><p>{LONG}</p><ul><li>{LINKED}<li>{LINKED}</ul></article>",
    f"<article><p>By the way</p><p>{LINKED}</p><p>{LONG}</p></article>",
    f'<article><p>{LONG}</p><p class="side-effects">{LONG}</p><p>{LONG}</p></article>',
    f'<article><section class="legal-history"><p>{LONG}</p></section></article>',
    f"<form id=aspnetForm><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></form>",
    f'<div class="right-sidebar"><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></div>',
    f"<main><article><p>{LONG}</p></article><p>Last words</p></main>",
    f'<article><div class="post-header"><h1>A title</h1></div><p>{LONG}</p></article>',
    f"<article><p>{LONG}</p><p>{LONG * 20}</p></article>",
]


@pytest.mark.parametrize("body", WHOLE)
def test_extraction_keeps_the_article(spark, body):
    page = f"<body><nav><a href=/>Home</a></nav>{body}<p>Other things to read on this site today</p><footer>all of us</footer></body>"
    if "<article>" not in body:  # the wrapper holds the page
        page = f"<body>{body.replace('<h1>', '<nav><a href=/>Home</a></nav><h1>', 1)}</body>"
        body = body.replace("<nav><a href=/>Home</a></nav>", "")
    want = [" ".join(re.sub("<[^>]*>", "", b).split()) for b in re.split("</?(?:p|li|ul|h1|div|section|form|main|article)[^>]*>", body)]
    for weight in (html_extract.weights({}), html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))):
        assert html_extract.main_text(page, weight).split("\n") == [b for b in want if b]


@pytest.mark.parametrize("name", ["comments", "comment-list", "post-comments", "related-posts", "social-share", "cookie-notice", "site-footer", "main-nav", "ad-box", "newsletter-signup", "left-side"])
def test_extraction_leaves_marked_parts_out(name):
    page = f'<body><article><p>{LONG}</p><div class="{name}"><p>{LONG} {LONG} {LONG}</p></div><p>{LONG}</p></article><div id="{name}">{LONG}</div></body>'
    assert html_extract.main_text(page, html_extract.weights({})).split("\n") == [LONG, LONG]
    alone = f'<body><div class="{name}"><p>{LONG} {LONG}</p></div></body>'
    assert html_extract.main_text(alone, html_extract.weights({})) == (f"{LONG} {LONG}" if name == "left-side" else "")


def test_extraction_awkward(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "just words"), (4, "u", "<p>open"), (5, "u", "<" * 50), (6, "u", "<a b='" + "x" * 1000), (7, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (7, "u", "</p>" * 3000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.id: r.text for r in html_extract.extracted(pages, html_extract.fit(pages)).where("id < 7").collect()}
    assert got[1] == got[2] == "" and got[3] == "just words" and got[4] == "open"
    assert html_extract.extracted(pages.limit(0), html_extract.weights({})).count() == 0
