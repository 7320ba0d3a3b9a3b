"""HTML extraction on odd and typical pages, and URL lists against a row-by-row version."""

import datetime as dt
import math
import random
import time

import pytest

from tidekeep.llm import html_text, url_filters

BODY = [
    "The first paragraph tells at some length what the whole article is about, in plain words.",
    "A second one goes on with it &amp; adds <b>bold</b> and <a href='/x'>linked</a> words to the story.",
    "Short end.",
]
TEXT = "The first paragraph tells at some length what the whole article is about, in plain words. A second one goes on with it & adds bold and linked words to the story. Short end."
NOISE = "<p>Some words that are not part of the article, yet long enough to look like a paragraph of it.</p>"


def article(wrap="article", head="<h1>Title here</h1>"):
    return f"<{wrap}>{head}" + "".join(f"<p>{p}</p>" for p in BODY) + f"</{wrap.split()[0]}>"


@pytest.mark.parametrize(
    "around",
    [
        "<nav><ul><li><a href=/a>a</a></li><li><a href=/b>b</a></li></ul></nav>{}<footer>(c) somebody</footer>",
        "<header><h2>Site name</h2><form><input name=q><button>Go</button></form></header><main>{}</main><aside>" + NOISE + "</aside>",
        '<div id="wrapper"><div class="sidebar">' + NOISE * 2 + '</div><div class="cookie-notice">' + NOISE + '</div>{}<section id="comments"><h3>Comments</h3>' + NOISE * 6 + "</section></div>",
        '<div class="page-with-sidebar"><div>{}</div><div class="ad-slot">' + NOISE + "</div></div><script>var x = '<p>no</p>';</script><style>p{{}}</style>",
        "<!-- <p>gone</p> --><noscript><p>Turn scripts on</p></noscript>{}<div role=navigation><p>" + "menu " * 30 + "</p></div>",
    ],
)
@pytest.mark.parametrize("wrap", ["article", "div class='post-body'", "section"])
def test_article_is_found(around, wrap):
    page = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body>" + around.format(article(wrap)) + "</body></html>"
    assert html_text.extract(page) == "Title here " + TEXT


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;\n\t here", "plain <text> here"),
        ("<p>a<b>b</b>c</p><p>d", "abc d"),
        ("<div>x<br>y&nbsp;z</div>", "x y z"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<ul><li>one<li>two</ul>", "one two"),
        ("<p title='a > b'>ok</p>", "ok"),
        ("a < b and 3 > 2", "a < b and 3 > 2"),
        ("<p>cut<!-- open", "cut"),
        ("<script>only()</script>", ""),
        ("<article><p>Left open<p>and again", "Left open and again"),
        ("<P CLASS=x>UPPER</P>", "UPPER"),
        ("</p></div>stray", "stray"),
    ],
)
def test_odd_pages(page, text):
    assert html_text.extract(page) == text


def test_large_and_deep_pages():
    deep = "<div>" * 2000 + "<p>deep text of some length here</p>"
    assert html_text.extract(deep) == "deep text of some length here"
    for page in ("<b>" * 20000 + "</i>" * 20000, "<i><div>" + "<b>" * 20000 + "</i>" * 20000, "<div>" * 20000, "<p><b>" * 20000 + "end"):
        began = time.process_time()
        html_text.extract(page)
        assert time.process_time() - began < 10
    long = "<article>" + "<p>word word word word.</p>" * 20000 + "</article>"
    assert html_text.extract(long) == " ".join(["word word word word."] * 20000)


def _page(rng, depth=0):
    """Random markup below a body: blocks, inline elements, links and text."""
    out = []
    for _ in range(rng.randint(1, 4)):
        name = rng.choice(["div", "section", "p", "a", "b", "ul", ""]) if depth < 5 else ""
        out.append(f"<{name}>{_page(rng, depth + 1)}</{name}>" if name else "".join(rng.choices(["word ", "some more text, ", "x ", "\n"], k=rng.randint(0, 12))))
    return "".join(out)


def test_densities_by_definition():
    rng = random.Random(9)
    for _ in range(60):
        tree = html_text.Tree(f"<html><body>{_page(rng)}</body></html>", True)
        n, below = len(tree.names), {i: [] for i in range(len(tree.names))}
        for i in range(1, n):
            below[tree.parents[i]].append(i)

        def every(i):
            return [i] + [k for j in below[i] for k in every(j)]

        def chars(i, linked=False):
            linked = linked or tree.names[i] == "a"
            own = sum(len(w) for w in tree.texts[i].split())
            found = [(own, own if linked else 0)] + [chars(j, linked) for j in below[i]]
            return sum(x for x, _ in found), sum(y for _, y in found)

        def link_above(i):
            return i > 0 and (tree.names[i] == "a" or link_above(tree.parents[i]))

        total, linked = chars(tree.body)
        if not total:
            assert tree.select() == []
            continue

        def density(i):
            c, lc = chars(i, link_above(i))
            if not c:
                return 0.0
            names = [tree.names[k] for k in every(i)[1:] if tree.names[k]]
            t, lt = len(names) or 1, names.count("a")
            base = math.log(c / ((c - lc) or 1) * lc + linked / total * c + math.e)
            return c / t * math.log(c / (lc or 1) * t / (lt or 1) + 1) / max(math.log(base), html_text.LEAST_BASE)

        def block(i):
            return i if i == 0 or tree.names[i] in html_text.BLOCKS else block(tree.parents[i])

        sums = dict.fromkeys(range(n), 0.0)
        for i in range(1, n):
            over = block(tree.parents[i])
            if tree.names[i] in html_text.BLOCKS:
                sums[over] += density(i)
            elif not tree.names[i]:
                sums[over] += density(over) * chars(i)[0] / (chars(over)[0] or 1)
        inside = [i for i in every(tree.body) if tree.names[i]]
        most = max(sums[i] for i in inside)
        core = next(i for i in inside if sums[i] >= most * (1 - 1e-12))
        path, i = [core], core
        while i != tree.body:
            i = tree.parents[i]
            path.append(i)
        least = min(density(i) for i in path)
        chosen = tree.select()
        assert any(core in every(i) for i in chosen)
        # nothing outside of what reaches the threshold is taken, but for headings
        assert all(any(density(k) >= least * (1 - 1e-9) for k in [i, tree.parents[i]]) or tree.names[i] in html_text.HEADINGS for i in chosen)


def test_pages_query(spark):
    rows = [(1, "u", f"<article><p>{TEXT}</p></article>"), (2, None, None), (2, None, None), (3, "v", "")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in got) == [(1, "u", TEXT, len(TEXT)), (2, "", "", 0), (2, "", "", 0), (3, "v", "", 0)]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_lists_against_a_row_by_row_version(spark):
    rng, day = random.Random(3), lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "notexample.com"]
    entries = [("l" + str(rng.randint(1, 2)), *rng.choice([("domain", h) for h in hosts] + [("prefix", h + p) for h in hosts for p in ("/p", "/p/q")]), rng.choice(["add", "remove"]), day(rng.randint(0, 30))) for _ in range(60)]
    entries += [("l1", "domain", None, "add", day(1)), ("l1", "domain", "x.org", "add", None), ("l1", "other", "x.org", "add", day(1)), ("l1", "domain", "x.org", "noop", day(1))]
    captures = [(k, rng.choice(["http://", "https://user@", "//"]) + rng.choice(hosts).upper() + rng.choice(["", ":80"]) + rng.choice(["", "/", "/p", "/p/q/r", "/pq", "/p?x=/p/q#y"]), day(rng.randint(0, 32))) for k in range(300)]
    captures += [(900, None, day(3)), (901, "http://x.org/", None), (902, "not a url", day(3)), (902, "not a url", day(3))]

    spans = []
    for key in sorted({e[:3] for e in entries if e[2] is not None}):
        if key[1] not in ("domain", "prefix"):
            continue
        since = None
        for _, _, _, action, at in sorted((e for e in entries if e[:3] == key and e[3] in ("add", "remove") and e[4]), key=lambda e: (e[4], e[3])):
            if action == "add" and since is None:
                since = at
            elif action == "remove" and since is not None:
                if at > since:
                    spans.append((*key, since, at))
                since = None
        if since is not None:
            spans.append((*key, since, None))

    def hits(url, at):
        if url is None or at is None or "//" not in url:
            return []
        rest = url.split("//", 1)[1].split("#")[0].split("?")[0]
        host, _, path = rest.partition("/")
        host = host.split("@")[-1].split(":")[0].lower()
        steps = [s for s in path.split("/") if s]
        own = {("domain", host.split(".", k)[-1]) for k in range(host.count(".") + 1)} | {("prefix", "/".join([host, *steps[: k + 1]])) for k in range(len(steps))}
        return [s for s in spans if (s[1], s[2]) in own and s[3] <= at and (s[4] is None or at < s[4])]

    schema = "page_id long, url string, fetched_at timestamp"
    listed = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at timestamp")
    got = {r.page_id: (r.blocked, r.n_matches, r.pattern) for r in url_filters.evaluate(spark.createDataFrame(captures, schema), listed).collect()}
    want = {k: (bool(h), len(h), min((s[2] for s in h), default=None)) for k, u, t in captures for h in [hits(u, t)]}
    assert got == want and any(v[0] for v in want.values())
    assert url_filters.evaluate(spark.createDataFrame([], schema), listed).count() == 0
    assert not any(r.blocked for r in url_filters.evaluate(spark.createDataFrame(captures, schema), spark.createDataFrame([], listed.schema)).collect())


def test_url_lists_by_capture(spark):
    entries = spark.createDataFrame([("l", "domain", "Example.com", "add", 5), ("l", "prefix", "Other.org/Path", "add", 1)], "list string, kind string, pattern string, action string, at long")
    captures = [(1, "http://example.com/a", 3), (1, "http://example.com/a", 7), (1, "http://example.com/a", 7), (1, "http://other.org/Path/x", 7), (2, "http://other.org/path/x", 7), (3, None, 7)]
    got = url_filters.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at long"), entries).collect()
    assert sorted((r.page_id, r.url or "", r.fetched_at, r.blocked, r.n_matches) for r in got) == sorted(
        (k, u or "", t, hit, int(hit)) for (k, u, t), hit in zip(captures, [False, True, True, True, False, False], strict=True)
    )
