"""Each operator against a brute-force version, and its defined results in odd cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plenaria.llm import chat, classifier, components, decontam, html, pack, quality, shard, simhash, suffix, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOC).withColumns({c: F.lit(1) for c in ("bucket", "_host", "score", "key", "print", "length")})


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").orderBy("doc_id").collect()]


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "x " * 40_000), (None, "nobody's words"), (6, "é" * 60), (7, "é" * 60)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# --- 1: html


ARTICLE = "<article><h1>T &amp; t</h1><p>One <b>two</b>&nbsp;three<p>Four<ul><li>a<li>b</ul></article>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><nav>m</nav>{ARTICLE}<footer>f</footer>", "T & t\n\nOne two three\n\nFour\n\na\n\nb"),
        (f"<script>var x='<p>no</p>'</script><aside><p>side</p></aside>{ARTICLE}<div class=comments><p>hi</div>", "T & t\n\nOne two three\n\nFour\n\na\n\nb"),
        ("<main><header><h1>Head</h1><p>by line</header><p>Text.</p><form><p>sign up</form></main>", "Head\n\nText."),
        ("<body class='has-sidebar'><div id=cookie-notice><p>Cookies</div><p>Long enough to be kept as a text.</p>", "Long enough to be kept as a text."),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<div class=page-wrap><div id=header><h1>Site</h1></div><div class='post-header'><h1>Title</h1><p>by line</div><p>A text.</p></div>", "Title\n\nA text."),
        ("<article><div class=entry-header><h2>Title</h2>by line</div><p>A text.</p></article>", "Title\n\nA text."),
        ("<article><p>a < b &lt; c<!-- <p>x --> d<br>e</p><article class=comment>no</article></article>", "a < b < c d e"),
        ("<div class='article-comments'><p>no</p></div><table><tr><td>1<td>2<tr><td>3</table>", "1 2\n\n3"),
        ("<article><h1>T</h1><div class='alert-text'><p>The army raised the alarm.</div><p class='share-price'>Shares rose</p></article>", "T\n\nThe army raised the alarm.\n\nShares rose"),
        ("<article><p>One</p><section id='related-work'><h2>Related</h2><p>Earlier papers.</p></section></article>", "One\n\nRelated\n\nEarlier papers."),
        ("<article><p>One</p><ul class='related-guides'><li><a href=x>More</a></ul><div class='share-box c-2'>Share</div><p class='login_form'>in</p></article>", "One"),
        ("<article><div class='notice'><p>no</div><div class='alert-text'><div class='reader-comments'>no</div><p>One</p></div></article>", "One"),
        ("<div class='share-price'>no</div><p>One</p>", "One"),
        ("<div class='page-header'>One</div><div class='PostHeader'><h1>T</h1>by</div><p>Two</p>", "One\n\nT\n\nTwo"),
        ("", ""),
    ],
)
def test_html_of_one_page(page, want):
    assert html.main_text(html.Page(page), None, {}) == want


def test_html_of_very_long_texts(spark):
    """A text of megabytes, in one block and in many, beside pages of a few words and repeated rows."""
    one, many = "word " * 600_000, [f"block {i} of many" for i in range(20_000)]
    rows = [(1, "https://a.org/1", f"<nav>m</nav><article><p>{one}</article>"), (2, "https://a.org/2", "<article><p>short</article>")]
    rows += [(3, "https://a.org/3", "<article>" + "".join(f"<p>{x}" for x in many) + "</article>")] * 2
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    want = {1: one.strip(), 2: "short", 3: "\n\n".join(many)}
    assert sorted(r.page_id for r in got) == [1, 2, 3, 3]
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_html_alignment_is_simple_tree_matching():
    def weight(a, b, i, j):
        if a.labels[i] != b.labels[j]:
            return 0
        x, y = a.children[i], b.children[j]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(len(x)):
            for q in range(len(y)):
                m[p + 1][q + 1] = max(m[p][q + 1], m[p + 1][q], m[p][q] + weight(a, b, x[p], y[q]))
        return 1 + m[-1][-1]

    rng = random.Random(3)
    for _ in range(200):
        pages = []
        for _ in range(2):
            p = html.Page("".join(rng.choice(["<div>", "</div>", "<p>t", "<ul><li>", "</ul>", "<h2>h</h2>"]) for _ in range(12)))
            pages.append(html.Tree(p.labels, p.sizes, p.said))
        a, b = pages
        mapped = html.align(a, b)
        assert sum(x >= 0 for x in mapped) == weight(a, b, 0, 0)
        assert all(a.labels[i] == b.labels[j] for i, j in enumerate(mapped) if j >= 0)


def test_html_alignment_of_wide_levels_is_exact(monkeypatch):
    rng = random.Random(6)
    piece = ["<p>t</p>", "<h2>h</h2>", "<div><p>t</p></div>", "<ul><li>a</ul>", "<div><p>a</p><h2>b</h2></div>"]

    def tree(parts):
        p = html.Page("".join(parts))
        return html.Tree(p.labels, p.sizes, p.said)

    for _ in range(30):
        a, b = (tree(["<section>", *rng.choices(piece, k=rng.randint(1, 40)), "</section>", *rng.choices(piece, k=20)]) for _ in range(2))
        monkeypatch.setattr(html, "WIDEST", 10**9)
        want = html.align(a, b)
        monkeypatch.setattr(html, "WIDEST", 0)
        assert html.align(a, b) == want
    monkeypatch.undo()
    # a run of blocks put into a long flat page, whose ends differ as well
    flat = rng.choices(piece, k=700)
    longer = ["<hr><h3>new</h3>", *flat[:300], *["<p>t</p><h2>h</h2>"] * 60, *flat[300:], "<h4>end</h4>"]
    mapped = html.align(tree(longer), tree(["<h5>old</h5>", *flat, "<h6>end</h6>"]))
    assert sum(j >= 0 for j in mapped) == len(tree(flat).labels)
    inner = html.align(tree(["<section>", *longer, "</section>"]), tree(["<section><h5>old</h5>", *flat, "<h6>end</h6></section>"]))
    assert sum(j >= 0 for j in inner) == len(tree(flat).labels) + 1


def test_html_template_is_left_out(spark):
    rows = []
    for i in range(30):
        # no element says what is what: only the host's other pages do
        body = f"<div>Welcome to our lovely site of many words</div><div>Story {i} tells of {i * 7} things</div><div>All rights are ours and not yours</div>"
        rows.append((i, f"https://h.example/{i}", f"<body>{body}</body>"))
    rows += [(None, None, None), (40, "https://alone.example/", "<p>Alone</p>"), (40, "https://alone.example/", "<p>Alone</p>"), (41, "no host", "<p>x</p>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("tree", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == f"Story {i} tells of {i * 7} things" for i in range(30))
    assert (by[None].text, by[None].n_chars, by[40].text, by[41].text) == ("", 0, "Alone", "x")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_of_each_layout(spark):
    rows = [(0, "https://h.example/", "<p>Moved, please go on")]
    for i in range(1, 61):
        story = f"<div>Story {i} tells of {i * 7} things</div>"
        if i % 2:
            body = f"<div class=top><div>Welcome to our lovely site of many words</div></div><div class=text>{story}</div>"
        else:
            body = f"<section><div>Read this in print as well as you can here</div>{story}<div>All rights are ours and not yours</div></section>"
        rows.append((i, f"https://h.example/{i}", f"<body>{body}</body>"))
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[0] == "Moved, please go on"
    assert all(by[i] == f"Story {i} tells of {i * 7} things" for i in range(1, 61))


def test_html_copies_and_odd_blocks_are_kept(spark):
    article = "".join(f"<div>Part {k} of a long and winding tale that is told on each mirror of the page</div>" for k in range(6))
    rows = [(i, f"https://two.example/{i}", f"<body>{article}<div>Seen {i} times</div></body>") for i in range(2)]
    rows += [(100 + i, f"https://many.example/{i}", f"<body>{article}<div>Seen {i} times</div></body>") for i in range(40)]
    # 40 equal pages are one page, and three that differ are no evidence
    rows += [(200 + i, f"https://same.example/{i}", f"<body>{article}<div>Seen</div></body>") for i in range(40)]
    rows += [(300 + i, f"https://same.example/x{i}", f"<body>{article}<div>Once upon a time {'or more ' * 20}{i}</div></body>") for i in range(3)]
    rows += [(400, "https://one.example/", "<body><div>Short</div><div><a href=/x>All of it a link</a></div><p>Text</p></body>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(t.count("long and winding") == 6 for i, t in got.items() if i < 400)
    assert all(f"Seen {i % 100} times" in got[i] for i in (0, 1, *range(100, 140)))
    assert got[400] == "Short\n\nAll of it a link\n\nText"


def nested(n, inner):
    return "<div>" * n + inner + "</div>" * n


def test_html_deep_and_wide_pages(spark):
    """Pages nested 2,000 levels, with 5,000 children, and with end tags that nothing opened."""
    def tree(html_text):
        p = html.Page(html_text)
        return html.Tree(p.labels, p.sizes, p.said)

    a, b = tree(nested(2000, "<p>x</p><h2>y</h2>")), tree(nested(2000, "<h2>y</h2><p>x</p><p>z</p>"))
    assert sum(j >= 0 for j in html.align(a, b)) == 2002
    flat = ["<p>t</p>", "<h2>h</h2>", "<div><p>t</p></div>"]
    wide = [flat[i * i % 3] for i in range(5000)]
    a, b = tree("".join(["<h3>a</h3>", *wide[:2500], "<ul><li>n</ul>", *wide[2500:], "<h4>b</h4>"])), tree("".join(["<h5>c</h5>", *wide, "<h6>d</h6>"]))
    assert sum(j >= 0 for j in html.align(a, b)) == len(tree("".join(wide)).labels)
    rows = [(i, f"https://deep.example/{i}", nested(2000, f"<p>Page {i} says so</p>" * (1 + i % 3))) for i in range(12)]
    rows += [(50 + i, f"https://wide.example/{i}", "".join(f"<p>Part {k} of {i}</p>" for k in range(5000 - i))) for i in range(3)]
    rows += [(90, "https://odd.example/", "</li></p></div>" * 20_000 + "<p>" * 20_000 + "end")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n\n".join([f"Page {i} says so"] * (1 + i % 3)) for i in range(12))
    assert all(got[50 + i].count("\n\n") == 4999 - i for i in range(3)) and got[90] == "end"


def test_html_wrapper_finds_the_article_without_names(spark):
    """All pages of the larger tables with every telling name taken away: on hosts with pages enough, the
    wrapper alone tells the article from menus, adverts and footers, all of which vary."""
    sf = "/root/testdata/sf0.1"
    pages = table(spark, sf, "pages")
    plain = F.regexp_replace(F.col("html"), r"<(/?)(?:nav|article|footer|main|aside|header)\b[^>]*>", "<$1div>")
    plain = F.regexp_replace(plain, r"""<div (?:class|id)="[^"]*">""", "<div>")
    named = {r.page_id: r.text for r in html.extract(pages).collect()}
    bare = pages.withColumn("html", plain).withColumn("host", urls.host_of(F.col("url")))
    got = {r.page_id: r.text for r in html.extract(bare).collect()}
    rows = {r.page_id: r for r in bare.collect()}
    n = collections.Counter(r.host for r in rows.values())
    often = [i for i, r in rows.items() if n[r.host] >= 2 * html.REGION_PAGES]
    right = sum(got[i] == named[i] for i in often)
    alone = sum(html.main_text(html.Page(rows[i].html), None, {}) == named[i] for i in often)
    print(f"of {len(often)} pages, {right} are right by the wrapper alone and {alone} without it")
    assert len(often) > 1000 and right >= 0.95 * len(often) and alone < 0.05 * len(often)


def test_html_of_all_pages(spark, sf):
    import html as std

    want = {}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1]
        blocks = [" ".join(std.unescape(re.sub(r"<[^>]*(>|$)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in html.op1_html_extraction(spark, sf).collect()} == want


# --- 2: urls


def test_urls(spark):
    rows = [
        (1, "https://A.Example.org/en/12?x", None), (2, "http://example.org/es/x", ""), (3, "http://x.com/de/1", None),
        (4, "http://alias.net/a#top", '<link rel="canonical" href="http://x.com/de/1">'), (5, "http://alias.net/b", '<meta http-equiv=refresh content="0; url=/a">'),
        (6, "http://free.org/", '<LINK href="http://alias.net/b" rel=canonical>'), (7, None, "<p>"), (8, "nothing", None), (9, "http://other.net", None), (10, "http://alias.net/c/", "<link rel='canonical' href='d'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"a": F.lit(1), "component": F.lit(1)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/es/x", "example.org/es/", "block") and got[3][2:] == ("com/de/", "block")
    assert got[4] == ("alias.net", "/a", None, "block") and got[5] == ("alias.net", "/b", None, "block")
    assert got[6] == ("free.org", "/", "org/", "allow")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9] == ("other.net", "", None, "allow")
    assert got[10][3] == "allow"
    more = spark.createDataFrame([("http://alias.net/d", "http://alias.net/b"), ("http://alias.net/c/d", "http://alias.net/d")], "a string, b string")
    got = {r.page_id: r.verdict for r in urls.judge(df, edges=more).collect()}
    assert got[10] == "block" and got[9] == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 1), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert got == want


def test_components_plans_are_small(spark):
    """A step's plan doesn't hold the step before: the driver keeps the plans of all executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = max((e.executionId() for e in map(store.executionsList().apply, range(store.executionsList().size()))), default=-1)
    hub = spark.range(2000).selectExpr("id AS a", "CASE WHEN id < 1000 THEN 0L ELSE id - 1 END AS b")
    found = components.components(hub, "a", "b").collect()
    assert len(found) == 2000 and {r.component for r in found} == {0}
    made = store.executionsList()
    plans = [e.physicalPlanDescription() for e in map(made.apply, range(made.size())) if e.executionId() > seen]
    assert plans and max(p.count("Exchange") for p in plans) <= 24


# --- 3: suffix arrays


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for trial in range(150):
        k = rng.choice([1, 2, 3, 256])
        s = np.array([rng.randrange(k) for _ in range(rng.randint(1, 150))], np.uint8)
        s = np.tile(s, 3) if trial % 5 == 0 else s
        b = s.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix.suffix_array(s).tolist() == want
        bounded = suffix.suffix_array(s, 10).tolist()
        assert sorted(bounded) == list(range(len(b))) and [b[i : i + 10] for i in bounded] == sorted(b[i : i + 10] for i in range(len(b)))
        prefix = suffix.permuted_prefixes(s, np.array(want), 50)
        for x, y in zip(want, want[1:]):
            c = 0
            while c < 50 and max(x, y) + c < len(b) and b[x + c] == b[y + c]:
                c += 1
            assert prefix[y] == c


def removed(rows):
    """(bytes, removed, spans, digest) by row in order, by the definition."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49) if i is not None else ():
            w = b[j : j + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49) if i is not None else ():
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_are_removed(spark, texts, odd, none):
    rng = random.Random(2)
    passage = " ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(40))
    made = [(i, " ".join([rng.choice(["x", "yy"]) * 30, passage, str(i)])) for i in range(100, 130)]
    hot = [(200 + i, f"{i} the same sixteen bytes and then {i * 7919} different things that go on") for i in range(60)]
    for rows in (texts[:120] + made + hot, ODD):
        for bound, segments in ((512, suffix.HOT_SEGMENTS), (1, suffix.HOT_SEGMENTS), (512, 3)):
            got = suffix.remove_repeats(docs(spark, rows), outputs=(), hot_buckets=bound, hot_segments=segments).collect()
            assert sorted([tuple(r) for r in got], key=str) == removed(rows)
    assert suffix.remove_repeats(none).count() == 0


def test_repeats_beyond_the_limit_of_buckets(spark, texts):
    limit = "spark.sql.sources.bucketing.maxBuckets"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "3")
    try:
        rows = texts[:40]
        got = suffix.remove_repeats(docs(spark, rows), outputs=()).collect()
        assert sorted([tuple(r) for r in got], key=str) == removed(rows) and int(spark.conf.get(limit)) > 3
    finally:
        spark.conf.set(limit, before)


def test_a_bucket_costs_nothing_for_shards_it_does_not_meet():
    """A million shards, as of a corpus of terabytes: a bucket names those of its own segments only."""
    rng = random.Random(2)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(20)]
    rows = pa.table({"bucket": pa.array([3] * 200, pa.int32()), "doc_id": range(200), "text": [rng.choice(shared) + str(i) for i in range(200)]})
    key = (pa.scalar(3),)
    answers = suffix._answers(512, suffix.HOT_SEGMENTS)((pa.scalar(0),), suffix._anchors(1)(key, rows))
    began = time.process_time()
    many = suffix._send(1, 10**6)(key, rows, answers)
    assert time.process_time() - began < 1
    few = suffix._send(1, 7)(key, rows, answers)
    assert len(many) > len(few) == 7
    assert sum(map(len, many.column("bytes").to_pylist())) == sum(map(len, few.column("bytes").to_pylist()))


def test_what_buckets_send_is_compressed():
    """Sorted hashes, ids and segments take far fewer bytes than they have, and come back as they were."""
    rng = np.random.default_rng(5)
    hashes = np.sort(rng.integers(0, 1 << 32, 2000)).astype("<u4")
    assert (suffix._unzipped_steps(suffix._zipped_steps(hashes), "<u4") == hashes).all() and len(suffix._zipped_steps(hashes)) < 0.85 * hashes.nbytes
    ids = np.array([5, -3, 2**62, 7, 7, -(2**62)], "<i8")
    for x in (ids, ids[:0], np.arange(10**6, 10**6 + 500).astype("<i8")):
        assert (suffix._unzipped(suffix._zipped(x), "<i8") == x).all() and (suffix._unzipped_steps(suffix._zipped_steps(x), "<i8") == x).all()
    words = ["speech", "house", "member", "motion", "the", "of", "and", "minister", "question", "budget"]
    shared = [" ".join(rng.choice(words, 40)) for _ in range(50)]
    rows = pa.table({"bucket": pa.array([3] * 200, pa.int32()), "doc_id": range(200), "text": [shared[i % 50] + str(i) for i in range(200)]})
    key = (pa.scalar(3),)
    answers = suffix._answers(512, suffix.HOT_SEGMENTS)((pa.scalar(0),), suffix._anchors(1)(key, rows))
    raw, sent = (f(key, rows, answers) for f in (suffix._send(1, 3), suffix._compressed(suffix._send(1, 3))))
    sizes = [sum(map(len, x.column("bytes").to_pylist())) for x in (raw, sent)]
    assert sizes[1] < 0.4 * sizes[0]
    found = suffix._resolve(key, sent.slice(0, 1))
    assert found.num_rows == 1


def test_an_anchor_of_many_segments_is_hot_in_few_buckets():
    """Lines of one beginning and other ends, in two buckets: their anchor is dealt by window, that of copies isn't."""
    rng = random.Random(3)
    start, passage = "an other beginning of a line, which is a bit longer: ", "a passage with nothing random in it, said again and again, "
    ends = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(400)]
    parts = []
    for b in (0, 1):
        text = [start + e for e in ends[200 * b : 200 * b + 200]] + [passage * 2] * 300
        rows = pa.table({"bucket": pa.array([b] * 500, pa.int32()), "doc_id": range(1000 * b, 1000 * b + 500), "text": text})
        bucket = suffix._Bucket(rows)
        begin, windows, _, keys = bucket.segments(1)
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order].view(np.int64)) != 0]))
        brute = collections.defaultdict(set)
        times = collections.Counter(keys.tolist())
        for a, w, k in zip(begin.tolist(), windows.tolist(), keys.tolist()):
            brute[k].add(bucket.data[a : a + w + suffix.LENGTH - 1].tobytes())
        got = bucket.different(begin, windows, order, first)
        want = [len(brute[k]) if times[k] > suffix.FEW else times[k] for k in keys[order][first].tolist()]
        assert got.tolist() == want and max(want) > 150
        parts.append(suffix._anchors(1)((pa.scalar(b),), rows))
    answers = suffix._answers(512, 300)((pa.scalar(0),), pa.concat_tables(parts))
    hot = {}
    for hashes, flags in zip(answers.column("hashes").to_pylist(), answers.column("hot").to_pylist()):
        known = np.frombuffer(hashes, "<u4")
        hot |= dict(zip(known.tolist(), np.unpackbits(np.frombuffer(flags, np.uint8), count=len(known)).tolist()))
    assert 0 < sum(hot.values()) < len(hot)
    assert suffix._saturated(np.array([3, 300, 70_000])).tolist() == [[3, 44, 255], [0, 1, 255]]


def sent_by(texts, shards=1):
    """What one bucket of these documents sends, whose ids are their places."""
    key, rows = (pa.scalar(0),), pa.table({"bucket": pa.array([0] * len(texts), pa.int32()), "doc_id": range(len(texts)), "text": texts})
    answers = suffix._answers(512, suffix.HOT_SEGMENTS)((pa.scalar(0),), suffix._anchors(1)(key, rows))
    return suffix._compressed(suffix._send(1, shards))(key, rows, answers)


def test_a_shard_sorts_what_may_be_found_in_another_segment(monkeypatch):
    """Segments that alone have their anchor aren't sorted; each window's least id is that of the definition all the same."""
    rng = random.Random(4)
    sorted_bytes = []
    whole = suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s, need=None: sorted_bytes.append(len(s)) or whole(s, need))
    copies = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(5)]
    parts = [c[at : at + 400] for c in copies for at in (0, 300, 777, 1234)]
    for texts, share in ((copies * 2, 0), (["%s %d" % (rng.choice(parts), i) for i in range(60)] + copies, 0.5)):
        sent = sent_by(texts)
        sorted_bytes.clear()
        found = suffix._resolve((pa.scalar(0),), sent)
        sizes = suffix._unzipped(sent.column("sizes")[0].as_py(), "<u2").tolist()
        raw = pa.decompress(sent.column("bytes")[0].as_py(), sum(sizes), "zstd", asbytes=True)
        assert sum(sorted_bytes) <= share * len(raw) and bool(sorted_bytes) == (share > 0)
        counts, lengths, ids = (suffix._unzipped(found.column(c)[0].as_py(), k).tolist() for c, k in (("counts", "<u2"), ("lengths", "<u2"), ("docs", "<i8")))
        assert len(counts) == len(sizes) and sum(lengths) == sum(sizes) - 49 * len(sizes)
        each = np.repeat(ids, lengths).tolist()
        windows = [raw[a + i : a + i + 50] for a, n in zip(np.cumsum(sizes) - sizes, sizes) for i in range(n - 49)]
        data = [x.encode() for x in texts]
        assert each == [next(i for i, x in enumerate(data) if w in x) for w in windows]


def test_passages_in_many_buckets_travel_in_segments():
    """However many buckets have an anchor, its windows aren't dealt one by one while its segments fit a shard."""
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))

    def rows(b):
        return pa.table({"bucket": pa.array([b], pa.int32()), "doc_id": [b], "text": [text]})

    own = suffix._anchors(1)((pa.scalar(0),), rows(0))
    parts = [own.set_column(own.schema.get_field_index("bucket"), "bucket", pa.array([b], pa.int32())) for b in range(1000)]
    answers = suffix._answers(suffix.HOT_BUCKETS, suffix.HOT_SEGMENTS)((pa.scalar(0),), pa.concat_tables(parts))
    assert answers.num_rows == 1000 and not any(any(x) for x in answers.column("hot").to_pylist())
    sent = suffix._send(1, 1)((pa.scalar(5),), rows(5), answers.filter(pa.compute.equal(answers.column("bucket"), 5)))
    assert sum(map(len, sent.column("bytes").to_pylist())) < 8 * len(text)


def test_phrases_shared_by_chance_are_neither_sent_nor_sorted(monkeypatch):
    """Texts that share some common words only: strings much shorter than a window's 50 bytes."""
    rng = random.Random(8)
    sorted_bytes = []
    monkeypatch.setattr(suffix, "suffix_array", lambda s, need=None: sorted_bytes.append(len(s)))

    def around(phrase):
        return ["".join(rng.choice("abcdefgh ") for _ in range(200)) + phrase + "".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(100)]

    assert sent_by(around(" of the and in to ")).num_rows == 0
    sent = sent_by(around(" of the and in to is it on"))
    found = suffix._resolve((pa.scalar(0),), sent)
    assert sent.num_rows and found.num_rows and not sorted_bytes


def test_equal_strings_are_told_by_their_bytes(monkeypatch):
    """Strings of one hash aren't taken for equal: with a hash that is the same for all, results stay right."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") * 25 for _ in range(rng.randint(2, 5))) for _ in range(80)]
    key, rows = (pa.scalar(0),), pa.table({"bucket": pa.array([0] * 80, pa.int32()), "doc_id": range(80), "text": texts})
    answers = suffix._answers(512, suffix.HOT_SEGMENTS)(key, suffix._anchors(1)(key, rows))
    bucket, want = suffix._Bucket(rows), removed(list(enumerate(texts)))
    for factor in (suffix._FACTOR, np.uint64(0)):
        with monkeypatch.context() as m:
            m.setattr(suffix, "_FACTOR", factor)
            found = suffix._resolve(key, suffix._compressed(suffix._send(1, 1))(key, rows, answers))
            _, occurrences = bucket.shared(answers, 1, 1)
        goes = suffix._cut(bucket, found, occurrences)
        assert [int(goes[a:b].sum()) for a, b in zip(bucket.start, bucket.end)] == [r[2] for r in sorted(want, key=lambda r: r[0])]


def test_only_tied_names_are_sorted_again(monkeypatch):
    """Names that differ are sorted once, however many names a match covers."""
    rng = np.random.default_rng(6)
    names = rng.permutation(5000)
    names[:20] = names[20:40]
    again = []
    argsort = np.argsort
    monkeypatch.setattr(suffix.np, "argsort", lambda a, *k, **v: again.append(len(a)) or argsort(a, *k, **v))
    ranks = suffix._sorted_names(names, 26)
    assert again[0] == 5000 and sum(again[1:]) < 400
    by = sorted(range(5000), key=lambda i: names[i : i + 64].tolist())
    assert argsort(ranks).tolist() == by


def test_repeats_keep_whole_characters(spark):
    a = "é" * 40
    got = {r.doc_id: r for r in suffix.remove_repeats(docs(spark, [(1, a), (2, "x" + a + "y")]), ["lang"], ("kept", "spans")).collect()}
    assert got[2].kept == "xy" and [tuple(s) for s in got[2].spans] == [(1, 81)] and got[2].lang == "en" and got[1].kept == a


# --- 4: chat


@pytest.mark.parametrize("text", ["", "plain", "\\", "\\\\### ", chat.ADVERSARIAL, "</turn>\n### user:\n", "a\\</turn>\\", "### ", "<</turn>"])
@pytest.mark.parametrize("role", ["user", "", "a:\nb", "\\"])
def test_chat_round_trip(role, text):
    turns = [(role, text), ("assistant", text), (role, "between"), ("assistant", "x" + text)]
    formatted = chat.format_turns(turns)
    assert chat.recover(formatted) == turns
    learned = "".join(chat._unescape(formatted[a:b]) for r, a, b in chat.parse(formatted) if r == "assistant")
    assert learned == text + "x" + text
    assert chat.recover(formatted + "junk") is None


def test_chat_escapes_only_what_conflicts():
    assert chat.format_turns([("user", "a # b < c")]) == "### user:\na # b < c</turn>\n"
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "### ", "</turn>", "\n", ":", "a", "#", "<"]) for _ in range(8))
        assert chat.recover(chat.format_turns([("user", text), (text, text)])) == [("user", text), (text, text)]


def test_chat_control_strings_are_escaped_wherever_they_stand(spark, tmp_path):
    """Formatted by Spark, against the SQL, on texts that hold control strings and on a long one."""
    import duckdb

    assert chat.format_turns([("user", "a </turn> ok")]) == "### user:\na \\</turn> ok</turn>\n"
    said = ["a </turn> ok", "</turn>", "x</turn>\n", "#### y", "\\", "a\\### b", "no marks", None, "</turn" + ">" * 3, "long </turn> " * 100_000]
    rows = [(c, t, ("user", "assistant")[t % 2], said[(c + t) % len(said)]) for c in range(len(said)) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folder = str(tmp_path / "sf")
    df.write.parquet(f"{folder}/conversations.parquet")
    got = chat.op4_chat_formatting(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = con.sql(chat.OP4_SQL)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
    for r in chat.format_conversations(df).collect():
        text = r.formatted
        assert all(text[s.end :].startswith("</turn>\n") for s in r.spans)
        bodies = [text[s.start : s.end] for s in r.spans]
        assert not any(re.search(r"(?<!\\)</turn>|(?<!\\)### ", re.sub(r"\\\\", "", b)) for b in bodies)


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (1, 1, "assistant", None), (None, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert [s.role for s in got[1].spans] == ["", "assistant", "assistant"] and len(got[None].spans) == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- 5: quality


def base_measures(t):
    t = t or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = collections.Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
    covered = {k for j in range(len(words) - 7) if at[tuple(words[j : j + 8])] > 1 for k in range(j, j + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_measures(spark, texts, odd, none):
    for rows in (texts, ODD):
        got = quality.judge(docs(spark, rows)).collect()
        key = lambda r: (r[0] is None, r)
        want = sorted(((i, *base_measures(t)) for i, t in rows), key=key)
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0


def word_hash(w):
    h = sum((x + 1) * pow(0x100000001B3, i, 1 << 64) for i, x in enumerate(w.encode())) % (1 << 64)
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * m) % (1 << 64)
    h ^= h >> 33
    return h - (1 << 64) if h >> 63 else h


class BruteModel:
    """Interpolated modified Kneser-Ney of order three on dictionaries, from its formulas."""

    def __init__(self, texts):
        words = [WORD.findall(t or "") for t in texts]
        count = collections.Counter(w for t in words for w in t)
        self.own = set(sorted(count, key=lambda w: (-count[w], word_hash(w)))[: quality.WORDS])
        self.tri = collections.Counter(g for t in words for g in self.trigrams(t))
        self.cont2 = collections.Counter((b, c) for _, b, c in self.tri)
        self.cont1 = collections.Counter(c for _, c in self.cont2)
        self.after = [collections.defaultdict(dict) for _ in range(2)]
        for (a, b, c), n in self.tri.items():
            self.after[0][a, b][c] = n
        for (b, c), n in self.cont2.items():
            self.after[1][b][c] = n
        self.d = [self.discounts(x.values()) for x in (self.tri, self.cont2, self.cont1)]

    def symbol(self, w):
        if w in self.own:
            return w
        b = w.encode()
        upper = sum(65 <= x <= 90 for x in b)
        capitals = 0 if not upper else 1 if upper == 1 and 65 <= b[0] <= 90 else 2
        signs = [x for x in b if 33 <= x < 127 and not chr(x).isalnum() and chr(x) not in ".,;:!?'-"]
        kind = 3 if signs else 2 if any(48 <= x <= 57 for x in b) else 1 if b[-1:] in (b".", b",", b";", b":", b"!", b"?") else 0
        return capitals, kind, sum(len(b) > x for x in (3, 6, 10))

    def trigrams(self, words):
        s = ["<", "<", *map(self.symbol, words)]
        return list(zip(s, s[1:], s[2:]))

    @staticmethod
    def discounts(counts):
        n = [0] + [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k, 0.1), k) for k in (1, 2, 3)]

    def above(self, n):
        return n - self.d[0][min(n, 3)]

    def probability(self, a, b, c, own=None):
        """own: counts of the text at hand, which are taken out of the highest order."""
        d3, d2, d1 = self.d
        own = own or {}
        total = sum(self.cont1.values())
        p = (self.cont1[c] - d1[min(self.cont1[c], 3)]) / total + sum(d1[min(n, 3)] for n in self.cont1.values()) / total / quality.SYMBOLS
        pairs = self.after[1].get(b, {})
        if pairs:
            n = pairs.get(c, 0)
            p = (n - d2[min(n, 3)] + sum(d2[min(x, 3)] for x in pairs.values()) * p) / sum(pairs.values())
        table = {x: n - own.get((a, b, x), 0) for x, n in self.after[0].get((a, b), {}).items()}
        total = sum(table.values())
        if total:
            kept = {x: self.above(n) for x, n in table.items()}
            p = kept.get(c, 0) / total + (total - sum(kept.values())) / total * p
        return p

    def log_of(self, words, own=True):
        grams = self.trigrams(words)
        count = collections.Counter(grams) if own else None
        return sum(np.log(self.probability(*g, count)) for g in grams)


def test_kneser_ney_by_hand(spark, texts, monkeypatch):
    """The model's log probabilities against the formulas, and their sum."""
    rows = [t for _, t in texts[:60]]
    brute = BruteModel(rows)
    model = quality.train(docs(spark, list(enumerate(rows))).repartition(3))
    assert len(model.tri) == len(brute.tri) and model.n.sum() == sum(brute.tri.values())
    assert (np.diff(model.tri.astype(np.int64)) > 0).all()
    for t in [*rows[:20], "never seen words +++ here 12", "The the THE"]:
        chunk = quality.Chunk([0], [t.encode()])
        symbol, text, _ = quality._symbols(chunk, model.words)
        for own in (True, False) if t in rows else (True,):  # a text that was not counted has nothing to take out
            got = model.log(quality._trigrams(symbol, text), text, own)[1].sum()
            assert np.isclose(got, brute.log_of(WORD.findall(t), not own), rtol=1e-9)
    for middle, first in ((3, 7), (quality.BEGIN, quality.BEGIN), (quality.WORDS + 1, 0), (250, 251)):
        every = (middle << 2 * quality.BITS | first << quality.BITS | np.arange(quality.SYMBOLS)).astype(np.uint32)
        assert np.isclose(np.exp(model.log(every, np.zeros(len(every), np.int64), True)[1]).sum(), 1)
    # sums by levels, and what a task sends in parts, give the same counts
    monkeypatch.setattr(quality, "FAN_IN", 2)
    again = quality.train(docs(spark, list(enumerate(rows))).repartition(7))
    assert all(np.array_equal(getattr(again, x), getattr(model, x)) for x in ("tri", "n", "words", "totals", "above", "p2"))
    # texts of one chunk don't touch each other
    own = [t.encode() for t in rows[:9]]
    symbol, text, _ = quality._symbols(quality.Chunk(list(range(9)), own), model.words)
    of, logs = model.log(quality._trigrams(symbol, text), text)
    assert np.allclose(np.bincount(of, logs), [brute.log_of(WORD.findall(t)) for t in rows[:9]])


def test_counts_of_any_size_and_every_trigram():
    """Counts beyond four bytes come back whole; the largest model has its bound; each trigram has its own hash."""
    n, rows = quality.SYMBOLS, {}
    for middle, (pairs, counts) in {4: ([9, 70], [3, 1 << 40]), 5: ([0], [(1 << 32) - 1])}.items():
        table = np.zeros(n * n, np.int64)
        table[pairs] = counts
        table = table.reshape(n, n)
        seen = {f"seen_{k}": (table == k if k < 3 else table > 2).sum(axis=1) for k in (1, 2, 3)}
        rows[middle] = {"totals": table.sum(axis=1), "continued": (table > 0).sum(axis=0), "counts_of": np.zeros(4, int), **seen}
        rows[middle] |= {"pairs": np.array(pairs, np.uint16), "counts": np.array(counts)}
    model = quality.Model(np.empty(0, np.uint64), rows)
    codes = np.array([4 << 16 | 9, 4 << 16 | 70, 4 << 16 | 71, 5 << 16, 6 << 16])
    assert model.counts(codes).tolist() == [3, 1 << 40, 0, (1 << 32) - 1, 0]
    assert len(np.unique(quality._hashed(np.arange(n**3, dtype=np.uint32)))) == n**3
    assert n**3 * (model.tri.itemsize + model.n.itemsize) <= 140_000_000


def test_quality_verdicts_by_brute_force(spark, sf):
    """``kept`` and the perplexity of every document of the smallest tables."""
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, sf, "documents").collect()]
    brute = BruteModel([t for _, t, _ in rows])
    logs, bins, seen = {}, collections.defaultdict(list), set()
    for i, t, lang in rows:
        grams = brute.trigrams(WORD.findall(t or ""))
        if grams:
            logs[i] = -brute.log_of(WORD.findall(t)) / len(grams)
            if (lang, tuple(WORD.findall(t))) not in seen:
                seen.add((lang, tuple(WORD.findall(t))))
                bins[lang].append(int(np.floor(logs[i] / quality.BIN)))
    middle = lambda v: sorted(v)[(len(v) - 1) // 2]
    band = {}
    for lang, v in bins.items():
        m = middle(v)
        away = max(middle([abs(x - m) for x in v]) * quality.BIN, quality.LEAST_DEVIATION)
        band[lang] = (m + 0.5) * quality.BIN - quality.BAND_LOW * away, (m + 0.5) * quality.BIN + quality.BAND_HIGH * away
    got = {r.doc_id: r for r in quality.op5_quality_rules(spark, sf).collect()}
    assert len(got) == len(rows) >= 200
    kept = 0
    for i, t, lang in rows:
        r, n = got[i], len(WORD.findall(t or ""))
        if i in logs:
            assert np.isclose(np.log(r.perplexity), logs[i], atol=1e-4)
            slack = quality.ALLOWANCE / np.sqrt(n)
            margins = logs[i] - band[lang][0] + slack, band[lang][1] + slack - logs[i]
            if min(map(abs, margins)) > 0.01:  # farther from the bounds than rounding and a bin's edge can tell
                assert r.kept == (not r.base_failed and min(margins) >= 0), i
        else:
            assert not r.kept
        kept += r.kept
    assert 0 < kept < len(rows)


def test_quality_bands_reject_both_sides(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(300)]
    # words of all shapes in no order
    kinds = [c + "{}" + k for c in ("", "Q", "QZ") for k in ("", ".", "7", "+")]
    rows += [(1000, " ".join(rng.choice(kinds).format("x" * rng.choice([1, 4, 7, 14])) for _ in range(600)))]
    # cells of tables, of which there are some: every other word can be foretold
    rows += [(1001 + i, " ".join(f"{rng.choice(words)} |" for _ in range(300))) for i in range(8)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    middle = np.median([got[i].perplexity for i in range(300)])
    assert not got[1000].kept and got[1000].perplexity > middle and not got[1000].base_failed
    for i in range(1001, 1009):
        assert not got[i].kept and got[i].perplexity < middle and not got[i].base_failed
    assert sum(got[i].kept for i in range(300)) >= 297


def test_quality_bands_count_copies_once(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(200)]
    copy = " ".join(rng.choice(["".join(rng.choice("bdglmp") for _ in range(5)), "the", "of"]) for _ in range(150))
    # a text that isn't like the others, as more than half of the rows; some of its copies differ in white space
    rows += [(1000 + i, copy if i % 2 else copy.replace(" ", "\n")) for i in range(600)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].kept for i in range(200)) >= 195
    assert len({got[1000 + i].kept for i in range(600)}) == 1


# --- 6: simhash


def fingerprint(t):
    words = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_simhash(spark, texts, none):
    rows = [*texts, *((i, t) for i, t in ODD if i is not None and i < 4), (5000, texts[3][1].upper()), (5001, texts[3][1] + " tail")]
    rows = list({i: (i, t) for i, t in rows}.values())
    prints = {i: fingerprint(t) for i, t in rows}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, [*rows, rows[0]])).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == groups(prints)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_key_families_and_large_keys(spark, monkeypatch):
    from itertools import combinations

    assert all(any(set(k) <= set(five) for k in simhash.KEYS) for five in combinations(range(8), 5))
    rng = random.Random(1)
    made = set()
    while len(made) < 700:
        x = 0x123456789ABCDEF0
        for b in rng.sample(range(32), rng.choice([1, 2, 3, 5, 9])):
            x ^= 1 << b
        made.add(x)
    prints = np.array(sorted(made), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    want = groups({i: int(p) for i, p in enumerate(prints)})
    assert 1 < len(set(want.values())) < 600
    number = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    # keys as they are; those of over 64 entries by five bytes; and of those, the large ones by flips
    for block in (2048, 64, 3):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = [(number[r.a], number[r.b]) for r in simhash.links(df).collect()]
        assert all(1 <= (int(prints[a]) ^ int(prints[b])).bit_count() <= 3 for a, b in found)
        own = {i: i for i in range(len(prints))}
        for _ in range(20):
            for a, b in found:
                own[a] = own[b] = min(own[a], own[b])
        assert own == want
    five = (0, 1, 2, 3, 4)
    some = np.unique(np.uint64(0x1234567890000000) | np.array([rng.getrandbits(24) & rng.getrandbits(24) & rng.getrandbits(24) for _ in range(500)], np.uint64))
    forests = []
    for block in (2048, 3):
        monkeypatch.setattr(simhash, "BLOCK", block)
        pairs = simhash._links(some, five)
        own = list(range(len(some)))
        for _ in range(20):
            for a, b in pairs:
                own[a] = own[b] = min(own[a], own[b])
        forests.append((len(pairs), own))
    assert forests[0] == forests[1] and 0 < forests[0][0] < len(some)


def test_simhash_groups_by_row(spark):
    rows = [(5, "a b c d e"), (5, "u v w x y z"), (None, "a b c d e"), (3, "a b c d e"), (None, "p q r s t"), (None, None)]
    got = simhash.near_duplicates(docs(spark, rows), digest=F.md5("text")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.digest): r for r in got}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert by[5, md5("a b c d e")].component_id == by[None, md5("a b c d e")].component_id == 3
    assert by[5, md5("u v w x y z")].component_id == 5 and by[None, md5("p q r s t")].component_id is None
    assert len({r.component for r in got}) == 4


# --- 7: decontamination


def test_masks_find_every_substitution():
    from itertools import combinations

    for width, bad in (*((n, n // 5) for n in range(1, 13)), (13, 2), (15, 3), (20, 4)):
        masks = [m for m in (*decontam.MASKS, *decontam.SHORT_MASKS, (0,), (0, 1), (0, 1, 2)) if decontam._read_by(m, np.array([width]))[0]]
        for gone in combinations(range(width), bad):
            assert any(all(o + p not in gone for p in m) for m in masks for o in range(width - m[-1])), (width, gone)


def leaked(documents, items):
    split = lambda t: [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in WORD.findall((t or "").lower())) if w]
    found = set()
    for d, t in documents:
        w = split(t)
        for i, s in items:
            v = split(s)
            if not v:
                continue
            for shift in range(-len(v) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                same = [w[q + shift] == v[q] for q in range(lo, hi)]
                sums = np.concatenate([[0], np.cumsum([20 if x else -80 for x in same])])
                least = min(13, len(v))
                if any(sums[b] - sums[: b - least + 1].min() >= 0 for b in range(least, len(sums))):
                    found.add((d, i))
                    break
    return found


def test_leaks(spark, none, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([30, 20, 15, 13, 12, 10, 8, 6, 5, 4])]
    items += [(10, "the capital is Paris"), (11, "unique"), (12, "two words"), (None, "a b c d e f g"), (19, None), (20, "")]
    rows = []
    for d in range(130):
        i, s = items[d % 13]
        v = s.split()
        for _ in range(d // 13 % 5):
            v[rng.randrange(len(v))] = "other"
        noise = [rng.choice(vocabulary) for _ in range(40)]
        at = rng.randrange(40)
        rows.append((d, " ".join([*noise[:at], *v, *noise[at:]]).replace("w1 ", "W1, ")))
    rows += [(70, None), (71, ""), (72, items[0][1]), (72, items[1][1]), (73, "here a b c d e f g is")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(0))
    want = leaked(rows, items)
    assert {i for _, i in want} >= set(range(13)) and (73, None) in want
    for size in (decontam.BLOCK_BYTES, 100):
        got = decontam.leaks(docs(spark, rows), bench, size).collect()
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})
        assert {(r.doc_id, r.item_id) for r in got} == want
    monkeypatch.setattr(decontam, "_AT_ONCE", 7)
    table_of = pa.table({"item_id": pa.array([i for i, t in items if t]), "text": [t for _, t in items if t]})
    ix = decontam.index(table_of)
    chunk = decontam.Chunk(list(range(len(rows))), [(t or "").lower().encode() for _, t in rows])
    doc, item, _ = decontam._search(ix, chunk)
    assert {(rows[d][0], ix.ids[i].as_py()) for d, i in zip(doc, item)} == want
    # of items without an id, each text counts once
    unnamed = spark.createDataFrame([(None, "v w x y z"), (None, "v w x y z"), (None, "one two three four")], "item_id long, text string")
    twice = decontam.leaks(docs(spark, [(1, "v w x y z one two three four"), (2, "v w x y z")]), unnamed).collect()
    assert sorted((r.doc_id, r.item_id, r.item_words) for r in twice if r.item_id is None) == [(1, None, 4), (1, None, 5), (2, None, 5)]
    digests = {(i, hashlib.md5(t.encode()).hexdigest()): t for i, t in rows if t}
    one = [((i, h), t) for (i, h), t in digests.items()]
    keyed = decontam.leaks(docs(spark, rows), bench, key=F.md5("text"))
    assert {(r.doc_id, r.item_id) for r in keyed.collect()} == {(d[1], i) for d, i in leaked(one, items)}
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs(spark, rows), bench.limit(0)).count() == 0


# --- 8: packing


def test_packing(spark, texts, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(pack.TOKENIZER))
    for rows in (texts[:60], ODD):
        got = collections.defaultdict(list)
        places = collections.defaultdict(list)
        out = pack.pack_documents(docs(spark, rows)).collect()
        for r in out:
            got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
            places[r.sequence_id].append((r.offset, r.length))
        want = collections.defaultdict(list)
        for i, t in rows:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            for k, a in enumerate(range(0, len(ids), 2048)):
                part = ids[a : a + 2048]
                want[i].append((k, a, len(part), zlib.crc32(part.tobytes())))
        assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
        for held in places.values():
            end = 0
            for offset, length in sorted(held):
                assert offset == end
                end += length
            assert end <= 2048
        total = sum(r.length for r in out)
        assert len(places) <= -(-total // 2048) + 1
    assert pack.pack_documents(none).count() == 0


def test_words_are_cut_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(pack.TOKENIZER)
    ids, tokenizer = pack._Ids(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    letters = "aA'stTrelLvVdDmM09.,!<|>éÈßÿŁİıǅŉ×÷ΣσёЖ漢\u0301\u2003  -_%$#ẞſK~"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    for w in [*words, "<|endoftext|>", "a<|startoftext|>b", "don't", "I'LL"]:
        want = np.asarray(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(ids[x] for x in w.encode().split()) == want, w


def test_plan_uses_every_piece_and_fills_gaps():
    rng = np.random.default_rng(3)
    for counts in ({2048: 5}, {1: 4096}, {1000: 3, 1048: 2, 500: 7, 24: 1}, dict(zip(range(1, 700), rng.integers(0, 50, 699).tolist()))):
        patterns = pack.plan(counts)
        used = collections.Counter()
        for times, lengths in patterns:
            assert times > 0 and sum(lengths) <= 2048
            for x in lengths:
                used[x] += times
        assert used == collections.Counter({k: v for k, v in counts.items() if v})
    assert sum(t for t, _ in patterns) == -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(t for t, _ in pack.plan({1000: 2, 1048: 2})) == 2 and sum(t for t, _ in pack.plan({1000: 1, 700: 1, 348: 1, 900: 1})) == 2


# --- 9: sharding


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 97, 1000, 4096):
        assert sorted(shard.permute(i, n) for i in range(n)) == list(range(n))


def test_sharding(spark, texts, odd, none):
    for rows in (texts, ODD):
        got = shard.shard(docs(spark, rows)).collect()
        n = len(rows)
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
        want = []
        for k, (i, t) in enumerate(order):
            b = (t or "").encode()
            p = shard.permute(k, n)
            want.append((i, len(b) + 8, zlib.crc32(b), k, p % 24, p // 24))
        assert sorted([(r.doc_id, r["size"], r.text_crc32, r.row_number, r.shard, r.slot) for r in got], key=str) == sorted(want, key=str)
        counts = collections.Counter(r.shard for r in got)
        assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1
        for s in counts:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert shard.shard(none).count() == 0


# --- 10: classifier


def test_equal_rows_are_dealt_to_several_ranges(spark, monkeypatch):
    """A third of all rows equal, another third with null ids and one text."""
    rows = [(7, "same")] * 1000 + [(None, "same")] * 1000 + [(i, f"text {i}") for i in range(1000)]
    made, sizes = shard.scratch, []

    def noted(df, name):
        found = made(df, name)
        sizes.extend(r["n"] for r in found.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
        return found

    monkeypatch.setattr(shard, "scratch", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = shard.shard(docs(spark, rows).repartition(6), 5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.row_number for r in got) == list(range(3000))
    assert max(sizes) < 1500 and len(sizes) == 4
    assert all(r.doc_id is None for r in got if r.row_number < 1000)


def test_classifier_held_out(spark):
    """On the next larger tables, as the smallest have but 87 labels."""
    sf = "/root/testdata/sf0.1"
    got = classifier.op10_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(out) > 300
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.98
    bins = np.mean([(r.score - r.quality) ** 2 for r in out])
    assert bins < 0.02  # calibrated: a low Brier score


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    model = classifier.train(odd, labels)
    assert classifier.score(odd.drop("score"), model).filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert classifier.score(odd.drop("score"), model).count() == len(ODD)
    empty = classifier.train(none, labels.limit(0))
    assert classifier.score(none.drop("score"), empty).count() == 0
    assert classifier.score(odd, empty, "other").select("other").distinct().count() == 1


def test_scores_do_not_depend_on_what_shares_a_chunk(spark, texts):
    own = [(t or "").encode() for _, t in texts[:80]] + [b"", b"a a a a b b", b"word " * 50_000]
    vectors = np.rint(np.random.default_rng(1).normal(0, 0.2, (classifier.SLOTS, 2 * classifier.DIMENSIONS)) * classifier.UNIT).astype(np.int32)
    together = classifier.pooled(classifier.Chunk(list(range(len(own))), own), vectors)
    assert together.shape == (len(own), classifier.FEATURES)
    for k, t in enumerate(own):
        assert np.array_equal(classifier.pooled(classifier.Chunk([0], [t]), vectors)[0], together[k])
    slot, _ = classifier._tokens(classifier.Chunk([0], [own[5]]))
    by_hand = vectors[slot].astype(np.int64).sum(axis=0) / (classifier.UNIT * len(slot))
    assert np.allclose(together[5, : 2 * classifier.DIMENSIONS], by_hand)
    dense = np.zeros((classifier.SLOTS, classifier.DIMENSIONS))
    for i in range(classifier.NONZERO):
        dense[np.arange(classifier.SLOTS), classifier._PLACE[:, i]] = classifier._SIGN[:, i] / np.sqrt(classifier.NONZERO)
    near = [np.mean(np.sum(dense[slot[:-r]] * dense[slot[r:]], axis=1)) for r in (1, 2)]
    assert np.allclose(together[5, -3:-1], near)
    df = docs(spark, texts[:60]).drop("score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = classifier.train(df, labels)
    scores = [{r.doc_id: r.score for r in classifier.score(d, model).collect()} for d in (df.coalesce(1), df.repartition(13))]
    assert scores[0] == scores[1]
    again = classifier.train(df.repartition(7).unionByName(df.filter("doc_id < 9")), labels)
    assert np.array_equal(again.vectors.shape, model.vectors.shape)


def test_texts_longer_than_a_chunk(spark):
    """One text of three chunks' bytes beside others, through each operator that works by chunks."""
    from plenaria.llm import textarrays

    rng = random.Random(11)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(3 * textarrays.CHUNK_BYTES // 5))
    assert len(long) > 2 * textarrays.CHUNK_BYTES
    leak = " ".join(f"leak{k}" for k in range(20))
    rows = [(1, "some few words here"), (2, f"{long} {leak}"), (3, " ".join(rng.choice(words) for _ in range(90))), (4, leak)]
    df = docs(spark, rows).drop("score").coalesce(1)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_measures(t)
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(df).collect()} == {i: f"{fingerprint(t):016x}" for i, t in rows}
    bench = spark.createDataFrame([(7, leak)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == {(2, 7), (4, 7)}
    model = classifier.train(df, spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int"))
    assert classifier.score(df, model).filter("score BETWEEN 0 AND 1").count() == 4


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(float)
    net = classifier.fit(x, y)
    p = net.probability(x)
    for lo, hi in ((0.1, 0.3), (0.7, 0.9)):
        rows = (p > lo) & (p < hi)
        assert abs(p[rows].mean() - y[rows].mean()) < 0.08
