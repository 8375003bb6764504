import pytest

from pagewright.llm import html_text as h

PAGE = "<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>{0}</a></ul></nav><div class='ad'>{0} ad</div><article><h1>T{0} &amp;c</h1><p><b>x{0}<br><p>y  {0}</p></article><footer>&copy; {0}</footer></body></html>"


@pytest.mark.parametrize(
    "page, want",
    [
        (PAGE.format(1), "T1 &c\nx1\ny 1"), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<nav>menu</nav><form>f</form>", ""),
        ("<body><header>H</header><div id=cookie-notice>C</div><div class=content><h2>T &lt;x&gt;</h2>one<br>two <i>three</i><ul><li>a<li>b</ul><div class='comments'><p>bad</p></div></div></body>", "T <x>\none two three\na\nb"),
        ("<main><h1>m</h1><aside>no</aside><table><tr><td>1<td>2</table></main><div>out</div>", "m\n1\n2"), ("<!-- open <p>x", ""), ("<article><p>cut &amp", "cut &"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
        ("<body><div class=page><div class=menu>m</div><div><h2>one</h2><p>first part of it</p></div><div><p>second part of it</p></div></div></body>", "one\nfirst part of it\nsecond part of it"),
        ("<body><section><p>part a of all</p></section><section><p>part b of all</p></section><div><p>other</p></div></body>", "part a of all\npart b of all\nother"),
    ],
)
def test_single_pages(page, want):
    assert h.main_text(page, None, None) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div><svg class=icon /><math/></div><article><p>text</p></article>", "text"),
        ("<body><svg><path d=1><article><p>text <svg><g>x</g><svg>y</svg></svg>on</p></article>", "text on"),
        ("<article><div><select><option>a<option>b</div><p>text</p></article>", "text"),
        ("<article><div><template><p>no</p></div><p>text</p></article>", "text"),
        ("<body><noscript><article><p>text</p></article>", "text"), ("<article><p>text</p><script>var a = '<p>';", "text"),
        ("<article><p>a <iframe>no</iframe>b</p><title>no</title></article>", "a b"),
    ],
)
def test_raw_elements_end_where_they_should(page, want):
    assert h.main_text(page, None, None) == want


@pytest.mark.parametrize("tag", ["<a name=x>", "<font>", "<div class=b>", "<span>", "<section>"])
def test_deep_pages(tag):
    page = "<body><div>" + (tag + "words ") * 5000
    reference = h.written(h.outline(h.parse(page)))
    assert h.align(h.outline(h.parse(page)), h.read(reference)) == {i: i for i in range(len(h.containers(h.parse(page))))}
    assert h.main_text(page, reference, 1).split() == ["words"] * 5000


def test_wide_and_deep_pages_finish():
    import time

    start = time.process_time()
    cells = "<table>" + "<tr><td>h<td>c<td>d<td>e" * 1250 + "</table>"
    page = f"<body><div><p>some running text</p>{cells}</div></body>"
    reference = h.written(h.outline(h.parse(page)))
    assert h.align(h.outline(h.parse(page)), h.read(reference)) == {i: i for i in range(len(h.containers(h.parse(page))))}
    assert h.main_text(page, reference, 1).startswith("some running text\nh\nc")
    deep = "<body><div>" + "<div class=b>words " * 10_000
    assert h.main_text(deep, h.written(h.outline(h.parse(deep))), 1).split() == ["words"] * 10_000
    assert time.process_time() - start < 20


def test_a_form_around_the_page():
    page = "<body><form id=aspnet><div class=menu>m</div><div><h2 id=search-methods>Methods</h2><p>" + "running text " * 30 + "</p></div></form></body>"
    assert h.main_text(page, None, None).startswith("Methods\nrunning text")


def test_edges_of_pages(spark):
    rows = [(2**60 + 1, "http://h.example/1", "<p>one</p>"), (None, None, None), (2**60 + 3, "http://h.example/3", None), (2**60 + 1, "http://h.example/1", "<p>one</p>"), (4, "", ""), (5, "http://h.example/5", "<p>" + "long text " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for c in ("host", "reference", "slot", "constant", "varying", "text", "n_chars", "node", "digest"):
        df = df.withColumn(c, df.url)
    got = h.extract_main_text(df).collect()
    assert sorted((r.page_id or 0, r.text[:8], r.n_chars) for r in got) == [(0, "", 0), (4, "", 0), (5, "long tex", 999_999), (2**60 + 1, "one", 3), (2**60 + 1, "one", 3), (2**60 + 3, "", 0)]


def test_the_wrapper_decides_without_names(spark):
    """Boxes without telling names: a long notice that repeats, one inside the article's box, a list of links, and an article in a box that is named like clutter."""
    links = " ".join(f"<a href=/{i}>link number {i} of them</a>" for i in range(30))
    notice = "The same long notice stands on every page of this host, again and again. " * 9
    body = "<body><div class=x1>" + notice + "</div><div class=x2>{links}</div><div class=menu><p>{own}</p><div class=x4>Inner notice of the host.</div><section id=related-work><p>{more}</p></section></div></body>"
    own = lambda i: f"text {i} of its own with several words in it " * (1 + i % 3)
    pages = [body.format(links=links.replace("number", f"number {i}"), own=own(i), more=own(i + 100)) for i in range(12)]
    rows = [(i, f"http://h.example/{i}", page) for i, page in enumerate(pages)]
    got = {r.page_id: r.text for r in h.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"{own(i).strip()}\n{own(i + 100).strip()}" for i in range(12)}
    assert got == want
    assert all(h.main_text(page, None, None) != want[i] for i, page in enumerate(pages))


def test_tree_matching():
    a = ["r", [["x", []], ["y", [["z", []]]], ["w", []]]]
    b = ["r", [["y", [["z", []], ["q", []]]], ["w", []]]]
    assert h.match(a, b)[0] == 4
    assert h.align(a, b) == {0: 0, 2: 1, 3: 2, 4: 4}
    assert h.align(["r", []], ["s", []]) == {}


@pytest.mark.parametrize("n", [3, 99, 100, 300, 3000])
def test_one_rule_of_matching_for_all_sizes(n):
    """A box more at the start of a page shifts all others: the n-th goes with the one before it, in small and large pages alike."""
    box = ["div", [["section", []]]]
    page = ["body", [["div", []], *[["div", [["section", []]]] for _ in range(n - 1)], ["div", [["form", []]]]]]
    reference = ["body", [*[box] * (n - 1), ["div", [["form", []]]]]]
    assert h.match(page, reference)[0] == 1 + 2 * n
    reference = h.read(h.written(reference))  # each node once
    assert h.align(page, reference) == {0: 0} | {i + 1: i for i in range(1, 2 * n + 1)}


def test_matching_equals_brute_force():
    import random

    def largest(p, q):
        if p[0] != q[0]:
            return 0
        best = [[0] * (len(q[1]) + 1)]
        for x in p[1]:
            best.append([0])
            for j, y in enumerate(q[1]):
                best[-1].append(max(best[-2][j + 1], best[-1][j], best[-2][j] + largest(x, y)))
        return 1 + best[-1][-1]

    def tree(n):
        nodes = [["r", []]] + [[rng.choice("ab"), []] for _ in range(n)]
        for i in range(1, n + 1):
            nodes[rng.randrange(max(0, i - rng.choice([2, 9, 99])), i)][1].append(nodes[i])
        return nodes[0]

    rng = random.Random(3)
    for n in [*range(40)] * 5 + [400, 600]:
        a, b = tree(n), tree(n)
        pairs = h.align(a, b)
        assert h.match(a, b)[0] == len(pairs) == largest(a, b)
        assert [pairs[i] for i in sorted(pairs)] == sorted(pairs.values())


def test_hosts_share_a_wrapper(spark):
    # no semantic elements: only the alignment tells the repeated notice from the short article
    body = "<body><div class=a><p>{1}</p></div><div class=b><p>The same long notice on every page of this host, again and again.</p></div></body>"
    rows = [(i, f"http://h.example/{i}", body.format(0, f"own text {i}" * (1 + i % 3))) for i in range(12)] + [(50, None, PAGE.format(2)), (51, "http://alone.example/", PAGE.format(3)), (52, "x", None), (None, "http://h.example/9", body.format(0, "no id"))]
    got = h.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == f"own text {i}" * (1 + i % 3) for i in range(12))
    assert by[50].text == "T2 &c\nx2\ny 2" and by[51].n_chars == len(by[51].text) and by[52].text == "" and by[None].text == "no id"
    assert h.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_all_pages_keep_their_article(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in h.extract_main_text(pages).collect()} == want


MB = 1_000_000


@pytest.mark.parametrize(
    "page",
    [
        "<p " * (MB // 3), "<p a='" * (MB // 6), "<p a='" * (MB // 6 | 1) + ">", "<a" * (MB // 2), "<!" * (MB // 2), "<form>x" * (MB // 7), "<script " * (MB // 8),
        "<svg>" * (MB // 5), "<div>" * (MB // 10) + "</x>" * (MB // 8), "<p><div>" + "<ul>" * (MB // 4), "<div>" + "<template>" * (MB // 20) + "<p>" * (MB // 6),
    ],
    ids=lambda p: p[:8] + p[-4:],
)
def test_unclosed_markup_takes_linear_time(page):
    import time

    start = time.process_time()
    h.main_text(page, None, None)
    assert time.process_time() - start < 15


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div><svg></div><math><p>text</p>", "text"), ("<p>a <b c", "a <b c"), ("<p>a</p><p b='>c", "a\n<p b='>c"), ("<p>1 <! 2", "1 <! 2"),
        ("<p>x</p><p <p <p>y</p>", "x\ny"), ("<p>a</i></ul></p><p>b", "a\nb"), ("<div><script x='</script>'>no</script>yes</div>", "yes"),
    ],
)
def test_broken_markup(page, want):
    assert h.main_text(page, None, None) == want
