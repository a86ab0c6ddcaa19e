import html
import re
import time

import pytest

from spoken.llm.html import extract_main_text, main_text, parse, weigh

SCHEMA = "page_id long, url string, html string"
SF = "/root/testdata/sf0.01"


def alone(page, **options):
    """The text of a page whose site is not counted."""
    nodes = parse(page, **options)
    weigh(nodes, **options)
    return main_text(nodes, counted=False)


def texts(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, SCHEMA), **options).collect()}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class=post><p>A long story of some words.</p></div><article class="comment-body">Nice post!</article>', "A long story of some words."),
        ("<article><p>Some text <span class=social>of</span> ours</p><div class=menu>Soup</div><math><mi>x</mi></math><article class=comment>Bad</article></article>", "Some text of ours\nSoup\nx"),
        ("<article>a<script>var t='</p>';if(a<b){x=\"</script><p>b</p>", "a\nb"),
        ("<p>one<p>two &#8217;&eacute;&amp;lt;<ul><li>x<li>y</ul>", "one\ntwo ’é&lt;\nx\ny"),
        ("<datalist><option value=a><option value=b></datalist><article>kept</article>", "kept"),
        ("<head><title>T</title><body><p>kept", "kept"),
        ("<form><div><p>All of the page stands in a form.</p></div></form>", "All of the page stands in a form."),
        ("<blockquote><p>So it goes.</p><footer>Someone</footer></blockquote><footer>Imprint</footer>", "So it goes.\nSomeone"),
        ("<div><h2>Title</h2><p>The text of the page has a few words.</p></div><div id=cookie-notice>We use cookies</div><p hidden>x</p>", "Title\nThe text of the page has a few words."),
        ("&am<b>p;</b>  a\n b", "&amp; a b"),
        ("<b>x</p><", "x<"),
        ("", ""),
    ],
)
def test_single_pages(page, text):
    assert alone(page) == text


def test_parse_is_linear_in_depth():
    began = time.time()
    assert alone("<div>" * 60_000 + "deep" + "</p>" * 10 + "<li>" * 60_000) == "deep"
    assert time.time() - began < 20


def _site(i, extra="", url="https://h.example/x"):
    links = "".join(f"<li><a href=/{i * k}>to {i * k}</a></li>" for k in range(1, 4 + i % 3))
    return (i, url, f"<body><div><ul>{links}</ul></div><div>News of day {i}</div>{extra}<div><h2>Head {i}</h2><p>Body {i} goes on for a while, as the text of a page does.</p>{f'<p>And on, for {i} words.</p>' * (i % 4)}<p>Share this page</p></div><div>All rights of {i} reserved</div></body>")


def _own(i):
    return "\n".join([f"Head {i}", f"Body {i} goes on for a while, as the text of a page does.", *[f"And on, for {i} words."] * (i % 4)])


def test_shapes_that_recur_on_a_host_go(spark):
    """Furniture without any telling tag or class, its text never the same."""
    rows = [_site(i, "<section><p>Only here: a remark of this page.</p></section>" if i == 7 else "") for i in range(1, 25)]
    rows += [(100, "https://other.example/", "<div>News of day 1</div><div><p>A page of a site that has few pages.</p></div>"), (101, None, None), (102, None, "")]
    rows.append(rows[0])
    got = texts(spark, rows)
    assert got[101] == got[102] == ""
    for i in range(1, 25):
        assert got[i] == ("Only here: a remark of this page.\n" if i == 7 else "") + _own(i)
    assert got[100] == "News of day 1\nA page of a site that has few pages."
    assert texts(spark, rows, max_broadcast=0) == got
    plain = texts(spark, rows, templates=False, evidence=False)
    assert all(f"News of day {i}" in plain[i] and "Share this page" in plain[i] for i in range(1, 25))


def test_hosts_of_few_pages_are_one_site(spark):
    rows = [_site(i, url=f"https://h{i}.example/") for i in range(1, 12)]
    assert all(t.startswith(f"Head {i}") and "reserved" not in t for i, t in texts(spark, rows).items())


def test_given_pages(spark):
    """The articles of the given pages, by counts with and without evidence; without templates something else."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")

    def article(page):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|<br>|</?h1>", inner))
        return "\n".join(x for x in lines if x)

    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    get = lambda **options: {r["page_id"]: r["text"] for r in extract_main_text(pages, **options).collect()}
    assert get() == want
    counted = get(evidence=False)
    assert sum(counted[k] == want[k] for k in want) >= 0.97 * len(want)
    assert not any(t == want[k] for k, t in get(templates=False).items())


def test_edges(spark):
    wide = spark.createDataFrame([(1, "u", "<p>a", "x", 3), (1, "u", "<p>a", "x", 3), (None, None, "<p>" + "word " * 200_000, None, None), (2, "u", None, None, None)], SCHEMA + ", host string, key int")
    rows = extract_main_text(wide).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows) == [(0, 999_999), (1, 1), (1, 1), (2, 0)] and rows[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert extract_main_text(wide.limit(0)).count() == 0
