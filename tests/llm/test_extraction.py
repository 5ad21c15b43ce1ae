import random

import pytest

from tokenmill.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head>
<body><header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- note --><div class="ad big">Buy now</div><article><h1>Big &amp; small</h1><p>First   line<br>second
line <b>bold</b>x</p><aside>aside</aside><p>Caf&eacute;&nbsp;&lt;tag&gt;</p><div class="comments"><div>c1</div><p>c2</p></div><p>End</p></article>
<form><p>Name</p><input></form><div id="cookie-notice">We use</div><footer>f</footer></body></html>"""
TEXT = "Big & small\nFirst line\nsecond line boldx\nCafé <tag>\nEnd"


@pytest.fixture(scope="module")
def weights():
    return extraction.weights_of(extraction.label_counts(PAGE))


def test_page(weights):
    assert extraction.main_text(PAGE, weights) == TEXT


@pytest.mark.parametrize("cut", ["</article>", "</body>", "</p></article>"])
def test_page_that_ends_early(weights, cut):
    end = PAGE.index("<p>End")
    assert extraction.main_text(PAGE[:end] + "<p>End", weights) == TEXT
    assert extraction.main_text(PAGE[: PAGE.index(cut)], weights).startswith("Big & small\nFirst line")


def test_page_without_marks():
    page = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert extraction.main_text(page, {}) == TEXT


@pytest.mark.parametrize("page", ["", " ", "<p>", "<script>only", "<nav><a>x</a></nav>", "<!-- x", "<", "<a href='x"])
def test_pages_without_text(weights, page):
    assert extraction.main_text(page, weights).strip("<") == ""


@pytest.mark.parametrize(
    "body, want",
    [
        ('<h1>T</h1><p class="notice">Note.<p>One.</p><p>Two.</p>', "T\nOne.\nTwo."),
        ('<h1>T</h1><p class="notice">Note <b>x<p>One.<p>Two.', "T\nOne.\nTwo."),
        ('<p class="notice">Note.<h2>One.</h2><p>Two.', "One.\nTwo."),
        ('<ul><li class="ad">Buy<ul><li>more</ul><li>One.<li>Two.</ul><p>Three.', "One.\nTwo.\nThree."),
        ('<ul><li>One.<li class="ad">Buy</ul><p>Two.</p>', "One.\nTwo."),
        ('<table><tr><td class="ad">Buy<td>One.<tr><td>Two.</table><p>Three.', "One.\nTwo.\nThree."),
        ('<dl><dt>One.<dd><div class="ad">Buy</dl><p>Two.</p>', "One.\nTwo."),
        ('<div>One.<div class="ad">Buy <p>now</div></div><p>Two.</p>', "One.\nTwo."),
        ('<section>One.<div class="ad"><div>Buy</div></section><p>Two.</p>', "One.\nTwo."),
        ('<p>One.<div class="ad"><table><tr><td>a</article>b</table></div><p>Two.</p>', "One.\nTwo."),
    ],
)
def test_left_out_elements_without_end_tag(body, want):
    assert extraction.main_text(f"<body><article>{body}</article></body>", {}) == want


def test_best_run_against_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        start, stop = extraction.best_run(scores)
        assert sum(scores[start:stop]) == max([0, *sums.values()])


def test_weights_keep_their_signs(weights):
    assert weights[""] > 0
    assert all(w < 0 for kind, w in weights.items() if kind not in ("", "#"))


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p>" + "w " * 50_000, "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = extraction.extract(df).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == sorted(
        [("1", TEXT), ("1", TEXT), ("2", ""), ("None", ""), ("3", ("w " * 50_000).strip())]
    )
    assert extraction.extract(df.limit(0)).collect() == []


def test_query_against_the_marked_article(spark):
    """On pages that mark their article, against a cut by patterns."""
    import html
    import re

    from tokenmill.llm import queries

    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op7_main_text"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", body)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])
