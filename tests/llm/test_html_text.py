import html
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest

from plumbline.llm import html_text as H


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(H.labelled_pages(spark))


def labelled_text(page):
    return " ".join(" ".join("".join(t for t, _ in b.parts).split()) for b in H.blocks_of(page, H.Places()) if b.main)


def f1(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_layouts_that_the_fit_has_not_seen(model):
    own = H.Extractor(model)
    pages = [H._Layouts(77_000_000 + k).page() for k in range(300)]
    found = [(labelled_text(p), own.main_text(re.sub("<!--/?main-->", "", p))) for p in pages]
    assert sum(f1(a, b) for a, b in found) / len(found) > 0.99
    assert sum(a == b for a, b in found) / len(found) > 0.9


WORDS = "On the hill a wind turned for years, and nobody in the town could say when it had begun. People came to see it."
MORE = "The keeper wrote that he had counted every turn since the spring, and that the number was no longer of any use."
PAGES = {
    "article": (f"<html><body><header><a href='/'>Site</a></header><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>A hill</h1><p>{WORDS}<p>{MORE}</article><footer>&copy; 2020 Site</footer>", f"A hill {WORDS} {MORE}"),
    "advert inside": (f"<body><article><h1>A hill</h1><p>{WORDS}</p><div class='ad'>Buy now, only today!</div><p>{MORE}</p></article></body>", f"A hill {WORDS} {MORE}"),
    "sidebar inside": (f"<body><main><h1>A hill</h1><p>{WORDS}</p><aside><h3>Related</h3><ul>{'<li><a href=/x>Some other story</a></li>' * 9}</ul></aside><p>{MORE}</p></main></body>", f"A hill {WORDS} {MORE}"),
    "comments": (f"<body><div id='content'><h1>A hill</h1><p>{WORDS}</p><p>End.</p></div><section id='comments'><h2>Comments</h2><div class='comment'><b>Ann</b><p>{MORE}</p></div><div class='comment'><p>{MORE}</p></div></section></body>", f"A hill {WORDS} End."),
    "comments in the article": (f"<body><article><h1>A hill</h1><p>{WORDS}</p><div class='comments'><article class='comment'><p>{MORE}</p></article></div></article></body>", f"A hill {WORDS}"),
    "notice and form": (f"<body><div class='cookie-notice'><p>We use cookies. {MORE}</p><button>Fine</button></div><div class=content><h1>A hill</h1><p>{WORDS}</p></div><form><label>Mail</label><input><p>Write to us at any time.</p><button>Send</button></form></body>", f"A hill {WORDS}"),
    "old tables": (f"<HTML><BODY><TABLE><TR><TD><A HREF=a>Home</A><BR><A HREF=b>News</A></TD><TD><H1>A hill</H1><P>{WORDS}<P>{MORE}</TD></TR></TABLE></BODY></HTML>", f"A hill {WORDS} {MORE}"),
    "no class says what": (f"<body><div class=x1><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div><div class=x2><h1>A hill</h1><p>{WORDS}</p><p>{MORE}</p></div><footer>© Site</footer></body>", f"A hill {WORDS} {MORE}"),
    "bare": (f"<p>{WORDS}</p><p>{MORE}</p>", f"{WORDS} {MORE}"),
    "lists and quotes": (f"<article><h2>Parts</h2><ul><li>one thing</li><li>a second <a href=/s>thing</a> with a link</li></ul><blockquote><p>{MORE}</p></blockquote><table><tr><td>a</td><td>b</td></tr></table></article>", f"Parts one thing a second thing with a link {MORE} a b"),
    "inline": (f"<article><p>Wo<b>rd</b>s join, <i>{WORDS}</i> lines<br>break &amp; &lt;p&gt; stays &#233;&nbsp;x.</p></article>", f"Words join, {WORDS} lines break & <p> stays é x."),
    "raw text": (f"<article><script>var t='</p><p>no';</script><style>p{{}}</style><p>{WORDS}</p><textarea>no</textarea><!-- <p>no</p> > --><svg><text>no</text></svg></article>", WORDS),
    "quoted brackets": (f"<article><p title='1 > 2' data-x=\"a < b\">{WORDS}</p><span title=\"foo>{MORE}</span> <p class=\"x\">{MORE}</p></article>", f"{WORDS} {MORE} {MORE}"),
    "cut off": (f"<body><nav><a href=/>Home</a></nav><article><h1>A &am</h1><p>{WORDS}</p><p>And the", f"A &am {WORDS} And the"),
    "stray end tags": (f"<body></div></p><article><h1>A hill</h1></span><p>{WORDS}</b></p></div><p>{MORE}</p></article></body>", f"A hill {WORDS} {MORE}"),
    "hidden": (f"<article><p>{WORDS}</p><div style='display: none'><p>{MORE}</p></div></article>", WORDS),
}


@pytest.mark.parametrize("kind", sorted(PAGES))
def test_pages_of_many_kinds(model, kind):
    page, want = PAGES[kind]
    assert H.Extractor(model).main_text(page) == want


def test_region_is_the_best_run():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        begin, end = H.region(scores)
        runs = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        assert sum(scores[begin:end]) == max([0, *runs])


def test_tags_weigh_and_words_score(model):
    assert all(v > 0 for v in model.tags.values())
    assert model.tags["a"] > model.tags["p"]
    # a short teaser far from the article, behind many tags, is not part of it
    page = f"<body><div><p>A short word.</p></div>{'<nav><a href=/>x</a></nav>' * 5}<article><p>{WORDS}</p></article></body>"
    assert H.Extractor(model).main_text(page) == WORDS


def test_own_labelled_pages(spark):
    """Weights follow the labels: here only what stands in <code-x class=yes> is main text."""
    pages = [(f"<div class=no><p>{WORDS}</p></div><!--main--><div class=yes><p>{MORE}</p></div><!--/main-->",)] * 20 + [(None,)]
    own = H.Extractor(H.fit(spark.createDataFrame(pages, "html string")))
    assert own.main_text(f"<div class=no><p>{MORE}</p></div><div class=yes><p>{WORDS}</p></div>") == WORDS
    with pytest.raises(ValueError, match="labelled"):
        H.fit(spark.createDataFrame([(None,)], "html string"))


@pytest.mark.parametrize("page", ["<" * 300_000, "<a \"" * 60_000, "<div>" * 60_000, "<!--" * 60_000, "</p>" * 60_000, "<script>" * 60_000, "<p>" * 60_000, "<a href='x" * 40_000, "&" * 200_000, "<b><p>x" * 30_000, "<x y=\"" + "a=b " * 100_000, "<ul><li>" * 20_000, "<table><tr><td>" * 20_000, "<svg>" * 60_000])
def test_hostile_pages_take_linear_time(model, page):
    began = time.time()
    H.Extractor(model).main_text(page)
    assert time.time() - began < 10


def test_odd_rows(spark, model):
    long = "<article>" + f"<p>{WORDS}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", PAGES["article"][0]), (4, "w", "   "), (5, "x", "<div></div>"), (6, "y", long), (6, "y", long), (7, "z", "<script>only</script>")]
    df = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = sorted(map(tuple, H.extract(df, model).collect()), key=str)
    texts = {1: "", 2: "", None: PAGES["article"][1], 4: "", 5: "", 6: " ".join([WORDS] * 20_000), 7: ""}
    assert got == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=str)
    assert H.extract(df.limit(0), model).collect() == []


def test_all_pages_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op13_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == " ".join(x for x in blocks if x)
        assert r.n_chars == len(r.text)


def test_counts_of_labelled_pages_are_summed():
    batch = pa.RecordBatch.from_arrays([pa.array(["<!--main--><p>a b</p><!--/main--><div>c</div>"])], ["html"])
    rows = H._counted(batch).to_pylist()
    assert sum(r["n"] for r in rows if r["main"] and not r["features"].startswith("\x1e")) == 2
    assert {r["features"][1:] for r in rows if r["features"].startswith("\x1e")} == {"p", "div"}


def test_query_is_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(tuple, H.op13_main_text(spark, sf).collect())) == sorted(con.execute(H.OP13_SQL).fetchall())
