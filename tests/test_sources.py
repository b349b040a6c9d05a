import pytest
from pyspark.sql import functions as F

from vocatio.sources import html
from vocatio.sources.store import Store

CARD = '<li class="x"><h3> A <b>dev</b> </h3><h4>Acme</h4>{loc}<a class="base-card__full-link z" href="https://x.y/view/dev-3-at-9{i}?position=1&amp;pageNum=0&amp;t=q">l</a>'
PLACE = '<span class="job-search-card__location">Here</span>'
SEARCH = "<ul>" + CARD.format(loc=PLACE, i=1) + CARD.format(loc="", i=2) + "<li><h3>no company</h3></li><li><h3>t</h3><h4>c</h4></li></ul>"
POST = """<html><h2>first</h2><h1 class="topcard__title">second</h1><a class="topcard__org-name-link"> Acme&nbsp;\t Inc </a>
<ul><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Industries</h3><span class="description__job-criteria-text--criteria">IT</span>
<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">No value</h3></ul>
<div class="show-more-less-html__markup"><p>One<br>two <a href=x>link</a><script>bad()</script><button>b</button><ul><li>three</ul></div>"""


def test_cards(spark):
    pages = spark.createDataFrame([(7, SEARCH), (8, None), (9, "<p>redirect")], "page_id long, html string")
    rows = html.search_cards(pages).orderBy("job_id").collect()
    assert [(r.page_id, r.job_id, r.title, r.company, r.location, r.source_url) for r in rows] == [
        (7, "91", "A dev", "Acme", "Here", "https://x.y/view/dev-3-at-91?position=1&pageNum=0"),
        (7, "92", "A dev", "Acme", None, "https://x.y/view/dev-3-at-92?position=1&pageNum=0"),
    ]


def test_post_fields_in_document_order(spark):
    r = html.job_posts(spark.createDataFrame([(1, POST), (2, None)], "job_id long, html string")).orderBy("job_id").collect()
    assert (r[0].title, r[0].company, r[0].location, r[0].criteria) == ("first", "Acme Inc", None, {"Industries": "IT"})
    assert r[0].sections == "One\ntwo\nlink\nthree" and r[1].sections == "" and r[1].criteria == {}


def test_ingest_merges_cards_and_details(spark):
    cards = html.search_cards(spark.createDataFrame([(SEARCH,)], "html string"))
    posts = html.job_posts(spark.createDataFrame([(91, POST), (92, POST)], "job_id long, html string"))
    got = html.merged(cards, posts, spark.createDataFrame([(92,)], "job_id long")).collect()
    assert [(r.job_id, r.title_raw, r.industry_raw, r.seniority_level_raw) for r in got] == [(91, "A dev", "IT", None)]


def test_store_replaces_a_table_by_what_is_computed_from_it(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.qualify("t") == f"{tmp_path}/silver/t" and s.qualify("t", "gold") == f"{tmp_path}/gold/t"
    assert not s.exists("t")
    with pytest.raises(LookupError):
        s.read("t")
    s.write(spark.range(3), "t")
    s.write(s.read("t").select((F.col("id") + 1).alias("id")), "t")
    assert sorted(r.id for r in s.read("t").collect()) == [1, 2, 3]


def test_plain_pages_give_the_tolerant_parsers_tree():
    def shape(n):
        return n if isinstance(n, str) else (n.tag, n.attrs, [shape(c) for c in n.children])

    def tolerant(page):
        p = html._Tree()
        p.feed(page)
        p.close()
        return shape(p.root)

    plain = ['<ul><li>a &amp; b<li class="x  y">c</ul>d', '<a href="u?a=1&amp;b=2">&nbsp;&copy</a></b>', "", "x > y & z", "<h1>t</h1><br><p>one<p>two"]
    other = ["<B>x</B>", "<script>a<b</script>", "<!-- c -->x", "a < b", "<p class='q'>", '<br/>', '</p id="1">', "<title>a<b>", "<p"]
    assert all(shape(html._plain(x)) == tolerant(x) for x in plain)
    assert all(html._plain(x) is None for x in other) and all(shape(html.tree(x)) == tolerant(x) for x in plain + other)


def test_a_page_captured_again_is_parsed_once(spark, monkeypatch):
    seen, parse = [], html.post_of
    monkeypatch.setattr(html, "post_of", lambda h: (seen.append(h), parse(h))[1])
    assert [p["title"] for p in html.posts_of([POST, None, POST, "<h1>x</h1>", None])] == ["first", None, "first", "x", None]
    assert seen == [POST, None, "<h1>x</h1>"]
    monkeypatch.setattr(html, "KNOWN_CHARS", 0)
    assert [p["title"] for p in html.posts_of([POST, "<h1>x</h1>", POST])] == ["first", "x", "first"] and len(seen) == 6


def test_details_of_more_pages_than_a_batch(spark):
    pages = spark.range(0, 2500, 1, 1).selectExpr("id AS job_id", "concat('<h1>t', id % 700, '</h1>') AS html")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        assert all(r.title == f"t{r.job_id % 700}" for r in html.job_posts(pages).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
