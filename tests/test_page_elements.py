from pyspark.sql import functions as F

from larder.sources import pages as PG


def test_links_and_facts_after_a_nested_element_of_the_same_name_are_read(spark):
    html = (
        '<div class="breadcrumb"><div><a href="/">Home</a></div><a>Desserts</a><div><a>Kuchen</a></div></div>'
        '<ul class="recipe-tags"><li><ul><li><a>Vegi</a></li></ul></li><li><a>Thai</a></li></ul>'
        '<div class="RecipeFacts"><div><span>30 Min.</span></div><div>x <b>y</b></div><span>einfach</span></div>'
        "<div><a>Anderes</a></div>"
    )
    own = '<div class="recipe-difficulty"><div></div>schwer</div>'
    plain = '<nav class="breadcrumb"><a>Home</a><a>Suppen</a></nav><p class="tag"><a>Italienisch</a></p><ul class="recipe-info"><li>mittel</li></ul>'
    col = F.col("html")
    rows = spark.createDataFrame([(1, html), (2, own), (3, plain)], "id int, html string").select(
        "id", PG.breadcrumbs(col).alias("crumbs"), PG.category(col).alias("category"), PG.tag_links(col).alias("tags"),
        PG.cuisine(col).alias("cuisine"), PG.difficulty(col).alias("difficulty"),
    )
    got = {r.id: tuple(r)[1:] for r in rows.collect()}
    assert got[1] == (["Desserts", "Kuchen"], "Desserts", ["Vegi", "Thai"], "thai", "einfach")
    assert got[2][-1] == "schwer"
    assert got[3] == (["Suppen"], "Suppen", ["Italienisch"], "italian", "mittel")


def test_selectors_of_a_page_cut_once_equal_those_of_its_markup(spark):
    pages = [
        '<ul><li class="ingredient">Teig<ul><li>200 g Mehl</li></ul>danach 20 g Salz</li><li>1 Bund Dill</li></ul><nav class="breadcrumb"><a>Suppen</a></nav>',
        '<div class="recipe-step">a<div>b</div>c</div><script>"<div class=recipe-step>"</script><!-- <div class="recipe-step"> --><p class="step">d<br>e</p>',
        '<div class="recipe-gallery"><div><img src="/a.jpg"></div><img data-src="/b.jpg"/></div><img src="/c.jpg"><div class="recipe-info"><span>mittel</span></div>',
        '<section class="ingredients"><h4>Teil</h4><ul><li>1 Ei</li></ul></section><div class="tag"><a>Thai</a>', "</div></p>kein Element <", "", None,
    ]
    html, page = F.col("html"), PG.Page(F.col("html"), F.col("tags"))
    readers = (PG.breadcrumbs, PG.category, PG.tag_links, PG.keywords, PG.cuisine, PG.difficulty, PG.list_items, PG.ingredient_lines, PG.ingredient_groups, PG.steps, PG.image_urls)
    cut = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "id int, html string").withColumn("tags", PG.page_tags(html))
    for read in readers:
        rows = cut.select("id", read(html).alias("a"), read(page).alias("b")).collect()
        assert all(r.a == r.b for r in rows), read.__name__
    got = {r.id: r for r in cut.select("id", PG.ingredient_lines(page).alias("lines"), PG.steps(page).alias("steps"), PG.image_urls(page).alias("images")).collect()}
    assert got[0].lines == ["Teig 200 g Mehl danach 20 g Salz"]
    assert got[1].steps == ["abc", "de"]
    assert got[2].images == ["/a.jpg", "/b.jpg"]


def test_a_record_cuts_its_page_once(spark):
    pages = spark.createDataFrame([("https://x.ch/r", "<h1>Suppe</h1>", "de")], "url string, html string, language string")
    plan = PG.from_markup(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--.*?-->|<(?:script|style)") == 1


def test_texts_of_markup_are_computed_once_and_references_replaced_once(spark):
    texts = ["&amp;quot; &quot;a&quot;", "&&#113;uot;", "&#38;lt; &lt;", "&foo; &uuml;&uuml;&#x1F600;", "&#59;&#35;38;", "a & b &amp; c", "", None]
    want = ['&quot; "a"', "&quot;", "&lt; <", "&foo; üü\U0001f600", ";#38;", "a & b & c", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r.u for r in df.select("id", PG.unescape(df["t"]).alias("u")).orderBy("id").collect()] == want
    plan = df.select(PG.inner_text(df["t"]).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--") == 1
