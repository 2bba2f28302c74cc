import json

import pytest
from pyspark.sql import functions as F

from larder.errors import DataStaleError, SchemaError, UnknownTableError
from larder.operators import quality as Q
from larder.schemas import RAW_RECIPE, SCHEMAS
from larder.sources import pages as PG
from larder.sources import sitemaps as SM
from larder.sources import structured as SD
from larder.sources import tables as TB

RECIPE = {
    "@type": "Recipe",
    "name": " Lauch mit Reis ",
    "description": "Gut.",
    "image": ["https://e.ch/1.jpg", {"url": "https://e.ch/2.jpg", "name": "Zwei"}, {"caption": "ohne"}],
    "recipeYield": 4,
    "recipeCategory": ["Hauptgericht", "Mittagessen"],
    "keywords": "lauch, reis, ,einfach",
    "recipeIngredient": ["400 g Lauch", " ", "Naturaplan Reis", "Alufolie"],
    "recipeInstructions": [
        "Waschen.",
        {"@type": "HowToStep", "text": " Kochen. "},
        {"@type": "HowToSection", "itemListElement": [
            {"@type": "HowToStep", "text": "Würzen."},
            {"@type": "HowToSection", "itemListElement": [{"@type": "HowToStep", "text": "Servieren."}]},
        ]},
        {"@type": "Other", "text": "nie"},
    ],
}


def test_steps_of_sections_nested_to_any_depth(spark):
    deep = {"@type": "HowToStep", "text": "deep"}
    for _ in range(7):
        deep = {"@type": "HowToSection", "itemListElement": [deep, "next"]}
    rows = [(json.dumps([{"@type": "HowToStep", "text": "first"}, deep, "last"]),), (json.dumps([{"@type": "HowToSection"}]),)]
    df = spark.createDataFrame(rows, "j string").select(SD.instructions(F.try_parse_json("j")).alias("s"))
    assert [r.s for r in df.collect()] == [["first", "deep", *["next"] * 7, "last"], []]


def page(*scripts, body=""):
    head = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    return f"<html><head>{head}</head><body>{body}</body></html>"


def raw(spark, html):
    pages = spark.createDataFrame([(1, "https://e.ch/de/x", "de", html)], "page_id int, url string, language string, html string")
    return SD.to_raw_records(SD.extract_recipes(pages)).collect()


def test_structured_recipe(spark):
    (r,) = raw(spark, page(json.dumps(RECIPE)))
    assert (r.title, r.description, r.yield_amount, r.category, r.cuisine, r.error) == (
        "Lauch mit Reis", "Gut.", "4", "Hauptgericht", "", None,
    )
    assert r.ingredients_raw == ["400 g Lauch", "Naturaplan Reis", "Alufolie"]
    assert r.steps_raw == ["Waschen.", "Kochen.", "Würzen.", "Servieren."]
    assert (r.image_urls, r.image_captions) == (["https://e.ch/1.jpg", "https://e.ch/2.jpg"], ["", "Zwei"])
    assert r.keywords == ["lauch", "reis", "einfach"]


def test_structured_variants(spark):
    text = {"@type": "Recipe", "name": "T", "recipeIngredient": "a\n b\n\n", "recipeInstructions": "x\ny", "image": "u",
            "recipeYield": ["6 Stück"], "keywords": ["k1", " k2 "]}
    (r,) = raw(spark, page(json.dumps({"@graph": [{"@type": "Person"}, text]})))
    assert (r.ingredients_raw, r.steps_raw, r.image_urls, r.yield_amount, r.keywords) == (
        ["a", "b"], ["x", "y"], ["u"], "6 Stück", ["k1", "k2"],
    )
    assert len(raw(spark, page(json.dumps([RECIPE, {"@type": "WebPage"}, text]), "{broken", json.dumps(text)))) == 3
    assert raw(spark, page(json.dumps({**text, "@type": ["Recipe"]}))) == []
    assert raw(spark, "<html></html>") == []
    (bare,) = raw(spark, page(json.dumps({"@type": "Recipe"})))
    assert (bare.error, bare.ingredients_raw, bare.steps_raw, bare.image_urls, bare.yield_amount) == ("missing name", [], [], [], "")


MARKUP = """<html><head><meta name="description" content="Fein &amp; gut"><meta property="og:image" content="https://e.ch/m.jpg">
<meta name="keywords" content="Thai, schnell"></head><body><nav class="breadcrumb"><a href="/">Home</a><a>Rezepte</a><a>Hauptgerichte</a></nav>
<h1> Pad <b>Thai</b> </h1><div class="recipe-meta"><span>Gesamtzeit: 1 h</span><span>Aktivzeit: 45 min</span><span>Einfach</span></div>
<span>4 Personen</span><section class="ingredients"><h3>Zutaten</h3><ul><li>1 EL <i>Öl</i></li></ul><h3>Für die Sauce</h3>
<ul><li>2 dl  Rahm</li><li>Menu schliessen</li><li>Salz</li></ul></section>
<div class="preparation__step">1 Reis kochen.</div><div class="preparation__step big">2 Servieren.</div><div class="preparation__step">2 Servieren.</div>
<div class="recipe-gallery"><img data-src="https://e.ch/g1.jpg"><img srcset="https://e.ch/g2.jpg 1x, b 2x"><img src="data:x"></div>
<div class="recipe-tags"><a href="/tag/asiatisch">Asiatisch</a></div></body></html>"""


def test_markup(spark):
    pages = spark.createDataFrame([(1, "https://www.bettybossi.ch/de/u", "de", MARKUP), (2, "v", "de", "<p>nichts</p>")], "page_id int, url string, language string, html string")
    r, none = PG.from_markup(pages).orderBy("page_id").collect()
    assert (r.title, r.description, r.category, r.cuisine, r.difficulty, r.yield_amount) == (
        "Pad Thai", "Fein & gut", "Hauptgerichte", "asian", "Einfach", "4 Portionen",
    )
    assert [(g["label"], g["items"]) for g in r.ingredient_groups] == [(None, ["1 EL Öl"]), ("Für die Sauce", ["2 dl Rahm", "Salz"])]
    assert r.ingredients_raw == ["1 EL Öl", "2 dl Rahm", "Salz"]
    assert r.steps_raw == ["Reis kochen.", "Servieren."]
    assert (r.prep_time, r.cook_time) == ("45 min", "1 h")
    assert r.image_urls == ["https://e.ch/m.jpg", "https://e.ch/g1.jpg", "https://e.ch/g2.jpg"]
    assert r.image_captions == ["Pad Thai"] * 3
    assert r.keywords == ["Thai", "schnell"]
    assert none.error == "no recipe title"


def test_component_props(spark):
    props = {"numberOfPersons": 4, "ingredientsLists": [
        {"entity": {"title": None, "ingredients": [
            {"entity": {"amount": "25", "quantity": {"entity": {"name": "g"}}, "title": "frischer Ingwer"}},
            {"entity": {"amount": "", "quantity": None, "title": "Salz"}}]}},
        {"entity": {"title": "Sauce", "ingredients": [
            {"entity": {"amount": "2", "quantity": {"entity": {"name": "Esslöffel", "shortForm": "EL"}}, "title": "Öl"}}]}},
    ]}
    html = "<h1>T</h1><div data-react-props='{}'></div><div data-react-props=\"" + json.dumps(props).replace('"', "&quot;") + '"></div>'
    pages = spark.createDataFrame([("u", "de", html)], "url string, language string, html string")
    r = PG.from_markup(pages).first()
    assert [(g["label"], g["items"]) for g in r.ingredient_groups] == [(None, ["25 g frischer Ingwer", "Salz"]), ("Sauce", ["2 EL Öl"])]
    assert r.yield_amount == "4 Portionen"


def test_complete_with_markup(spark):
    html = page(json.dumps(RECIPE), body=MARKUP[MARKUP.index("<nav"):])
    pages = spark.createDataFrame([("u", "de", html)], "url string, language string, html string")
    records = SD.to_raw_records(SD.extract_recipes(pages)).crossJoin(pages.select("html"))
    r = PG.complete_with_markup(records).first()
    assert r.ingredients_raw == ["400 g Lauch", "Reis"]
    assert (r.keywords, r.category, r.cuisine) == (["lauch", "reis", "einfach"], "Hauptgericht", "asian")
    assert r.image_captions == ["Lauch mit Reis", "Zwei"]
    assert [g["label"] for g in r.ingredient_groups] == [None, "Für die Sauce"]


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [
        ("fooby", f"<urlset {ns}><url><loc> https://fooby.ch/de/rezepte/a </loc></url><url><loc>https://fooby.ch/fr/recettes/b</loc></url>"
                  "<url><loc>https://fooby.ch/de/magazin</loc></url></urlset>"),
        ("schweizerfleisch", f"<sitemapindex {ns}><sitemap><loc>https://viandesuisse.ch/recettes/c-d</loc></sitemap></sitemapindex>"),
    ]
    found = SM.discover(spark.createDataFrame(rows, "source string, xml string"))
    assert sorted((r.url, r.language) for r in found.collect()) == [
        ("https://fooby.ch/de/rezepte/a", "de"), ("https://fooby.ch/fr/recettes/b", "fr"), ("https://viandesuisse.ch/recettes/c-d", "fr"),
    ]
    only = SM.discover(spark.createDataFrame(rows, "source string, xml string"), ["de"])
    assert [r.url for r in only.collect()] == ["https://fooby.ch/de/rezepte/a"]
    urls = spark.createDataFrame(
        [("schweizerfleisch", "https://schweizerfleisch.ch/rezepte", False), ("bettybossi", "https://x/de/rezepte/rezept/y/", True),
         ("swissmilk", "https://x/de/nachhaltigkeit/", False), ("other", "https://x/rezepte/", False)],
        "s string, u string, w boolean",
    )
    assert all(r.w == r.g for r in urls.select("w", SM.is_recipe_url(F.col("u"), F.col("s")).alias("g")).collect())
    assert [s.key for s in SM.enabled_sources(key="fooby")] == ["fooby"]


def test_tables(spark, tmp_path):
    folder = str(tmp_path / "data")
    with pytest.raises(DataStaleError):
        TB.read_table(spark, folder, "tags")
    with pytest.raises(UnknownTableError):
        TB.read_table(spark, folder, "nope")
    with pytest.raises(SchemaError):
        TB.conform(spark.range(1).withColumn("bad", F.lit(1)), "tags")
    df = spark.createDataFrame([("k", 1)], "key string, id long")
    TB.write_table(df, folder, "tags")
    TB.append_table(df.withColumn("id", F.lit(2)), folder, "tags")
    assert sorted(tuple(r) for r in TB.read_table(spark, folder, "tags").collect()) == [(1, "k", None, None), (2, "k", None, None)]
    assert "tags" not in TB.seed_empty_tables(spark, folder)
    assert TB.seed_if_empty(SM.source_rows(spark), folder, "sources") and not TB.seed_if_empty(SM.source_rows(spark), folder, "sources")
    TB.write_fingerprint(spark, folder)
    assert set(TB.register_views(spark, folder)) == set(SCHEMAS)
    assert "computed_tags" in spark.table("recipes").columns
    assert {r["table"]: r["rows"] for r in TB.stats(spark, folder).collect()}["tags"] == 2
    assert {r["check"]: r.severity for r in Q.doctor(spark, folder).collect()} == {"tables": "ok", "schema_version": "ok"}
    spark.createDataFrame([('{"schema_hash": "0"}',)], "value string").write.mode("overwrite").text(f"{folder}/_schema_version")
    with pytest.raises(DataStaleError):
        TB.register_views(spark, folder)


def test_computed_tags_are_pruned_from_the_scan(spark, tmp_path):
    folder = str(tmp_path / "pruned")
    TB.seed_empty_tables(spark, folder)
    TB.register_views(spark, folder)
    df = spark.sql("select id from recipes where status = 'active'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" not in plan and "PushedFilters: [IsNotNull(status), EqualTo(status,active)]" in plan


def test_quality_checks(spark):
    recipes = spark.createDataFrame([(1, "a", 1, "x"), (2, "", 1, "x"), (3, "c", None, "y")], "id int, title string, source_id int, source_external_id string")
    child = spark.createDataFrame([(1,), (8,), (8,)], "recipe_id int")
    issues = Q.validate_tables({"recipes": recipes, "recipe_steps": child, "recipe_ingredients": child.filter("recipe_id = 1")})
    assert sorted(tuple(r) for r in issues.collect()) == [
        ("duplicate_recipes", "1|x", "2"), ("recipe_required_fields", "2", "title"), ("recipe_required_fields", "3", "source_id"),
        ("recipe_steps_fk", "8", "recipe_id"),
    ]


def test_raw_schema_is_not_changed_by_the_stream_schema():
    import larder.streaming.ingest_stream  # noqa: F401

    assert len(RAW_RECIPE.fields) == 17


@pytest.mark.parametrize(
    ("column", "html", "want"),
    [
        (PG.steps, '<div class="recipe-step"><div>1</div><p>Zwiebel hacken.</p></div><DIV class="step">2 <br/>Servieren</DIV>',
         ["Zwiebel hacken.", "Servieren"]),
        (PG.steps, '<div class="step">offen <div>x</div>', ["offen x"]),
        (PG.ingredient_groups, '<div class="ingredient-group"><h4>A</h4><ul><li>1 Ei</li></ul></div><p>x</p>'
         '<div class="ingredient-group"><h4>B</h4><ul><li>2 Eier</li></ul></div>', [("A", ["1 Ei"]), ("B", ["2 Eier"])]),
        (PG.ingredient_groups, '<section class="ingredients"><section><h4>Teig</h4><li>Mehl</li></section>'
         '<section><h4>Sauce</h4><li>Rahm</li></section></section>', [("Teig", ["Mehl"]), ("Sauce", ["Rahm"])]),
        (PG.unescape, "Cr&#232;me &rsquo; &ocirc; &#x1F372; &amp;lt; &unbekannt; &; a&b &#0; &#xD800;", "Crème ’ ô 🍲 &lt; &unbekannt; &; a&b � �"),
        (PG.unescape, "&eacute;", "é"),
        (PG.unescape, None, None),
    ],
)
def test_nested_markup_and_references(spark, column, html, want):
    got = spark.createDataFrame([(html,)], "html string").select(column(F.col("html")).alias("x")).first().x
    if got and not isinstance(got, str) and not isinstance(got[0], str):
        got = [(g.label, g["items"]) for g in got]
    assert got == want
