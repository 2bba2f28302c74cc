"""Lines of nested lists, and line rules that hold for one source only."""

from pyspark.sql import functions as F

from larder.sources import pages as PG


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("x")).first().x


def test_what_follows_a_nested_list_is_kept(spark):
    html = "<ul><li>Teig <ul><li>10 g Mehl</li><li>1 Ei</li></ul> danach 20 g Salz</li><li>Zucker</li></ul>"
    assert one(spark, html, PG.list_items(F.col("html"))) == ["Teig 10 g Mehl1 Ei danach 20 g Salz", "Zucker"]
    marked = '<li itemprop="recipeIngredient">A <ol><li>b</li></ol> c</li><li itemprop="recipeIngredient">D</li>'
    assert one(spark, marked, PG.ingredient_lines(F.col("html"))) == ["A b c", "D"]
    assert one(spark, "<li>offen<li>zu</li>", PG.list_items(F.col("html"))) is not None


def test_line_rules_of_one_source(spark):
    items = ["1 Bund Workshop-Kräuter", "200 g " + "Mehl " * 60, "ShopHauptmenü Jetzt entdecken 1 Stk"]
    section = "".join(f"<li>{x}</li>" for x in items)
    html = f'<h1>T</h1><section class="ingredients"><h3>Teig</h3>{section}</section>'
    rows = [(url, html, "de") for url in ("https://www.bettybossi.ch/x", "https://fooby.ch/bettybossi.ch", None)]
    got = PG.from_markup(spark.createDataFrame(rows, "url string, html string, language string"))
    lines = {r.source_url: [len(g["items"]) for g in r.ingredient_groups] for r in got.collect()}
    assert lines == {"https://www.bettybossi.ch/x": [], "https://fooby.ch/bettybossi.ch": [3], None: [3]}
    kept = spark.createDataFrame([(items,)], "x array<string>").select(PG.valid_lines(F.col("x")).alias("x")).first().x
    assert len(kept) == 3
