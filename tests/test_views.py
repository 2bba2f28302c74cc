from datetime import date, datetime

from larder.operators.views import ingredients_resolved, recipe_full


def test_recipe_full_keeps_recipes_without_events_and_images(spark):
    recipes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    log = spark.createDataFrame(
        [(1, 1, date(2024, 1, 2), 4, datetime(2024, 1, 2)), (2, 1, date(2024, 1, 5), None, datetime(2024, 1, 5)), (3, 9, date(2024, 1, 1), 1, None)],
        "id int, recipe_id int, cooked_on date, rating int, logged_at timestamp_ntz",
    )
    images = spark.createDataFrame([(1, 2, "u2"), (1, 1, "u1"), (9, 1, "x")], "recipe_id int, seq int, url string")
    got = sorted(tuple(r) for r in recipe_full(recipes, log, images).collect())
    assert got == [(1, "a", 2, date(2024, 1, 5), 4, "u1"), (2, "b", 0, None, None, None)]


def test_ingredients_resolved_keeps_lines_without_entry(spark):
    lines = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 6)], "recipe_id int, seq int, ingredient_id int")
    entries = spark.createDataFrame([(5, "leek", "Lauch", "vegetable")], "id int, key string, display_de string, category string")
    got = {r.seq: (r.ingredient_key, r.ingredient_display_de, r.ingredient_category) for r in ingredients_resolved(lines, entries).collect()}
    assert got == {1: ("leek", "Lauch", "vegetable"), 2: (None, None, None), 3: (None, None, None)}
