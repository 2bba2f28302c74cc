"""Rows of a batch are computed when they are asked for; texts that repeat are classified once."""

from datetime import datetime

import pytest

from larder.operators import ingest as I
from larder.schemas import SCHEMAS
from larder.streaming.ingest_stream import RECORD_STREAM

CATALOGUE = "id int, key string, display_de string, display_fr string, display_it string, display_en string, category string, sub_category string, pairing_tags array<string>, aliases array<string>"


def batch(spark, n):
    rows = [
        {
            "source_id": 1, "position": k, "source_url": f"https://a.ch/de/rezepte/teller-{k}", "title": [f"Pizza Nr. {k}", "Zitronentorte", None][k % 3], "language": "de",
            "ingredients_raw": [f"{k + 1} g Linsen"], "steps_raw": ["Im Ofen 20 Min. backen."], "prep_time": ["10 min", None, "PT1H"][k % 3], "cook_time": "", "total_time": "90 min",
            "keywords": [["Dessert"], None, []][k % 3], "category": "", "cuisine": "", "difficulty": "",
        }
        for k in range(n)
    ]
    kind = RECORD_STREAM
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind.fields) for r in rows], kind)


@pytest.fixture
def parts(spark):
    return spark.createDataFrame([(1, "linsen", "Linsen", None, None, None, "pantry", None, None, None)], CATALOGUE)


def run(spark, records, parts):
    return I.ingest(records, spark.createDataFrame([], SCHEMAS["recipes"]), spark.createDataFrame([], SCHEMAS["tags"]), parts, datetime(2024, 1, 1))


def test_lines_need_no_classification(spark, parts, monkeypatch):
    def never(*args, **kw):
        raise AssertionError("not asked for")

    monkeypatch.setattr(I, "recipe_rows", never)
    monkeypatch.setattr(I, "keyword_tags", never)
    rows = run(spark, batch(spark, 4), parts)
    assert sorted((r.recipe_id, r.ingredient_id, r.quantity) for r in rows.recipe_ingredients.collect()) == [(k, 1, float(k)) for k in range(1, 5)]


def test_repeated_and_single_texts_are_classified_alike(spark, parts):
    def of(rows):
        return {r.source_url: r.asDict() for r in rows.recipes.drop("id").collect()}

    few, many = of(run(spark, batch(spark, 3), parts)), of(run(spark, batch(spark, 60), parts))
    assert {u: many[u] for u in few} == few
    pizza, torte, untitled = (few[f"https://a.ch/de/rezepte/teller-{k}"] for k in range(3))
    assert pizza["cuisine"] == "italian" and torte["title_normalised"] == "zitronentorte" and torte["prep_minutes"] is None
    assert untitled["title_normalised"] is None and untitled["prep_minutes"] == 60 and untitled["total_minutes"] == 90
    assert {r["cooking_method"] for r in few.values()} == {many["https://a.ch/de/rezepte/teller-59"]["cooking_method"]}
