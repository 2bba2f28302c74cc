import pytest

from larder.operators.resolve import alias_index, resolve_lines, resolve_names
from larder.schemas import SCHEMAS

CATALOGUE = [
    (1, "chicken-breast", "Pouletbrust", "Blanc de poulet", "Chicken breast", ["Poulet", "Pouletfleisch"]),
    (2, "onion", "Zwiebel", "Oignon", "Onion", []),
    (3, "potato", "Kartoffel", "Pomme de terre", "Potato", ["Gschwellti"]),
    (4, "butter", "Butter", "Beurre", "Butter", []),
    (5, "salmon-fillet", "Lachsfilet", "Filet de saumon", None, ["Lachstranche"]),
    (6, "parsley", "Petersilie", "Persil", None, []),
    (7, "pepper-black", "Pfeffer", "Poivre", None, []),
    (8, "cooking-oil", "Öl", None, None, []),
    (9, "yogurt", "Joghurt", "Yogourt", None, []),
    (10, "steak", "Steak", None, None, []),
    (11, "cheese", "Sbrinz", None, None, []),
    (12, "oil-nut", "Nussöl", None, None, ["Öl"]),
    (13, "cabbage", "Kohl", "Chou", None, []),
    (14, "animal", "Animal", None, None, []),
]

CASES = [
    ("Pouletbrust", "chicken-breast"), ("POULETBRUST", "chicken-breast"), ("Zwiebeln", "onion"),
    ("mehlig kochende Kartoffeln", "potato"), ("200g Butter", "butter"), ("½ Bund Petersilie", "parsley"),
    ("wenig Pfeffer", "pepper-black"), ("ein wenig Pfeffer", "pepper-black"), ("Joghurt nature", "yogurt"),
    ("4 Lachsfilets ohne Haut (je ca. 160 g), graue Fettschicht entfernt", "salmon-fillet"),
    ("250 g geschnetzeltes Pouletfleisch", "chicken-breast"), ("Baby-Kartoffeln", "potato"),
    ("un peu de poivre noir", "pepper-black"), ("du beurre", "butter"), ("petits oignons", "onion"),
    ("des oignons hachés", "onion"), ("poivre noir", "pepper-black"), ("choux", "cabbage"), ("animaux", "animal"),
    ("2 Steaks à ca. 200 g", "steak"), ("Sbrinz AOP", "cheese"), ("Öl zum Braten", "oil-nut"), ("Öl", "oil-nut"),
    ("Kartoffeln, 0,5 cm dick", "potato"), ("16 Zwiebeln", "onion"), ("(oder Fertig-Butterkuchenteig)", None),
    ("Xylophon", None), ("()", None), ("", None), ("Poulet vom Schweizer Rind", "chicken-breast"),
    ("frische, rote Zwiebeln", None), ("grosse rote Zwiebel", "onion"), ("Gschwellti", "potato"),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, key, de, fr, None, en, "x", None, "g", None, [], aliases) for i, key, de, fr, en, aliases in CATALOGUE]
    return alias_index(spark.createDataFrame(rows, SCHEMAS["ingredients"])).cache()


@pytest.fixture(scope="module")
def resolved(spark, index):
    df = spark.createDataFrame([(c[0],) for c in CASES] + [(None,)], "ingredient string")
    return {r.name: (r.key, r.id) for r in resolve_names(df, index).collect()}


@pytest.mark.parametrize("name,key", CASES)
def test_resolve_names(resolved, name, key):
    ids = {row[1]: row[0] for row in CATALOGUE}
    assert resolved[name] == (key, ids.get(key))


def test_filter_on_parsed_columns_keeps_the_plan_small(spark, index):
    from larder.functions.lines import parse_lines

    lines = parse_lines(spark.createDataFrame([("200 g Butter",)], "raw_text string"))
    plan = lines.filter("unit = 'g' and ingredient is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000


def test_resolve_lines_keeps_every_line(spark, index):
    lines = spark.createDataFrame(
        [(i, "Zwiebeln" if i % 3 else None if i % 2 else "Nichts") for i in range(300)], "n int, ingredient string"
    )
    rows = resolve_lines(lines, index).collect()
    assert len(rows) == 300
    assert all((r.ingredient_key == "onion") == (r.n % 3 > 0) for r in rows)
