import pytest
from pyspark.sql import functions as F

from larder.operators import classify as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


@pytest.mark.parametrize("category,title,keywords,want", [
    ("Hauptgericht", "x", (), "main"), ("", "Zitronentorte", (), "bake"), ("", "Quinoasalat", (), "starter"),
    ("", "Avocado-Dip", (), "side"), ("", "Pancakes ohne Ei", ("Brunch & Frühstück",), "breakfast"),
    ("", "Schweinssteak mit Tomaten-Relish", (), "main"), ("", "Etwas", ("Fleisch",), "main"),
    ("", "Zucchini-Spiessli", ("Gemüse", "Salat"), "starter"), ("", "Etwas", (), None),
])
def test_course(spark, category, title, keywords, want):
    assert one(spark, C.course(F.lit(category), F.lit(title), words(*keywords))) == want


@pytest.mark.parametrize("raw,title,keywords,url,want", [
    ("Swiss", "x", (), "", "swiss"), ("", "Spaghetti Carbonara", (), "", "italian"), ("", "Pad Thai mit Poulet", (), "", "thai"),
    ("milchprodukte, käse, eier", "Gemüseauflauf", (), "", None), ("Schnelle Küche", "x", (), "", None),
    ("asiatische küche", "x", (), "", "asian"), ("", "Gemüsepfanne", (), "https://e.ch/rezepte/asiatisch-gemuese-123/", "asian"),
    ("", "x", ("Curry",), "", "asian"), ("", "Currywurst", (), "", None), ("Peruanisch", "x", (), "", "peruanisch"),
    ("", "Crêpes", (), "", "french"), ("", "Sate", (), "https://www.e.ch/de/rezepte/rezept/thai-curry-99998/", "asian"),
])
def test_cuisine(spark, raw, title, keywords, url, want):
    assert one(spark, C.cuisine(F.lit(raw), F.lit(title), words(*keywords), F.lit(url))) == want


def test_cuisine_from_lines(spark):
    assert one(spark, C.cuisine_from_lines(words("2 EL Sojasauce", "1 Stück Ingwer"))) == "asian"
    assert one(spark, C.cuisine_from_lines(words("100 g Parmesan", "Basilikum"))) == "italian"
    assert one(spark, C.cuisine_from_lines(words("200 g Butter"))) is None


@pytest.mark.parametrize("raw,total,want", [
    ("Einfach", 90, "easy"), ("", 25, "easy"), ("", 45, "medium"), ("", 90, "advanced"), ("", None, None), ("weird", 60, "medium"),
])
def test_difficulty(spark, raw, total, want):
    assert one(spark, C.difficulty(F.lit(raw), F.lit(total).cast("int"))) == want


@pytest.mark.parametrize("steps,keywords,want", [
    (("Fleisch grillieren",), (), "grilled"), (("Im Ofen 20 Min. backen",), (), "baked"), ((), (), None),
    (("In der Pfanne anbraten, dann kochen",), (), "fried"), (("Servieren",), ("BBQ",), "grilled"),
])
def test_cooking_method(spark, steps, keywords, want):
    assert one(spark, C.cooking_method(words(*steps), words(*keywords))) == want


@pytest.mark.parametrize("text,kinds", [
    ("500 g Pouletschenkel,", ["poultry"]), ("Rauchlachs", ["fish"]), ("Lachsfilet", ["fish"]), ("Rinds-Filet", ["beef"]),
    ("Salz und Wasser", []), ("Reh", ["game"]), ("Rehe", []), ("Speck und Crevetten", ["pork", "seafood"]),
])
def test_protein_bits(spark, text, kinds):
    bits = one(spark, C.protein_bits(F.lit(text)))
    assert [k for i, k in enumerate(C._PROTEINS) if bits >> i & 1] == kinds


CATALOGUE = [
    (1, "chicken", "Pouletbrust", "meat", "poultry", ["poultry"]), (2, "beef", "Rind", "meat", "beef", ["beef", "red-meat"]),
    (3, "cream", "Rahm", "dairy", "cream", []), (4, "sugar", "Zucker", "pantry", None, []), (5, "carrot", "Rüebli", "vegetable", None, ["root_veg"]),
    (6, "stock", "Rindsbouillon", "pantry", None, []), (7, "offal", "Innereien", "meat", "offal", []), (8, "nut", "Nuss", "pantry", None, ["nut"]),
]


def classify(spark, lines, course=None, cook=None, total=None, keywords=()):
    recipes = spark.createDataFrame(
        [(1, course, cook, total, list(keywords))],
        "recipe_id int, course string, cook_minutes int, total_minutes int, keywords array<string>",
    )
    parts = spark.createDataFrame(
        [(1, i, *line) for i, line in enumerate(lines)],
        "recipe_id int, seq int, ingredient_id int, raw_text string, quantity double",
    )
    catalogue = spark.createDataFrame(
        CATALOGUE, "id int, key string, display_de string, category string, sub_category string, pairing_tags array<string>"
    )
    return C.classify_parts(recipes, parts, catalogue).first()


@pytest.mark.parametrize("lines,want", [
    ([(1, "x", 200.0)], "poultry"), ([(1, "x", 200.0), (2, "x", 100.0)], "mixed"), ([(1, "x", 201.0), (2, "x", 100.0)], "poultry"),
    ([(1, "x", None), (2, "x", 1.0)], "beef"), ([(None, "Poulet", None)], "poultry"), ([(None, "Poulet und Speck", None)], "mixed"),
    ([(5, "x", 1.0), (None, "Lachs", 1.0)], "fish"), ([(7, "x", 1.0), (None, "Lachs", 1.0)], None), ([], None), ([(99, "Poulet", 1.0)], None),
])
def test_primary_protein(spark, lines, want):
    assert classify(spark, lines).primary_protein == want


@pytest.mark.parametrize("lines,total,want", [
    ([], 20, ["dairy-free", "quick", "vegan", "vegetarian"]), ([(1, "x", 1.0)], None, ["dairy-free"]),
    ([(None, "500 g Poulet", None)], None, []), ([(None, "Salz", None)], 30, ["quick"]), ([(3, "x", 1.0)], 31, ["vegetarian"]),
    ([(5, "x", 1.0), (None, "Lachs", 1.0)], None, ["dairy-free"]), ([(6, "x", 1.0)], None, ["dairy-free"]),
])
def test_dietary_flags(spark, lines, total, want):
    assert classify(spark, lines, total=total).dietary_flags == want


def test_taste_weight_and_groups(spark):
    assert classify(spark, [], course="dessert").taste_profile == "sweet"
    assert classify(spark, [(1, "x", 1.0)], keywords=["Süss"]).taste_profile == "sweet-savoury"
    assert classify(spark, [(4, "x", 1.0), (5, "x", 1.0), (8, "x", 1.0)]).taste_profile == "sweet"
    assert classify(spark, [(4, "x", 1.0)] + [(5, "x", 1.0)] * 3).taste_profile == "savoury"
    assert classify(spark, [], course="starter").weight_class == "light"
    assert classify(spark, [(2, "x", 1.0)], course="main", cook=90).weight_class == "heavy"
    assert classify(spark, [(3, "x", 1.0)], keywords=["Gratin"]).weight_class == "heavy"
    assert classify(spark, [], cook=20).weight_class == "light"
    assert classify(spark, [(2, "x", 1.0)], cook=30).weight_class == "medium"
    assert classify(spark, [(1, "x", 1.0), (2, "x", 1.0), (8, "x", 1.0)]).food_groups == ["nut", "poultry"]


def test_computed_tags(spark):
    row = spark.sql(
        "select 'poultry' primary_protein, 'savoury' taste_profile, 'light' weight_class, 'grilled' cooking_method, "
        "'main' course, 'swiss' cuisine, 'easy' difficulty, array('dairy-free', 'quick') dietary_flags, array('poultry', 'cheese') food_groups"
    ).select(C.computed_tags().alias("t")).first()
    assert row.t == ["cheese", "dairy-free", "easy", "grilled", "light", "main", "poultry", "quick", "savoury", "swiss"]
