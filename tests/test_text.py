import unicodedata

import pytest
from pyspark.sql import functions as F

from larder.functions import durations as D
from larder.functions import text as X
from larder.functions import urls as U


def values(spark, inputs, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.o for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalise_title(spark):
    got = values(spark, ["Crème Brûlée mit Früchten", "  POULET   Brust  ", "Straße ½", ""], X.normalise_title)
    assert got == ["creme brulee mit fruchten", "poulet brust", "straße 1⁄2", ""]


def test_strip_accents_agrees_with_unicode_tables(spark):
    chars = [chr(c) for c in [*range(0xA1, 0x250), *range(0x1E00, 0x1F00)]]
    want = ["".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in chars]
    got = values(spark, [f"a{c}b" for c in chars], X.strip_accents)
    # Spacing marks such as ¨ decompose to a blank and a mark; nothing else may differ.
    differing = [c for c, g, w in zip(chars, got, want, strict=True) if g != f"a{w}b"]
    assert differing == [c for c in differing if len(unicodedata.normalize("NFKD", c)) > 1 and not c.isalnum()]


def test_strip_accents_equals_nfkd_on_all_code_points(spark):
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    blocks = [[chr(c) for c in codes[k : k + 512]] for k in range(0, len(codes), 512)]
    got = values(spark, ["|".join(b) for b in blocks], X.strip_accents)
    wrong = [hex(ord(b[0])) for b, g in zip(blocks, got, strict=True) if g != "|".join(map(fold, b))]
    assert wrong == []


def test_strip_accents_of_mixed_texts(spark):
    texts = ["ά ελλάδα й ｶﾞ", "한국어 각 😀é", "ﷺ ﬁn ½", "e\u0301\u0323", "", None]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert values(spark, texts, X.strip_accents) == want


def test_tag_slug(spark):
    assert values(spark, ["Für Gäste", "Brunch & Frühstück", " -x- "], X.tag_slug) == [
        "für-gäste", "brunch-frühstück", "x",
    ]


@pytest.mark.parametrize("text,minutes", [
    ("PT15M", 15), ("PT1H30M", 90), ("PT2H", 120), ("45 min", 45), ("1 h 35 min", 95), ("2 Std 10 min", 130),
    ("ca. 30 Min.", 30), ("", None), ("PT", None), ("PT29S", None), ("PT30S", 1), ("PT10081M", None), ("PT10080M", 10080),
    ("bald", None), ("PT99999999999999999999M", None),
])
def test_duration_minutes(spark, text, minutes):
    assert values(spark, [text], D.duration_minutes) == [minutes]


def test_text_to_iso(spark):
    got = values(spark, ["45 min", "ca. 30 Min.", "1 Std. 15 Min.", "2 Stunden", "2 heures", ""], D.text_to_iso)
    assert got == ["PT45M", "PT30M", "PT1H15M", "PT2H", "PT2H", ""]


def test_servings(spark):
    assert values(spark, ["4 Portionen", "6", "", "für alle", "99999"], D.servings) == [4, 6, None, None, None]


@pytest.mark.parametrize("given,want", [
    ((15, 15, 40), (15, 25, 40)), ((15, 15, 15), (15, None, 15)), ((15, 15, None), (15, None, 15)),
    ((10, 20, None), (10, 20, 30)), ((10, None, 25), (10, 15, 25)), ((10, None, 5), (10, None, 5)),
    ((10, None, None), (10, None, 10)), ((None, 20, 50), (None, 20, 20)), ((None, None, 50), (None, None, 50)),
    ((None, None, None), (None, None, None)),
])
def test_reconcile_times(spark, given, want):
    df = spark.createDataFrame([given], "p int, c int, t int")
    times = D.reconcile_times(F.col("p"), F.col("c"), F.col("t"))
    assert tuple(df.select(times.prep, times.cook, times.total).first()) == want


def test_external_id(spark):
    rows = [
        ("https://fooby.ch/de/rezepte/pouletbrust-12345", "de", "pouletbrust-12345-de"),
        ("https://example.com/recipe/AB-40-fr?x=1#y", "fr", "AB-40-fr"),
        ("https://example.com/pasta.html", "de", "pasta-de"),
        ("https://example.com/pasta/", None, "pasta"),
        ("", "de", ""),
    ]
    df = spark.createDataFrame(rows, "u string, l string, w string")
    for r in df.select("w", U.external_id(F.col("u"), F.col("l")).alias("g")).collect():
        assert r.g == r.w


def test_images(spark):
    assert values(spark, ["https://e.com/a.png", "https://e.com/a", "https://e.com/a.WEBP?x=.gif"], U.image_extension) == [
        ".png", ".jpg", ".webp",
    ]
    big = "https://recipeimages.migros.ch/crop/v-w-2050-h-1367-a-center_center/abc/img.jpg"
    assert values(spark, [big, "https://e.com/v-w-2050-h-1367/x.jpg"], lambda c: U.resized_url(c, 1200)) == [
        "https://recipeimages.migros.ch/crop/v-w-1200-h-800-a-center_center/abc/img.jpg",
        "https://e.com/v-w-2050-h-1367/x.jpg",
    ]
    assert values(spark, ["https://e.com/i.jpg 1x, https://e.com/j.jpg 2x", ""], U.first_srcset_url) == [
        "https://e.com/i.jpg", "",
    ]
