import pytest

from larder.functions.lines import parse_lines

CASES = [
    ("200 g Pouletbrust, in Würfeln", 200.0, "g", "Pouletbrust", "in Würfeln", False),
    ("Salz und Pfeffer", None, None, "Salz und Pfeffer", None, False),
    ("3 Zehen Knoblauch, fein gehackt", 3.0, "Zehe", "Knoblauch", "fein gehackt", False),
    ("½ Zitrone, Saft davon", 0.5, None, "Zitrone", "Saft davon", False),
    ("1½ dl Milch", 1.5, "dl", "Milch", None, False),
    ("0,5 dl Essig", 0.5, "dl", "Essig", None, False),
    ("2-3 Eier", 2.0, None, "Eier", None, False),
    ("200", 20.0, None, "0", None, False),
    ("1 Zitrone (nur Saft)", 1.0, None, "Zitrone", "nur Saft", False),
    ("  200 g Mehl  ", 200.0, "g", "Mehl", None, False),
    ("2 EL. Butter", 2.0, "EL", "Butter", None, False),
    ("200 g Käse, gerieben, für die Kruste", 200.0, "g", "Käse", "gerieben, für die Kruste", False),
    ("evt. etwas Petersilie", None, None, "Petersilie", None, True),
    ("2 EL Schnittlauch, optional", 2.0, "EL", "Schnittlauch", None, True),
    ("nach Belieben: 1 EL Honig", 1.0, "EL", "Honig", None, True),
    ("ev. einige Tropfen Tabasco", None, None, "einige Tropfen Tabasco", None, True),
    ("wer möchte: 1 EL Crème fraîche", 1.0, "EL", "Crème fraîche", None, True),
    ("zum Garnieren frische Kräuter", None, None, "frische Kräuter", None, True),
    ("sehr wenig Salz", None, None, "Salz", None, False),
    ("3 c.s. de sucre", 3.0, "EL", "sucre", None, False),
    ("1 c. à s. de beurre", 1.0, "EL", "beurre", None, False),
    ("½ c. à c. de cannelle", 0.5, "TL", "cannelle", None, False),
    ("1 cuillère à café de sel", 1.0, "TL", "sel", None, False),
    ("2 cs de moutarde", 2.0, "EL", "moutarde", None, False),
    ("1 pincée de muscade, facultatif", 1.0, "Prise", "muscade", None, True),
    ("2 gousses d'ail, émincées", 2.0, "Zehe", "ail", "émincées", False),
    ("1 Päckchen Vanillezucker", 1.0, "Packung", "Vanillezucker", None, False),
    ("   ", None, None, None, None, False),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw_text string")
    return {r.i: r for r in parse_lines(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parse_line(parsed, i):
    r = parsed[i]
    assert (r.quantity, r.unit, r.ingredient, r.prep_note, r.optional) == CASES[i][1:]
