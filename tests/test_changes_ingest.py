from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from larder.operators import changes as CH
from larder.operators import events as EV
from larder.operators import ingest as I
from larder.operators import promotions as P
from larder.operators import recommend as R
from larder.operators import render as M
from larder.operators import tags as TG
from larder.plans.oracle import statements
from larder.plans.registered import registered
from larder.schemas import SCHEMAS
from larder.sources.sitemaps import source_rows
from larder.sources.store import run_ingest
from larder.sources.tables import read_table, seed_empty_tables
from larder.streaming.event_stats import windowed_tool_stats
from larder.streaming.ingest_stream import RECORD_STREAM, record_stream, start_ingest

AT = datetime(2024, 1, 31, 12)


def table(spark, name, rows):
    names = SCHEMAS[name].names
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], SCHEMAS[name])


def recipe(i, **kw):
    return {"id": i, "source_id": 1, "source_external_id": f"x{i}", "source_url": f"u{i}", "title": f"t{i}", "status": "active",
            "times_cooked": 0, "starred": False, **kw}


def test_star_and_rate(spark):
    recipes = table(spark, "recipes", [recipe(1, owner_rating=3), recipe(2, owner_rating=3), recipe(3, owner_rating=3)])
    stars = spark.createDataFrame(
        [(1, True, datetime(2024, 1, 1)), (1, False, datetime(2024, 1, 2)), (2, True, datetime(2024, 1, 1)), (9, True, AT)],
        "recipe_id int, starred boolean, changed_at timestamp_ntz",
    )
    assert {r.id: r.starred for r in CH.star_recipes(recipes, stars).collect()} == {1: False, 2: True, 3: False}
    rates = spark.createDataFrame(
        [(1, 5, datetime(2024, 1, 1)), (1, 9, datetime(2024, 1, 2)), (2, None, AT)],
        "recipe_id int, owner_rating int, changed_at timestamp_ntz",
    )
    rated = CH.rate_recipes(recipes, rates)
    assert {r.id: r.owner_rating for r in rated.collect()} == {1: 5, 2: None, 3: 3}
    assert rated.schema == recipes.schema


def test_log_cooks(spark):
    recipes = table(spark, "recipes", [recipe(1, owner_rating=2, times_cooked=7), recipe(2, owner_rating=4)])
    log = table(spark, "cook_log", [{"id": 5, "recipe_id": 1, "cooked_on": date(2024, 1, 1), "rating": 1, "logged_at": datetime(2024, 1, 1)}])
    pins = table(spark, "pinned_recipes", [{"id": 1, "recipe_id": 1, "status": "pinned"}, {"id": 2, "recipe_id": 1, "status": "dismissed"}, {"id": 3, "recipe_id": 2, "status": "pinned"}])
    new = table(spark, "cook_log", [
        {"recipe_id": 1, "rating": 4, "logged_at": AT}, {"recipe_id": 1, "cooked_on": date(2024, 2, 1), "logged_at": AT},
        {"recipe_id": 8, "logged_at": AT}, {"recipe_id": 1, "rating": 6, "logged_at": AT},
    ]).drop("id")
    out = CH.log_cooks(log, recipes, new, date(2024, 1, 31), pins)
    assert sorted((r.id, r.recipe_id, r.cooked_on) for r in out.cook_log.collect()) == [
        (5, 1, date(2024, 1, 1)), (6, 1, date(2024, 1, 31)), (7, 1, date(2024, 2, 1)),
    ]
    assert {r.id: (r.times_cooked, r.owner_rating) for r in out.recipes.collect()} == {1: (3, 4), 2: (0, 4)}
    assert {r.id: r.status for r in out.pins.collect()} == {1: "cooked", 2: "dismissed", 3: "pinned"}
    assert sorted(r.reason for r in out.rejected.collect()) == ["rating out of range", "unknown recipe"]


def test_pins(spark):
    recipes = table(spark, "recipes", [recipe(1), recipe(2), recipe(3)])
    pins = table(spark, "pinned_recipes", [{"id": 4, "recipe_id": 1, "status": "pinned"}, {"id": 5, "recipe_id": 2, "status": "cooked", "target_date": date(2024, 1, 5)}])
    asked = table(spark, "pinned_recipes", [
        {"recipe_id": 1, "pinned_at": AT}, {"recipe_id": 2, "pinned_at": AT, "note": "later"}, {"recipe_id": 2, "pinned_at": datetime(2024, 1, 1), "note": "first"},
        {"recipe_id": 9, "pinned_at": AT},
    ]).drop("id", "status")
    out = CH.pin_recipes(pins, recipes, asked)
    assert sorted((r.id, r.recipe_id, r.status, r.note) for r in out.collect()) == [(4, 1, "pinned", None), (5, 2, "cooked", None), (6, 2, "pinned", "first")]
    assert [r.id for r in CH.list_pins(out, recipes, include_done=True).collect()] == [5, 6, 4]
    assert [r.id for r in CH.list_pins(out, recipes).collect()] == [6, 4]


def test_pantry(spark):
    ingredients = table(spark, "ingredients", [{"id": 1, "key": "a"}, {"id": 2, "key": "b"}, {"id": 3, "key": "c"}])
    pantry = table(spark, "pantry", [{"ingredient_id": 1, "approx_quantity": 1.0}, {"ingredient_id": 2, "approx_quantity": 2.0}])
    additions = spark.createDataFrame(
        [("a", 5.0, "g", "fridge", datetime(2024, 1, 1), None), ("a", 6.0, "g", "fridge", AT, None), ("c", 7.0, "g", "fridge", AT, None), ("z", 1.0, "g", "fridge", AT, None)],
        "key string, approx_quantity double, unit string, location string, updated_at timestamp_ntz, note string",
    )
    removals = spark.createDataFrame([("b",), ("y",)], "key string")
    out = CH.update_pantry(pantry, ingredients, additions, removals)
    assert sorted((r.ingredient_id, r.approx_quantity) for r in out.pantry.collect()) == [(1, 6.0), (3, 7.0)]
    assert sorted(r.key for r in out.unknown.collect()) == ["y", "z"]


def test_own_recipes(spark):
    entries = spark.createDataFrame(
        [(1, " Mein Gratin ", ["200 g Käse, gerieben", "Salz"], ["Backen."], 4, 10, 20, "easy", AT), (2, " ", ["x"], ["y"], None, None, None, None, AT),
         (3, "x", [], ["y"], None, None, None, None, AT), (4, "Z", ["x"], ["y"], None, None, 5, None, AT)],
        "entry_no int, title string, ingredients array<string>, steps array<string>, servings int, prep_minutes int, cook_minutes int, difficulty string, entered_at timestamp_ntz",
    )
    out = CH.add_own_recipes(table(spark, "recipes", [recipe(7)]), entries, 6)
    assert sorted((r.id, r.source_external_id, r.title, r.total_minutes) for r in out.recipes.collect()) == [(8, "own-8", "Mein Gratin", 30), (9, "own-9", "Z", 5)]
    assert sorted((r.recipe_id, r.seq, r.quantity, r.prep_note) for r in out.recipe_ingredients.collect() if r.recipe_id == 8) == [(8, 1, 200.0, "gerieben"), (8, 2, None, None)]
    assert out.recipe_steps.count() == 2 and out.rejected.count() == 2


def test_tags(spark):
    existing = table(spark, "tags", [{"id": 3, "key": "main"}])
    records = spark.createDataFrame([(1, ["Gemüse", "Hauptgericht", "Sommer"]), (2, ["Party", "gemüse", "&"])], "recipe_id int, keywords array<string>")
    rows = TG.keyword_tags(records, existing)
    assert sorted((r.id, r.key, r.display, r.facet) for r in rows.tags.collect()) == [(4, "gemüse", "Gemüse", "ingredient"), (5, "party", "Party", "occasion")]
    assert sorted(tuple(r) for r in rows.links.collect()) == [(1, 3), (1, 4), (2, 4), (2, 5)]
    recipes = spark.createDataFrame([(1, ["vegan", "quick"], "main", "easy", "grilled")], "id int, dietary_flags array<string>, course string, difficulty string, cooking_method string")
    classed = TG.classification_tags(recipes, existing)
    assert [(r.key, r.facet) for r in classed.tags.orderBy("id").collect()] == [("vegan", "dietary"), ("quick", "dietary"), ("easy", "difficulty"), ("grilled", "method")]
    given = spark.createDataFrame([(1, "Für Gäste"), (1, "für gäste"), (1, "Main"), (5, "x")], "recipe_id int, tag string")
    user = TG.user_tags(given, table(spark, "recipes", [recipe(1)]), existing, table(spark, "recipe_tags", [{"recipe_id": 1, "tag_id": 3}]))
    assert [(r.id, r.key, r.display, r.facet) for r in user.tags.collect()] == [(4, "für-gäste", "für gäste", "user")]
    assert [tuple(r) for r in user.links.collect()] == [(1, 4)]


def raw(position, url, title="T", lines=("200 g Poulet",), steps=("Kochen.",), **kw):
    row = {"title": title, "description": "", "ingredients_raw": list(lines), "ingredient_groups": [], "steps_raw": list(steps), "yield_amount": "4", "prep_time": "20 min",
           "cook_time": "", "total_time": "", "image_urls": ["i1", "i2"], "image_captions": ["c"], "keywords": ["Party"], "source_url": url, "language": "de",
           "category": "", "cuisine": "", "difficulty": "", "source_id": 1, "position": position, "error": None, **kw}
    return tuple(row[f.name] for f in RECORD_STREAM.fields)


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD_STREAM)


def test_two_ingest_runs(spark, tmp_path):
    folders = [str(tmp_path / f"v{i}") for i in range(3)]
    seed_empty_tables(spark, folders[0])
    catalogue = table(spark, "ingredients", [
        {"id": 1, "key": "chicken", "display_de": "Poulet", "category": "meat", "sub_category": "poultry", "pairing_tags": ["poultry"]},
        {"id": 2, "key": "salt", "display_de": "Salz", "category": "pantry"},
    ])
    first = records(
        spark, raw(1, "a"), raw(2, "b"), raw(3, "c", title="Other", lines=("Salz", "Nichts"), ingredient_groups=[("Teig", ["Salz"]), ("Sauce", ["Nichts"])]),
        raw(4, "d", lines=(), steps=()), raw(5, "e", language="fr"), raw(6, "f", error="Fetch failed"), raw(7, "g", title="Late"),
    )
    rows = run_ingest(spark, first, folders[0], folders[1], catalogue, source_rows(spark), AT, datetime(2024, 1, 31, 13), languages=["de"], limit_per_source=2)
    assert {r.position: r.disposition for r in rows.decided.collect()} == {1: "new", 2: "duplicate", 3: "new", 4: "over_limit", 5: "over_limit", 6: "over_limit", 7: "over_limit"}
    stored = {r.id: r for r in read_table(spark, folders[1], "recipes").collect()}
    assert {i: (r.source_url, r.primary_protein, r.total_minutes, r.dietary_flags, r.status) for i, r in stored.items()} == {
        1: ("a", "poultry", 20, ["dairy-free", "quick"], "active"), 2: ("c", None, 20, ["dairy-free", "quick", "vegan", "vegetarian"], "active"),
    }
    lines = read_table(spark, folders[1], "recipe_ingredients").orderBy("recipe_id", "seq").collect()
    assert [(r.recipe_id, r.seq, r.ingredient_id, r.quantity, r.group_label) for r in lines] == [(1, 1, 1, 200.0, None), (2, 1, 2, None, "Teig"), (2, 2, None, None, "Sauce")]
    assert [(r.seq, r.caption) for r in read_table(spark, folders[1], "recipe_images").filter("recipe_id = 1").orderBy("seq").collect()] == [(1, "c"), (2, None)]
    assert read_table(spark, folders[1], "ingredients").count() == 2 and read_table(spark, folders[1], "sources").count() == 5
    run = read_table(spark, folders[1], "etl_runs").filter("source = 'bettybossi'").first()
    assert (run.id, run.source, run.discovered, run.fetched, run.skipped, run.status, run["limit"]) == (1, "bettybossi", 7, 2, 1, "success", 2)

    second = records(spark, raw(1, "a"), raw(2, "z"), raw(3, "g", title="Late"), raw(4, "f", error="Fetch failed"), raw(5, "d", lines=(), steps=()), raw(6, "e", language="fr"))
    rows = run_ingest(spark, second, folders[1], folders[2], catalogue, source_rows(spark), AT, AT, languages=["de"])
    assert {r.position: r.disposition for r in rows.decided.collect()} == {1: "known", 2: "duplicate", 3: "new", 4: "error", 5: "invalid", 6: "language"}
    assert {r.id: (r.source_url, r.status) for r in read_table(spark, folders[2], "recipes").collect()} == {1: ("a", "active"), 2: ("c", "deleted"), 3: ("g", "active")}
    run = read_table(spark, folders[2], "etl_runs").filter("source = 'bettybossi'").orderBy(F.desc("id")).first()
    assert run.id == 6  # the five sources of the first run come before
    assert (run.fetched, run.skipped, run.errors, run.validation_skipped, run.soft_deleted, run.status, run.error_summary) == (1, 3, 1, 1, 1, "partial", "Fetch failed")
    tags = {r.key: r.id for r in read_table(spark, folders[2], "tags").collect()}
    assert len(set(tags.values())) == len(tags) and {"party", "easy", "quick", "vegan"} <= set(tags)


def test_suspicious_lines(spark):
    cases = [(["200 g Mehl", "3 Eier"], None), (["ShopHauptmenü"], "navigation text"), (["x" * 151], "long lines"), (["a", "b", "c"], "few quantities"), ([], None)]
    df = spark.createDataFrame(cases, "lines array<string>, want string")
    assert all(r.want == r.got for r in df.select("want", I.suspicious_lines(F.col("lines")).alias("got")).collect())


def test_streaming_ingest_over_several_batches(spark, tmp_path):
    incoming, target, progress = (str(tmp_path / n) for n in ("incoming", "stored", "progress"))

    def run():
        start_ingest(record_stream(spark, incoming, 1), target, progress, ["de"]).awaitTermination()
        return sorted(r.source_url for r in spark.read.parquet(target).collect())

    records(spark, raw(1, "a"), raw(2, "b")).coalesce(1).write.mode("append").parquet(incoming)
    assert run() == ["a"]
    records(spark, raw(3, "a"), raw(4, "c", title="New"), raw(5, "d", language="fr")).coalesce(1).write.mode("append").parquet(incoming)
    records(spark, raw(6, "e", title="New")).coalesce(1).write.mode("append").parquet(incoming)
    assert len(run()) == 2
    assert len(run()) == 2


def test_event_statistics(spark):
    events = spark.createDataFrame(
        [("a", datetime(2024, 1, 1, 0, 10), 10.0, True, None), ("a", datetime(2024, 1, 1, 0, 20), 20.04, False, "x"), ("b", datetime(2024, 1, 1, 1, 0), 5.0, True, None)],
        "tool string, started_at timestamp, duration_ms double, success boolean, error string",
    )
    assert tuple(EV.event_stats(events).first()) == (3, 2, 1, 11.7, 20.0)
    assert [tuple(r) for r in EV.tool_stats(events).collect()] == [("a", 2, 1, 15.0), ("b", 1, 0, 5.0)]
    assert [r.tool for r in EV.recent_events(events, 1).collect()] == ["b"]
    assert sorted((r.tool, r.calls) for r in windowed_tool_stats(events).collect()) == [("a", 2), ("b", 1)]


def test_promotions(spark):
    promotions = table(spark, "promotions", [
        {"id": 1, "retailer_id": 1, "product_name": "Poulet Brust", "price_chf": 5.0, "discount_pct": 20.0, "valid_from": date(2024, 1, 1), "valid_to": date(2024, 1, 31)},
        {"id": 2, "retailer_id": 2, "product_name": "Poulet", "price_chf": 4.0, "discount_pct": None, "valid_from": date(2024, 2, 1), "valid_to": date(2024, 2, 9)},
        {"id": 3, "retailer_id": 1, "product_name": "Rahm", "price_chf": 4.0, "discount_pct": 30.0, "valid_from": date(2024, 1, 1), "valid_to": date(2024, 1, 30)},
    ])
    retailers = table(spark, "retailers", [{"id": 1, "key": "coop"}, {"id": 2, "key": "migros"}])
    assert [r.id for r in P.find_promotions(promotions).collect()] == [3, 1, 2]
    assert [r.id for r in P.find_promotions(promotions, retailers, retailer="coop", product="poulet", min_discount_pct=10).collect()] == [1]
    assert [r.id for r in P.unexpired(promotions, date(2024, 1, 31)).collect()] == [1, 2]
    mapping = table(spark, "promotion_ingredient_map", [{"promotion_id": i, "ingredient_id": 7} for i in (1, 2, 3)])
    best = P.best_offers(promotions, mapping, date(2024, 1, 15)).collect()
    assert [(r.ingredient_id, r.promotion_id, r.n_offers) for r in best] == [(7, 3, 2)]
    recipes = table(spark, "recipes", [recipe(1), recipe(2, status="deleted")])
    lines = table(spark, "recipe_ingredients", [{"recipe_id": 1, "seq": 1, "ingredient_id": 7, "quantity": 100.0, "unit": "g"}, {"recipe_id": 2, "seq": 1, "ingredient_id": 7}])
    ranked = P.suggest_for_promotions(recipes, lines, P.best_offers(promotions, mapping, date(2024, 1, 15))).collect()
    assert [(r.recipe_id, r.value) for r in ranked] == [(1, 30.0)]
    plan = spark.createDataFrame([(1, 1.5), (1, 1.0)], "recipe_id int, scale double")
    pantry = table(spark, "pantry", [{"ingredient_id": 7, "approx_quantity": 50.0, "unit": "g"}])
    bought = R.shopping_list(lines, table(spark, "ingredients", [{"id": 7, "key": "chicken"}]), plan, pantry).collect()
    assert [(r.key, r.needed, r.to_buy) for r in bought] == [("chicken", 250.0, 200.0)]


def test_dossier(spark):
    recipes = spark.createDataFrame([(1, "Pasta", " Fein. ", "https://e.ch/x", 2, 30, "e1", 4)], "id int, title string, description string, source_url string, servings int, total_minutes int, source_external_id string, source_id int")
    lines = table(spark, "recipe_ingredients", [
        {"recipe_id": 1, "seq": 1, "raw_text": "200 g Mehl", "group_label": "Teig"}, {"recipe_id": 1, "seq": 2, "raw_text": "Salz", "prep_note": "fein", "optional": True, "group_label": "Teig"},
        {"recipe_id": 1, "seq": 3, "quantity": 2.0, "unit": "dl", "group_label": "Sauce"}, {"recipe_id": 1, "seq": 4, "raw_text": "Öl", "group_label": "Teig"}, {"recipe_id": 9, "seq": 1, "raw_text": "x"},
    ])
    steps = table(spark, "recipe_steps", [{"recipe_id": 1, "step_no": 2, "text": "Essen."}, {"recipe_id": 1, "step_no": 1, "text": "Kochen."}])
    rendered = M.dossier_lines(recipes, lines, steps)
    want = (
        "# Pasta\n\nFein.\n\n## Metadata\n\n- **Source:** https://e.ch/x\n- **Servings:** 2\n- **Total time:** 30 min\n\n"
        "## Source\n\n- **URL:** https://e.ch/x\n- **External ID:** e1\n- **Source ID:** 4\n\n"
        "## Ingredients\n\n**Teig**\n\n- 200 g Mehl\n- Salz, fein *(optional)*\n\n**Sauce**\n\n- 2.0 dl\n\n**Teig**\n\n- Öl\n\n"
        "## Steps\n\n1. Kochen.\n2. Essen.\n\n## Notes\n\n\n## Cook log\n\n"
    )
    assert [r.text for r in M.dossier_documents(rendered).collect()] == [want]
    parts = M.dossier_documents(rendered, 7).orderBy("part").collect()
    assert len(parts) > 3 and "\n".join(p.text for p in parts) == want
    texts = spark.createDataFrame([(1, want)], "id int, text string")
    assert [r.section for r in M.split_sections(texts, "id").orderBy("position").collect()] == ["Metadata", "Source", "Ingredients", "Steps", "Notes", "Cook log"]
    assert M.section(texts, "id", " STEPS ").first().body.strip() == "1. Kochen.\n2. Essen."


def test_every_twin_has_a_query():
    assert set(statements()) <= set(registered())
    assert len(registered()) > 80


@pytest.mark.parametrize("name", ["last_events_per_recipe", "ingest_capped"])
def test_top_k_per_group_is_cut_before_the_shuffle(spark, name):
    df = registered()[name](spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_documents_without_a_word_fail_the_validity_check(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = {1: "Mehl. Salz.", 2: "", 3: " \n\t ", 4: None, 5: "Kurz", 6: "Mehl. Salz.", 10: None, 11: " ", 12: "."}
    rows = [(k, v, "es" if k == 11 else "de") for k, v in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = {}
    for name in ("ingest_dispositions", "ingest_capped", "ingest_audit"):
        got = registered()[name](spark, str(tmp_path))
        want = db.sql(f"select {', '.join(got.columns)} from ({statements()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
        found[name] = got.collect()
    kinds = {r.position: r.disposition for r in found["ingest_dispositions"]}
    assert kinds == {1: "new", 2: "invalid", 3: "invalid", 4: "invalid", 5: "new", 6: "duplicate", 10: "invalid", 11: "language", 12: "new"}
    assert {r.source_id: r.validation_skipped for r in found["ingest_audit"]} == {1: 4, 3: 0}


def test_dossier_lines_are_dealt_before_they_are_gathered(spark, monkeypatch):
    recipes = spark.range(400).selectExpr("id", "concat('Plat ', id) as title")
    steps = recipes.selectExpr("id as recipe_id", "1 as step_no", "title as text")
    items = recipes.selectExpr("id as recipe_id", "1 as seq", "title as raw_text", "1.0D as quantity", "'g' as unit", "'' as prep_note", "false as optional", "'Teig' as group_label")
    monkeypatch.setattr(M, "LINES_PER_TASK", 500)
    texts = M.dossier_documents(M.dossier_lines(recipes, items, steps))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    first = plan.splitlines().index(next(x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x))
    assert not any("collect_list" in x for x in plan.splitlines()[first:])
    assert texts.rdd.getNumPartitions() > 4 and texts.count() == 400
